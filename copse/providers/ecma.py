"""JavaScript with JSX and TypeScript: a subset grammar."""

from __future__ import annotations

import re

from copse.providers.scan import Bad, Parser
from copse.providers.tree import Binding, Node, as_role, summary

ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
#: After these a slash begins a regular expression (fixed values of the language).
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "accessor", "declare")
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: JSX: what begins an element, names of elements and attributes, white space and comments between these.
JSX_START = re.compile(r"<(?:[^\W\d]|[$>])")
JSX_NAME = re.compile(r"[^\W\d][\w$.:-]*|\$[\w$.:-]*")
JSX_CLOSE = re.compile(r"</\s*([\w$.:-]*)\s*>")
JSX_TEXT = re.compile(r"[^<{]+")
#: After so many elements without an end a text has no JSX: each costs a pass over the rest of the text.
UNCLOSED = 100
TEMPLATE_END = re.compile(r"`|\$\{|\\.", re.S)
JSX_SPACE = re.compile(r"(?:\s+|/\*.*?\*/|//[^\n]*\n)*", re.S)


class Ecma(Parser):
    lexer = re.compile(
        r"""(?P<comment>//[^\n]*|/\*.*?\*/|\A\#![^\n]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`)|(?P<num>\.?[0-9](?:[eE][+-][0-9]|[\w.])*)|(?P<id>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)"""
        r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^<>=!?()\[\]{},;.:~@#])", re.S)
    assign = ASSIGN
    binary = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ <<".split())
    typed = False

    def __init__(self, text: str) -> None:
        self.elements: dict[int, Node] = {}  # JSX and templates by start: each is one token
        self.unclosed = 0
        super().__init__(text)

    def token_end(self, found: re.Match) -> int:
        """Templates end at their own back tick, those in ``${}`` are inside; JSX elements end with their closing tag."""
        if not self.typed and found[0] == "<" and self.unclosed < UNCLOSED and self.before_operand() and JSX_START.match(self.text, found.start()):
            tokens, n, i, last = self.tokens, len(self.comments), self.i, self.last
            try:
                self.elements[found.start()] = node = self.element_of_jsx(found.start())
                return node.end
            except (Bad, RecursionError):  # a comparison after all
                self.tokens, self.i, self.last = tokens, i, last
                del self.comments[n:]
                self.unclosed += 1
        if found.lastgroup == "op" and found[0] in ("/", "/="):
            last = self.tokens[-1] if self.tokens else None
            if last is None or last.text in BEFORE_REGEX or (last.kind == "op" and last.text not in (")", "]", "}")):
                if regex := REGEX.match(self.text, found.start()):
                    return regex.end()
        if found.lastgroup != "template":
            return found.end()
        tokens, n, i, last = self.tokens, len(self.comments), self.i, self.last
        try:
            self.elements[found.start()] = node = self.template(found.start())
            return node.end
        except (Bad, RecursionError):  # the rest of the text: no statement can end there
            self.tokens, self.i, self.last = tokens, i, last
            del self.comments[n:]
            return len(self.text)

    def template(self, start: int) -> Node:
        i, parts = start + 1, []
        while (found := TEMPLATE_END.search(self.text, i)) and found[0] != "`":
            if found[0] == "${":
                parts.append(self.braces(found.start() + 1))
                parts[-1].type, parts[-1].start = "template_substitution", found.start()
            i = parts[-1].end if found[0] == "${" else found.end()
        if not found:
            raise Bad
        return Node("template_string", start, found.end(), parts)

    def before_operand(self) -> bool:
        last = self.tokens[-1] if self.tokens else None
        if last is None or last.text in BEFORE_REGEX or last.text == "default":
            return True
        return last.kind == "op" and last.text not in (")", "]", "}", "++", "--") and not (len(last.text) > 1 and (last.text[0] == "/" != last.text[-1] or last.start in self.elements))

    # JSX: read by character, as its text follows no rule of tokens; what is in braces is
    def element_of_jsx(self, start: int) -> Node:
        text, space = self.text, lambda i: JSX_SPACE.match(text, i).end()
        tag, i = JSX_NAME.match(text, space(start + 1)), space(start + 1)
        kids = [self.tag_name(tag.start(), tag.end())] if tag else []
        i = space(tag.end() if tag else i)
        while text[i : i + 1] != ">":
            if tag and text.startswith("/>", i):
                return Node("jsx_self_closing_element", start, i + 2, kids)
            if not tag or not (text[i : i + 1] == "{" or JSX_NAME.match(text, i)):
                raise Bad
            kids.append(self.braces(i) if text[i] == "{" else self.attribute(i, space))
            i = space(kids[-1].end)
        i += 1
        children = [Node("jsx_opening_element", start, i, kids, "open_tag")]
        while not text.startswith("</", i):
            if i >= len(text):
                raise Bad
            if text[i] == "<":
                children.append(self.element_of_jsx(i))
            else:
                children.append(self.braces(i) if text[i] == "{" else Node("jsx_text", i, JSX_TEXT.match(text, i).end()))
            i = children[-1].end
        close = JSX_CLOSE.match(text, i)
        if not close or close[1] != (tag[0] if tag else ""):
            raise Bad
        name = [self.tag_name(*close.span(1))] if tag else []
        return Node("jsx_element", start, close.end(), [*children, Node("jsx_closing_element", i, close.end(), name, "close_tag")])

    def element_at(self, role: str) -> Node:
        t = self.take()
        node = self.elements.get(t.start)
        if node is None or node.end != t.end:  # a template without an end, or one that was given up
            raise Bad
        return as_role(node, role)

    def tag_name(self, start: int, end: int) -> Node:
        name = self.text[start:end]
        return Node("jsx_namespace_name" if ":" in name else "member_expression" if "." in name else "identifier", start, end, (), "name")

    def attribute(self, i: int, space) -> Node:
        name = JSX_NAME.match(self.text, i)
        key, j = Node("property_identifier", i, name.end()), space(name.end())
        if self.text[j : j + 1] != "=":
            return Node("jsx_attribute", i, name.end(), [key])
        j = space(j + 1)
        c = self.text[j : j + 1]
        if c in ("'", '"') and c:
            if (end := self.text.find(c, j + 1)) < 0:
                raise Bad
            value = Node("string", j, end + 1)
        elif c == "{":
            value = self.braces(j)
        elif c == "<":
            value = self.element_of_jsx(j)
        else:
            raise Bad
        return Node("jsx_attribute", i, value.end, [key, value])

    def braces(self, start: int) -> Node:
        """An expression, or only comments, in braces: read by a run of the lexer and the parser of its own."""
        outer, i, last = self.tokens, self.i, self.last
        self.tokens, self.i = [], 0
        try:
            end = self.lex(start + 1, "}")
            if end >= len(self.text):
                raise Bad
            inner = self.trying(self.expression) if self.tokens else None
            if self.tokens and (inner is None or self.at().kind != "end"):
                inner = Node("ERROR", self.tokens[0].start, self.tokens[-1].end)
            return Node("jsx_expression", start, end + 1, [inner])
        finally:
            self.tokens, self.i, self.last = outer, i, last

    binary_words = ("in", "instanceof")

    def joins(self, t) -> bool:
        """Shifts to the right are two or three tokens: ``>`` may close a list of types."""
        if t.kind == "op" and t.text == ">":
            while self.at(1).text == ">" and self.at(1).start == self.at().end:
                self.take()
        return t.text in self.binary and t.kind == "op" or t.kind == "id" and t.text in self.binary_words

    def end(self, node: Node) -> Node:
        """A semicolon, a closing brace or a line's end."""
        if self.maybe(";"):
            node.end = self.last
        elif not (self.sees("}", ")") or self.at().fresh or self.at().kind == "end"):
            raise Bad
        return node

    # statements
    def statement(self) -> Node:
        t = self.at()
        if t.text.startswith("@") and t.kind == "id":
            marks = self.marks()
            inner = self.statement()
            inner.kids += marks
            inner.start = marks[0].start
            return inner
        own = getattr(self, "on_" + t.text, None) if t.kind == "id" else None
        if own and (node := own(t.start)):
            return node
        if t.text == "{" and t.kind == "op":
            return self.block("statement_block")
        if t.kind == "id" and self.at(1).text == ":" and self.at(1).kind == "op":
            self.word("statement_identifier")
            self.take()
            return self.make("labeled_statement", t.start, self.statement())
        inner = self.expression()
        return self.end(self.make("expression_statement", t.start, inner))

    def marks(self) -> list[Node]:
        out = []
        while self.at().kind == "id" and self.at().text.startswith("@"):
            t = self.take()
            name = Node("identifier", t.start + 1, t.end)
            out.append(self.make("decorator", t.start, self.postfix(name)))
        return out

    def function(self, start: int, type_: str, name: Node | None) -> Node:
        if self.typed and self.sees("<"):
            self.generics()
        params = self.params()
        self.annotation()
        if self.sees("{"):
            return self.make(type_, start, name, params, self.block("statement_block"))
        if self.typed:
            return self.end(self.make("function_signature", start, name, params))
        raise Bad

    def params(self) -> Node:
        start = self.need("(").start

        def one() -> Node:
            marks = self.marks()
            s = self.at().start
            while self.typed and self.at().text in MODIFIERS and self.at(1).kind == "id":
                self.take()
            rest = self.maybe("...")
            target = self.pattern()
            optional = self.typed and self.maybe("?")
            self.annotation()
            value = self.single() if self.maybe("=") else None
            if not (marks or value or optional or rest) and not self.typed:
                return target
            kind = ("optional_parameter" if optional else "required_parameter") if self.typed else "rest_pattern" if rest else "assignment_pattern"
            return self.make(kind, s, *marks, target, value)

        return as_role(self.make("formal_parameters", start, *self.listed(one, ")")), "parameters")

    def pattern(self) -> Node:
        t = self.at()
        if self.maybe("["):
            kids = self.listed(self.element, "]")
            return self.make("array_pattern", t.start, *kids)
        if self.maybe("{"):
            return self.make("object_pattern", t.start, *self.listed(self.property_pattern, "}"))
        return self.word()

    def element(self) -> Node:
        s, rest = self.at().start, self.maybe("...")
        target = self.pattern()
        if self.maybe("="):
            return self.make("assignment_pattern", s, target, self.single())
        return self.make("rest_pattern", s, target) if rest else target

    def property_pattern(self) -> Node:
        s = self.at().start
        if self.maybe("..."):
            return self.make("rest_pattern", s, self.pattern())
        if self.at(1).text == ":" or self.sees("["):
            key = as_role(self.key(), "key")
            self.need(":")
            return self.make("pair_pattern", s, key, as_role(self.element(), "value"))
        name = self.word("shorthand_property_identifier_pattern")
        return self.make("object_assignment_pattern", s, name, self.single()) if self.maybe("=") else name

    def on_function(self, start: int) -> Node | None:
        if self.at(1).text == "(":
            return None
        self.take()
        star = self.maybe("*")
        return self.function(start, "generator_function_declaration" if star else "function_declaration", self.word(role="name"))

    def on_async(self, start: int) -> Node | None:
        if self.at(1).text != "function" or self.at(1).fresh:
            return None
        self.take()
        return self.on_function(start) or self.fail()

    def fail(self):
        raise Bad

    def on_class(self, start: int) -> Node:
        return self.class_like(start, "class_declaration")

    def on_abstract(self, start: int) -> Node | None:
        if not self.typed or self.at(1).text != "class":
            return None
        self.take()
        return self.class_like(start, "class_declaration")

    def class_like(self, start: int, type_: str) -> Node:
        self.need("class")
        name = self.word(role="name") if self.at().kind == "id" and not self.sees("extends", "implements") else None
        if self.typed and self.sees("<"):
            self.generics()
        heritage = []
        while self.sees("extends", "implements"):
            if self.take().text == "extends":
                heritage.append(self.postfix(self.primary()))
                if self.typed and self.sees("<"):
                    self.generics()
            else:
                self.type()
                while self.maybe(","):
                    self.type()
        return self.make(type_, start, name, *heritage, self.block("class_body", self.class_member))

    def key(self) -> Node:
        t = self.at()
        if self.maybe("["):
            inner = self.single()
            self.need("]")
            return self.make("computed_property_name", t.start, inner)
        if t.kind in ("str", "num"):
            return self.leaf("string" if t.kind == "str" else "number")
        return self.word("private_property_identifier" if t.text.startswith("#") else "property_identifier")

    def modifiers(self) -> list[Node]:
        out = []
        while self.at().text in MODIFIERS and self.at().kind == "id" and self.at(1).text not in ("(", "=", ";", ":", "?", "!", ",", "}", "<") and self.at(1).kind != "end":
            out.append(self.leaf(self.at().text, "modifier"))
        return out

    def class_member(self) -> Node:
        marks, start = self.marks(), self.at().start
        if self.sees("static") and self.at(1).text == "{":
            self.take()
            return self.make("class_static_block", start, self.block("statement_block"))
        mods = self.modifiers()
        self.maybe("*")
        if self.typed and self.sees("[") and self.at(2).text == ":":
            self.skip_group()
            self.annotation()
            return self.end(self.make("index_signature", start, *mods))
        name = as_role(self.key(), "name")
        self.maybe("?", "!")
        if self.sees("(", "<"):
            if self.sees("<"):
                self.generics()
            params = self.params()
            self.annotation()
            if self.sees("{"):
                return self.make("method_definition", marks[0].start if marks else start, *marks, *mods, name, params, self.block("statement_block"))
            return self.end(self.make("method_signature", start, *marks, *mods, name, params))
        self.annotation()
        value = as_role(self.single(), "value") if self.maybe("=") else None
        return self.end(self.make("public_field_definition" if self.typed else "field_definition", marks[0].start if marks else start, *marks, *mods, name, value))

    def declaration(self, start: int, type_: str, header: bool = False) -> Node:
        self.take()

        def one() -> Node:
            s, name = self.at().start, as_role(self.pattern(), "name")
            self.maybe("!") if self.typed else None
            self.annotation()
            value = as_role(self.single(), "value") if self.maybe("=") else None
            return self.make("variable_declarator", s, name, value)

        kids = [one()]
        while self.maybe(","):
            kids.append(one())
        node = self.make(type_, start, *kids)
        return node if header else self.end(node)

    def on_const(self, start: int, header: bool = False) -> Node:
        if self.typed and self.at(1).text == "enum":
            self.take()
            return self.on_enum(start)
        return self.declaration(start, "lexical_declaration", header)

    def on_let(self, start: int, header: bool = False) -> Node:
        return self.declaration(start, "lexical_declaration", header)

    def on_var(self, start: int, header: bool = False) -> Node:
        return self.declaration(start, "variable_declaration", header)

    def on_return(self, start: int) -> Node:
        self.take()
        return self.end(self.make("return_statement", start, None if self.sees(";", "}") or self.at().fresh or self.at().kind == "end" else self.expression()))

    def on_throw(self, start: int) -> Node:
        self.take()
        return self.end(self.make("throw_statement", start, self.expression()))

    def condition(self) -> Node:
        start = self.need("(").start
        inner = self.expression()
        self.need(")")
        return self.make("parenthesized_expression", start, inner)

    def on_if(self, start: int) -> Node:
        self.take()
        kids = [self.condition(), self.statement()]
        if self.maybe("else"):
            kids.append(as_role(self.statement(), "alternative"))
        return self.make("if_statement", start, *kids)

    def on_while(self, start: int) -> Node:
        self.take()
        return self.make("while_statement", start, self.condition(), self.statement())

    def on_do(self, start: int) -> Node:
        self.take()
        body = self.statement()
        self.need("while")
        node = self.make("do_statement", start, body, self.condition())
        self.maybe(";")
        return node

    def on_for(self, start: int) -> Node:
        self.take()
        self.maybe("await")
        self.need("(")
        first = None
        if self.sees("const", "let", "var"):
            own = self.trying(lambda: self.each(self.take().text))
            if own:
                return self.make("for_in_statement", start, *own, self.statement())
            first = getattr(self, "on_" + self.at().text)(self.at().start, True)
        elif not self.sees(";"):
            own = self.trying(lambda: self.each(""))
            if own:
                return self.make("for_in_statement", start, *own, self.statement())
            first = self.expression()
        kids = [first]
        self.need(";")
        kids.append(None if self.sees(";") else self.expression())
        self.need(";")
        kids.append(None if self.sees(")") else self.expression())
        self.need(")")
        return self.make("for_statement", start, *kids, self.statement())

    def each(self, word: str) -> list[Node]:
        left = as_role(self.pattern() if word else self.postfix(self.primary()), "left")
        self.need("of", "in")
        right = as_role(self.expression(), "right")
        self.need(")")
        return [left, right]

    def on_switch(self, start: int) -> Node:
        self.take()
        value = self.condition()
        s = self.need("{").start
        cases = []
        while not self.maybe("}"):
            c, kids = self.at().start, []
            if self.need("case", "default").text == "case":
                kids.append(self.expression())
            self.need(":")
            while not self.sees("case", "default", "}"):
                if not self.maybe(";"):
                    kids.append(self.statement())
            cases.append(self.make("switch_case", c, *kids))
        return self.make("switch_statement", start, value, self.make("switch_body", s, *cases))

    def on_try(self, start: int) -> Node:
        self.take()
        kids = [self.block("statement_block")]
        while self.sees("catch", "finally"):
            s = self.at().start
            if self.take().text == "catch" and self.sees("("):
                self.skip_group()
            kids.append(self.make("handler", s, self.block("statement_block")))
        return self.make("try_statement", start, *kids)

    def jump(self, start: int) -> Node:
        word = self.take().text
        label = self.word("statement_identifier") if self.at().kind == "id" and not self.at().fresh else None
        return self.end(self.make(f"{word}_statement", start, label))

    on_break = on_continue = jump

    def specifiers(self, type_: str) -> list[Node]:
        def one() -> Node:
            s = self.at().start
            if self.typed and self.sees("type") and self.at(1).kind == "id" and self.at(1).text != "as":
                self.take()
            name = self.leaf("identifier", "name")
            return self.make(type_, s, name, self.leaf("identifier", "alias") if self.maybe("as") else None)

        self.need("{")
        return self.listed(one, "}")

    def source(self) -> Node | None:
        if not self.maybe("from"):
            return None
        if self.at().kind != "str":
            raise Bad
        return self.leaf("string", "source")

    def on_import(self, start: int) -> Node | None:
        if self.at(1).text in ("(", "."):
            return None
        self.take()
        if self.at().kind == "str":
            return self.end(self.make("import_statement", start, self.leaf("string", "source")))
        if self.typed and self.sees("type") and self.at(1).text not in ("from", ","):
            self.take()
        kids = [self.word()] if self.at().kind == "id" and not self.sees("*") else []
        if kids and self.typed and self.maybe("="):
            return self.end(self.make("import_statement", start, *kids, self.single()))
        self.maybe(",")
        if self.sees("*"):
            s = self.take().start
            self.need("as")
            kids.append(self.make("namespace_import", s, self.word(role="name")))
        elif self.sees("{"):
            kids += self.specifiers("import_specifier")
        return self.end(self.make("import_statement", start, *kids, self.source() or self.fail()))

    def on_export(self, start: int) -> Node:
        self.take()
        if self.maybe("default"):
            own = self.sees("function", "class", "async", "abstract", "interface")
            inner = self.trying(self.statement) if own else None
            return self.make("export_statement", start, as_role(inner, "declaration")) if inner else self.end(self.make("export_statement", start, as_role(self.single(), "value")))
        if self.typed and self.sees("type") and self.at(1).text in ("{", "*"):
            self.take()
        if self.maybe("*"):
            name = self.leaf("identifier") if self.maybe("as") else None
            return self.end(self.make("export_statement", start, name, self.source()))
        if self.sees("{"):
            kids = self.specifiers("export_specifier")
            return self.end(self.make("export_statement", start, *kids, self.source()))
        return self.make("export_statement", start, as_role(self.statement(), "declaration"))

    # expressions
    def arrow(self, start: int) -> Node | None:
        """``x =>``, ``(a, b) =>`` and, typed, ``(a: T): U =>``."""
        k = 1 if self.sees("async") and not self.at(1).fresh and (self.at(1).kind == "id" or self.at(1).text in ("(", "<")) else 0
        if self.at(k).kind == "id" and self.at(k + 1).text == "=>":
            self.i += k
            params = as_role(self.word(), "parameter")
        elif self.at(k).text == "(" and (end := self.closing(k)) > 0 and (self.at(end + 1).text == "=>" or (self.typed and self.at(end + 1).text == ":")) or (self.typed and self.at(k).text == "<"):
            def head() -> Node:
                self.i += k
                if self.sees("<"):
                    self.generics()
                found = self.params()
                self.annotation()
                if not self.sees("=>"):
                    raise Bad
                return found

            params = self.trying(head)
            if params is None:
                return None
        else:
            return None
        self.need("=>")
        body = self.block("statement_block") if self.sees("{") else as_role(self.single(), "body")
        return self.make("arrow_function", start, params, body)

    def primary(self) -> Node:
        t = self.at()
        if t.kind in ("num", "str"):
            return self.leaf("number" if t.kind == "num" else "string")
        if t.kind == "template" or t.kind == "op" and t.start in self.elements:
            return self.element_at("")
        if t.kind == "op" and t.text.startswith("/"):
            return self.leaf("regex")
        if found := self.arrow(t.start):
            return found
        if self.maybe("("):
            inner = self.expression()
            self.need(")")
            return self.make("parenthesized_expression", t.start, inner)
        if self.maybe("["):
            return self.make("array", t.start, *self.listed(self.single, "]"))
        if self.maybe("{"):
            return self.make("object", t.start, *self.listed(self.pair, "}"))
        if t.kind != "id":
            raise Bad
        if t.text == "async" and self.at(1).text == "function":
            self.take()
        if self.maybe("function"):
            self.maybe("*")
            return self.function(t.start, "function_expression", self.word(role="name") if self.at().kind == "id" else None)
        if t.text == "class":
            return self.class_like(t.start, "class_expression")
        if t.text == "new" and self.at(1).text != ".":
            self.take()
            target = self.postfix(self.primary(), False)
            if self.typed and self.sees("<"):
                self.trying(self.generics)
            return self.make("new_expression", t.start, as_role(target, "constructor"), self.args() if self.sees("(") else None)
        if t.text in ("typeof", "void", "delete", "await", "yield"):
            self.take()
            self.maybe("*")
            if self.sees(")", "]", "}", ",", ";") or self.at().kind == "end":
                return self.make("yield_expression", t.start)
            inner = self.single() if t.text == "yield" else self.unary()
            return self.make({"await": "await_expression", "yield": "yield_expression"}.get(t.text, "unary_expression"), t.start, inner)
        return self.leaf("identifier")

    def pair(self) -> Node:
        start = self.at().start
        if self.maybe("..."):
            return self.make("spread_element", start, self.single())
        mods = self.modifiers()
        self.maybe("*")
        name = self.key()
        if self.sees("(", "<"):
            method = self.function(start, "method_definition", as_role(name, "name"))
            method.kids += mods
            return method
        if self.maybe(":"):
            return self.make("pair", start, as_role(name, "key"), as_role(self.single(), "value"))
        name.type = "shorthand_property_identifier"
        return self.make("assignment_pattern", start, name, self.single()) if self.maybe("=") else name

    def postfix(self, left: Node, calls: bool = True) -> Node:
        while True:
            t = self.at()
            if t.text == "(" and calls and t.kind == "op":
                left = self.make("call_expression", left.start, as_role(left, "function"), self.args())
            elif self.maybe(".", "?."):
                if t.text == "?." and self.sees("("):
                    continue
                if t.text == "?." and self.sees("["):
                    continue
                left = self.make("member_expression", left.start, as_role(left, "object"), self.word("property_identifier", "property"))
            elif t.text == "[" and t.kind == "op":
                self.take()
                inner = self.expression()
                self.need("]")
                left = self.make("subscript_expression", left.start, left, inner)
            elif t.kind == "template":
                left = self.make("call_expression", left.start, as_role(left, "function"), self.element_at("arguments"))
            elif t.text in ("++", "--") and t.kind == "op" and not t.fresh:
                self.take()
                left = self.make("update_expression", left.start, left)
            elif self.typed and t.text == "!" and not t.fresh and t.kind == "op":
                self.take()
                left = self.make("non_null_expression", left.start, left)
            elif self.typed and t.text == "<" and self.trying(self.type_arguments):
                continue
            elif self.typed and t.kind == "id" and t.text in ("as", "satisfies") and not t.fresh and calls:
                self.take()
                self.type()
                left = self.make("as_expression", left.start, left)
            else:
                return left

    # types
    def type_arguments(self) -> bool:
        self.generics()
        if not self.sees("("):
            raise Bad
        return True

    def annotation(self) -> None:
        if self.typed and self.maybe(":"):
            self.maybe("asserts") if self.at(1).kind == "id" else None
            self.type()

    def generics(self) -> None:
        """Over ``<...>``; inside, ``>>`` is two tokens, since only single ones are made."""
        self.need("<")
        while not self.maybe(">"):
            if self.sees("const", "in", "out") and self.at(1).kind == "id":
                self.take()
            self.type()
            if self.maybe("extends"):
                self.type()
            if self.maybe("="):
                self.type()
            if not self.maybe(",") and not self.sees(">"):
                raise Bad

    def type(self) -> None:
        self.maybe("|", "&")
        self.one_type()
        while self.maybe("|", "&"):
            self.one_type()
        if self.sees("is") and not self.at().fresh:
            self.take()
            self.type()
        if self.sees("extends") and not self.at().fresh and (found := self.trying(self.conditional)):
            return found

    def conditional(self) -> None:
        self.take()
        self.type()
        self.need("?")
        self.type()
        self.need(":")
        self.type()

    def one_type(self) -> None:
        while self.at().kind == "id" and self.at().text in ("keyof", "readonly", "typeof", "unique", "infer", "new", "abstract", "asserts") and (self.at(1).kind in ("id", "str") or self.at(1).text in ("(", "[", "{", "<")):
            self.take()
        t = self.at()
        if t.text == "<" and t.kind == "op":
            self.generics()
            t = self.at()
        if t.kind == "op" and t.text in ("(", "[", "{"):
            self.skip_group()
            if self.maybe("=>"):
                self.type()
        elif t.kind in ("str", "num", "template"):
            self.take()
        elif self.maybe("-"):
            self.take()
        elif t.kind == "id":
            self.take()
            while self.maybe("."):
                self.word()
            if self.sees("<") and not self.at().fresh:
                self.generics()
        else:
            raise Bad
        while self.sees("[") and not self.at().fresh:
            self.skip_group()


class JavaScript(Ecma):
    pass


class TypeScript(Ecma):
    typed = True

    def on_interface(self, start: int) -> Node | None:
        if self.at(1).kind != "id":
            return None
        self.take()
        name = self.word("type_identifier", "name")
        if self.sees("<"):
            self.generics()
        if self.maybe("extends"):
            self.type()
            while self.maybe(","):
                self.type()
        return self.make("interface_declaration", start, name, self.block("interface_body", self.signature))

    def signature(self) -> Node:
        start = self.at().start
        while self.maybe(",", ";"):
            start = self.at().start
        if self.sees("}"):
            return None
        mods = self.modifiers()
        type_, name = "property_signature", None
        if self.sees("(", "<"):
            type_ = "call_signature"
        elif self.sees("new") and self.at(1).text in ("(", "<"):
            self.take()
            type_ = "construct_signature"
        elif self.sees("[") and self.at(2).text in (":", "in"):
            self.skip_group()
            type_ = "index_signature"
        else:
            name = as_role(self.key(), "name")
        self.maybe("?")
        params = None
        if type_ != "index_signature" and self.sees("(", "<"):
            type_ = "method_signature" if name else type_
            if self.sees("<"):
                self.generics()
            params = self.params()
        self.annotation()
        node = self.make(type_, start, *mods, name, params)
        if not (self.maybe(",", ";") or self.sees("}") or self.at().fresh):
            raise Bad
        return node

    def on_type(self, start: int) -> Node | None:
        if self.at(1).kind != "id" or self.at(2).text not in ("=", "<"):
            return None
        self.take()
        name = self.word("type_identifier", "name")
        if self.sees("<"):
            self.generics()
        self.need("=")
        self.type()
        return self.end(self.make("type_alias_declaration", start, name))

    def on_enum(self, start: int) -> Node | None:
        if self.at(1).kind != "id":
            return None
        self.take()
        name = self.word(role="name")
        s = self.need("{").start

        def one() -> Node:
            at, key = self.at().start, as_role(self.key(), "name")
            return self.make("enum_member", at, key, as_role(self.single(), "value") if self.maybe("=") else None)

        kids = self.listed(one, "}")
        return self.make("enum_declaration", start, name, as_role(self.make("enum_body", s, *kids), "body"))

    def scope(self, start: int) -> Node | None:
        if not (self.at(1).kind in ("id", "str")) or self.at(1).fresh:
            return None
        word = self.take().text
        name = self.leaf("string" if self.at().kind == "str" else "identifier", "name")
        while self.maybe("."):
            name.end = self.take().end
        return self.make(f"{word}_declaration", start, name, self.block("statement_block"))

    on_namespace = on_module = scope

    def on_declare(self, start: int) -> Node | None:
        if self.at(1).kind != "id" or self.at(1).fresh:
            return None
        self.take()
        return self.make("ambient_declaration", start, self.statement())


def named(n: Node) -> Node | None:
    return n.part("name") or n.part("key")


def name_of(n: Node, text: str) -> str:
    at = lambda k: text[k.start : k.end] if k else ""
    if n.type == "comment":
        return summary(at(n))
    if n.type == "return_statement":
        return "return"
    if n.type in ("import_statement", "export_statement") and n.part("source"):
        return at(n.part("source")).strip("\"'")
    if n.type in ("arrow_function", "function_expression"):
        return inferred(n, text)
    role = {"call_expression": "function", "new_expression": "constructor", "assignment_expression": "left", "augmented_assignment_expression": "left", "pair": "key"}.get(n.type)
    if role and n.part(role):
        return at(n.part(role))
    if n.type in ("variable_declaration", "lexical_declaration"):
        return at(n.kids[0].part("name")) if n.kids else ""
    return at(named(n)) or at(next(iter(n.of("identifier")), None))


def inferred(n: Node, text: str) -> str:
    """Of a function without a name of its own: what it is assigned to."""
    up = n.up
    if up is not None and up.type == "variable_declarator" and up.part("name").type == "identifier":
        return text[up.part("name").start : up.part("name").end]
    left = up.part("left") if up is not None and up.type == "assignment_expression" else None
    if left is not None and left.type == "member_expression":
        left = left.part("property")
    return text[left.start : left.end] if left is not None and left.type in ("identifier", "property_identifier") else "anonymous"


def targets(pattern: Node) -> list[Node]:
    if pattern.type == "identifier":
        return [pattern]
    if pattern.type == "array_pattern":
        return pattern.of("identifier")
    out = []
    for k in pattern.kids:
        if k.type == "shorthand_property_identifier_pattern":
            out.append(k)
        elif k.type == "pair_pattern" and (v := k.part("value")) and v.type == "identifier":
            out.append(v)
    return out


def bindings(n: Node, text: str) -> list[Binding]:
    at = lambda k: text[k.start : k.end]
    if n.type in ("variable_declaration", "lexical_declaration"):
        return [Binding(k, at(k)) for d in n.of("variable_declarator") for k in targets(d.part("name"))]
    if n.type == "variable_declarator":
        return [Binding(k, at(k)) for k in targets(n.part("name"))]
    if n.type in ("import_statement", "export_statement"):
        found = n.of("import_specifier", "namespace_import", "export_specifier")
        if found:
            return [Binding(k, at(k.part("alias") or k.part("name"))) for k in found]
    return [Binding(n, name_of(n, text))]


def declared_type(n: Node, text: str) -> str:
    return ""


def exported(name: str) -> bool:
    return "A" <= name[:1] <= "Z"


def member(n: Node, text: str) -> str:
    """What a class's member is, for the kinds constructor, getter, setter and accessor."""
    if n.type not in ("method_definition", "method_signature"):
        return ""
    if n.type == "method_definition" and name_of(n, text) == "constructor":
        return "constructor"
    return {"get": "getter", "set": "setter", "accessor": "accessor"}.get(next((k.type for k in n.kids if k.role == "modifier" and k.type in ("get", "set", "accessor")), ""), "")


def parse_javascript(text: str) -> Node:
    return JavaScript(text).parse()


def parse_typescript(text: str) -> Node:
    return TypeScript(text).parse()
