"""PHP: a subset grammar. Text outside of the tags is skipped."""

from __future__ import annotations

import re

from copse.providers.scan import Bad, Parser, Token
from copse.providers.tree import Binding, Node, as_role, summary

MODIFIERS = ("public", "private", "protected", "static", "abstract", "final", "readonly", "var")
CASTS = ("int", "integer", "bool", "boolean", "float", "double", "string", "array", "object", "binary", "unset")


class Php(Parser):
    lexer = re.compile(
        r"""(?P<comment>//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|<<<[ \t]*(?P<q>["']?)(?P<tag>\w+)(?P=q)\n.*?\n?[ \t]*(?P=tag)\b)"""
        r"|(?P<num>\.?[0-9](?:[eE][+-][0-9]|[\w.])*)|(?P<var>\$[^\W\d]\w*)|(?P<id>\\?[^\W\d]\w*(?:\\\w+)*)"
        r"|(?P<op>\?>|\*\*=|\.\.\.|<=>|===|!==|<<=|>>=|\?\?=|\?->|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\*\*|<<|>>|\#\[|[-+*/%&|^<>=!?()\[\]{},;.:~@$])", re.S)
    assign = ("=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "??=", "&=", "|=", "^=", "<<=", ">>=")
    binary = frozenset("+ - * / % ** == != === !== <> < > <= >= <=> && || ?? & | ^ << >> .".split())
    prefix = frozenset("+ - ! ~ ++ -- & @ ...".split())

    def lex(self) -> None:
        """Tags end statements; what lies between them is not read."""
        whole, at = self.text, 0
        while (found := re.compile(r"<\?(?:php\b|=|(?!xml))").search(whole, at)) is not None:
            at = found.end()
            while at < len(whole):
                m = self.lexer.match(whole, at)
                if not m:
                    if not whole[at].isspace():
                        self.tokens.append(Token("bad", whole[at], at, at + 1, False))
                    at += 1
                    continue
                kind = next(k for k in ("comment", "str", "num", "var", "id", "op") if m[k] is not None)
                if m[0] == "?>":
                    self.tokens.append(Token("op", ";", at, at, False))
                    at = m.end()
                    break
                if kind == "comment":
                    self.comments.append(Node("comment", at, m.end()))
                else:
                    self.tokens.append(Token(kind, m[0], at, m.end(), "\n" in whole[self.tokens[-1].end if self.tokens else 0 : at]))
                at = m.end()

    def sees(self, *texts: str) -> bool:
        t = self.at()
        return (t.text in texts and t.kind in ("op", "id")) or (t.kind == "id" and t.text.lower() in texts)

    def lower(self, k: int = 0) -> str:
        return self.at(k).text.lower() if self.at(k).kind == "id" else self.at(k).text

    def end(self, node: Node) -> Node:
        if self.maybe(";"):
            node.end = max(node.end, self.last)
        elif not (self.sees("}") or self.at().kind == "end"):
            raise Bad
        return node

    def name(self, role: str = "name") -> Node:
        return self.word("name", role)

    def statement(self) -> Node:
        self.attributes()
        t = self.at()
        own = getattr(self, "on_" + self.lower(), None) if t.kind == "id" and self.at(1).text not in ("::",) else None
        if own and (node := own(t.start)):
            return node
        if t.text == "{" and t.kind == "op":
            return self.block("compound_statement")
        return self.end(self.make("expression_statement", t.start, self.expression()))

    def attributes(self) -> None:
        while self.maybe("#["):
            depth = 1
            while depth:
                x = self.take().text
                depth += (x in ("[", "#[")) - (x == "]")

    def body(self, *ends: str) -> list[Node]:
        """A statement, or statements from a colon to the word that ends them."""
        if not self.maybe(":"):
            return [as_role(self.statement(), "body")]
        kids = []
        while not self.sees(*ends):
            if not self.maybe(";"):
                kids.append(self.statement())
        return kids

    def condition(self) -> Node:
        start = self.need("(").start
        inner = self.expression()
        self.need(")")
        return self.make("parenthesized_expression", start, inner)

    def on_namespace(self, start: int) -> Node:
        self.take()
        name = as_role(self.word("namespace_name"), "name") if self.at().kind == "id" else None
        return self.make("namespace_definition", start, name, self.block("compound_statement")) if self.sees("{") else self.end(self.make("namespace_definition", start, name))

    def on_use(self, start: int) -> Node:
        self.take()
        self.maybe("function", "const") if self.at(1).kind == "id" else None

        def clause() -> Node:
            s = self.at().start
            self.maybe("function", "const") if self.at(1).kind == "id" else None
            name = self.word("qualified_name", "name")
            return self.make("namespace_use_clause", s, name, self.name("alias") if self.maybe("as") else None)

        kids = [clause()]
        if self.text[self.last : self.last + 2] == "\\{":
            self.tokens[self.i].kind = "op"
        if self.at().text == "\\" or self.at().kind == "bad":
            self.take()
        if self.sees("{"):
            self.take()
            kids = self.listed(clause, "}")
        while self.maybe(","):
            kids.append(clause())
        return self.end(self.make("namespace_use_declaration", start, *kids))

    def constants(self, start: int, type_: str, kids: list[Node]) -> Node:
        self.need("const")
        if self.at(1).kind == "id":
            self.take()

        def one() -> Node:
            s, name = self.at().start, self.name()
            self.need("=")
            return self.make("const_element", s, name, self.single())

        kids.append(one())
        while self.maybe(","):
            kids.append(one())
        return self.end(self.make(type_, start, *kids))

    def on_const(self, start: int) -> Node:
        return self.constants(start, "const_declaration", [])

    def on_function(self, start: int) -> Node | None:
        named = self.at(1).kind == "id" or (self.at(1).text == "&" and self.at(2).kind == "id")
        if not named:
            return None
        self.take()
        self.maybe("&")
        name, params = self.name(), self.params()
        self.returns()
        return self.make("function_definition", start, name, params, self.block("compound_statement"))

    def returns(self) -> None:
        if self.maybe(":"):
            self.type()

    def type(self) -> None:
        self.maybe("?")
        while True:
            if self.sees("("):
                self.skip_group()
            else:
                self.word()
            if not (self.sees("|") or (self.sees("&") and (self.at(1).kind == "id" or self.at(1).text == "("))):
                return
            self.take()

    def params(self) -> Node:
        start = self.need("(").start

        def one() -> Node:
            self.attributes()
            s, promoted = self.at().start, False
            while self.at().kind == "id" and self.lower() in MODIFIERS:
                self.take()
                promoted = True
            if self.at().kind == "id" or self.sees("?", "("):
                self.type()
            self.maybe("&")
            rest = self.maybe("...")
            name = self.variable("name")
            value = as_role(self.single(), "default") if self.maybe("=") else None
            return self.make("property_promotion_parameter" if promoted else "variadic_parameter" if rest else "simple_parameter", s, name, value)

        return as_role(self.make("formal_parameters", start, *self.listed(one, ")")), "parameters")

    def variable(self, role: str = "") -> Node:
        if self.at().kind != "var":
            raise Bad
        return self.leaf("variable_name", role)

    def class_like(self, start: int) -> Node | None:
        while self.lower() in ("abstract", "final", "readonly"):
            self.take()
        word = self.lower()
        if word not in ("class", "interface", "trait", "enum") or self.at(1).kind != "id":
            raise Bad
        self.take()
        name = self.name()
        self.heritage()
        return self.make(f"{word}_declaration", start, name, self.block("declaration_list", self.member_))

    def heritage(self) -> None:
        if self.maybe(":"):
            self.type()
        while self.sees("extends", "implements"):
            self.take()
            self.word()
            while self.maybe(","):
                self.word()

    def on_enum(self, start: int) -> Node | None:
        return self.class_like(start) if self.at(1).kind == "id" else None

    on_class = on_interface = on_trait = on_abstract = on_final = on_readonly = class_like

    def member_(self) -> Node:
        self.attributes()
        start, mods = self.at().start, []
        if self.sees("use"):
            self.take()
            kids = [self.word("name")]
            while self.maybe(","):
                kids.append(self.word("name"))
            if self.sees("{"):
                self.skip_group()
                return self.make("use_declaration", start, *kids)
            return self.end(self.make("use_declaration", start, *kids))
        if self.sees("case"):
            self.take()
            name = self.name()
            return self.end(self.make("enum_case", start, name, self.single() if self.maybe("=") else None))
        while self.at().kind == "id" and self.lower() in MODIFIERS:
            mods.append(self.leaf("visibility_modifier" if self.lower() in ("public", "private", "protected") else f"{self.lower()}_modifier", "modifier"))
        if self.sees("const"):
            return self.constants(start, "class_constant_declaration", mods)
        if self.maybe("function"):
            self.maybe("&")
            name, params = self.name(), self.params()
            self.returns()
            body = self.block("compound_statement") if self.sees("{") else None
            node = self.make("method_declaration", start, *mods, name, params, body)
            return node if body else self.end(node)
        if self.at().kind != "var":
            self.type()

        def element() -> Node:
            s, name = self.at().start, self.variable("name")
            return self.make("property_element", s, name, as_role(self.single(), "default") if self.maybe("=") else None)

        kids = [element()]
        while self.maybe(","):
            kids.append(element())
        return self.end(self.make("property_declaration", start, *mods, *kids))

    def on_return(self, start: int) -> Node:
        self.take()
        return self.end(self.make("return_statement", start, None if self.sees(";", "}") else self.expression()))

    def on_echo(self, start: int) -> Node:
        self.take()
        return self.end(self.make("echo_statement", start, self.expression()))

    def on_if(self, start: int) -> Node:
        self.take()
        kids = [self.condition(), *self.body("elseif", "else", "endif")]
        while self.sees("elseif") or (self.sees("else") and self.lower(1) == "if"):
            s = self.take().start
            self.maybe("if")
            kids.append(self.make("else_if_clause", s, self.condition(), *self.body("elseif", "else", "endif")))
        if self.sees("else"):
            s = self.take().start
            kids.append(self.make("else_clause", s, *self.body("endif")))
        self.maybe("endif")
        return self.make("if_statement", start, *kids)

    def on_while(self, start: int) -> Node:
        self.take()
        kids = [self.condition(), *self.body("endwhile")]
        self.maybe("endwhile")
        return self.make("while_statement", start, *kids)

    def on_do(self, start: int) -> Node:
        self.take()
        body = self.statement()
        self.need("while")
        return self.end(self.make("do_statement", start, body, self.condition()))

    def on_for(self, start: int) -> Node:
        self.take()
        self.need("(")
        kids = []
        while not self.maybe(")"):
            if not self.maybe(";"):
                kids.append(self.expression())
        kids += self.body("endfor")
        self.maybe("endfor")
        return self.make("for_statement", start, *kids)

    def on_foreach(self, start: int) -> Node:
        self.take()
        self.need("(")
        kids = [self.expression()]
        self.need("as")
        kids.append(self.single())
        if self.maybe("=>"):
            kids.append(self.single())
        self.need(")")
        kids += self.body("endforeach")
        self.maybe("endforeach")
        return self.make("foreach_statement", start, *kids)

    def on_switch(self, start: int) -> Node:
        self.take()
        kids, ends = [self.condition()], ("}", "endswitch")
        self.need("{", ":")
        while not self.maybe(*ends):
            s, inner = self.at().start, []
            if self.need("case", "default").text.lower() == "case":
                inner.append(self.expression())
            self.need(":", ";")
            while not self.sees("case", "default", *ends):
                if not self.maybe(";"):
                    inner.append(self.statement())
            kids.append(self.make("case_statement", s, *inner))
        return self.make("switch_statement", start, *kids)

    def on_try(self, start: int) -> Node:
        self.take()
        kids = [self.block("compound_statement")]
        while self.sees("catch", "finally"):
            s = self.at().start
            if self.take().text.lower() == "catch":
                self.skip_group()
            kids.append(self.make("catch_clause", s, self.block("compound_statement")))
        return self.make("try_statement", start, *kids)

    def jump(self, start: int) -> Node:
        word = self.take().text.lower()
        return self.end(self.make(f"{word}_statement", start, None if self.sees(";", "}") else self.expression()))

    on_break = on_continue = on_global = on_unset = jump

    def on_static(self, start: int) -> Node | None:
        if self.at(1).kind != "var":
            return None
        return self.jump(start)

    def on_declare(self, start: int) -> Node:
        self.take()
        self.skip_group()
        return self.end(self.make("declare_statement", start))

    # expressions
    def joins(self, t: Token) -> bool:
        return super().joins(t) or (t.kind == "id" and t.text.lower() in ("instanceof", "and", "or", "xor"))

    def assignment(self, left: Node, op: str, right: Node) -> Node:
        if op == "=" and left.type == "array_creation_expression":
            left.type = "list_literal"
            for k in left.kids:
                k.kids, k.type = (k.kids, k.type) if len(k.kids) != 1 else (k.kids[0].kids, k.kids[0].type)
        return super().assignment(left, op, right)

    def unary(self) -> Node:
        t, word = self.at(), self.lower()
        if t.text == "(" and t.kind == "op" and self.lower(1) in CASTS and self.at(2).text == ")":
            self.i += 3
            return self.make("cast_expression", t.start, self.unary())
        if t.kind == "id" and word in ("print", "clone", "throw", "yield", "include", "include_once", "require", "require_once") and self.at(1).text not in ("::",):
            self.take()
            self.maybe("from")
            inner = None if self.sees(";", ")", ",", "]") else self.single()
            if inner and self.maybe("=>"):
                inner = self.make("pair", inner.start, inner, self.single())
            return self.make(f"{word}_expression", t.start, inner)
        return super().unary()

    def primary(self) -> Node:
        self.attributes()
        t, word = self.at(), self.lower()
        if t.kind in ("str", "num"):
            return self.leaf("string" if t.kind == "str" else "integer")
        if t.kind == "var":
            return self.leaf("variable_name")
        if self.maybe("$"):
            if self.maybe("{"):
                inner = self.expression()
                self.need("}")
                return self.make("dynamic_variable_name", t.start, inner)
            return self.make("dynamic_variable_name", t.start, self.primary())
        if self.maybe("("):
            inner = self.expression()
            self.need(")")
            return self.make("parenthesized_expression", t.start, inner)
        if self.maybe("["):
            return self.make("array_creation_expression", t.start, *self.listed(self.element, "]"))
        if t.kind != "id":
            raise Bad
        if word in ("array", "list") and self.at(1).text == "(":
            self.i += 2
            return self.make("array_creation_expression" if word == "array" else "list_literal", t.start, *(self.listed(self.element if word == "array" else self.single, ")")))
        if word == "static" and self.lower(1) in ("function", "fn"):
            self.take()
            word = self.lower()
        if word == "function":
            self.take()
            self.maybe("&")
            params = self.params()
            uses = None
            if self.maybe("use"):
                s = self.at().start
                self.skip_group()
                uses = self.make("anonymous_function_use_clause", s)
            self.returns()
            return self.make("anonymous_function_creation_expression", t.start, params, uses, self.block("compound_statement"))
        if word == "fn" and self.at(1).text in ("(", "&"):
            self.take()
            self.maybe("&")
            params = self.params()
            self.returns()
            self.need("=>")
            return self.make("arrow_function", t.start, params, as_role(self.single(), "body"))
        if word == "match" and self.at(1).text == "(":
            self.take()
            value = self.condition()
            self.need("{")
            return self.make("match_expression", t.start, value, *self.listed(self.arm, "}"))
        if word == "new":
            self.take()
            self.attributes()
            if self.sees("class"):
                self.take()
                args = self.args() if self.sees("(") else None
                self.heritage()
                return self.make("object_creation_expression", t.start, args, self.block("declaration_list", self.member_))
            target = self.leaf("name") if self.at().kind == "id" else self.postfix(self.primary(), False)
            return self.make("object_creation_expression", t.start, target, self.args() if self.sees("(") else None)
        return self.leaf("name")

    def arm(self) -> Node:
        start, kids = self.at().start, []
        while not self.maybe("=>"):
            if not self.maybe(",", "default"):
                kids.append(self.single())
        return self.make("match_condition", start, *kids, self.single())

    def element(self) -> Node:
        s, first = self.at().start, self.single()
        if self.maybe("=>"):
            return self.make("array_element_initializer", s, as_role(first, "key"), as_role(self.single(), "value"))
        return self.make("array_element_initializer", s, as_role(first, "value"))

    def args(self) -> Node:
        start = self.need("(").start

        def one() -> Node:
            if self.at().kind == "id" and self.at(1).text == ":":
                self.i += 2
            return self.leaf("variadic_placeholder") if self.sees("...") and self.at(1).text == ")" else self.single()

        return as_role(self.make("arguments", start, *self.listed(one, ")")), "arguments")

    def postfix(self, left: Node, calls: bool = True) -> Node:
        while True:
            t = self.at()
            if t.text == "(" and t.kind == "op" and calls:
                left = self.make("function_call_expression", left.start, as_role(left, "function"), self.args())
            elif t.text in ("->", "?->", "::") and t.kind == "op":
                self.take()
                if self.maybe("{"):
                    name = as_role(self.expression(), "name")
                    self.need("}")
                else:
                    name = self.leaf("variable_name", "name") if self.at().kind == "var" else self.name()
                scoped = t.text == "::"
                role = "scope" if scoped else "object"
                if self.sees("(") and calls:
                    left = self.make("scoped_call_expression" if scoped else "member_call_expression", left.start, as_role(left, role), name, self.args())
                else:
                    left = self.make(("class_constant_access_expression" if name.type == "name" else "scoped_property_access_expression") if scoped else "member_access_expression", left.start, as_role(left, role), name)
            elif t.text == "[" and t.kind == "op":
                self.take()
                inner = None if self.sees("]") else self.expression()
                self.need("]")
                left = self.make("subscript_expression", left.start, left, inner)
            elif t.text in ("++", "--") and t.kind == "op":
                self.take()
                left = self.make("update_expression", left.start, left)
            else:
                return left


def parse(text: str) -> Node:
    return Php(text).parse()


def bare(k: Node | None, text: str) -> str:
    return text[k.start : k.end].removeprefix("$").strip() if k else ""


def variables(n: Node) -> list[Node]:
    return [n] if n.type == "variable_name" else [v for k in n.kids if k.role != "default" for v in variables(k)]


def name_of(n: Node, text: str) -> str:
    if n.type == "comment":
        return summary(text[n.start : n.end])
    if n.type == "return_statement":
        return "return"
    if n.type in ("arrow_function", "anonymous_function_creation_expression"):
        left = n.up.part("left") if n.up is not None and n.up.type == "assignment_expression" else None
        return bare(left, text) if left is not None and left.type == "variable_name" else "anonymous"
    if n.type == "variable_name":
        return bare(n, text)
    if n.type == "assignment_expression":
        left = n.part("left")
        return bare(left, text) if left.type == "variable_name" else ""
    if n.type == "array_element_initializer":
        return text[(k := n.part("key") or n.part("value")).start : k.end].strip()
    return bare(n.part("function") or n.part("name"), text) or bare(next(iter(n.of("name")), None), text)


def bindings(n: Node, text: str) -> list[Binding]:
    if n.type == "property_declaration":
        return [Binding(k, bare(k, text)) for k in variables(n)]
    if n.type in ("const_declaration", "class_constant_declaration"):
        return [Binding(e.part("name"), bare(e.part("name"), text)) for e in n.of("const_element")]
    if n.type == "namespace_use_declaration":
        found = [c.part("alias") or c.part("name") for c in n.of("namespace_use_clause")]
        return [Binding(k, bare(k, text)) for k in found]
    if n.type == "assignment_expression" and n.part("left").type == "list_literal":
        return [Binding(k, bare(k, text)) for k in n.part("left").of("variable_name")]
    bound = n.part("left") if n.type == "assignment_expression" else n.part("name") if n.type == "simple_parameter" else None
    return [Binding(bound if bound is not None and bound.type == "variable_name" else n, name_of(n, text))]


def declared_type(n: Node, text: str) -> str:
    return ""


def exported(name: str) -> bool:
    return bool(name) and not name.startswith("_")


def member(n: Node, text: str) -> str:
    return "constructor" if n.type == "method_declaration" and name_of(n, text).lower() == "__construct" else ""
