"""Go: a subset grammar."""

from __future__ import annotations

import re

from copse.providers.scan import Bad, Parser, Token
from copse.providers.tree import Binding, Node, as_role, summary

ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")
#: Words after which a line's end does not end a statement's tokens (fixed values of the language: what may end one).
ENDERS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class Go(Parser):
    lexer = re.compile(
        r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<str>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<num>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d]\w*)"""
        r"|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])", re.S)
    root, holder, assign = "source_file", "argument_list", ()
    prefix = frozenset("+ - ! ^ * & <- ~".split())
    binary = frozenset("+ - * / % == != < > <= >= && || & | ^ << >> &^".split())

    def lex(self) -> None:
        """Line ends after operands are semicolons."""
        super().lex()
        self.literals, out = True, []
        for t in self.tokens:
            if t.fresh and out and (out[-1].kind in ("num", "str") or out[-1].text in ENDERS or (out[-1].kind == "id" and out[-1].text not in KEYWORDS)):
                out.append(Token("op", ";", out[-1].end, out[-1].end, False))
            out.append(t)
        self.tokens = out

    def ended(self, node: Node) -> Node:
        if not (self.sees(";", "}", ")", ":") or self.at().kind == "end"):
            raise Bad
        return node

    def statement(self) -> Node:
        t = self.at()
        own = getattr(self, "on_" + t.text, None) if t.kind == "id" else None
        if own:
            return self.ended(own(t.start))
        if t.text == "{":
            return self.ended(self.block("block"))
        if t.kind == "id" and t.text not in KEYWORDS and self.at(1).text == ":":
            label = self.word("label_name")
            self.take()
            return self.make("labeled_statement", t.start, label, None if self.sees("}") or self.maybe(";") else self.statement())
        return self.ended(self.simple())

    def simple(self) -> Node:
        left = self.exprs()
        t = self.at()
        if t.text == ":=":
            self.take()
            right = self.range_or_exprs()
            return self.make("short_var_declaration", left.start, as_role(left, "left"), as_role(right, "right"))
        if t.kind == "op" and t.text in ASSIGN:
            self.take()
            right = self.range_or_exprs()
            return self.make("assignment_statement", left.start, as_role(left, "left"), as_role(right, "right"))
        if self.maybe("++", "--"):
            return self.make("inc_statement" if t.text == "++" else "dec_statement", left.start, left)
        if self.maybe("<-"):
            return self.make("send_statement", left.start, left, self.single())
        return left.kids[0] if len(left.kids) == 1 else left

    def exprs(self) -> Node:
        kids = [self.single()]
        while self.maybe(","):
            kids.append(self.single())
        return self.make("expression_list", kids[0].start, *kids)

    def range_or_exprs(self) -> Node:
        return self.make("range", self.take().start, self.single()) if self.sees("range") else self.exprs()

    def on_package(self, start: int) -> Node:
        self.take()
        return self.make("package_clause", start, self.word("package_identifier"))

    def group(self, item) -> list[Node]:
        return self.listed(item, ")", ";") if self.maybe("(") else [item()]

    def on_import(self, start: int) -> Node:
        self.take()

        def spec() -> Node:
            s = self.at().start
            name = None if self.at().kind == "str" else self.leaf("dot", "name") if self.sees(".") else self.word("package_identifier", "name")
            if self.at().kind != "str":
                raise Bad
            return self.make("import_spec", s, name, self.leaf("interpreted_string_literal", "path"))

        return self.make("import_declaration", start, *self.group(spec))

    def values(self, kind: str, start: int) -> Node:
        self.take()

        def spec() -> Node:
            s, names = self.at().start, [self.word()]
            while self.maybe(","):
                names.append(self.word())
            type_ = None if self.sees("=", ";", ")") or self.at().kind == "end" else as_role(self.type(), "type")
            value = as_role(self.exprs(), "value") if self.maybe("=") else None
            return self.make(f"{kind}_spec", s, *names, type_, value)

        return self.make(f"{kind}_declaration", start, *self.group(spec))

    def on_var(self, start: int) -> Node:
        return self.values("var", start)

    def on_const(self, start: int) -> Node:
        return self.values("const", start)

    def on_type(self, start: int) -> Node:
        self.take()

        def spec() -> Node:
            s, name = self.at().start, self.word("type_identifier", "name")
            if self.sees("[") and self.at(1).kind == "id" and self.at(2).text not in ("]",):
                self.skip_group()
            alias = self.maybe("=")
            return self.make("type_alias" if alias else "type_spec", s, name, as_role(self.type(), "type"))

        return self.make("type_declaration", start, *self.group(spec))

    def type(self) -> Node:
        t = self.at()
        if self.maybe("*"):
            return self.make("pointer_type", t.start, self.type())
        if self.maybe("("):
            inner = self.type()
            self.need(")")
            return self.make("parenthesized_type", t.start, inner)
        if self.sees("["):
            slice_ = self.at(1).text == "]"
            self.skip_group()
            return self.make("slice_type" if slice_ else "array_type", t.start, self.type())
        if self.maybe("map"):
            self.need("[")
            key = self.type()
            self.need("]")
            return self.make("map_type", t.start, key, self.type())
        if self.sees("chan", "<-"):
            self.maybe("<-")
            self.need("chan")
            self.maybe("<-")
            return self.make("channel_type", t.start, self.type())
        if self.maybe("func"):
            params = self.params()
            return self.make("function_type", t.start, params, self.result())
        if self.sees("struct") or self.sees("interface"):
            struct = self.take().text == "struct"
            kids = [self.block("field_declaration_list", self.struct_field, "")] if struct else self.block("method_spec_list", self.interface_item, "").kids
            return self.make("struct_type" if struct else "interface_type", t.start, *kids)
        name = self.word("type_identifier")
        if name and self.sees(".") and self.at(1).kind == "id":
            self.take()
            self.take()
            name = self.make("qualified_type", t.start)
        if self.sees("[") and self.at(1).text != "]":
            self.skip_group()
            name = self.make("generic_type", t.start)
        return name

    def struct_field(self) -> Node:
        s, names = self.at().start, []
        if self.at().kind == "id" and self.at(1).text not in (".", ";", "}") and self.at(1).kind != "str":
            names = [self.word("field_identifier", "name")]
            while self.maybe(","):
                names.append(self.word("field_identifier", "name"))
        type_ = as_role(self.type(), "type")
        tag = self.leaf("raw_string_literal", "tag") if self.at().kind == "str" else None
        return self.ended(self.make("field_declaration", s, *names, type_, tag))

    def interface_item(self) -> Node:
        s = self.at().start
        if self.at().kind == "id" and self.at(1).text == "(":
            name = self.word("field_identifier", "name")
            params = self.params()
            return self.ended(self.make("method_elem", s, name, params, self.result()))
        kids = []
        while True:
            self.maybe("~")
            kids.append(self.type())
            if not self.maybe("|"):
                return self.ended(self.make("type_elem", s, *kids))

    def params(self) -> Node:
        """Names and types are told apart by what follows them: ``a, b int`` or ``int, string``."""
        start = self.need("(").start

        def one() -> Node:
            s = self.at().start
            if self.maybe("..."):
                return self.make("parameter_declaration", s, as_role(self.type(), "type"))
            if self.at().kind == "id" and self.at().text not in KEYWORDS and self.at(1).text not in (",", ")", ".", "["):
                name = self.word(role="name")
                self.maybe("...")
                return self.make("parameter_declaration", s, name, as_role(self.type(), "type"))
            named = self.trying(lambda: self.make("parameter_declaration", s, self.word(role="name"), as_role(self.type(), "type"))) if self.at(1).text == "[" else None
            return named or self.make("parameter_declaration", s, as_role(self.type(), "type"))

        return as_role(self.make("parameter_list", start, *self.listed(one, ")")), "parameters")

    def result(self) -> Node | None:
        if self.sees("("):
            return as_role(self.params(), "result")
        return None if self.sees("{", ";", ",", ")", "}", "=", ":=", "]", ":") or self.at().kind in ("end", "str") else as_role(self.type(), "result")

    def on_func(self, start: int) -> Node:
        if self.at(1).text == "(" and not self.is_method():
            return self.simple()
        self.take()
        receiver = as_role(self.params(), "receiver") if self.sees("(") else None
        name = self.word("field_identifier" if receiver else "identifier", "name")
        if self.sees("["):
            self.skip_group()
        params, result = self.params(), self.result()
        body = self.body() if self.sees("{") else None
        return self.make("method_declaration" if receiver else "function_declaration", start, receiver, name, params, result, body)

    def is_method(self) -> bool:
        k = self.closing(1)
        return k > 0 and self.at(k + 1).kind == "id" and self.at(k + 2).text == "("

    def body(self) -> Node:
        outer, self.literals = self.literals, True
        try:
            return self.block("block")
        finally:
            self.literals = outer

    def on_return(self, start: int) -> Node:
        self.take()
        return self.make("return_statement", start, None if self.sees(";", "}") or self.at().kind == "end" else self.exprs())

    def header(self) -> list[Node]:
        """Statements between a keyword and its block; composite literals need parentheses there."""
        outer, self.literals, kids = self.literals, False, []
        try:
            while not self.sees("{"):
                if not self.maybe(";"):
                    kids.append(self.make("range_clause", self.at().start, self.range_or_exprs()) if self.sees("range") else self.simple())
                    if not self.sees(";", "{"):
                        raise Bad
        finally:
            self.literals = outer
        return kids

    def on_if(self, start: int) -> Node:
        self.take()
        kids = [*self.header(), self.body()]
        if self.maybe("else"):
            kids.append(as_role(self.on_if(self.at().start) if self.sees("if") else self.body(), "alternative"))
        return self.make("if_statement", start, *kids)

    def on_for(self, start: int) -> Node:
        self.take()
        kids = self.header()
        for k in kids:
            if k.type in ("short_var_declaration", "assignment_statement") and (r := k.part("right")) and r.type == "range":
                k.type = "range_clause"
        return self.make("for_statement", start, *kids, self.body())

    def on_switch(self, start: int) -> Node:
        self.take()
        return self.make("expression_switch_statement", start, *self.header(), *self.cases())

    def on_select(self, start: int) -> Node:
        self.take()
        return self.make("select_statement", start, *self.cases())

    def cases(self) -> list[Node]:
        outer, self.literals, out = self.literals, True, []
        self.need("{")
        while not self.maybe("}"):
            if self.maybe(";"):
                continue
            start, kids = self.at().start, []
            if self.need("case", "default").text == "case":
                kids.append(self.trying(self.case_types) or self.simple())
            self.need(":")
            while not self.sees("case", "default", "}"):
                if not self.maybe(";"):
                    kids.append(self.statement())
            out.append(self.make("expression_case", start, *kids))
        self.literals = outer
        return out

    def case_types(self) -> Node:
        start, kids = self.at().start, [self.type()]
        while self.maybe(","):
            kids.append(self.type())
        if not self.sees(":") or all(k.type == "type_identifier" for k in kids):
            raise Bad
        return self.make("type_list", start, *kids)

    def keyword_call(self, start: int) -> Node:
        return self.make(f"{self.take().text}_statement", start, self.single())

    on_go = on_defer = keyword_call

    def jump(self, start: int) -> Node:
        return self.make(f"{self.take().text}_statement", start, None if self.sees(";", "}") else self.word("label_name"))

    on_break = on_continue = on_goto = on_fallthrough = jump

    def primary(self) -> Node:
        t = self.at()
        if t.kind in ("str", "num"):
            return self.leaf("interpreted_string_literal" if t.kind == "str" else "int_literal")
        if self.maybe("("):
            outer, self.literals = self.literals, True
            inner = self.trying(self.single_closed) or self.type_closed()
            self.literals = outer
            return self.make("parenthesized_expression", t.start, inner)
        if t.text == "func" and t.kind == "id":
            self.take()
            params, result = self.params(), self.result()
            return self.make("func_literal", t.start, params, result, self.body()) if self.sees("{") else self.make("function_type", t.start, params, result)
        if t.text in ("[", "map", "struct", "chan", "interface"):
            type_ = self.type()
            return self.literal(type_) if self.sees("{") else type_
        if t.kind != "id" or t.text in KEYWORDS:
            raise Bad
        return self.leaf("identifier")

    def single_closed(self) -> Node:
        inner = self.single()
        self.need(")")
        return inner

    def type_closed(self) -> Node:
        inner = self.type()
        self.need(")")
        return inner

    def literal(self, type_: Node | None) -> Node:
        start = self.at().start if type_ is None else type_.start
        self.need("{")
        outer, self.literals = self.literals, True

        def value() -> Node:
            return self.literal(None) if self.sees("{") else self.single()

        def element() -> Node:
            s, first = self.at().start, value()
            return self.make("keyed_element", s, first, value()) if self.maybe(":") else first

        kids = self.listed(element, "}")
        self.literals = outer
        return self.make("composite_literal", start, as_role(type_, "type"), *kids)

    def args(self) -> Node:
        start = self.need("(").start
        outer, self.literals = self.literals, True

        def one() -> Node:
            arg = self.single() if not self.sees("*", "[", "map", "chan", "interface", "struct", "func") else self.trying(self.single) or self.type()
            self.maybe("...")
            return arg

        kids = self.listed(one, ")")
        self.literals = outer
        return as_role(self.make("argument_list", start, *kids), "arguments")

    def postfix(self, left: Node) -> Node:
        while True:
            if self.sees("("):
                left = self.make("call_expression", left.start, as_role(left, "function"), self.args())
            elif self.sees("."):
                self.take()
                if self.sees("("):
                    self.skip_group()
                    left = self.make("type_assertion_expression", left.start, left)
                else:
                    left = self.make("selector_expression", left.start, as_role(left, "operand"), self.word("field_identifier", "field"))
            elif self.sees("["):
                self.take()
                outer, self.literals, kids = self.literals, True, []
                while not self.maybe("]"):
                    if not self.maybe(":", ","):
                        kids.append(self.trying(self.single) or self.type())
                self.literals = outer
                left = self.make("index_expression", left.start, left, *kids)
            elif self.sees("{") and self.literals and left.type in ("identifier", "selector_expression", "index_expression"):
                left = self.literal(left)
            else:
                return left


def parse(text: str) -> Node:
    return Go(text).parse()


def name_of(n: Node, text: str) -> str:
    at = lambda k: text[k.start : k.end] if k else ""
    if n.type == "comment":
        return summary(at(n))
    if n.type == "call_expression":
        return at(n.part("function"))
    if n.type in ("assignment_statement", "short_var_declaration"):
        stack = [n.part("left")]
        while stack:
            k = stack.pop()
            if k.type == "identifier":
                return at(k)
            stack += reversed(k.kids)
        return ""
    return at(n.part("name")) or at(next(iter(n.of("identifier")), None))


def bindings(n: Node, text: str) -> list[Binding]:
    at = lambda k: text[k.start : k.end]
    if n.type in ("var_declaration", "const_declaration"):
        return [Binding(k, at(k)) for spec in n.kids for k in spec.of("identifier")]
    if n.type == "short_var_declaration":
        names = [Binding(k, at(k), ("variable", "short_var_declaration")) for k in n.part("left").of("identifier")]
        return [Binding(n, name_of(n, text), ("assignment", "assign")), *names]
    if n.type == "import_declaration":
        return [Binding(k, at(k.part("name")) if k.part("name") else at(k.part("path")).strip('"`')) for k in n.of("import_spec")]
    return [Binding(n, name_of(n, text))]


def declared_type(n: Node, text: str) -> str:
    holder = n if n.part("type") else n.up if n.up is not None and n.up.type in ("field_declaration", "var_spec", "const_spec") else None
    found = holder.part("type") if holder else None
    return text[found.start : found.end] if found else ""


def exported(name: str) -> bool:
    return "A" <= name[:1] <= "Z"


def member(n: Node, text: str) -> str:
    """What a type is, for the kinds struct and interface."""
    found = n.part("type") if n.type == "type_spec" else None
    return {"struct_type": "struct", "interface_type": "interface"}.get(found.type, "") if found else ""
