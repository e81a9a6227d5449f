"""Python, by the parser of the running interpreter; comments by its tokenizer."""

from __future__ import annotations

import ast
import functools
import io
import re
import tokenize

from copse.providers.tree import Binding, Node, as_role, summary

# Node types of syntax classes whose names differ from their class.
TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "Return": "return_statement",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "Match": "match_statement",
    "Global": "global_statement", "Nonlocal": "nonlocal_statement", "TypeAlias": "type_alias_statement", "With": "with_statement", "AsyncWith": "with_statement", "Try": "try_statement", "TryStar": "try_statement",
    "Raise": "raise_statement", "Assert": "assert_statement", "Delete": "delete_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Expr": "expression_statement",
    "Name": "identifier", "Dict": "dictionary", "BoolOp": "boolean_operator", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "Compare": "comparison_operator", "IfExp": "conditional_expression",
    "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "JoinedStr": "string", "Starred": "list_splat",
    "keyword": "keyword_argument", "ExceptHandler": "except_clause", "match_case": "case_clause",
}


_LINE_END = re.compile("\r\n|\r|\n")


class _Builder:
    def __init__(self, text: str) -> None:
        self.text, self.lines = text, [0] + [m.end() for m in _LINE_END.finditer(text)]
        self.bytes = None if text.isascii() else [None if text[a:b].isascii() else text[a:b].encode() for a, b in zip(self.lines, [*self.lines[1:], len(text)])]

    def at(self, line: int, col: int) -> int:
        raw = self.bytes and self.bytes[line - 1]
        return self.lines[line - 1] + (col if raw is None else len(raw[:col].decode()))

    def span(self, n: ast.AST) -> tuple[int, int]:
        if self.bytes is None:
            return self.lines[n.lineno - 1] + n.col_offset, self.lines[n.end_lineno - 1] + n.end_col_offset
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)

    def find(self, what: str, start: int, end: int, role: str = "", type_: str = "identifier") -> Node | None:
        """Where ``what`` first stands between ``start`` and ``end`` as a word."""
        text, in_word = self.text, lambda c: c.isalnum() or c == "_"
        at = text.find(what, start, end)
        while at >= 0:
            after = at + len(what)
            if not (at and in_word(text[at - 1])) and not (after < min(end, len(text)) and in_word(text[after])):
                return Node(type_, at, after, role=role)
            at = text.find(what, at + 1, end)
        return None

    def block(self, body: list, role: str = "body") -> Node | None:
        kids = [self.node(x) for x in body]
        return Node("block", kids[0].start, kids[-1].end, kids, role) if kids else None

    def children(self, n: ast.AST) -> list[Node]:
        out = []
        for name in n._fields:
            value = getattr(n, name, None)
            if isinstance(value, ast.AST):
                if value._attributes:  # it has a place
                    out.append(as_role(self.node(value), name))
                elif value._fields:
                    out += self.children(value)
            elif value and isinstance(value, list):
                if isinstance(value[0], ast.stmt):
                    out.append(self.block(value, name))
                    continue
                for x in value:
                    if isinstance(x, ast.AST):
                        out += [as_role(self.node(x), name)] if x._attributes else self.children(x)
        return out

    def node(self, n: ast.AST) -> Node:
        start, end = self.span(n)
        make, type_ = _made(type(n))
        return make(self, n, start, end) if make else Node(type_, start, end, self.children(n))

    def definition(self, n, start: int, end: int) -> Node:
        """Decorators stand beside the definition, in one node that holds both."""
        marks = [Node("decorator", self.text.rindex("@", 0, self.span(d)[0]), self.span(d)[1], [self.node(d)]) for d in n.decorator_list]
        n.decorator_list = []
        head = self.find(n.name, start + 1, end, "name")
        self_ = Node(TYPES[type(n).__name__], start, end, [head, *self.children(n)])
        return Node("decorated_definition", marks[0].start, end, [*marks, as_role(self_, "definition")]) if marks else self_

    on_FunctionDef = on_AsyncFunctionDef = on_ClassDef = definition

    def on_Assign(self, n: ast.Assign, start: int, end: int) -> Node:
        """a = b = 1 is an assignment whose right side is one."""
        right = as_role(self.node(n.value), "right")
        for target in reversed(n.targets):
            left = as_role(self.node(target), "left")
            if left.type == "tuple" and self.text[left.start] != "(":
                left.type = "pattern_list"
            right = Node("assignment", left.start, end, [left, right], "right")
        right.role = ""
        return right

    def on_AnnAssign(self, n, start: int, end: int) -> Node:
        return Node("assignment", start, end, [as_role(self.node(n.target), "left"), as_role(self.node(n.annotation), "type"), as_role(self.node(n.value), "right") if n.value else None])

    def on_AugAssign(self, n, start: int, end: int) -> Node:
        return Node("augmented_assignment", start, end, [as_role(self.node(n.target), "left"), as_role(self.node(n.value), "right")])

    def on_Call(self, n: ast.Call, start: int, end: int) -> Node:
        function = as_role(self.node(n.func), "function")
        args = [self.node(x) for x in [*n.args, *n.keywords]]
        return Node("call", start, end, [function, Node("argument_list", self.text.index("(", function.end), end, args, "arguments")])

    def on_Expr(self, n: ast.Expr, start: int, end: int) -> Node:
        return Node("expression_statement", start, end, [self.node(n.value)])

    def names(self, n, start: int, end: int) -> Node:
        return Node(TYPES[type(n).__name__], start, end, [self.find(x, start + 6, end) for x in n.names])

    on_Global = on_Nonlocal = names

    def on_TypeAlias(self, n, start: int, end: int) -> Node:
        return Node("type_alias_statement", start, end, [as_role(self.node(n.name), "left"), as_role(self.node(n.value), "right")])

    def on_Name(self, n: ast.Name, start: int, end: int) -> Node:
        return Node("identifier", start, end)

    def on_Constant(self, n: ast.Constant, start: int, end: int) -> Node:
        v = n.value
        return Node("string" if isinstance(v, str | bytes) else "none" if v is None else "ellipsis" if v is ... else {bool: "true" if v else "false", int: "integer"}.get(type(v), "float"), start, end)

    def on_JoinedStr(self, n, start: int, end: int) -> Node:
        return Node("string", start, end, [self.node(v.value) for v in n.values if isinstance(v, ast.FormattedValue)])

    def imported(self, n, start: int, end: int) -> Node:
        whole, kids = start, []
        kind = "import_statement"
        if isinstance(n, ast.ImportFrom):
            kind = "import_from_statement"
            module = "." * n.level + (n.module or "")
            place = self.text.find(module, start + 4, end)
            if place >= 0:
                kids.append(Node("relative_import" if n.level else "dotted_name", place, place + len(module), role="module_name"))
                start = place + len(module)
        for a in n.names:
            if a.name == "*":
                continue
            s, e = self.span(a)
            plain = "dotted_name" if kind == "import_statement" else "identifier"
            name = Node(plain, s, s + len(a.name), role="name")
            kids.append(Node("aliased_import", s, e, [name, Node("identifier", e - len(a.asname), e, role="alias")], "name") if a.asname else name)
        return Node(kind, whole, end, kids)

    on_Import = on_ImportFrom = imported


@functools.cache
def _made(class_: type) -> tuple:
    """The method that makes nodes of a syntax class, or None; and their type."""
    name = class_.__name__
    return getattr(_Builder, "on_" + name, None), TYPES.get(name, re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower())


def parse(text: str) -> Node:
    """The tree of a text. Where Python cannot parse it, the root has a node ERROR at the place and no other nodes."""
    b = _Builder(text)
    try:
        tree = ast.parse(text)
        kids = [b.node(x) for x in tree.body]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = min(max(getattr(e, "lineno", None) or 1, 1), len(b.lines))
        place = min(b.lines[line - 1] + max((getattr(e, "offset", None) or 1) - 1, 0), len(text))
        return Node("module", 0, len(text), [Node("ERROR", place, len(text))])
    root = Node("module", 0, len(text), kids)
    for t in _tokens(text) if "#" in text else ():
        if t.type == tokenize.COMMENT:
            start = b.lines[t.start[0] - 1] + t.start[1]
            _place(root, Node("comment", start, start + len(t.string)))
    return root


def _tokens(text: str):
    try:
        yield from tokenize.generate_tokens(io.StringIO(text).readline)
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return


def _place(root: Node, comment: Node) -> None:
    """Below the smallest node that holds it."""
    while inner := next((k for k in root.kids if k.start <= comment.start and comment.end <= k.end), None):
        root = inner
    root.kids.append(comment)


def name_of(n: Node, text: str) -> str:
    at = lambda k: text[k.start : k.end] if k else ""
    if n.type == "comment":
        return summary(at(n))
    if n.type in ("lambda", "return_statement"):
        return "anonymous" if n.type == "lambda" else "return"
    role = {"call": "function", "import_from_statement": "module_name", "type_alias_statement": "left"}.get(n.type)
    if role:
        return at(n.part(role))
    if n.type == "decorator":
        return at(next(iter(n.of("identifier", "attribute")), None))
    return at(n.part("name")) or at(next(iter(n.of("identifier")), None))


def bindings(n: Node, text: str) -> list[Binding]:
    at = lambda k: text[k.start : k.end]
    if n.type in ("assignment", "augmented_assignment"):
        left = n.part("left")
        names = [left] if left.type == "identifier" else left.of("identifier") if left.type in ("tuple", "list", "pattern_list") else []
        return [Binding(k, at(k)) for k in names]
    if n.type in ("import_statement", "import_from_statement"):
        names = [k for k in n.kids if k.role == "name"]
        if names:
            return [Binding(k, at(k.part("alias") or k)) for k in names]
    return [Binding(n, name_of(n, text))]


def declared_type(n: Node, text: str) -> str:
    return ""


def exported(name: str) -> bool:
    return bool(name) and not name.startswith("_")


def member(n: Node, text: str) -> str:
    return ""
