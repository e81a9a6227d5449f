"""Tokens and the common part of the parsers of languages with braces: a subset grammar that keeps the nodes which kinds name.

A statement that cannot be parsed becomes a node ERROR up to the next place where one may begin.
"""

from __future__ import annotations

import re

from copse.providers.tree import Node, as_role


class Bad(Exception):
    """What is expected is not there."""


class Token:
    __slots__ = ("kind", "text", "start", "end", "fresh")

    def __init__(self, kind: str, text: str, start: int, end: int, fresh: bool) -> None:
        self.kind, self.text, self.start, self.end, self.fresh = kind, text, start, end, fresh


END = Token("end", "", 0, 0, True)
CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Parser:
    """``lexer`` has the groups comment, str, num, id and op; what none of them matches is skipped."""

    lexer: re.Pattern
    root = "program"
    holder = "arguments"
    member_type = "member_expression"
    assign = ("=",)

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.comments, self.i, self.last = text, [], [], 0, 0
        self.end_token = Token("end", "", len(text), len(text), True)
        self.lex()

    def lex(self, at: int = 0, close: str = "") -> int:
        """Tokens from ``at`` to the end or, if ``close`` is given, to a bracket that none of them opens: where that is."""
        depth, fresh = 0, True
        while at < len(self.text):
            found = self.lexer.match(self.text, at)
            if not found:
                fresh = fresh or self.text[at] == "\n"
                if not self.text[at].isspace():
                    self.tokens.append(Token("bad", self.text[at], at, at + 1, fresh))
                at += 1
                continue
            kind, end = found.lastgroup, self.token_end(found)
            if kind == "comment":
                self.comments.append(Node("comment", at, end))
                fresh = fresh or "\n" in self.text[at:end]
            else:
                text = self.text[at:end]
                if close and kind == "op":
                    depth += (text in CLOSERS) - (text in (")", "]", "}"))
                    if depth < 0:
                        return at if text == close else len(self.text)
                self.tokens.append(Token(kind, text, at, end, fresh))
                fresh = False
            at = end
        return at

    def token_end(self, found: re.Match) -> int:
        return found.end()

    # moving along
    def at(self, k: int = 0) -> Token:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else self.end_token

    def sees(self, *texts: str) -> bool:
        t = self.at()
        return t.text in texts and t.kind in ("op", "id")

    def take(self) -> Token:
        t = self.at()
        if t.kind == "end":
            raise Bad
        self.i += 1
        self.last = t.end
        return t

    def maybe(self, *texts: str) -> Token | None:
        return self.take() if self.sees(*texts) else None

    def need(self, *texts: str) -> Token:
        if not self.sees(*texts):
            raise Bad
        return self.take()

    def make(self, type_: str, start: int, *kids: Node | None) -> Node:
        return Node(type_, start, max(self.last, start), kids)

    def leaf(self, type_: str, role: str = "") -> Node:
        t = self.take()
        return Node(type_, t.start, t.end, role=role)

    def word(self, type_: str = "identifier", role: str = "") -> Node:
        if self.at().kind != "id":
            raise Bad
        return self.leaf(type_, role)

    def skip_group(self) -> None:
        """Over a bracket and all up to the one that closes it."""
        open_ = [CLOSERS[self.need(*CLOSERS).text]]
        while open_:
            t = self.take()
            if t.kind == "op" and t.text in CLOSERS:
                open_.append(CLOSERS[t.text])
            elif t.kind == "op" and t.text == open_[-1]:
                open_.pop()
            elif t.kind == "op" and t.text in (")", "]", "}"):
                raise Bad

    def closing(self, k: int = 0) -> int:
        """How far ahead the bracket at ``k`` is closed (-1: not at all)."""
        depth = 0
        for j in range(self.i + k, len(self.tokens)):
            t = self.tokens[j]
            if t.kind == "op":
                depth += (t.text in CLOSERS) - (t.text in (")", "]", "}"))
                if not depth:
                    return j - self.i
        return -1

    def listed(self, item, close: str, sep: str = ",") -> list[Node]:
        """Items up to ``close``, which is taken; separators may stand at both ends."""
        out = []
        while not self.maybe(close):
            if self.maybe(sep):
                continue
            out.append(item())
            if not self.sees(sep, close):
                raise Bad
        return out

    def trying(self, parse):
        """What ``parse`` gives, or None without a step taken."""
        i, last = self.i, self.last
        try:
            return parse()
        except Bad:
            self.i, self.last = i, last
            return None

    # statements
    def statements(self, close: str = "", item=None) -> list[Node]:
        """Up to ``close`` or the end. An ERROR covers the tokens from a bad statement to its end."""
        out, item = [], item or self.statement
        while self.at().kind != "end" and not (close and self.sees(close)):
            if self.maybe(";"):
                continue
            i, start = self.i, self.at().start
            try:
                node = item()
                if node is not None:
                    out.append(node)
                if self.i == i and node is None:
                    raise Bad
            except Bad:
                self.i = max(i, self.i)
                self.recover(i)
                out.append(self.make("ERROR", start))
        return out

    def recover(self, i: int) -> None:
        """Behind the statement that begins at token ``i``; to the end of the text where its brackets do not match."""
        self.i = i
        try:
            while self.at().kind != "end":
                t = self.at()
                if t.kind == "op" and t.text in CLOSERS:
                    self.skip_group()
                    if t.text == "{":
                        return
                elif t.text == "}" and t.kind == "op" and self.i > i:
                    return
                elif self.take().text == ";" or self.at().fresh:
                    return
        except Bad:
            self.i, self.last = len(self.tokens), len(self.text)

    def block(self, type_: str, item=None, role: str = "body") -> Node:
        start = self.need("{").start
        kids = self.statements("}", item)
        self.need("}")
        return as_role(self.make(type_, start, *kids), role)

    def parse(self) -> Node:
        try:
            kids = self.statements()
        except RecursionError:
            kids = [Node("ERROR", 0, len(self.text))]
        root = Node(self.root, 0, len(self.text), kids)
        for c in self.comments:
            holder = root
            while inner := next((k for k in holder.kids if k.start <= c.start and c.end <= k.end), None):
                holder = inner
            holder.kids.append(c)
        return root

    # expressions: operators of all ranks form one flat chain, as only calls, functions and assignments are looked for
    def expression(self) -> Node:
        first = self.single()
        if not self.sees(","):
            return first
        rest = []
        while self.maybe(","):
            rest.append(self.single())
        return self.make("sequence_expression", first.start, first, *rest)

    def single(self) -> Node:
        left = self.unary()
        parts = [left]
        while True:
            t = self.at()
            if t.kind == "op" and t.text in self.assign and len(parts) == 1:
                self.take()
                right = self.single()
                return self.assignment(left, t.text, right)
            if t.kind == "op" and t.text == "?" or t.text == "?:" and t.kind == "op":
                self.take()
                if t.text == "?" and not self.maybe(":"):
                    parts.append(self.single())
                    self.need(":")
                parts.append(self.single())
                return self.make("ternary_expression", left.start, *parts)
            if not self.joins(t):
                break
            self.take()
            parts.append(self.unary())
        return left if len(parts) == 1 else self.make("binary_expression", left.start, *parts)

    def joins(self, t: Token) -> bool:
        return t.kind == "op" and t.text in self.binary

    binary = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> &^ <=> <> .".split())
    prefix = frozenset("+ - ! ~ ++ -- & * @ ... <-".split())

    def unary(self) -> Node:
        t = self.at()
        if t.kind == "op" and t.text in self.prefix:
            self.take()
            inner = self.unary()
            return self.make("spread_element" if t.text == "..." else "unary_expression", t.start, inner)
        return self.postfix(self.primary())

    def assignment(self, left: Node, op: str, right: Node) -> Node:
        return self.make("assignment_expression" if op == "=" else "augmented_assignment_expression", left.start, as_role(left, "left"), as_role(right, "right"))

    def args(self) -> Node:
        start = self.need("(").start
        kids = self.listed(self.single, ")")
        return as_role(self.make(self.holder, start, *kids), "arguments")

    def primary(self) -> Node:
        raise NotImplementedError

    def postfix(self, left: Node) -> Node:
        raise NotImplementedError

    def statement(self) -> Node:
        raise NotImplementedError
