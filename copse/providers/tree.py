"""Nodes of a parsed text, and the rows that they become."""

from __future__ import annotations

import re
from bisect import bisect_right
from operator import attrgetter


class Node:
    """A typed span of a text (in characters) with its children in order; ``role`` is its field in the parent."""

    __slots__ = ("type", "start", "end", "kids", "role", "up", "pre", "last", "depth", "ord")

    def __init__(self, type_: str, start: int, end: int, kids: list[Node] | tuple = (), role: str = "") -> None:
        self.type, self.start, self.end, self.role = type_, start, end, role
        self.kids = [k for k in kids if k is not None] if kids else []
        self.up: Node | None = None

    def part(self, role: str) -> Node | None:
        return next((k for k in self.kids if k.role == role), None)

    def of(self, *types: str) -> list[Node]:
        return [k for k in self.kids if k.type in types]


def as_role(node: Node | None, role: str) -> Node | None:
    if node is not None:
        node.role = role
    return node


class Binding:
    """What a declaration gives to selectors: a node and its name; ``kinds`` limits the kinds that see it (None: all)."""

    __slots__ = ("node", "name", "kinds")

    def __init__(self, node: Node, name: str, kinds: tuple[str, ...] | None = None) -> None:
        self.node, self.name, self.kinds = node, name, kinds


def summary(comment: str) -> str:
    """The first line of a comment, without its markers."""
    body = re.sub(r"^(///?|#|/\*\*?)", "", comment.strip())
    return body.removesuffix("*/").strip().split("\n", 1)[0].strip().removeprefix("*").strip()


#: Stands for the type of the root, whatever that is.
ROOT = "(root)"
_LINE_END = re.compile("\n")
COLUMNS = ("pre", "last", "parent", "depth", "ord", "node_type", "field", "start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col", "name", "text", "args", "decl_type", "exported",
           "cand_pre", "is_target", "is_node", "only", "member")


def numbered(root: Node) -> list[Node]:
    """All nodes in document order with ``pre``, ``last``, ``up``, ``depth`` and ``ord`` set; children are put in order of
    their spans."""
    out: list[Node] = []
    root.depth = root.ord = 0
    stack = [root]
    while stack:
        node = stack.pop()
        node.pre = len(out)
        out.append(node)
        kids = node.kids
        if kids:
            if len(kids) > 1:
                kids.sort(key=_span)
            below = node.depth + 1
            for i, k in enumerate(kids):
                k.up, k.depth, k.ord = node, below, i
            stack += reversed(kids)
    for node in reversed(out):
        node.last = node.kids[-1].last if node.kids else node.pre
    return out


_span = attrgetter("start", "end")


def arguments(node: Node, text: str) -> list[str]:
    """Texts of the children of the first list of arguments below ``node``, without comments."""
    for k in node.kids:
        if k.type == "argument_list" or "arguments" in k.type:
            return [text[a.start : a.end] for a in k.kids if a.type != "comment"]
    return []


def rows(root: Node, text: str, language, types: frozenset[str] | None = None, nodes: list[Node] | None = None) -> list[tuple]:
    """One row for each node in the order of ``COLUMNS``, and one more for each node that a declaration binds.

    The row of a node is a target if the declaration is seen as itself by some kind; ``only`` names those kinds (null: all).
    With ``types`` only nodes of these types, and what they bind, have rows; ``ROOT`` is the root's. ``nodes``: ``numbered(root)``.
    """
    nodes = numbered(root) if nodes is None else nodes
    asked = nodes if types is None else [n for n in nodes if n.type in types or (n is root and ROOT in types)]
    if not asked:
        return []
    lines = [0] + [m.end() for m in _LINE_END.finditer(text)]
    if text.isascii():
        at = lambda i: i
    else:
        offsets = [0]
        for c in text:
            offsets.append(offsets[-1] + len(c.encode("utf-8", "surrogatepass")))
        at = offsets.__getitem__

    def place(i: int) -> tuple[int, int]:
        row = bisect_right(lines, i) - 1
        return row, at(i) - at(lines[row])

    out = []

    def row(n: Node, name: str, cand: Node, target: bool, own: bool, only) -> tuple:
        start, end = n.start, n.end
        return (n.pre, n.last, n.up.pre if n.up else None, n.depth, n.ord, cand.type if not own else n.type, n.role, at(start), at(end), *place(start), *place(end), name, text[start:end],
                arguments(n, text) if n.kids else [], language.declared_type(n, text), language.exported(name), cand.pre, target, own, only, language.member(cand, text))

    for n in asked:
        bound = language.bindings(n, text)
        if len(bound) == 1 and bound[0].node is n and bound[0].kinds is None:
            out.append(row(n, bound[0].name or ("" if n is root else "anonymous"), n, True, True, None))
            continue
        own = [b for b in bound if b.node is n]
        only = None if any(b.kinds is None for b in own) else sorted({k for b in own for k in b.kinds}) or None
        out.append(row(n, (own[0].name if own else "") or ("" if n is root else "anonymous"), n, bool(own), True, only))
        out.extend(row(b.node, b.name or "anonymous", n, True, False, list(b.kinds) if b.kinds else None) for b in bound if b.node is not n)
    return out
