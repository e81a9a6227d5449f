"""Where appended code goes in Go and TypeScript: beside its like, or inside the class that is meant."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SMART = ("go", "typescript")
#: Go: the first word of what is appended, and the declarations that it goes behind (fixed values).
GO_LIKE = {
    "import": ("import_declaration",), "func": ("function_declaration", "method_declaration"), "type": ("type_declaration",),
    "const": ("type_declaration", "const_declaration"), "var": ("type_declaration", "var_declaration"),
}
#: TypeScript: what begins a declaration of a whole file (fixed values).
TOP_LEVEL = re.compile(r"(import|export|class|abstract class|interface|type|enum|function|async function|const|let|var|namespace|module|declare)\s", re.I)
SCOPES = ("class_declaration", "class_expression", "interface_declaration")


def spaced(text: str, at: int, block: str, blank: bool = True) -> str:
    """``block`` at ``at`` on lines of its own; before it an empty line, unless a line has just ended and ``blank`` is off."""
    before, after = text[:at], text[at:]
    flat = before.rstrip(" \t")
    ended = min(len(flat) - len(flat.rstrip("\n")), 2)
    lead = (2, int(blank), 0)[ended]
    return before + "\n" * lead + block.rstrip("\n") + "\n" + ("\n" if after and after[0] != "\n" else "") + after


def in_go(text: str, content: str) -> str:
    from copse.providers import golang

    block = content.strip()
    word = re.match(r"(import|func|type|const|var)(?=[ ])|func(?=\()", block, re.I)
    like = word[0].lower() if word else "import" if block.startswith('"') and "\n" not in block else ""
    top = golang.parse(text).kids
    if like and like != "import":
        same = [n for n in top if n.type in GO_LIKE[like]]
        if same:
            return spaced(text, same[-1].end, block, like == "func")
    if like:
        imports = [n for n in top if n.type == "import_declaration"]
        package = next((n for n in top if n.type != "comment"), None)
        if imports or (package and package.type == "package_clause"):
            line = block if like != "import" or block.startswith("import") else f"import {block}"
            return spaced(text, (imports[-1] if imports else package).end, line, not imports)
    return spaced(text, len(text), block)


def indent_at(text: str, at: int) -> str:
    return re.match(r"[ \t]*", text[text.rfind("\n", 0, at) + 1 : at])[0]


def inside(text: str, start: int, end: int, content: str) -> str:
    """Before the last closing brace of the span, indented like its members."""
    at = text.rfind("}", start, end)
    if at <= start:
        return text
    outer, head = indent_at(text, start), text[start:at]
    deeper = [i for i in re.findall(r"\n([ \t]*)(?=\S)", head) if len(i) > len(outer)]
    indent = deeper[0] if deeper else outer + ("\t" if "\t" in head else "  ")
    block = "\n".join(x if x.strip() else "" for x in textwrap.dedent(content.strip("\n")).split("\n"))
    body = head[head.find("{") + 1 :]
    ended = len(head.rstrip(" \t"))
    before = text[: start + ended] if head[:ended].endswith("\n") else text[:at]
    newlines = len(before) - len(before.rstrip("\n"))
    lead = 0 if newlines > 1 else int(bool(body.strip())) if newlines else 1
    return before + "\n" * lead + textwrap.indent(block, indent) + "\n" + outer + text[at:]


def in_typescript(text: str, content: str) -> str:
    """Into the only class or interface of the file, if the content is no declaration of a file itself; else at its end."""
    from copse.providers import ecma

    content = content.strip("\n")
    tops = [n.part("declaration") if n.type == "export_statement" and n.part("declaration") else n for n in ecma.parse_typescript(text).kids]
    found = [n for n in tops if n.type in SCOPES]
    if len(found) == 1 and not TOP_LEVEL.match(content.strip()):
        return inside(text, found[0].start, found[0].end, content)
    ended = min(len(text) - len(text.rstrip("\n")), 2)
    return text + "\n" * (2 - ended) + content + "\n"


def placed(language: str, text: str, content: str, span: tuple[int, int] | None) -> str | None:
    """The text with ``content`` in its place; None where it just follows the target. span: the target's bytes, None: the
    whole file."""
    if not content.strip():
        return None
    if span is None:
        return {"go": in_go, "typescript": in_typescript}[language](text, content)
    if language != "typescript":
        return None
    from copse.providers import ecma
    from copse.providers.tree import numbered

    raw = text.encode()
    start, end = (len(raw[:x].decode("utf-8", "replace")) for x in span)
    if any(n.type in SCOPES and (n.start, n.end) == (start, end) for n in numbered(ecma.parse_typescript(text))):
        return inside(text, start, end, content.strip("\n"))
    return None


def placing(language: str, content: str):
    """A function from columns (source, start and end in bytes or None) to the changed text or null."""

    def place(source: Column, start: Column | None = None, end: Column | None = None) -> Column:
        @F.pandas_udf("string")
        def make(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([placed(language, t or "", content, None if x < 0 else (int(x), int(y))) for t, x, y in zip(texts, a, b)], dtype=object)

        none = F.lit(-1).cast("long")
        return make(source, none if start is None else start, none if end is None else end)

    return place
