"""Name patterns, path globs and captures as Java regular expressions, compiled once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def name_regex(pattern: str) -> str | None:
    """Whole-string pattern: ``*`` and ``?`` do not cross ``/``, ``[a-z]`` and ``[^a]`` are classes, ``\\`` escapes; None if
    the pattern is malformed (it then matches nothing)."""
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == n:
                return None
            out += _literal(pattern[i])
        elif c == "[":
            end = _class(pattern, i)
            if end is None:
                return None
            body, i = end
            out += body
        else:
            out += _literal(c)
        i += 1
    return out


def _class(pattern: str, i: int) -> tuple[str, int] | None:
    """The class that begins at ``i``, and the place of its closing bracket."""
    i, n = i + 1, len(pattern)
    negated = i < n and pattern[i] == "^"
    i += negated
    parts = ""

    def one(i: int) -> tuple[str, int] | None:
        if i >= n or pattern[i] in "-]":
            return None
        if pattern[i] == "\\":
            i += 1
            if i >= n:
                return None
        return pattern[i], i + 1

    while True:
        if i < n and pattern[i] == "]" and parts:
            return f"[{'^' if negated else ''}{parts}]", i
        low = one(i)
        if low is None:
            return None
        lo, i = low
        hi = lo
        if i < n and pattern[i] == "-":
            high = one(i + 1)
            if high is None:
                return None
            hi, i = high
        if lo <= hi:
            parts += _literal(lo) + (f"-{_literal(hi)}" if hi != lo else "")
        else:
            parts += "&&[^\\x{0}-\\x{10FFFF}]"  # an empty range


def full_match(text: Column, regex: str | None) -> Column:
    return F.lit(False) if regex is None else text.rlike(f"(?s)\\A(?:{regex})\\z")


def matches(text: Column, pattern: str) -> Column:
    """Name pattern against ``text``: empty and ``*`` match all; a pattern with ``$`` is a capture pattern."""
    if pattern in ("", "*"):
        return F.lit(True)
    return full_match(text, capture_regex(pattern)[0] if "$" in pattern else name_regex(pattern))


def capture_regex(pattern: str) -> tuple[str, list[str]]:
    """Regex and capture names: ``$id`` takes as little as it can, or all that is left where it ends the pattern; ``*`` is
    anything, ``/`` too; a ``$`` without a name is itself. A name given twice keeps its last capture."""
    out, names, i = "", [], 0
    while i < len(pattern):
        found = re.match(r"\$([A-Za-z_][A-Za-z0-9_]*)", pattern[i:], re.ASCII)
        if found:
            i += found.end()
            names.append(found[1])
            out += "(.+)" if i == len(pattern) else "(.+?)"
            continue
        out += ".*" if pattern[i] == "*" else _literal(pattern[i])
        i += 1
    return out, names


def captures(text: Column, pattern: str) -> dict[str, Column]:
    """Capture name to column, for texts that match."""
    regex, names = capture_regex(pattern)
    return {name: F.regexp_extract(text, f"(?s)\\A(?:{regex})\\z", i) for i, name in enumerate(names, 1)}


QUOTES = "\"'` \t\r\n"


def trimmed(text: Column) -> Column:
    """Without the quotes and white space around it."""
    return F.regexp_replace(text, "^[\"'`\\s]+|[\"'`\\s]+$", "")


def text_matches(text: Column, pattern: str) -> Column:
    """Attribute pattern against a node's text, both trimmed: with ``*``, ``?`` or ``[`` the whole text, else a part of it."""
    want = pattern.strip(QUOTES)
    if any(c in want for c in "*?["):
        return full_match(trimmed(text), name_regex(want))
    return trimmed(text).contains(want)


def literal_prefix(pattern: str) -> str:
    """What every name that a pattern matches begins with; '' where that is not plain to see."""
    found = re.match(r"[A-Za-z0-9_ .:-]*", pattern)[0]
    return found if "|" not in pattern else ""


def path_regex(glob: str) -> str | None:
    """Path globs: ``**`` crosses ``/``, ``**/`` matches no directory too, ``{a,b}`` are alternatives; else as names."""
    if depth := re.search(r"\{([^{}]*)\}", glob):
        parts = [path_regex(glob[: depth.start()] + x + glob[depth.end() :]) for x in depth[1].split(",")]
        return None if None in parts else "|".join(f"(?:{p})" for p in parts)
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + (".*" if i == 0 and len(glob) == 2 else "[^/]*"), i + 2
        else:
            j = i + 1
            while j < len(glob) and not glob.startswith("**", j) and not glob.startswith("/**", j):
                j += 1
            part = name_regex(glob[i:j])
            if part is None:
                return None
            out, i = out + part, j
    return out


def glob_matches(path: Column, glob: str) -> Column:
    """A glob against a path relative to the scope's root; globs without ``/`` are tried on the last name, too."""
    whole = full_match(path, path_regex(glob))
    return whole | full_match(F.substring_index(path, "/", -1), path_regex(glob)) if "/" not in glob else whole


def in_scope(path: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> Column:
    """Excludes win, for the path and for any folder above it; without includes all else is in."""
    out = F.lit(not include)
    for glob in include:
        out = out | glob_matches(path, glob)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    for glob in exclude:
        out = out & ~_any_matches(above, glob)
    return out


def _any_matches(paths: Column, glob: str) -> Column:
    return F.exists(paths, lambda p: glob_matches(p, glob))
