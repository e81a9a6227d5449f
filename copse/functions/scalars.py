"""Languages by extension, depths, pages of results and log levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension (fixed values).
EXTENSIONS = {
    ".go": "go", ".mod": "go", ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".php": "php", ".phtml": "php", ".php4": "php", ".php5": "php", ".phps": "php", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".dart": "dart", ".clj": "clojure", ".ml": "ocaml",
    ".hs": "haskell", ".elm": "elm", ".ex": "elixir", ".erl": "erlang",
}

LEVELS = ("debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")


def language(path: Column, explicit: str = "") -> Column:
    """By the last extension only; ``unknown`` without one that is known. Added languages come first."""
    from copse.providers import registry

    if explicit:
        return F.lit(explicit)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in (EXTENSIONS | registry.extensions()).items() for x in kv])[ext], F.lit("unknown"))


def depth(path: Column) -> Column:
    """Folders above a path relative to the root."""
    return F.size(F.split(path, "/")) - 1


def page(df: DataFrame, order: list[str], cursor: str = "", limit: int = 50, largest: int = 200) -> tuple[DataFrame, str]:
    """A page of rows in ``order`` from the offset that ``cursor`` says, and the next page's cursor."""
    if cursor and not cursor.isdigit():
        raise ValueError(f"bad cursor {cursor!r}")
    n, start = min(limit if limit > 0 else 50, largest), int(cursor or 0)
    return df.orderBy(*order).offset(start).limit(n), str(start + n)


def at_least(level: Column, least: str) -> Column:
    """Whether a log level is ``least`` or above; unknown ones count as info."""
    rank = F.create_map(*[x for i, name in enumerate(LEVELS) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(rank[F.lower(level)], F.lit(LEVELS.index("info"))) >= (LEVELS.index(least) if least in LEVELS else LEVELS.index("info"))


def utf8(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are replaced (``decode`` would fail the query)."""
    return F.make_valid_utf8(content.cast("string"))


def with_defaults(text: Column, defaults: dict[str, object]) -> Column:
    """A JSON object as text, with those of ``defaults`` that it lacks, keys in order. A key whose value is null has it; null,
    malformed and other values than objects give the defaults alone."""
    import json

    raw = F.map_from_arrays(F.array(*map(F.lit, defaults)).cast("array<string>"), F.array(*[F.lit(json.dumps(v)) for v in defaults.values()]).cast("array<string>"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.coalesce(F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), empty)
    merged = F.map_concat(F.map_filter(raw, lambda k, _: ~F.map_contains_key(own, k)), own)
    pairs = F.array_sort(F.map_entries(merged))
    quoted = lambda k: F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6)
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))
