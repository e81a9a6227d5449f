"""Quality rules: a ledger of rule failures as bitmasks.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule;
policies (named, versioned sets of rules) are applied to the stored bits afterwards, and ablations are computed from a
count for each mask, which is a small table whatever the number of documents.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import HAS_WORD, fresh, let, table, words

SYMBOLS = "[#*$%&|<>]"

#: Bit of each rule. A bit is never given to another rule, so that stored ledgers stay readable.
BITS = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "capitals": 4, "word_length": 5}

#: Rules of each policy; a document is kept if none of them failed.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length"),
}


@dataclass(frozen=True)
class Limits:
    """Limits of the rules, as whole numbers, so that every comparison is exact."""

    min_words: int = 50
    repeated_words_percent: int = 50
    symbols_percent: int = 8  # of the characters in words
    repeated_lines_percent: int = 70  # of the lines with a word
    capitals_percent: int = 50  # A-Z and other capital letters, of the characters in words
    word_length: tuple[int, int] = (2, 15)  # mean characters in a word


def _repeated_words(of: Column, spare: int = 0) -> Column:
    """Words covered by windows of three words found twice or more in the text.

    Each window becomes one long: its hash in the high bits, its place in as many low bits as the text needs (and ``spare``
    ones). Sorted longs bring equal windows together (a primitive sort); those next to each other with equal hashes are
    compared word by word. Where different windows share a hash, which a long text's few bits allow, one could lie between
    two equal ones: then the windows themselves are sorted, by their words. The places, sorted again, give the covered words.
    """
    shifted = lambda name, x, s: F.call_function(f"shift{name}", x, s)
    three = F.lit(3).cast("long")
    no = F.lit(False)

    def covered(places: Column) -> Column:
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(three, F.coalesce(F.get(p, i + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(F.sort_array(places), gaps)

    def by_words(w: Column, n: Column) -> Column:
        window = lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("i"))
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), no)
        hits = lambda a: covered(F.transform(F.filter(a, lambda x, i: same(x, F.get(a, i + 1)) | same(x, F.get(a, i - 1))), lambda x: x["i"]))
        return let(F.sort_array(F.transform(F.slice(w, F.lit(1), n - 2), window)), hits)

    def flagged(w: Column, n: Column, sorted_: Column, s: Column) -> Column:
        place = lambda x: x.bitwiseAND(shifted("left", F.lit(1).cast("long"), s) - 1)
        word = lambda x, k: F.get(w, place(x).cast("int") + k)

        def next_(x: Column, i: Column) -> Column:
            """1: equal to the next window, 2: another one with the same hash, 0: neither."""
            y = F.get(sorted_, i + 1)
            equal = word(x, 0) == word(y, 0)
            for k in (1, 2):
                equal = equal & (word(x, k) == word(y, k))
            return F.when(shifted("right", x, s) == shifted("right", y, s), F.when(equal, 1).otherwise(2)).otherwise(0)

        def hits(f: Column) -> Column:
            found = F.filter(sorted_, lambda x, i: (F.get(f, i) == 1) | F.coalesce(F.get(f, i - 1) == 1, no))
            return F.when(F.array_contains(f, F.lit(2)), by_words(w, n)).otherwise(covered(F.transform(found, place)))

        return let(F.transform(sorted_, next_), hits)

    def count(w: Column, n: Column, s: Column) -> Column:
        pack = lambda x, i: shifted("left", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), s).bitwiseOR(i.cast("long"))
        return let(F.sort_array(F.transform(F.slice(w, F.lit(1), n - 2), pack)), lambda a: flagged(w, n, a, s))

    bits = lambda n: F.length(F.conv(n.cast("string"), 10, 2)) + spare  # noqa: E731  # that hold every place
    return F.when(F.size(of) < 4, F.lit(0).cast("long")).otherwise(let(of, lambda w: let(F.size(w), lambda n: let(bits(n), lambda s: count(w, n, s)))))


def ledger(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Add the measurements and ``fail_mask`` to every row of ``docs``.

    Null and empty texts have no words: all measurements are 0 and the mask has ``few_words``. Repeated rows are
    measured alike. Columns of ``docs`` whose names clash with the new ones are given up for the new ones.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_repeat_words", "fail_mask"]
    taken = {x.lower() for x in made}
    kept = [c for c in docs.columns if c.lower() not in taken or c == text]
    whole, w, lines = fresh([*docs.columns, *made], "whole", "w", "lines")
    out = docs.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in taken], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))
    out = out.withColumn(w, words(F.col(whole))).withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(HAS_WORD)))
    long = lambda c: c.cast("long")
    out = out.select(
        "*",
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.regexp_count(F.col(whole), F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(lines) - F.size(F.array_distinct(F.col(lines)))).alias("n_dup_lines"),
        long(F.regexp_count(F.col(whole), F.lit(r"\p{Lu}"))).alias("n_capitals"),
        _repeated_words(F.col(w)).alias("n_repeat_words"),
    ).drop(w, lines, whole)
    return out.withColumn("fail_mask", fail_mask(limits))


def fail_mask(limits: Limits = Limits()) -> Column:
    c, x = F.col, limits
    failed = {
        "few_words": c("n_words") < x.min_words,
        "repeated_words": 100 * c("n_repeat_words") > x.repeated_words_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > x.symbols_percent * c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > x.repeated_lines_percent * c("n_lines"),
        "capitals": 100 * c("n_capitals") > x.capitals_percent * c("word_chars"),
        "word_length": (c("word_chars") < x.word_length[0] * c("n_words")) | (c("word_chars") > x.word_length[1] * c("n_words")),
    }
    mask = F.lit(0).cast("long")
    for name, bit in BITS.items():
        mask = mask.bitwiseOR(F.when(failed[name], F.lit(1 << bit)).otherwise(0).cast("long"))
    return mask


def policy_mask(policy: str) -> int:
    return sum(1 << BITS[x] for x in POLICIES[policy])


def apply_policy(ledgered: DataFrame, policy: str = "web-1") -> DataFrame:
    """Add ``kept``: no rule of ``policy`` failed."""
    return ledgered.withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(ledgered: DataFrame, policy: str = "web-1") -> DataFrame:
    """For each rule of ``policy``: failed documents, those that fail it alone, and what the policy keeps without it.

    Documents are counted by mask first (at most 2 to the number of rules rows, whatever the input), so that the
    rules are compared on the counts.
    """
    whole = policy_mask(policy)
    counts = ledgered.groupBy(F.col("fail_mask").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    each = counts.select("m", "n", rules.alias("r")).select("m", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        n(F.col("m").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        n(F.col("m") == F.col("bit"))("n_failed_alone"),
        n(F.col("m") == 0)("n_kept"),
        n(F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document under policy ``web-1``."""
    base = policy_mask("base-1")
    out = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "fail_mask",
        (F.col("fail_mask").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept",
    )


#: n_capitals: Java's \p{Lu} and DuckDB's agree on the letters of assigned scripts.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_capitals,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (100 * n_symbols > 8 * word_chars)::BIGINT + 8 * (100 * n_dup_lines > 70 * n_lines)::BIGINT
             + 16 * (100 * n_capitals > 50 * word_chars)::BIGINT
             + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT)::BIGINT AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, fail_mask,
       fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept FROM f
"""
