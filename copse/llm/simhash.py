"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32, and a table for each segment holds the fingerprints by its value.
At most two differing bits leave one segment within one bit: small Hamming balls within the segments are enumerated, the
matches fetched from the tables, and verified by their complete distance. A slot of a table that holds many fingerprints
(a group of near copies) is split by the other segment, so that no group gives all its pairs; see ``links``.

Equal fingerprints are one row from the start, and components are found by alternating large-star and small-star steps
over tables in the shared folder; nothing but a count reaches the driver.

``similar`` verifies what two bits link by the Jaccard similarity of the texts' shingles and adds the links that two bits
miss, for stages that remove near-duplicates: what two bits link is practically exact copies only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.llm.common import among, discard, fresh, in_batches, table, written

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text whose words are held at a time, about.
PIECE = 1 << 20


def _words(text: str | None, size: int, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a whole text, A-Z lower-cased, in lists that overlap by ``size - 1`` words, so that each shingle is in
    one of them. Lists with fewer words than a shingle are left out, but for a text that has no more."""
    data, at, held, given = (text or "").encode(), 0, [], False
    while at < len(data):
        end = at + piece
        if end < len(data):
            end = found.start() if (found := _SPACE.search(data, end)) else len(data)
        held += data[at:end].translate(_LOWER).split()  # bytes are split at U+0020 and U+0009 to U+000D
        at = end
        if len(held) >= size:
            yield held
            held, given = held[len(held) - size + 1 :], True
    if held and not given:
        yield held


def _joined(words: list[bytes], size: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*[words[k:] for k in range(size)])) if len(words) >= size else iter([b" ".join(words)])


def fingerprint(text: str | None, size: int = 3, piece: int = PIECE) -> int:
    """SimHash of the ``size``-word shingles of a whole text, A-Z lower-cased; 0 without words.

    Each shingle counts as often as it occurs; a bit is set if it is set in over half of their XXH64 (seed 42).
    """
    n, total = 0, np.zeros(64, np.int64)
    for words in _words(text, size, piece):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, _joined(words, size), repeat(42))), np.uint8).reshape(-1, 8)
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 16):
            total += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True) if n else 0


def fingerprints(text: Column, size: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, size) for x in texts], dtype="int64")

    return of(text)


#: Fingerprints of a table's slot that are read one by one, at most; larger slots are split by the other segment.
SLOT = 64


def links(prints: DataFrame, distance: int = 2, slot: int = SLOT) -> DataFrame:
    """From distinct fingerprints (``fp``) edges (a, b), a < b, at ``distance`` or fewer bits (0 to 2) that connect all
    that are linked.

    Two tables hold the fingerprints by their high and their low 32 bits. Of two linked fingerprints either the high
    segments are within one bit (at a distance of 2; else equal) or the low ones are equal: each fingerprint looks up that
    Hamming ball of its segment in the table, and what it finds is verified by the complete distance. A slot of more than
    ``slot`` fingerprints (a group of near copies with one segment in common) is not read through but split by the
    other segment: a fingerprint that is off in the first one by a bit looks up the ball of the other one, too; those of
    the slot itself meet at the centre between them, and each is linked with the smallest that it meets there. A centre
    has 33 fingerprints at most, so that edges are in proportion to the group and no link is lost.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a small table whose rows become many
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    masks = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << i for i in range(32)))])
    ball = lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m))
    entry = lambda which, v, other: F.struct(F.lit(which).alias("part"), v.alias("value"), other.alias("other"))
    entries = prints.select("fp", F.explode(F.array(entry(0, high, low), entry(1, low, high))).alias("e")).select("fp", "e.*")
    near = F.transform(ball(high), lambda v: entry(0, v, low)) if distance == 2 else F.array(entry(0, high, low))
    probes = prints.select(F.col("fp").alias("probe"), F.explode(F.concat(near, F.array(entry(1, low, high)))).alias("e")).select("probe", "e.*")
    large = written(entries.groupBy("part", "value").count().filter(F.col("count") > slot).select("part", "value"), "large_slots")
    slots, at = ["part", "value"], F.col("value")
    apart = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp")))
    found = probes.drop("other").join(entries.drop("other").join(large, slots, "left_anti"), slots).select("probe", "fp")
    inside = entries.join(large, slots, "left_semi")
    outside = probes.join(large, slots, "left_semi")
    if distance == 2:
        outside = outside.filter(F.when(F.col("part") == 0, F.call_function("shiftrightunsigned", F.col("probe"), F.lit(32)) != at).otherwise(F.lit(False)))
        centres = inside.select("part", "value", "fp", F.explode(ball(F.col("other"))).alias("centre")).groupBy("part", "value", "centre").agg(F.collect_list("fp").alias("met"))
        found = found.union(centres.filter("size(met) > 1").select(F.array_min("met").alias("probe"), F.explode("met").alias("fp")))
    outside = outside.select("probe", "part", "value", F.explode(ball(F.col("other"))).alias("other"))
    found = found.union(outside.join(inside, ["part", "value", "other"]).select("probe", "fp"))
    found = found.filter((F.col("probe") != F.col("fp")) & (apart <= distance))
    return found.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b")).distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs) but the roots: root is the smallest node connected to it.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until every node has one edge, to a node that has
    none itself. Each is a minimum by node, which is combined before the shuffle, and a join to it whose skewed keys Spark
    can split. Every step is a table in the shared folder, and goes when the next round is written.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    k = 0
    while not _are_stars(edges):
        k += 1
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()  # each larger neighbour to the least
        large = written(large, f"{name}_{k}_large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, f"{name}_{k}_small")
        discard(before, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and those that are pointed at have none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("from").alias("from"), F.max("to").alias("to")).filter("from > 1 or (from > 0 and to > 0)").isEmpty()


def grouped(docs: DataFrame, distance: int = 2, size: int = 3, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``: the smallest key reachable.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal keys are kept; a null key
    is larger than any other, and the id of a component of null keys is null. ``carry``: columns of the result, all of
    ``docs`` if not given; those that clash give way to the new ones.
    """
    made = ("fingerprint", "component_id")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    fp, id_ = fresh([*kept, *made], "fp", "id")
    name = lambda c: F.col(f"`{c}`")
    with in_batches(docs.sparkSession):
        rows = written(docs.select(*map(name, kept), fingerprints(name(text), size).alias(fp), name(key).alias(id_)), "fingerprints")
    least = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id_).alias("first")), "prints")  # one row for each distinct fingerprint
    roots = components(links(least.select("fp"), distance))
    of = written(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    ids_of = of.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(of.join(ids_of, "root").select(F.col("fp").alias("fp_of_class"), "component_id"), "classes")
    out = rows.join(classes, F.col(fp) == F.col("fp_of_class"))
    return out.select(*map(name, kept), F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = 5, piece: int = PIECE) -> np.ndarray:
    """Hashes of the distinct ``size``-word shingles of a whole text as signed longs, ascending: the XXH64 of the words,
    mixed in their order. A text of fewer words is one shingle, one without words has a shingle of its own."""
    parts = []
    for words in _words(text, size, piece):
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        n, out = max(1, len(h) - size + 1), np.zeros(1, np.uint64)
        for k in range(min(size, len(h))):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        parts.append(out)
    return np.unique(np.concatenate(parts).view(np.int64)) if parts else np.zeros(1, np.int64)


def _overlap(n: int, t: Fraction) -> int:
    """Shingles that a set of ``n`` has in common with any other of similarity ``t`` or more, at least (rounded up)."""
    return -(-n * t.numerator // t.denominator)


def _spare(n: int) -> int:
    return 1 + n // 10


def head(n: int, t: Fraction) -> int:
    """How many of its smallest hashes a set of ``n`` has in its head. As ``n - _overlap`` hashes at most are missing in a
    similar set, the heads of both share ``_spare`` of the smaller size, at least."""
    return n - _overlap(n, t) + _spare(n)


def tries(n: int, t: Fraction) -> int:
    """How many of its head, the rarest first, a set tries: one of them at least is tried by each similar set, too. A
    similar set has ``_overlap`` hashes or more, so that both heads share ``_spare`` of that."""
    return head(n, t) - _spare(_overlap(n, t)) + 1


#: Sets that try the same hash and are compared by pairs, at most; and sets and hashes of a block where there are more, about.
GROUP, BLOCK, BLOCK_HASHES = 64, 256, 1 << 18
#: Hashes of a block that are compared at a time.
COLUMNS = 4096


def in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``a`` and each of ``b`` have in common (sets are without repeats)."""
    sizes = [len(x) for x in (*a, *b)]
    values, column, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    order = order[count[column[order]] > 1]  # the others are in one set only
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, len(values) + COLUMNS, COLUMNS))
    for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
        if start < end:
            part = np.zeros((len(sizes), COLUMNS), np.float32)
            part[row[start:end], column[start:end] - k * COLUMNS] = 1
            out += part[: len(a)] @ part[len(a) :].T
    return out


def in_blocks(members: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (a, b) among the sets of each large group (members: h, held, total, set_id, root; sets: set_id, hashes) that
    have different roots. A group's sets are dealt to blocks, as many as its sets and their hashes (total) ask for, and each
    two of its blocks (a block and itself, too) are one row that a task compares; memory is bounded by two blocks."""
    up, down = t.numerator, t.denominator
    dealt = members.withColumn("blocks", F.ceil(F.greatest(F.col("held") / BLOCK, F.col("total") / BLOCK_HASHES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.hint("merge"), "set_id").groupBy("h", "block", "blocks").agg(F.collect_list(F.struct("set_id", "root", "hashes")).alias("sets"))
    dealt = written(dealt, "blocks")
    left = dealt.select("h", F.col("sets").alias("x"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(dealt.select("h", "block", F.col("sets").alias("y")).hint("merge"), ["h", "block"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                ids, roots, hashes = [], [], []
                for side in (x, y):
                    side = side.values
                    ids.append(side.field("set_id").to_numpy())
                    roots.append(side.field("root").to_numpy())
                    hashes.append([h.values.to_numpy() for h in side.field("hashes")])
                n = [np.array([len(h) for h in z]) for z in hashes]
                close = (up + down) * in_common(*hashes).astype(np.int64) >= up * (n[0][:, None] + n[1][None, :])
                i, j = np.nonzero(close & (roots[0][:, None] != roots[1][None, :]))
                a, b = ids[0][i], ids[1][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    with in_batches(members.sparkSession, 2):
        out = written(pairs.mapInArrow(run, "a long, b long").distinct(), "links_in_blocks")
    discard(dealt)
    return out


def similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id (the key), set_id (of the text's set of shingles) and component_id of every row of ``docs`` with a key: rows are
    linked if the Jaccard similarity of their sets of ``size``-word shingles is ``similarity`` (0.5 to 1) or more, and
    component_id is the smallest key reachable. Texts without words are equal.

    Texts whose SimHashes of these shingles are within two bits are found first, by multi-index hashing (``links``), and
    verified by their sets. What is similar beyond two bits, as most pairs near 0.8 are, comes from prefix filtering:
    it loses no pair, so that both together give exactly the links of that similarity. Each set's smallest hashes (``head``) are counted over all sets, those that are
    in no other head are left, and of the others each set tries its rarest (``tries``), so that a passage that many texts
    share does not bring them together unless they have little else. Sets that try the same hash are candidates: each with
    one set in the middle first (four different ones over all hashes), then all that are in different components by then.
    Candidates are cut down by what their heads tell of the hashes that only one of them has, and those that are left are
    verified with their whole sets. A large group of near copies so has pairs in proportion to its size. Where more than
    ``GROUP`` sets that try a hash are still apart, all that can be said without losing a link is how similar each two are:
    their sets are compared in blocks (``in_blocks``), of which links come out, not pairs.
    """
    t = Fraction(str(similarity))
    if not Fraction(1, 2) <= t <= 1:
        raise ValueError("similarity must be from 0.5 to 1")
    up, down = t.numerator, t.denominator
    spark = docs.sparkSession
    digests = lambda sets: np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)

    @F.pandas_udf("set_id long, n int, head array<long>, fp long")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(x, size) for x in texts]
        return pd.DataFrame({"set_id": digests(sets), "n": [len(s) for s in sets], "head": [s[: head(len(s), t)] for s in sets], "fp": [fingerprint(x, size) for x in texts]})

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # opaque to the planner, which would run a function over all texts to test its result for nulls
        for batch in batches:
            sets = [shingles(x.as_py(), size) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set_id", "hashes"])

    @F.pandas_udf(T.LongType())
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int64")

    # the same sizes as those of _overlap, _spare, head and tries
    whole = lambda x: F.floor(x).cast("int")
    overlap = lambda n: whole((n * up + (down - 1)) / down)
    spare = lambda n: whole(n / 10) + 1
    headed = lambda n: n - overlap(n) + spare(n)
    in_vain = lambda n: spare(overlap(n)) - 1
    joint = lambda n, m: F.ceil((n + m) * up / (up + down))  # noqa: E731  # hashes that similar sets of n and m have in common, at least

    keyed = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null")
    with in_batches(spark):
        rows = written(keyed.select("id", sketch("text").alias("s")).select(F.monotonically_increasing_id().alias("row"), "id", "s.*"), "sets")
    least = written(rows.groupBy("set_id").agg(F.min(F.struct("id", "row", "fp")).alias("first")).select("set_id", "first.*"), "least")  # one row for each distinct set
    copies = rows.select("set_id", "row").join(least.select("set_id", F.col("row").alias("first")), "set_id").filter("row <> first").select("row")
    once = among(rows, written(copies, "copies"), "row", "left_anti")
    heads = once.select("set_id", "n", F.element_at("head", -1).alias("last"), F.posexplode("head").alias("place", "h"))
    counts = heads.groupBy("h").agg(F.count("*").alias("held")).filter("held > 1")  # combined before the shuffle
    held = heads.join(counts, "h")
    rare = held.groupBy("set_id", "n", "last").agg(F.sort_array(F.collect_list(F.struct("held", "h", "place"))).alias("hs"))
    own = headed(F.col("n")) - F.size("hs")  # hashes of the head that are in no other head: the rarest, tried in vain
    tried = F.transform(F.slice("hs", F.lit(1), F.greatest(F.lit(0), F.size("hs") - in_vain(F.col("n")))), lambda x: x["h"])
    shared = F.sort_array(F.transform("hs", lambda x: F.struct(x["h"].alias("h"), x["place"].alias("place"))))
    rare = written(rare.select("set_id", "n", "last", own.alias("own"), tried.alias("tried"), shared.alias("shared")), "shared_heads")
    probes = rare.select("set_id", F.struct("n", "last", "own").alias("of"), F.explode("tried").alias("h"))

    def possible(a: Column, b: Column) -> Column:
        """What sizes tell, and the hashes of the head that ends first (the other set has no more of these) that are in no
        other head at all."""
        fits = up * F.greatest(a["n"], b["n"]) <= down * F.least(a["n"], b["n"])
        spared = lambda x, y: (x["last"] > y["last"]) | (x["own"] <= x["n"] - joint(x["n"], y["n"]))
        return fits & spared(a, b) & spared(b, a)

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        """Whole sets (set_id, hashes) of ``ids`` (set_id, id), from the texts."""
        schema = T.StructType([keyed.schema["id"], *T._parse_datatype_string("set_id long, hashes array<long>").fields])
        with in_batches(spark):
            sets = among(keyed, ids.select("id"), "id", "left_semi").select("id", "text").mapInArrow(complete, schema)
            return written(sets.join(ids.hint("merge"), ["set_id", "id"], "left_semi").dropDuplicates(["set_id"]).drop("id"), name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of ``pairs`` (a, b, of_a, of_b) those that are similar."""
        pairs = candidates = written(pairs.filter(possible(F.col("of_a"), F.col("of_b"))).select("a", "b", F.col("of_a.n").alias("n_a"), F.col("of_b.n").alias("n_b")).distinct(), f"{name}_candidates")
        for x in ("a", "b"):
            pairs = pairs.join(rare.select(F.col("set_id").alias(x), F.col("shared").alias(f"in_{x}")).hint("merge"), x)
        # up to the largest hash that both have, the places in both heads tell how many hashes only one of them has
        both = F.array_intersect("in_a.h", "in_b.h")
        at = lambda x, h: F.element_at(F.col(f"in_{x}.place"), F.array_position(F.col(f"in_{x}.h"), h).cast("int")) + 1
        found = pairs.withColumn("both", both).filter("size(both) > 0").withColumn("top", F.element_at("both", -1))
        spared = lambda x: at(x, F.col("top")) - F.size("both") <= F.col(f"n_{x}") - joint(F.col("n_a"), F.col("n_b"))
        pairs = likely = written(found.filter(spared("a") & spared("b")).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n")), f"{name}_likely")
        discard(candidates)
        ids = written(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(least, "set_id").select("set_id", "id"), f"{name}_ids")
        sets = sets_of(ids, f"{name}_sets")
        with in_batches(spark):
            for x in ("a", "b"):
                pairs = pairs.join(sets.select(F.col("set_id").alias(x), F.col("hashes").alias(f"of_{x}")).hint("merge"), x)
            out = written(pairs.filter((up + down) * common("of_a", "of_b") >= up * F.col("n")).select("a", "b"), name)
        discard(likely, ids, sets)
        return out

    # a text that others are copies of has nothing of its own: it comes first, but for every other hash
    alone = F.when(F.pmod("h", F.lit(2)) == 0, F.col("of.own") / headed(F.col("of.n"))).otherwise(0.0)
    middle = probes.groupBy("h").agg(F.min(F.struct(alone.alias("alone"), F.xxhash64("set_id", F.pmod("h", F.lit(4))).alias("r"), "set_id", "of")).alias("m"))
    stars = probes.join(middle, "h").filter("m.set_id <> set_id").select(F.col("set_id").alias("x"), F.col("m.set_id").alias("y"), F.col("of").alias("of_x"), F.col("m.of").alias("of_y"))
    first = F.col("x") < F.col("y")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    # sets whose SimHashes are within two bits: with equal ones each and the first, with others the first of both
    prints = written(least.groupBy("fp").agg(F.min("set_id").alias("of_print")), "prints")
    equal = least.join(prints, "fp").filter("set_id <> of_print").select(F.col("set_id").alias("x"), F.col("of_print").alias("y"))
    first_of = lambda c, x: prints.select(F.col("fp").alias(c), F.col("of_print").alias(x))
    hashed = equal.union(links(prints.select("fp")).join(first_of("a", "x"), "a").join(first_of("b", "y"), "b").select("x", "y"))
    for x in ("x", "y"):
        hashed = hashed.join(rare.select(F.col("set_id").alias(x), F.struct("n", "last", "own").alias(f"of_{x}")), x)
    stars = stars.unionByName(hashed.select("x", "y", "of_x", "of_y"))
    near = verified(stars.select(pick("x", "y", "a"), pick("y", "x", "b"), pick("of_x", "of_y", "of_a"), pick("of_y", "of_x", "of_b")), "near")
    roots = components(near).withColumnsRenamed({"node": "set_id"})
    placed = written(probes.join(roots, "set_id", "left").select("h", "set_id", "of", F.coalesce("root", "set_id").alias("root")), "placed")
    apart = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"), F.sum("of.n").alias("total")).filter("low < high")
    apart = written(apart.select("h", "held", "total"), "apart")
    few = placed.join(apart.filter(F.col("held") <= GROUP).drop("total"), "h")
    side = lambda x: few.select("h", F.col("set_id").alias(x), F.col("of").alias(f"of_{x}"), F.col("root").alias(f"root_{x}"))
    far = verified(side("a").join(side("b"), "h").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))), "far")
    many = written(placed.join(apart.filter(F.col("held") > GROUP), "h").select("h", "held", "total", "set_id", "root"), "large_groups")
    edges = near.union(far)
    discard(rare, placed, apart)
    if not many.isEmpty():
        ids = written(many.select("set_id").distinct().join(least, "set_id").select("set_id", "id"), "large_groups_ids")
        sets = sets_of(ids, "large_groups_sets")
        edges = edges.union(in_blocks(many, sets, t))
        discard(ids, sets)
    discard(many)
    roots = components(edges).withColumnsRenamed({"node": "set_id"})
    of = written(least.join(roots, "set_id", "left").select("set_id", F.col("id").alias("first"), F.coalesce("root", "set_id").alias("root")), "roots")
    ids_of = of.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(of.join(ids_of, "root").select("set_id", "component_id"), "classes")
    return rows.select("id", "set_id").join(classes, "set_id").select("id", "set_id", "component_id")


def deduplicated(docs: DataFrame, distance: int = 2, size: int | None = None, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of each component: that with the smallest key (of rows with equal keys and equal texts, one).

    Components are those of ``grouped`` at ``distance`` (of ``size`` 3 if not given) or, where ``similarity`` is given,
    those of ``similar`` (of ``size`` 5 if not given).
    Rows of a component that repeat its smallest key are all kept if their texts differ. Rows with a null key can't be told
    apart and are all kept.
    """
    if similarity is None:
        ids = grouped(docs, distance, size or 3, key, text, [key]).select(F.col(f"`{key}`").alias("id"), "component_id")
    else:
        ids = similar(docs, similarity, size or 5, key, text).select("id", "component_id")
    ids = written(ids.filter("id is not null"), "ids")
    gone = written(ids.filter("id <> component_id").select(F.col("id").alias(key)).distinct(), "gone")
    twice = written(ids.groupBy(F.col("id").alias(key)).count().filter("count > 1").select(key), "keys_of_several_rows")
    kept = among(docs, gone, key, "left_anti")
    return among(kept, twice, key, "left_anti").unionByName(among(kept, twice, key, "left_semi").dropDuplicates([key, text]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at two bits."""
    return grouped(table(spark, sf_dir, "documents"), carry=["doc_id"])
