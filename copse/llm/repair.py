"""Repair of conversations: the cheapest edits that make roles alternate, by Dial's shortest paths.

A conversation is a walk through layers: before each of its rows, and behind the last, it is in one of four states (nothing
yet, after a system row, a user row, an assistant row). Arcs keep, rerole or delete the next row, or insert an empty one in
between; they cost 0 to 3. Costs that small need no heap: Dial's algorithm keeps a ring of four buckets. It starts from the
end, records the distance of every node to it, and the edits are then walked from the front along tight arcs (whose cost is
the difference of the distances of their ends), the least letter first, which gives the least of all cheapest edits.

Rows are numbered by ranges, and a conversation is cut into segments of ``SEGMENT`` rows, so that none is one task's: the
distances between a segment's ends (16 numbers) are put together from the back, what its ends are then known to cost
decides which state each entry leads to, and these are put together from the front. Texts take no part in it: a row is
its role's first letter and what is wrong with it. They are moved twice, to their edits and in order, and never held.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.llm.common import HAS_WORD, in_batches, numbered, table, written

#: Rows of a conversation that are solved together.
SEGMENT = 4096
#: Cost of each edit: Keep, Rerole, Delete, Insert; and of a truncated row that is not deleted, besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A cost that no path has.
FAR = 1 << 40
#: Of each state (0 nothing yet, 1 after s, 2 after u, 3 after a) the initials that may follow, and the states they lead to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Of each state the role that an inserted or reroled row gets.
GIVEN = ("user", "user", "assistant", "user")
#: What is behind the last row: the distance of each state to the end, which are states 0 and 3.
END = (0, 4, 2, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3
FAULTS = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}


def arcs(state: int, initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows passed, state) of the arcs from ``state`` before a row, by letter."""
    given, more = NEXT[state][GIVEN[state][0]], TRUNCATED if fault == CUT else 0
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, given)]
    if fault not in (BLANK, DUPLICATE):
        if initial in NEXT[state]:
            out.append(("K", KEEP + more, 1, NEXT[state][initial]))
        out.append(("R", REROLE + more, 1, given))
    return out


def distances(rows: tuple[tuple[str, int], ...], end: list[int]) -> list[list[int]]:
    """Of each layer (before each of ``rows``, and behind the last) the distance of its four states to what is behind the
    rows, where ``end`` is known. Nodes are settled in the order of their distance, from a ring of buckets; ends enter it
    when it gets to their distance."""
    back: dict[tuple[str, int], list] = {}
    n = len(rows)
    out = [[FAR] * 4 for _ in range(n)] + [[*end]]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(DELETE + 1)]
    starts = sorted((d, q) for q, d in enumerate(end) if d < FAR)
    at, waiting, entered = starts[0][0] if starts else 0, 0, 0
    while waiting or entered < len(starts):
        if not waiting:
            at = max(at, starts[entered][0])
        while entered < len(starts) and starts[entered][0] == at:
            ring[at % len(ring)].append((n, starts[entered][1]))
            entered, waiting = entered + 1, waiting + 1
        bucket = ring[at % len(ring)]
        while bucket:  # arcs of no cost add to it
            i, q = bucket.pop()
            waiting -= 1
            if out[i][q] != at:
                continue  # a shorter path came first
            into = [(i, p, cost) for p, cost in _back(back, *rows[i])[1][q]] if i < n else []
            if i:
                into += [(i - 1, p, cost) for p, cost in _back(back, *rows[i - 1])[0][q]]
            for j, p, cost in into:
                if at + cost < out[j][p]:
                    out[j][p] = at + cost
                    ring[(at + cost) % len(ring)].append((j, p))
                    waiting += 1
        at += 1
    return out


def _back(known: dict, initial: str, fault: int) -> list[list[list[tuple[int, int]]]]:
    """Of each state the arcs that lead to it as (state, cost): those that pass a row, and those that insert one before it."""
    key = (initial if initial in "sua" else "", fault)
    if key not in known:
        passed, inserted = [[] for _ in range(4)], [[] for _ in range(4)]
        for p in range(4):
            for _, cost, rows, q in arcs(p, *key):
                (passed if rows else inserted)[q].append((p, cost))
        known[key] = [passed, inserted]
    return known[key]


def walk(rows: tuple[tuple[str, int], ...], far: list[list[int]], state: int) -> tuple[str, int]:
    """Letters of the cheapest way from ``state`` through all ``rows``, least first, and the state behind them."""
    letters, i = [], 0
    while i < len(rows):
        for letter, cost, passed, q in arcs(state, *rows[i]):
            if far[i][state] == cost + far[i + passed][q]:
                letters.append(letter)
                i, state = i + passed, q
                break
    return "".join(letters), state


def symbols(rows: list[dict], first: int, size: int) -> tuple[tuple[tuple[str, int], ...], int]:
    """Rows of a segment as (initial, fault), and how many of them are followed by a role that may not follow. ``rows`` also
    has the row behind the segment, if there is one."""
    rows = sorted(rows, key=lambda r: r["pos"])
    pairs = [a["initial"] + b["initial"] for a, b in zip(rows, rows[1:])]
    return tuple((r["initial"], r["fault"]) for r in rows if r["pos"] < first + size), sum(x not in ("su", "ua", "au") for x in pairs)


@functools.lru_cache(1 << 14)
def _short(rows: tuple[tuple[str, int], ...]) -> tuple[list[list[int]], str, int]:
    """Distances, letters and last state of a short conversation: many are alike."""
    far = distances(rows, [*END])
    return far, *walk(rows, far, 0)


def edits(rows: tuple[tuple[str, int], ...], letters: str, state: int, first: int, last: bool) -> list[tuple[int, int, str, str | None]]:
    """(pos, place, letter, role) of each edit in order: a row's own place is behind those inserted before it; role is null where a
    row keeps its own. ``last``: what is missing behind the conversation's last row is inserted."""
    out, i, place = [], 0, 0
    for x in letters:
        if x == "I":
            role = GIVEN[state]
            out.append((first + i, place, x, role))
            state, place = NEXT[state][role[0]], place + 1
            continue
        out.append((first + i, place, x, GIVEN[state] if x == "R" else None))
        state = {"D": state, "R": NEXT[state][GIVEN[state][0]]}.get(x) if x != "K" else NEXT[state][rows[i][0]]
        i, place = i + 1, 0
    while last and state in (1, 2):
        role = GIVEN[state]
        out.append((first + i, place, "I", role))
        state, place = NEXT[state][role[0]], place + 1
    return out


def faulty(rows: DataFrame, conv: str = "conv_id", size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Rows without their texts (row, group_id, pos, n, segment, turn, role and ``fault``, the first that a row has of blank,
    duplicate and truncated), and the conversations (``conv``, group_id, n). ``rows``: a written table of row (an id),
    ``conv``, turn, role and text.

    Rows are ordered by turn (nulls first; rows of the same turn by role, text and row). A row is a duplicate if one
    with its role and text comes before it; the first is a minimum, so that no number of repeats is one task's.
    """
    blank = ~F.col("text").rlike(HAS_WORD)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ended = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(".", "!", "?")
    short = written(rows.select("row", conv, "turn", "role", F.when(~blank, said).alias("said"), ended.alias("ended")), "turns")
    found, groups = numbered(short, [conv], ["turn", "role", "said", "row"], "turns_in_order")
    found = written(found, "numbered_turns")
    first = found.filter("said is not null").groupBy("group_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("times"))
    found = found.join(first.filter("times > 1").select("group_id", "said", "first"), ["group_id", "said"], "left")
    fault = F.when(F.col("said").isNull(), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~F.col("ended"), CUT).otherwise(0)
    kept = found.select("row", "group_id", "pos", "n", F.floor(F.col("pos") / size).cast("long").alias("segment"), "turn", "role", fault.alias("fault"))
    return written(kept, "faulty_turns"), groups


#: What is known of a solved segment: of a conversation's first one, ``cost`` is that of the whole.
SOLVED = "group_id long, segment long, illegal long, cost long, edits array<struct<pos:long,place:int,letter:string,role:string>>"


def solved(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The edits of each segment of the conversations of ``faulty``; illegal counts pairs of adjacent roles, with the next
    segment's first."""
    at = F.when((F.col("pos") % size == 0) & (F.col("pos") > 0), F.array(F.col("segment") - 1, F.col("segment"))).otherwise(F.array("segment"))
    row = F.struct("pos", F.substring("role", 1, 1).alias("initial"), "fault")
    parts = rows.select("group_id", "n", F.explode(at).alias("segment"), row.alias("row")).groupBy("group_id", "n", "segment").agg(F.collect_list("row").alias("rows"))
    parts = written(parts, "segments")
    ends = F.array(*map(F.lit, END)).cast("array<long>")
    ready = parts.filter(F.col("n") <= size).select("group_id", "n", "segment", "rows", ends.alias("ends"), F.lit(0).alias("entry"))

    def each(schema: str, solve: Callable) -> Callable:
        """A function on batches of segments that gives rows of ``schema``, one of ``solve`` for each."""
        types = to_arrow_schema(T._parse_datatype_string(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(p["group_id"], p["segment"], *solve(p, *symbols(p["rows"], p["segment"] * size, size))) for p in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(types)], schema=types)

        return run

    def between(_: dict, own: tuple, __: int) -> tuple:
        by_end = [distances(own, [0 if q == e else FAR for q in range(4)])[0] for e in range(4)]
        return ([by_end[e][q] for q in range(4) for e in range(4)],)

    def leading(part: dict, own: tuple, _: int) -> tuple:
        far = distances(own, part["ends"])
        return ([walk(own, far, q)[1] for q in range(4)],)

    def whole(part: dict, own: tuple, illegal: int) -> tuple:
        if part["n"] <= size:
            far, letters, _ = _short(own)
        else:
            letters, _ = walk(own, far := distances(own, part["ends"]), part["entry"])
        last = (part["segment"] + 1) * size >= part["n"]
        return illegal, far[0][part["entry"]], edits(own, letters, part["entry"], part["segment"] * size, last)

    with in_batches(rows.sparkSession):
        long_ = parts.filter(F.col("n") > size)
        if not long_.isEmpty():
            ways = long_.mapInArrow(each(schema := "group_id long, segment long, between array<long>", between), schema)
            costs = written(ways.groupBy("group_id").applyInArrow(_from_the_back, "group_id long, segment long, ends array<long>"), "ends")
            known = written(long_.join(costs, ["group_id", "segment"]), "segments_with_ends")
            leads = known.mapInArrow(each(schema := "group_id long, segment long, leads array<int>", leading), schema)
            entries = written(leads.groupBy("group_id").applyInArrow(_from_the_front, "group_id long, segment long, entry int"), "entries")
            ready = ready.unionByName(known.join(entries, ["group_id", "segment"]).select(*ready.columns))
        return written(ready.mapInArrow(each(SOLVED, whole), SOLVED), "solved")


def _from_the_back(parts: pa.Table) -> pa.Table:
    """What the states behind each segment of one conversation cost to the end."""
    ways = dict(zip(parts.column("segment").to_pylist(), parts.column("between").to_pylist()))
    ends, out = [*END], {}
    for k in sorted(ways, reverse=True):
        out[k] = ends
        ends = [min(ways[k][4 * q + e] + ends[e] for e in range(4)) for q in range(4)]
    return pa.table({"group_id": parts.column("group_id"), "segment": pa.array(out, pa.int64()), "ends": pa.array(out.values(), pa.list_(pa.int64()))})


def _from_the_front(parts: pa.Table) -> pa.Table:
    """The state before each segment of one conversation."""
    leads = dict(zip(parts.column("segment").to_pylist(), parts.column("leads").to_pylist()))
    state, out = 0, {}
    for k in sorted(leads):
        out[k], state = state, leads[k][state]
    return pa.table({"group_id": parts.column("group_id"), "segment": pa.array(out, pa.int64()), "entry": pa.array(out.values(), pa.int32())})


@dataclass
class Repair:
    """turns: repaired rows (group_id, pos, place, letter, role, text), in the order of pos and place within a conversation; with
    letter D those that are deleted, in I those that are new. report: a row for each conversation that has rows."""

    turns: DataFrame
    report: DataFrame


def repaired(rows: DataFrame, conv: str = "conv_id", size: int = SEGMENT) -> Repair:
    """Repair the conversations of ``rows`` (``conv``, turn, role, text) so that their roles' initials are
    ``(s?(ua)+)?``, at the least cost and of equal costs with the least letters.

    Null roles and texts are one space; a null ``conv`` is a conversation like any other. Blank rows and duplicates are
    deleted, the others kept, reroled or deleted, and empty user and assistant rows are inserted. report has ``conv``,
    group_id, gaps (turns missing between the first and the last; null turns do not count), blank, duplicate, truncated,
    illegal and cost (longs). Other columns of ``rows`` take no part.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    texts = written(rows.select(F.col(f"`{conv}`").alias("conv"), "turn", space("role"), space("text")).withColumn("row", F.monotonically_increasing_id()), "texts")
    found, groups = faulty(texts, "conv", size)
    parts = solved(found, size)
    by_turn = found.groupBy("group_id", "turn").agg(*[F.sum((F.col("fault") == k).cast("long")).alias(x) for x, k in FAULTS.items()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("group_id").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in FAULTS])
    costs = parts.groupBy("group_id").agg(F.sum("illegal").alias("illegal"), F.sum(F.when(F.col("segment") == 0, F.col("cost"))).alias("cost"))
    report = groups.join(counts, "group_id").join(costs, "group_id").select(F.col("conv").alias(conv), "group_id", "gaps", *FAULTS, "illegal", "cost")
    edit = parts.select("group_id", F.explode("edits").alias("e")).select("group_id", "e.pos", "e.place", "e.letter", F.col("e.role").alias("given"))
    own = edit.filter("letter <> 'I'").join(found.select("group_id", "pos", "row"), ["group_id", "pos"])
    own = own.join(texts.select("row", "role", "text"), "row").select("group_id", "pos", "place", "letter", F.coalesce("given", "role").alias("role"), "text")
    turns = own.unionByName(edit.filter("letter = 'I'").select("group_id", "pos", "place", "letter", F.col("given").alias("role"), F.lit("").alias("text")))
    return Repair(turns, report)


def digests(turns: DataFrame) -> DataFrame:
    """group_id, audit (the letters in order) and repaired_sha256 (of ``role:text`` of the rows that are left, joined by line
    ends) of each conversation. Both follow a conversation's order to the end, so that it passes through one task; it
    does so row by row, and only the letters are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, letters, digest, empty = None, [], hashlib.sha256(), True
        for batch in batches:
            done: list[tuple] = []
            for group, letter, line in zip(*(batch.column(c).to_pylist() for c in ("group_id", "letter", "line"))):
                if group != at:
                    if at is not None:
                        done.append((at, "".join(letters), digest.hexdigest()))
                    at, letters, digest, empty = group, [], hashlib.sha256(), True
                letters.append(letter)
                if letter != "D":
                    digest.update((line if empty else "\n" + line).encode())
                    empty = False
            if done:
                yield _batch(done)
        if at is not None:
            yield _batch([(at, "".join(letters), digest.hexdigest())])

    line = F.when(F.col("letter") != "D", F.concat("role", F.lit(":"), "text")).alias("line")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.select("group_id", "pos", "place", "letter", line).repartition(parts, "group_id").sortWithinPartitions("group_id", "pos", "place")
    return dealt.select("group_id", "letter", "line").mapInArrow(run, "group_id long, audit string, repaired_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["group_id", "audit", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``rows`` with faults where the CRC-32 of ``conv_id:turn`` modulo 20 is 0 to 4: a row is
    dropped, emptied, loses its ``[.!?]``, is repeated, has the role user. Nulls are one space to the CRC-32 and in role
    and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = rows.withColumn("kind", kind).filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "kind")
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    made = repaired(damaged(rows))
    report = made.report.join(digests(made.turns), "group_id").drop("group_id").withColumnRenamed("conv_id", "of")
    out = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def sql() -> str:
    """The result in SQL: distances from the back as strings of cost, letters and text, whose least is the cheapest."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda letter, cost, to, said: f"printf('%08d', left({to}, 8)::INT + {cost}) || '{letter}' || split_part(substr({to}, 9), chr(1), 1) || chr(1) || {said} || substr({to}, strpos({to}, chr(1)) + 1)"
    line = lambda role: f"chr(10) || {role} || ':' || text"
    extra = "+ CASE WHEN fault = 3 THEN 1 ELSE 0 END"
    passed, closed = [], []
    for q in range(4):
        to = NEXT[q][GIVEN[q][0]]
        keep = "".join(f" WHEN left(role, 1) = '{x}' THEN {add('K', '0' + extra, f'd.s{t}', line('role'))}" for x, t in NEXT[q].items())
        free = f"least(CASE{keep} END, {add('R', '2' + extra, f'd.s{to}', line(repr(GIVEN[q])))})"
        passed.append(f"least({add('D', '3', f'd.s{q}', repr(''))}, CASE WHEN fault NOT IN (1, 2) THEN {free} END) AS r{q}")
        after = NEXT[to][GIVEN[to][0]]
        one = lambda x, q=q: add("I", "2", x, f"chr(10) || '{GIVEN[q]}:'")
        closed.append(f"least(r{q}, {one(f'r{to}')}, {one('(' + add('I', '2', f'r{after}', f'chr(10) || {GIVEN[to]!r} || chr(58)') + ')')}) AS s{q}")
    ends = ", ".join(f"'{c:08d}' || '{'I' * (c // 2)}' || chr(1)" + "".join(f" || chr(10) || '{r}:'" for r in (("user", "assistant")[2 - c // 2:])) + f" AS s{q}" for q, c in enumerate(END))
    return f"""WITH RECURSIVE d0 AS (SELECT *, {crc} AS kind, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t FROM conversations),
d1 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS k FROM d0 WHERE kind <> 0),
d2 AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS p FROM d1),
rows_ AS (SELECT g, conv_id, turn, role, text, p, CASE WHEN trim(text, {white}) = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY p) > 1 THEN 2 WHEN right(rtrim(text, {white}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
CASE WHEN lead(role) OVER w IS NOT NULL AND left(role, 1) || left(lead(role) OVER w, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM d2 WINDOW w AS (PARTITION BY g ORDER BY p)),
c AS (SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, sum(illegal)::BIGINT AS illegal, max(p) AS n FROM rows_ GROUP BY g),
d(g, p, s0, s1, s2, s3) AS (SELECT g, n, {ends} FROM c UNION ALL
SELECT g, p, {", ".join(closed)} FROM (SELECT d.g, d.p - 1 AS p, {", ".join(passed)} FROM d JOIN rows_ ON rows_.g = d.g AND rows_.p = d.p))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
coalesce(left(s0, 8)::BIGINT, 0) AS cost, coalesce(split_part(substr(s0, 9), chr(1), 1), '') AS audit, sha256(coalesce(substr(s0, strpos(s0, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (c JOIN d ON d.g = c.g AND d.p = 0) ON o.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP11_SQL = sql()
