"""Merkle manifest of a dataset: levels of digests built bottom-up, proofs pushed down from the root.

Every row is a leaf, every group (a source) a tree, and the groups' roots are the leaves of one more tree. A level is a table
with a row for each node; of ``FAN`` nodes that follow each other the next level has one. Building goes up: a level is
grouped into the next one, and each node keeps the digests below it. Proofs go down: persisted levels join children to
parents, and a child puts its siblings in front of the proof that its parent handed down. So the tables shrink by ``FAN``
from level to level, and the proofs of rows themselves, which are longer than most rows, are made in the last join only.

Rows are numbered by ranges of group and key (``numbered``), so that no group is one task's; a run of ``FAN`` is all that
an aggregate gathers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import numbered, table, written

#: Nodes that have one parent.
FAN = 16
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ``proofs`` adds to rows.
ADDED = ("leaf", "subroot", "root", "proof")
STEP = "array<struct<before:array<string>,after:array<string>>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value its length in bytes, a colon and the value, or a dash for null. No two rows that
    differ in a value have the same input."""
    text = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    joined = lambda xs: F.array_join(xs, "")
    return F.aggregate(proof, start, lambda x, step: digest(joined(step["before"]), x, joined(step["after"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one string, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), "")


@dataclass
class Tree:
    """levels[0] has what the tree was built of, each with group_id, pos, n (nodes of its group on that level) and digest;
    those above have the digests below, ``kids``, too. A group's top is its only node on the lowest level that has one node
    of it. groups: the grouping columns, group_id, n."""

    levels: list[DataFrame]
    groups: DataFrame
    fan: int

    def tops(self) -> DataFrame:
        """group_id and digest of every group's top."""
        found = [x.filter("n = 1").select("group_id", "digest") for x in self.levels]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out


@dataclass
class Manifest:
    rows: Tree
    groups: Tree
    group: str
    key: str
    carry: list[str] = field(default_factory=list)

    def root(self) -> DataFrame:
        """One row with the dataset's root, none for an empty one."""
        return self.groups.tops().select(F.col("digest").alias("root"))


def tree(rows: DataFrame, group: list[str], order: list[str], name: str, fan: int = FAN) -> Tree:
    """The tree of each group over the column ``digest`` of the written table ``rows``: levels until every group has one
    node. A group of one row is its own top; the last run of a level may have fewer nodes, even one."""
    leaves, groups = numbered(rows, group, order, f"{name}_rows")
    levels = [written(leaves, f"{name}_0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = F.floor(F.col("pos") / fan).cast("long").alias("pos")
        runs = levels[-1].filter("n > 1").groupBy("group_id", up, F.ceil(F.col("n") / fan).cast("long").alias("n"))
        kids = F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), "digest"))), lambda x: x["digest"])
        above = runs.agg(kids.alias("kids")).withColumn("digest", digest(F.array_join("kids", "")))
        levels.append(written(above, f"{name}_{len(levels)}"))
        most = -(-most // fan)
    return Tree(levels, groups, fan)


def pushed(built: Tree, tops: DataFrame, name: str) -> DataFrame:
    """levels[0] of ``built`` with ``proof`` and the further columns of ``tops`` (group_id, proof and others): the proof
    that a top has, handed down level by level."""
    given = [c for c in tops.columns if c not in ("group_id", "proof")]
    above = None
    for k in range(len(built.levels) - 1, -1, -1):
        level = built.levels[k]
        got = level.filter("n = 1").join(tops, "group_id")
        if above is not None:
            parents = above.select("group_id", F.col("pos").alias("up"), F.col("kids").alias("run"), F.col("proof").alias("suffix"), *given)
            place = F.col("pos") % built.fan
            step = F.struct(F.slice("run", F.lit(1), place.cast("int")).alias("before"), F.slice("run", place.cast("int") + 2, F.lit(built.fan)).alias("after"))
            below = level.filter("n > 1").withColumn("up", F.floor(F.col("pos") / built.fan).cast("long")).join(parents, ["group_id", "up"])
            below = below.select(*level.columns, F.concat(F.array(step), F.col("suffix")).cast(STEP).alias("proof"), *given)
            got = got.select(*below.columns).unionByName(below)
        above = written(got, f"{name}_proofs_{k}") if k else got
    return above


def build(leaves: DataFrame, key: str = "doc_id", group: str = "source", fan: int = FAN) -> Manifest:
    """The manifest of ``leaves``: rows with ``key``, ``group`` and ``digest``; other columns are carried to the proofs, but
    for those that have the names of what ``proofs`` adds.

    Leaves of a group ascend by key, nulls first; rows with equal keys by digest, and rows equal in both as they are read.
    A null group is one like any other and comes first; groups are ordered by their bytes. An empty table has no root.
    """
    made = {key.lower(), group.lower(), "digest", *ADDED}
    carry = [c for c in leaves.columns if c.lower() not in made]
    own = [F.col(f"`{group}`").alias("of"), F.col(f"`{key}`").alias("key"), "digest", *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)]]
    rows = written(leaves.select(*own).withColumn("as_read", F.monotonically_increasing_id()), "leaves")
    of_rows = tree(rows, ["of"], ["key", "digest", "as_read"], "rows", fan)
    tops = of_rows.tops().join(of_rows.groups.select("of", "group_id"), "group_id").select(F.lit(0).alias("all"), F.col("group_id").alias("of_group"), "of", "digest")
    of_groups = tree(written(tops, "tops"), ["all"], ["of"], "groups", fan)
    return Manifest(of_rows, of_groups, group, key, carry)


def proofs(made: Manifest) -> DataFrame:
    """Every leaf with its proof: group, key, leaf, subroot, root, proof and what was carried. proof is an array with a step
    for each level, from the leaf up: the digests before and after its own among the children of one parent."""
    start = made.groups.tops().select("group_id", F.array().cast(STEP).alias("proof"), F.col("digest").alias("root"))
    tops = pushed(made.groups, start, "groups").select(F.col("of_group").alias("group_id"), "proof", F.col("digest").alias("subroot"), "root")
    rows = pushed(made.rows, written(tops, "tops_with_proofs"), "rows")
    named = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(made.carry)]
    return rows.select(F.col("of").alias(made.group), F.col("key").alias(made.key), F.col("digest").alias("leaf"), "subroot", "root", "proof", *named)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what proofs say of rows that were changed: of a fifth of all, A-Z in lower case."""
    docs = table(spark, sf_dir, "documents")
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*changed))
    leaves = docs.select("doc_id", "source", leaf(*FIELDS).alias("digest"), tampered.alias("tampered"))
    found = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = proofs(build(leaves)).select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, base: str, levels: int) -> str:
    """CTEs ``name``0 to ``name``<levels> of (g, p, n, d), and for those above 0 the run of digests below, l."""
    out = [f"{name}0 AS ({base})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT g, p // {FAN} AS p, any_value((n + {FAN - 1}) // {FAN}) AS n, list(d ORDER BY p) AS l,
CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {name}{k} GROUP BY g, p // {FAN})""")
    return ",\n".join(out)


def sql(levels: int = 5, levels_of_groups: int = 3) -> str:
    """The result in SQL, for groups of up to 16 ** levels rows."""
    item = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf_ = lambda text: f"sha256({' || '.join(item(text if c == 'text' else c) for c in FIELDS)})"
    steps = " ".join(f"LEFT JOIN a{k} ON a{k}.g = r.g AND a{k}.p = r.p // {FAN ** k}" for k in range(1, levels + 1))
    steps += " LEFT JOIN b0 ON b0.source IS NOT DISTINCT FROM r.source " + " ".join(f"LEFT JOIN b{k} ON b{k}.p = b0.p // {FAN ** k}" for k in range(1, levels_of_groups + 1))
    sizes = [(f"a{k}.l", f"(r.p // {FAN ** (k - 1)}) % {FAN}", f"r.n > {FAN ** (k - 1)}") for k in range(1, levels + 1)]
    sizes += [(f"b{k}.l", f"(b0.p // {FAN ** (k - 1)}) % {FAN}", f"b0.n > {FAN ** (k - 1)}") for k in range(1, levels_of_groups + 1)]
    before = lambda l, p: f"array_to_string({l}[1:{p}], '')"  # noqa: E731,E741
    after = lambda l, p: f"array_to_string({l}[{p} + 2:], '')"  # noqa: E731,E741
    proof = " || ".join(f"CASE WHEN {c} THEN {before(l, p)} || {after(l, p)} ELSE '' END" for l, p, c in sizes)
    ctes, last = [], "x0"
    for i, (_, _, _) in enumerate(sizes):
        ctes.append(f"x{i + 1} AS (SELECT * REPLACE (CASE WHEN c{i} THEN sha256(b{i} || f || e{i}) ELSE f END AS f) FROM x{i})")
        last = f"x{i + 1}"
    parts = ", ".join(f"{c} AS c{i}, coalesce({before(l, p)}, '') AS b{i}, coalesce({after(l, p)}, '') AS e{i}" for i, (l, p, c) in enumerate(sizes))
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    return f"""WITH r AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, source, doc_id, d, t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY source) AS n
FROM (SELECT doc_id, source, {leaf_('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf_(f"translate(text, '{UPPER}', '{LOWER}')")} END AS t FROM documents)),
{_levels("a", "SELECT g, p, n, d FROM r", levels)},
{_levels("b", f"SELECT 0 AS g, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS p, count(*) OVER () AS n, a{levels}.d AS d, s.source FROM (SELECT DISTINCT g, source FROM r) s JOIN a{levels} ON a{levels}.g = s.g", levels_of_groups)},
x0 AS (SELECT doc_id, r.d AS leaf, b0.d AS subroot, b{levels_of_groups}.d AS root, sha256({proof}) AS proof_sha256, coalesce(t, r.d) AS f, {parts} FROM r {steps}),
{", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {last}"""


OP13_SQL = sql()
