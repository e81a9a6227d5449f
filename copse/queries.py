"""Registered queries over the star-schema and text tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions import patterns, scalars
from copse.operators import capabilities, ledger, recipe, rewrite, safety, score, sessions
from copse.plans.forest import Forest, placed, projected
from copse.selector import parse
from copse.sources import files, shared, tables, writer
from copse.sources.tables import read
from copse.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def names(forest: Forest, selector: str) -> DataFrame:
    return forest.select(parse(selector)).select("doc", "kind", "name")


def simple(name: str, source, selector: str, sql: str, **options) -> None:
    """A query that gives doc, kind and name of what ``selector`` matches in the forest of ``source``."""
    register(name, sql)(lambda spark, d: names(source(spark, d, **options), selector))


CUSTOMER = "SELECT c_custkey AS doc, 'customer' AS kind, c_name AS name FROM customer"

# selection by kind and name, attributes
simple("q_select_glob", tables.parts, "part:small*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_name, 'small[^/]*')")
simple("q_glob_slash", tables.pages, "page:http*example*", "SELECT page_id AS doc, 'page' AS kind, url AS name FROM pages WHERE regexp_full_match(url, 'http[^/]*example[^/]*')")
simple("q_glob_path", tables.pages, "page:http*//*.example.com/en/*", r"SELECT page_id AS doc, 'page' AS kind, url AS name FROM pages WHERE regexp_full_match(url, 'http[^/]*//[^/]*\.example\.com/en/[^/]*')")
simple("q_glob_class", tables.parts, "part:[a-s]*[^a-d]", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_name, '(?s)[a-s][^/]*[^a-d]')")
simple("q_attr_source", tables.parts, "part:* source=red", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE contains(p_name || ' ' || p_brand || ' ' || p_type, 'red') OR contains(p_name, 'red')")
simple("q_attr_arg", tables.parts, "part:* arg=blue", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(x, 'blue'))) > 0")
simple("q_attr_argn", tables.parts, "part:* arg1=w*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(string_split(p_name, ' ')[2], 'w[^/]*')")
simple("q_attr_type", tables.parts, "part:* type=Brand#1*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_brand, 'Brand#1[^/]*')")
simple("q_attr_unknown", tables.parts, "part:small* color=none", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_name, 'small[^/]*')")
simple("q_not", tables.parts, "!part:small*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE NOT regexp_full_match(p_name, 'small[^/]*')")
simple("q_not_compound", tables.parts, "!(part:small* | part:large*)", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE false")
simple("q_or", tables.parts, "part:small* | part:* type=Brand#2*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_name, 'small[^/]*') OR regexp_full_match(p_brand, 'Brand#2[^/]*')")
simple("q_and", tables.parts, "part:s* & part:* type=Brand#2*", "SELECT p_partkey AS doc, 'part' AS kind, p_name AS name FROM part WHERE regexp_full_match(p_name, 's[^/]*') AND regexp_full_match(p_brand, 'Brand#2[^/]*')")

# structural joins
F_ORDER = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"
R_LINE = "EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_linestatus = 'O')"
simple("q_contains_descendant", tables.customers, "customer:* > line:* returnflag=R linestatus=O", f"{CUSTOMER} WHERE {R_LINE}")
simple("q_contains_nested_attr", tables.customers, "customer:* mktsegment=BUILDING > order:* orderstatus=F > line:* returnflag=R",
       f"{CUSTOMER} WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND l_returnflag = 'R')")
simple("q_contains_direct", tables.customers, "customer:* >> order:* orderstatus=F", f"{CUSTOMER} WHERE {F_ORDER}")
simple("q_direct_skips", tables.customers, "customer:* >> line:*", f"{CUSTOMER} WHERE false")
simple("q_transparent", tables.customers, "customer:* >> line:* returnflag=A", f"{CUSTOMER} WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'A')", transparent=("order",))
simple("q_contains_nested", tables.regions, "region:A* > nation:* > customer:* mktsegment=BUILDING",
       "SELECT DISTINCT n_nationkey::BIGINT AS doc, 'region' AS kind, r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name LIKE 'A%' AND c_mktsegment = 'BUILDING'")
simple("q_and_cross_kind", tables.customers, "customer:* & order:*", f"{CUSTOMER} WHERE false")
simple("q_not_in_contains", tables.customers, "customer:* > !order:* orderstatus=F", f"{CUSTOMER} WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
simple("q_distribute", tables.customers, "(customer:* mktsegment=BUILDING | customer:* mktsegment=MACHINERY) > order:* orderstatus=P",
       f"{CUSTOMER} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
simple("q_or_contains", tables.customers, "customer:* > (order:* orderstatus=P | line:* returnflag=R linestatus=O)",
       f"{CUSTOMER} WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR {R_LINE}")

# order of siblings
TURN = "SELECT conv_id AS doc, role AS kind, turn::VARCHAR AS name FROM conversations c"
simple("q_before", tables.conversations, "user:* before=assistant:*", f"{TURN} WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'assistant' AND o.turn > c.turn)")
simple("q_after", tables.conversations, "user:* after=assistant:*", f"{TURN} WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'assistant' AND o.turn < c.turn)")
simple("q_before_invalid", tables.conversations, "user:* before=assistant", f"{TURN} WHERE false")
simple("q_attr_text", tables.conversations, "assistant:* text=the", rf"{TURN} WHERE role = 'assistant' AND contains(regexp_replace(text, '^[\"''`\s]+|[\"''`\s]+$', '', 'g'), 'the')")
simple("q_attr_text_glob", tables.conversations, "user:* text=T*", rf"{TURN} WHERE role = 'user' AND regexp_full_match(regexp_replace(text, '^[\"''`\s]+|[\"''`\s]+$', '', 'g'), '(?s)T[^/]*')")


@register("q_capture", "SELECT c_custkey AS doc, regexp_extract(c_name, '(?s)^Customer#(.+)$', 1) AS num FROM customer WHERE regexp_matches(c_name, '(?s)^Customer#.+$')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tables.customers(spark, d).select(parse("customer:Customer#$num")).select("doc", F.col("captures")["num"].alias("num"))


@register("q_capture_url", r"SELECT page_id AS doc, regexp_extract(url, '(?s)^(.+?)://(.+?)/(.+)$', 1) AS scheme, regexp_extract(url, '(?s)^(.+?)://(.+?)/(.+)$', 2) AS host, regexp_extract(url, '(?s)^(.+?)://(.+?)/(.+)$', 3) AS rest FROM pages WHERE regexp_matches(url, '(?s)^.+?://.+?/.+$')")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = tables.pages(spark, d).select(parse("page:$scheme://$host/$rest"))
    return found.select("doc", *[F.col("captures")[x].alias(x) for x in ("scheme", "host", "rest")])


LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS k FROM documents)"


@register("q_expand_dedup", f"WITH {LINES} SELECT doc, line AS name, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc ORDER BY k)::BIGINT - octet_length(encode(line)) - 1 AS start_byte, octet_length(encode(line))::BIGINT AS n_bytes FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = tables.lines(spark, d).select(parse("line:* | line:*"))
    return found.select("doc", "name", F.col("start_byte").cast("long"), (F.col("end_byte") - F.col("start_byte")).alias("n_bytes"))


TAGS = r"""tok AS (SELECT page_id AS doc, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^<>]*>|[^<]+|<') AS x FROM pages)),
spot AS (SELECT *, sum(strlen(token)) OVER w - strlen(token) AS s, sum(len(token) - len(replace(token, chr(10), ''))) OVER w - (len(token) - len(replace(token, chr(10), ''))) AS row,
coalesce(max(CASE WHEN contains(token, chr(10)) THEN e + strlen(token) - strlen(regexp_extract(token, '[^\n]*$')) END) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
FROM (SELECT *, sum(strlen(token)) OVER (PARTITION BY doc ORDER BY k) - strlen(token) AS e FROM tok) WINDOW w AS (PARTITION BY doc ORDER BY k)),
tag AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS k), s - line AS col, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS name FROM spot WHERE regexp_matches(token, '^</?[A-Za-z]')),
formed AS (SELECT *, CASE WHEN starts_with(token, '</') THEN 'close' WHEN name IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') OR ends_with(token, '/>') THEN 'void' WHEN name IN ('script', 'style') THEN 'whole' ELSE 'open' END AS form FROM tag),
deep AS (SELECT *, sum(CASE form WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc, name ORDER BY k) AS d FROM formed),
low AS (SELECT *, least(0, min(d) OVER (PARTITION BY doc, name ORDER BY k)) AS m FROM deep), lagged AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY doc, name ORDER BY k), 0) AS b FROM low),
levels AS (SELECT *, CASE WHEN form = 'open' THEN d - m WHEN form = 'close' AND m = b THEN d - m + 1 END AS level FROM lagged),
pairs AS (SELECT *, CASE WHEN level IS NULL THEN NULL WHEN form = 'open' THEN lead(k) OVER w ELSE lag(k) OVER w END AS partner FROM levels WINDOW w AS (PARTITION BY doc, name, level ORDER BY k))"""


@register("q_project", f"WITH {LINES}, o AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc ORDER BY k)::BIGINT AS e FROM l) SELECT doc, 'line' AS type, line AS name, k::INT AS line, 1 AS column, k::INT AS end_line, (octet_length(encode(line)) + 1)::INT AS end_column, e - octet_length(encode(line)) - 1 AS start_byte, e - 1 AS end_byte FROM o WHERE contains(line, 'License')")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a license, with their places found in the whole texts."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return projected(placed(tables.lines(spark, d).select(parse("line:* text=License")), texts)).drop("content", "captures")


@register("q_project_tags", f"WITH {TAGS} SELECT doc, 'tag' AS type, name, (row + 1)::INT AS line, (col + 1)::INT AS column, s::BIGINT AS start_byte FROM pairs WHERE form <> 'close' AND NOT (form = 'open' AND partner IS NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return projected(tables.tags(spark, d).select(parse("tag:*"))).select("doc", "type", "name", "line", "column", "start_byte")


@register("q_tags_within", f"WITH {TAGS} SELECT a.doc, a.name, a.s::BIGINT AS start_byte FROM pairs a WHERE a.form = 'open' AND a.partner IS NOT NULL AND a.name = 'ul' AND EXISTS (SELECT 1 FROM pairs b WHERE b.doc = a.doc AND b.name = 'a' AND b.form = 'open' AND b.partner IS NOT NULL AND b.k > a.k AND b.k <= a.partner)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tables.tags(spark, d).select(parse("tag:ul > tag:a")).select("doc", "name", "start_byte")


@register("q_scope", "SELECT o_custkey AS doc, l_orderkey || '-' || l_linenumber AS name, 'customer:' || c_name || '/order:' || o_orderkey AS scope, o_orderkey::VARCHAR AS nearest FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines with all that encloses them, and the nearest of it."""
    forest = tables.customers(spark, d)
    found = forest.enclosing(forest.select(parse("line:* returnflag=R linestatus=F")), parse("customer:* | order:*"))
    path = F.array_join(F.transform("scope", lambda x: F.concat_ws(":", x["kind"], x["name"])), "/")
    return found.select("doc", "name", path.alias("scope"), F.element_at("scope", -1)["name"].alias("nearest"))


@register("q_scope_regions", "SELECT n_nationkey::BIGINT AS doc, c_name AS name, r_name AS region, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, d: str) -> DataFrame:
    forest = tables.regions(spark, d)
    found = forest.enclosing(forest.select(parse("customer:* mktsegment=BUILDING")), parse("region:* | nation:*"))
    return found.select("doc", "name", F.get("scope", F.lit(0))["name"].alias("region"), F.get("scope", F.lit(1))["name"].alias("nation"))


@register("q_inherited", "SELECT o_custkey AS doc, l_orderkey || '-' || l_linenumber AS name, c_mktsegment AS inherited FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'A'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the segment that they have from what encloses them: orders have none, so it is the customer's."""
    forest = tables.customers(spark, d)
    return forest.inherited(forest.select(parse("line:* returnflag=A")), "mktsegment", parse("customer:* | order:*")).select("doc", "name", "inherited")


@register("q_match_counts_by_doc", "SELECT c_custkey AS doc, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return names(tables.customers(spark, d), "order:* orderstatus=F").groupBy("doc").agg(F.count("*").alias("n"))


@register("q_unique_docs", "SELECT count(*) AS n_matches, count(DISTINCT o_custkey) AS n_docs FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return names(tables.customers(spark, d), "order:* orderstatus=F").agg(F.count("*").alias("n_matches"), F.countDistinct("doc").alias("n_docs"))


# scopes over paths
PATHS = r"p AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path FROM pages)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]*://([^?#]*)", 1).alias("path"))


@register("q_scope_globs", rf"WITH {PATHS} SELECT page_id, path FROM p WHERE regexp_full_match(path, '([^/]+/)*en/[^/]*') AND NOT regexp_full_match(path, '([^/]*\.example\.net)(/.*)?')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).filter(patterns.in_scope(F.col("path"), ["**/en/*"], ["*.example.net/**"]))


@register("q_max_depth", f"WITH {PATHS} SELECT page_id, path FROM p WHERE len(string_split(path, '/')) - 1 <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).filter(scalars.depth(F.col("path")) <= 2)


@register("q_max_files", f"WITH {PATHS} SELECT page_id, path FROM p ORDER BY string_split(path, '/'), page_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.first_files(paths(spark, d), 50, "page_id")


@register("q_lang_stats", "SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.language_stats(read(spark, d, "documents").withColumnRenamed("lang", "language"))


@register("q_detect_language", r"""WITH e AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '(\.[^./]+)$', 1)) AS ext FROM pages)
SELECT CASE WHEN ext = '.php' THEN 'php' WHEN ext = '.js' THEN 'javascript' ELSE 'unknown' END AS language, count(*) AS n FROM e GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select(scalars.language(F.col("path")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@register("q_validate", f"""WITH {TAGS}, w AS (SELECT doc, k, name, 'Syntax error at line ' || (row + 1)::BIGINT || ', column ' || (col + 1)::BIGINT AS message FROM pairs WHERE form IN ('open', 'close') AND partner IS NULL)
SELECT doc, count(*)::INT AS n, string_agg(message, '; ' ORDER BY k) AS messages, string_agg(name, ' ' ORDER BY k) AS names FROM w GROUP BY doc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Pages with tags that are not closed, or close nothing: where each is, and its name."""
    forest = tables.tags(spark, d)
    bad = forest.elements.filter("node_type = 'ERROR'").groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_byte", "name"))), lambda x: x["name"]), " ").alias("names"))
    return forest.errors().join(bad, "doc").select("doc", F.size("errors").alias("n"), F.array_join("errors", "; ").alias("messages"), "names")


# rewriting: lines of documents that name a license
HIT = "contains(line, 'License')"
PIECE = {"replace": "CASE WHEN hit THEN '[gone]' ELSE line END", "delete": "CASE WHEN hit THEN '' ELSE line END",
         "insert_before": "CASE WHEN hit THEN regexp_extract(line, '^[ \t]*') || '// x' || chr(10) || line ELSE line END",
         "insert_after": "CASE WHEN hit THEN line || chr(10) || regexp_extract(line, '^[ \t]*') || '// x' ELSE line END"}
for _method, _piece in PIECE.items():
    SQL[f"q_{_method}_digest"] = f"""WITH {LINES}, h AS (SELECT *, {HIT} AS hit FROM l)
SELECT doc, count(*) FILTER (hit) AS match_count, sha256(string_agg({_piece}, chr(10) ORDER BY k)) AS digest, octet_length(encode(string_agg({_piece}, chr(10) ORDER BY k)))::INT AS n_bytes FROM h GROUP BY doc HAVING bool_or(hit)"""
    QUERIES[f"q_{_method}_digest"] = lambda spark, d, m=_method: rewrite.transform(tables.lines(spark, d), m, parse("line:* text=License"), {"replace": "[gone]"}.get(m, "// x")).select(
        "doc", "match_count", F.sha2("modified", 256).alias("digest"), F.octet_length("modified").alias("n_bytes"))

SQL["q_append_digest"] = f"""WITH {LINES}, h AS (SELECT *, {HIT} AS hit, min(CASE WHEN {HIT} THEN k END) OVER (PARTITION BY doc) AS first FROM l)
SELECT doc, count(*) FILTER (hit) AS match_count, sha256(string_agg(CASE WHEN k = first THEN line || chr(10) || chr(10) || '// x' ELSE line END, chr(10) ORDER BY k)) AS digest FROM h GROUP BY doc HAVING bool_or(hit)"""
QUERIES["q_append_digest"] = lambda spark, d: rewrite.transform(tables.lines(spark, d), "append", parse("line:* text=License"), "// x").select("doc", "match_count", F.sha2("modified", 256).alias("digest"))
SQL["q_append_root_digest"] = "SELECT doc_id AS doc, 0::BIGINT AS match_count, sha256(text || chr(10) || chr(10) || 'end') AS digest FROM documents"
QUERIES["q_append_root_digest"] = lambda spark, d: rewrite.append_to_root(tables.lines(spark, d), "end").select("doc", "match_count", F.sha2("modified", 256).alias("digest"))


# confidence
SCORED = f"""{LINES}, m AS (SELECT doc, count(*) FILTER ({HIT}) AS n, sum(octet_length(encode(line)) + 1) - 1 AS old, sum(octet_length(encode(CASE WHEN {HIT} THEN '' ELSE line END)) + 1) - 1 AS new FROM l GROUP BY doc),
b AS (SELECT *, least(1, greatest(0, 1.0::DOUBLE + CASE WHEN n = 1 THEN 0.1 WHEN n > 5 THEN -0.3 ELSE 0 END - 0.1 - 0.15)) AS base FROM m WHERE n > 0),
s AS (SELECT doc, n AS match_count, least(1, greatest(0, base - CASE WHEN n > 3 THEN 0.1 ELSE 0 END - CASE WHEN old > 0 AND new > 0 AND abs(new - old) / old > 0.3 THEN 0.1 ELSE 0 END)) AS score FROM b)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.transform(tables.lines(spark, d), "delete", parse("line:* text=License"), "")


@register("q_confidence", f"WITH {SCORED} SELECT doc, match_count, round(score, 4)::DOUBLE AS score, CASE WHEN round(score, 9) < 0.5 THEN 'low' WHEN round(score, 9) < 0.8 THEN 'medium' ELSE 'high' END AS level FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc", "match_count", F.round("confidence.score", 4).alias("score"), F.col("confidence.level").alias("level"))


@register("q_confidence_rollup", f"""WITH {SCORED}, a AS (SELECT avg(score) AS mean, count(*) AS n, min(score) AS least FROM s),
r AS (SELECT least(1, greatest(0, mean - CASE WHEN least < 0.7 THEN 0.1 ELSE 0 END - CASE WHEN n > 10 THEN 0.1 ELSE 0 END)) AS score, n FROM a)
SELECT round(score, 6)::DOUBLE AS score, n AS files_modified, CASE WHEN round(score, 9) < 0.5 THEN 'low' WHEN round(score, 9) < 0.8 THEN 'medium' ELSE 'high' END AS level FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    details = _scored(spark, d).select(F.lit(True).alias("modified"), F.col("confidence.score").alias("score"), F.lit("").alias("error"))
    return score.rollup(details).select(F.round("score", 6).alias("score"), "files_modified", "level")


# the ledger: events as stages of their users' sessions
CUTOFF = "2024-01-15 00:00:00"
SESSIONS = "g AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("stg_"), "event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("operation"), F.col("ts").alias("created_at"), F.col("props").alias("original"), F.concat("props", F.lit("!")).alias("modified"), F.round(F.col("value") % 1, 4).alias("score"))


@register("q_stage_build", "SELECT 'stg_' || event_id AS id, user_id::VARCHAR AS session_id, sha256(props) AS base_digest, sha256(props || '!') AS after_digest, 'pending' AS status, floor(epoch(ts + INTERVAL 15 MINUTE))::BIGINT AS expires FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = ledger.build(_requests(spark, d))
    return s.select("id", "session_id", "base_digest", "after_digest", "status", F.unix_timestamp(F.col("expires_at").cast("timestamp")).alias("expires"))


@register("q_stage_limit", f"WITH {SESSIONS} SELECT 'stg_' || event_id AS id, user_id::VARCHAR AS session_id FROM g WHERE k <= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.admit(ledger.build(_requests(spark, d)), 3).filter("admitted").select("id", "session_id")


@register("q_stage_expire", f"SELECT CASE WHEN ts + INTERVAL 15 MINUTE < TIMESTAMP '{CUTOFF}' THEN 'expired' ELSE 'pending' END AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.expire(ledger.build(_requests(spark, d)), F.lit(CUTOFF).cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"))


@register("q_stage_latest", "SELECT user_id::VARCHAR AS session_id, arg_max('stg_' || event_id, ts) AS id FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(ledger.build(_requests(spark, d))).select("session_id", "id")


def _applied(spark: SparkSession, d: str):
    s = ledger.build(_requests(spark, d))
    return s, ledger.applies_of(s.filter("operation = 'purchase'"), F.col("created_at"), True)


@register("q_apply_join", "SELECT user_id::VARCHAR AS session_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, a = _applied(spark, d)
    return ledger.apply_counts(s, a)


@register("q_apply_left_join", "SELECT 'stg_' || event_id AS id, CASE WHEN event_type = 'purchase' THEN 'stg_' || event_id END AS stage_id FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, a = _applied(spark, d)
    return ledger.with_applies(s, a).select("id", "stage_id")


@register("q_apply_all", f"WITH {SESSIONS} SELECT 'stg_' || event_id AS id, CASE WHEN event_type = 'purchase' THEN 'not_pending' WHEN ts + INTERVAL 15 MINUTE < TIMESTAMP '{CUTOFF}' THEN 'expired' ELSE 'ok' END AS outcome FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, a = _applied(spark, d)
    return ledger.outcomes(ledger.mark_applied(s, a), F.lit(CUTOFF).cast("timestamp_ntz")).select("id", "outcome")


def _all_outcomes(spark: SparkSession, d: str, stop: bool) -> DataFrame:
    """What applying all that is left of each user's stages comes to; errors and those that are over by the cutoff fail."""
    s = ledger.build(_requests(spark, d))
    out = ledger.outcomes(s, F.lit(CUTOFF).cast("timestamp_ntz")).withColumn("outcome", F.when(F.col("operation") == "error", "changed").otherwise(F.col("outcome")))
    return ledger.attempted(out, stop).select("id", "outcome")


OUTCOME = f"CASE WHEN event_type = 'error' THEN 'changed' WHEN ts + INTERVAL 15 MINUTE < TIMESTAMP '{CUTOFF}' THEN 'expired' ELSE 'ok' END"
register("q_apply_all_skip", f"SELECT 'stg_' || event_id AS id, {OUTCOME} AS outcome FROM events")(lambda spark, d: _all_outcomes(spark, d, stop=False))
register("q_apply_all_stop", f"""WITH o AS (SELECT 'stg_' || event_id AS id, user_id, ts, {OUTCOME} AS outcome FROM events)
SELECT id, CASE WHEN max(outcome <> 'ok') OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'not_attempted' ELSE outcome END AS outcome FROM o""")(lambda spark, d: _all_outcomes(spark, d, stop=True))


@register("q_sessions", """SELECT user_id::VARCHAR AS session_id, floor(epoch(min(ts)))::BIGINT AS started, floor(epoch(max(ts)))::BIGINT AS last, floor(epoch(max(ts) FILTER (event_type = 'error')))::BIGINT AS ended,
count(*) FILTER (event_type = 'view') AS stages_count, count(*) FILTER (event_type = 'purchase') AS applies_count, max({'ts': ts, 'props': props})['props'] AS client FROM events GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Counters of users' sessions from batches that come out of order, some of them twice, and are compacted in between."""
    e = read(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for x in ("view", "stage", "purchase", "apply", "error", "end")])[F.col("event_type")]
    events = e.select("event_id", F.col("user_id").cast("string").alias("session_id"), F.coalesce(kind, F.lit("other")).alias("kind"), F.col("ts").alias("at"), F.col("props").alias("client"))
    kept = sessions.Sessions(spark, shared.shared_path(spark, "sessions"))
    for k in (2, 0, 1, 0, None, 2, 3, 1, 3):
        kept.compact() if k is None else kept.merge(k, events.filter(F.col("event_id") % 4 == k).drop("event_id"))
    seconds = lambda c: F.unix_timestamp(c).alias(c.removesuffix("_at"))
    return kept.table().select("session_id", seconds("started_at"), seconds("last_at"), seconds("ended_at"), "stages_count", "applies_count", "client")


@register("q_ledger_lookup", "SELECT 'stg_' || event_id AS id, user_id::VARCHAR AS session_id FROM events WHERE event_id IN (1, 42, 777, 100000007)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Stages by id out of a table that is dealt to folders by their hash."""
    where = shared.shared_path(spark, "stages_by_id")
    ledger.save(ledger.build(_requests(spark, d)).select("id", "session_id", "status", "created_at"), where, 16)
    return ledger.lookup(spark.read.parquet(where), [f"stg_{x}" for x in (1, 42, 777, 100000007)], 16).select("id", "session_id")


@register("q_changes", """WITH o AS (SELECT doc_id::VARCHAR AS uri, md5(text) AS mark FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT doc_id::VARCHAR AS uri, md5(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS mark FROM documents WHERE doc_id % 5 <> 2),
m AS (SELECT coalesce(o.uri, n.uri) AS uri, o.uri IS NULL OR n.uri IS NULL AS listed, n.uri IS NULL AS gone, o.mark AS a, n.mark AS b FROM o FULL JOIN n ON o.uri = n.uri)
SELECT uri, CASE WHEN gone THEN 'removed' ELSE 'updated' END AS type FROM m WHERE listed OR a <> b UNION ALL SELECT NULL, 'list_changed' WHERE EXISTS (SELECT 1 FROM m WHERE listed)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Events between two listings of the documents: some are gone, some are new, some have another text."""
    docs, key = read(spark, d, "documents"), F.col("doc_id").cast("string").alias("uri")
    old = docs.filter("doc_id % 7 <> 3").select(key, F.md5("text").alias("mark"))
    new = docs.filter("doc_id % 5 <> 2").select(key, F.md5(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("mark"))
    return changes.compared(old, new)


# safety, logs, recipes, scalars
@register("q_safety_validate", """SELECT source, count(*) AS n_files, max(octet_length(encode(text)))::BIGINT AS largest, sum(octet_length(encode(text)))::BIGINT AS total,
CASE WHEN count(*) > 100 THEN 11002 WHEN max(octet_length(encode(text))) > 15000 THEN 11003 WHEN sum(octet_length(encode(text))) > 110000 THEN 11003 ELSE 0 END AS code FROM documents GROUP BY source""")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.col("source").alias("batch"), F.octet_length("text").cast("long").alias("size"), F.lit(1.0).alias("confidence"))
    out = safety.validate(files, safety.Limits(max_files=100, max_file_size=15_000, max_total_size=110_000))
    return out.select(F.col("batch").alias("source"), "n_files", "largest", "total", "code")


@register("q_integrity", "SELECT a.doc_id AS path FROM documents a WHERE a.lang = 'en'")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    now = docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    expected = docs.select(F.col("doc_id").alias("path"), F.sha2(F.concat("text", F.when(F.col("lang") == "en", "x").otherwise("")), 256).alias("expected_hash"))
    return safety.integrity(now, expected).select("path")


@register("q_tx_summary", "SELECT event_type AS status, count(*) AS n, count(*) FILTER (value > 50) AS n_errors FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return writer.summary(read(spark, d, "events").select(F.col("event_type").alias("status"), F.when(F.col("value") > 50, "late").otherwise("").alias("error")))


@register("q_recipe", f"""WITH {LINES}, m AS (SELECT doc, count(*) FILTER ({HIT}) AS a, count(*) FILTER (regexp_full_match(line, 'The[^/]*')) AS b FROM l GROUP BY doc)
SELECT 'drop' AS step, 1 AS k, count(*) AS scanned, count(*) FILTER (a > 0) AS modified, sum(a)::BIGINT AS matches FROM m
UNION ALL SELECT 'mark', 2, count(*), count(*) FILTER (b > 0), sum(b)::BIGINT FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    steps = [recipe.Step("drop", "delete", parse("line:* text=License"), min_confidence=0.0), recipe.Step("mark", "replace", parse("line:The*"), "marked", min_confidence=0.0)]
    return recipe.preview(tables.lines(spark, d), steps).select("step", "k", "scanned", "modified", "matches")


#: Selectors of a recipe with many steps, and what each is in SQL.
MANY = [("line:* text=License", HIT), ("line:The*", "regexp_full_match(line, 'The[^/]*')"), ("line:*.", r"regexp_full_match(line, '[^/]*\.')"), ("line:A*", "regexp_full_match(line, 'A[^/]*')"), ("line:In*", "regexp_full_match(line, 'In[^/]*')"),
        ("line:Th* text=and", r"regexp_full_match(line, 'Th[^/]*') AND contains(regexp_replace(line, '^[\"''`\s]+|[\"''`\s]+$', '', 'g'), 'and')"), ("line:none at all", "line = 'none at all'"), ("line:La*", "regexp_full_match(line, 'La[^/]*')"),
        ("document:1*", None), ("line:De* | line:Un*", "regexp_full_match(line, '(De|Un)[^/]*')")]
_STEPS = " UNION ALL ".join(f"SELECT 's{k}' AS step, {k} AS k, doc, count(*) AS n FROM l WHERE {x} GROUP BY doc" if x else f"SELECT 's{k}', {k}, doc_id, 1 FROM documents WHERE doc_id::VARCHAR LIKE '1%'" for k, (_, x) in enumerate(MANY, 1))


@register("q_recipe_many", f"""WITH {LINES}, m AS ({_STEPS}), s AS (SELECT unnest(range(1, {len(MANY) + 1})) AS k)
SELECT 's' || s.k AS step, s.k::INT AS k, (SELECT count(*) FROM documents) AS scanned, count(m.doc) AS modified, coalesce(sum(m.n), 0)::BIGINT AS matches FROM s LEFT JOIN m ON m.k = s.k GROUP BY s.k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A dry run of ten steps: all selectors are tried in one pass over the lines."""
    steps = [recipe.Step(f"s{k}", "insert_after", parse(x), "// x", min_confidence=0.0) for k, (x, _) in enumerate(MANY, 1)]
    return recipe.preview(tables.lines(spark, d), steps).select("step", "k", "scanned", "modified", "matches")


@register("q_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scalars.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "100")[0]


@register("q_json_defaults", """SELECT event_id, '{"k":' || (props->>'k') || ',"mode":"dry"}' AS props FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", scalars.with_defaults(F.col("props"), {"mode": "dry", "k": 0}).alias("props"))


@register("q_log_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def _(spark: SparkSession, d: str) -> DataFrame:
    level = F.create_map(*[F.lit(x) for x in ("view", "debug", "click", "info", "signup", "notice", "purchase", "warning", "error", "error")])[F.col("event_type")]
    return read(spark, d, "events").filter(scalars.at_least(level, "warning")).select("event_id", "event_type")


@register("q_capabilities", """WITH m(event_type, name) AS (VALUES ('view', 'replace'), ('click', 'delete'), ('signup', 'insert_before'), ('purchase', 'append')),
c(category, name) AS (SELECT 'operator', unnest(['>>', '>', '&', '|', '!', '(', ')']) UNION ALL SELECT 'method', unnest(['replace', 'delete', 'insert_before', 'insert_after', 'append']) UNION ALL SELECT 'attribute', unnest(['text', 'source', 'arg', 'argN', 'before', 'after', 'type'])),
n AS (SELECT name, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY 1) SELECT category, c.name, CASE WHEN category = 'method' THEN coalesce(n, 0) ELSE 0 END AS n FROM c LEFT JOIN n ON c.name = n.name""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What selectors and requests may hold, and how often the stages of the events' users did which."""
    method = F.create_map(*[F.lit(x) for x in ("view", "replace", "click", "delete", "signup", "insert_before", "purchase", "append")])[F.col("event_type")]
    return capabilities.used(read(spark, d, "events").select(method.alias("operation")).filter("operation is not null"))


# source code: texts made of the tables' rows, parsed by the five parsers
def _code(spark: SparkSession, d: str, language: str) -> DataFrame:
    """One document for each row of a table. Small tables are one partition each, but parsing is work for all cores."""
    table, key, text = CODE[language]
    return read(spark, d, table).repartition(spark.sparkContext.defaultParallelism, key).select(F.col(key).cast("string").alias("doc"), F.lit(language).alias("language"), F.expr(text).alias("source"))


WORD = "regexp_replace({0}, '[^A-Za-z0-9]+', '_')"
#: Language to table, key and the text of a row's document, as SQL.
CODE = {
    "go": ("part", "p_partkey", "concat('package parts\n\ntype P', p_partkey, ' struct {\n\t', " + WORD.format("p_brand") + ", ' string\n\tSize int\n}\n\nfunc Load', p_partkey, '() string {\n\treturn os.Getenv(\"', p_type, '\")\n}\n')"),
    "python": ("orders", "o_orderkey", "concat('def order_', o_orderkey, '():\n    return load(\"', o_orderstatus, '\")\n\n\na, b = 1, 2\n')"),
    "javascript": ("customer", "c_custkey", "concat('class C', c_custkey, ' {\n  render() { return api.fetch(\"', c_mktsegment, '\"); }\n}\n')"),
    "typescript": ("supplier", "s_suppkey", "concat('export class S', s_suppkey, '<T> {\n  get value(): string { return \"', s_name, '\"; }\n  value2(): void {}\n}\n')"),
    "php": ("nation", "n_nationkey", "concat('<?php\nclass N', n_nationkey, ' {\n  public $', " + WORD.format("n_name") + ", ', $region;\n  public function __construct() { }\n}\n')"),
}


def code(name: str, language: str, selector: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return files.select(_code(spark, d, language), parse(selector), (language,)).select("doc", "kind", "name")

    register(name, sql)(run)


code("q_code_go", "go", "struct:* > field:Brand_1* string", r"SELECT p_partkey::VARCHAR AS doc, 'struct' AS kind, 'P' || p_partkey AS name FROM part WHERE regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g') LIKE 'Brand\_1%' ESCAPE '\'")
code("q_code_go_call", "go", "func:Load* > call:os.Getenv", "SELECT p_partkey::VARCHAR AS doc, 'function' AS kind, 'Load' || p_partkey AS name FROM part")
code("q_code_python", "python", "def:order_* > call:load arg0=F", "SELECT o_orderkey::VARCHAR AS doc, 'function' AS kind, 'order_' || o_orderkey AS name FROM orders WHERE o_orderstatus = 'F'")
code("q_code_python_unpacked", "python", "var:b", "SELECT o_orderkey::VARCHAR AS doc, 'variable' AS kind, 'b' AS name FROM orders")
code("q_code_javascript", "javascript", "class:* >> method:render", "SELECT c_custkey::VARCHAR AS doc, 'class' AS kind, 'C' || c_custkey AS name FROM customer")
code("q_code_typescript", "typescript", "getter:*", "SELECT s_suppkey::VARCHAR AS doc, 'getter' AS kind, 'value' AS name FROM supplier")
code("q_code_php", "php", "property:*", "SELECT n_nationkey::VARCHAR AS doc, 'property' AS kind, unnest([regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g'), 'region']) AS name FROM nation")


@register("q_code_capture", "SELECT c_custkey::VARCHAR AS doc, 'api' AS client, 'fetch' AS method FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = files.select(_code(spark, d, "javascript"), parse("call:$client.$method arg0=BUILDING"), ("javascript",))
    return found.select("doc", *[F.col("captures")[x].alias(x) for x in ("client", "method")])


@register("q_code_all_languages", """SELECT 'go' AS language, count(*) AS n FROM part UNION ALL SELECT 'python', count(*) FROM orders
UNION ALL SELECT 'javascript', count(*) FROM customer UNION ALL SELECT 'typescript', 2 * count(*) FROM supplier UNION ALL SELECT 'php', count(*) FROM nation""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    docs = reduce(DataFrame.unionByName, [_code(spark, d, x) for x in CODE])
    return files.select(docs, parse("fn:*")).groupBy("language").agg(F.count("*").alias("n"))


@register("q_code_replace", """WITH t AS (SELECT o_orderkey, 'def order_' || o_orderkey || '():' || chr(10) || '    return load("' || o_orderstatus || '")' || repeat(chr(10), 3) || 'a, b = 1, 2' || chr(10) AS old,
'def kept(): pass' || repeat(chr(10), 3) || 'a, b = 1, 2' || chr(10) AS new FROM orders)
SELECT o_orderkey::VARCHAR AS doc, sha256(new) AS digest, round(1.0::DOUBLE + 0.1 - 0.2 - 0.15 - CASE WHEN abs(length(new) - length(old)) / length(old) > 0.3 THEN 0.1 ELSE 0 END, 4) AS score FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = files.transform(_code(spark, d, "python"), "replace", parse("def:*"), "def kept(): pass", ("python",))
    return made.select("doc", F.sha2("modified", 256).alias("digest"), F.round("confidence.score", 4).alias("score"))


@register("q_walk", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS entry, 'unknown' AS language")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = files.listing(spark, files.Scope(d, include=("**/*.parquet",)))
    return found.select(F.split("path", "/")[0].alias("entry"), "language").distinct()
