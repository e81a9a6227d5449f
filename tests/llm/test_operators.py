"""The operators of copse.llm on small tables: nulls, empty and long texts, repeated rows, clashing columns; against SQL or
brute force."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from copse.llm import catalog, linededup, mixing, packing, quality, reputation, rules, sharding, simhash, topk, warc
from copse.llm.common import shared_path, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "house", "river", "é", "ß"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with everything that may go wrong, and columns that clash with the operators' own."""
    rng = random.Random(1)
    shared = "\n".join(prose(rng, 12) for _ in range(4))
    rows = [(1, None, None, None), (2, "", "en", "src0"), (3, " \n\t\n ", "en", "src0"), (4, "word", "en", "src1"), (4, "word", "en", "src1"), (5, "WORD", "en", None), (None, "no key here", "en", "src1"), (None, None, "en", "src2")]
    rows += [(10 + i, f"{prose(rng, 20)}\n{shared}\n{prose(rng, 20)}", "en", "src0") for i in range(8)]
    rows += [(30 + i, "same text again and again\n" * 3, "de", "src3") for i in range(5)]
    rows += [(50, prose(rng, 30_000), "fr", "src4"), (51, "a b c " * 40, "fr", "src4")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({"Score": F.lit("x"), "copy": F.lit("x"), "shard": F.lit("x"), "n_words": F.lit("x"), "fp": F.lit("x"), "component_id": F.lit("x"), "n_deleted": F.lit("x"), "kept": F.lit("x"), "id": F.lit("x"), "bits": F.lit("x")})


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, same, name):
    same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.SQL[name]))


def test_rules(odd):
    out = rules.apply_policy(rules.ledger(odd.drop("kept")))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and rows[1].n_words == 0 and rows[1].fail_mask & 1
    assert rows[51].n_repeat_words == 120 and rows[51].fail_mask & 2 and not rows[51].kept
    assert rows[30].n_dup_lines == 2
    n = rules.ablations(out).collect()
    assert {r.rule for r in n} == set(rules.POLICIES["web-1"]) and all(r.n_kept <= r.n_kept_without for r in n)


def test_repeated_words_against_brute_force(spark):
    """Short texts of few words, and long ones whose places leave few bits for hashes."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += [" ".join(str(rng.randint(0, 150)) for _ in range(3000)), " ".join(map(str, range(500_000))), "x y z " * 30_000]

    def brute(text):
        w, seen = text.split(), {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_repeat_words for r in rules.ledger(df).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]
    # hashes of six bits or none at all: different windows share them everywhere
    for spare in (50, 55):
        few = df.filter("doc_id < 200 or doc_id = 202").select("doc_id", rules._repeated_words(words(F.col("text")), spare).alias("n"))
        assert {r.doc_id: r.n for r in few.collect()} == {i: brute(texts[i]) for i in [*range(200), 202]}


def test_rules_empty(spark):
    assert rules.apply_policy(rules.ledger(spark.createDataFrame([], DOCS))).count() == 0


def test_hosts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q", None, "none", "ftp://x.org", "http://n.net/de/8", "http://example.net/de/8#a", "http://notexample.com/en/7", "HTTP://h.com?x", "http://a.com://b/en/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    bad = spark.createDataFrame([("x.org", 0)] * 60 + [("good.org", 1)] * 60, "host string, good int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judged(pages, bad).collect()}
    assert out[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == ("x.org", "", None, "block")
    assert out[4][2:] == ("net/de/", "allow") and out[5][2:] == ("example.net/de/8", "block") and out[6][2:] == ("com/en/", "block")
    assert out[7] == ("h.com", "", None, "allow")
    none = reputation.judged(pages, spark.createDataFrame([], "host string, good int"))
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}


def test_reputation_against_brute_force(spark):
    """Hosts without labelled pages have their domain's evidence, else the suffix's, else that of all."""
    rng = random.Random(12)
    outcomes = [(f"{h}.bad.org", 0) for h in "ab" for _ in range(600)]
    outcomes += [(f"h{i}.d{i % 9}.{s}", int(rng.random() < (0.9 if i % 9 else 0.3))) for i in range(60) for s in ("com", "net") for _ in range(rng.randint(1, 30))]
    new = ["new.bad.org", "bad.org", "x.org", "h1.d1.com", "h777.d0.com", "unseen.zz", "h9.d9.net"]
    df = spark.createDataFrame(outcomes, "host string, good int").repartition(3)
    want = brute.reputation(outcomes, {*new, *(h for h, _ in outcomes)})
    got = {r.host: r for r in reputation.reputations(df, spark.createDataFrame([(h,) for h in new], "host string")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[h].mean - m) < 1e-9 and abs(got[h].upper - u) < 1e-9 for h, (m, u) in want.items())
    assert {h: got[h].level for h in new} == {"new.bad.org": "domain", "bad.org": "domain", "x.org": "suffix", "h1.d1.com": "host", "h777.d0.com": "domain", "unseen.zz": "overall", "h9.d9.net": "suffix"}
    urls = ["http://New.bad.org/1", "http://u:p@b.bad.org:8080/", "http://good.org/", "http://10.1.2.3/x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = {r.page_id: (r.host, r.verdict) for r in reputation.judged(pages, df, rules=()).collect()}
    assert verdicts == {0: ("new.bad.org", "block"), 1: ("u:p@b.bad.org:8080", "block"), 2: ("good.org", "block"), 3: ("10.1.2.3", "allow"), 4: ("", "allow")}


def test_units_of_hosts(spark):
    names = ["a.b.example.co.uk", "example.com:81", "u@x.example.com.", "192.168.0.1:80", "[::1]:80", "localhost", "co.uk", ""]
    df = spark.createDataFrame([(x,) for x in names], "h string").select(reputation.bare(F.col("h")).alias("b"))
    got = [(r.b, r.d, r.s) for r in df.select("b", reputation.registered_domain(F.col("b")).alias("d"), reputation.suffix(F.col("b")).alias("s")).collect()]
    assert got == [
        ("a.b.example.co.uk", "example.co.uk", "co.uk"), ("example.com", "example.com", "com"), ("x.example.com", "example.com", "com"), ("192.168.0.1", "192.168.0.1", "(address)"),
        ("[::1]", "[::1]", "(address)"), ("localhost", "localhost", "localhost"), ("co.uk", "co.uk", "co.uk"), ("", "", ""),
    ]


def test_simhash_against_brute_force(spark, odd):
    rng = random.Random(2)
    base = prose(rng, 400).split()
    near = [(100 + i, " ".join(w if rng.random() > 0.002 else "new" for w in base)) for i in range(60)]
    docs = odd.filter("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string")).withColumn("fingerprint", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def print_(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(k, print_(t)) for k, t in rows]
    for distance in (2, 1, 0):
        root = {p: p for _, p in prints}
        changed = True
        while changed:
            changed = False
            for a in root:
                for b in root:
                    if (a ^ b).bit_count() <= distance and root[a] != root[b]:
                        root[a] = root[b] = min(root[a], root[b])
                        changed = True
        least = {}
        for k, p in prints:
            least[root[p]] = min(k, least.get(root[p], k))
        want = sorted((k, f"{p:016x}", least[root[p]]) for k, p in prints)
        got = sorted(tuple(r) for r in simhash.grouped(docs, distance).select("doc_id", "fingerprint", "component_id").collect())
        assert got == want
    assert simhash.deduplicated(odd.select("doc_id", "text")).filter("doc_id is null").count() == 2


def test_simhash_of_one_large_group(spark):
    """Prints that are all near to each other give edges in proportion to them, and one component."""
    center = 0x0123456789ABCDEF
    prints = {center} | {center ^ (1 << i) for i in range(63)} | {center ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(df)
    assert edges.count() < 70 * len(prints)
    for distance, slot in ((2, 1), (2, 5), (1, 1), (1, 10**6)):  # slots that are all split, and none
        found = simhash.links(df, distance, slot).collect()
        assert all(0 < (a ^ b).bit_count() <= distance for a, b in found)
        assert simhash.components(spark.createDataFrame(found, "a long, b long")).count() == len(prints) - 1
    roots = simhash.components(edges)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(prints) - 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_near_dedup_takes_fingerprints(spark, monkeypatch):
    """The stage looks up SimHashes by multi-index hashing; what they link is verified, what they miss is found besides."""
    import corpus_pipeline

    found, by_index = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *a: (found.append(prints.count()), by_index(prints, *a))[1])
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"v{w}" for w in words), " ".join([*words[:200], *(f"u{w}" for w in words[200:212]), *words[212:]])]
    docs = spark.createDataFrame([(i, x, "s", len(x)) for i, x in enumerate([*texts, texts[0]])], "doc_id long, text string, source string, n_chars int")
    bits = [simhash.fingerprint(x, 5) for x in texts]
    assert bin((bits[0] ^ bits[1]) % 2**64).count("1") <= 2 < bin((bits[0] ^ bits[3]) % 2**64).count("1")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]
    assert found == [len(set(bits))]


def test_similar_against_brute_force(spark):
    """All pairs of similarity 0.8 or more are linked, chains too; texts with a common passage and little else are not."""
    rng = random.Random(8)
    passage, rows = prose(rng, 60), [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e f g h"), (7, "a b c d e f g h i")]
    for _ in range(25):
        base = prose(rng, rng.choice([12, 60, 200, 500])).split()
        for rate in (0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.04):
            rows.append((len(rows) + 10, " ".join(w if rng.random() >= rate else f"new{rng.random()}" for w in base)))
    rows += [(1000 + i, f"{passage} {prose(rng, 12)}") for i in range(30)]
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, (t or "").lower().split()) for k, t in rows)}
    root, n_far = {k: k for k in sets}, 0
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                bits = simhash.fingerprint(dict(rows)[a]) ^ simhash.fingerprint(dict(rows)[b])
                n_far += (bits & (1 << 64) - 1).bit_count() > 2
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert n_far > 20 and {r.id: r.component_id for r in simhash.similar(docs).collect()} == root
    import corpus_pipeline

    docs = docs.union(spark.createDataFrame([(None, "no key"), (None, "no key")], docs.schema))
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted([0, 0, *set(root.values())])


def test_line_dedup(spark, odd):
    docs = odd.filter("doc_id is not null and doc_id <> 4")
    got = {r.doc_id: (r.n_deleted, r.text) for r in linededup.deduplicated(docs).collect()}
    assert got == brute.lines_left([(r.doc_id, r.text) for r in docs.collect()]) and got[11][0] == 4 and got[10][0] == 0 and got[1] == (0, None)
    assert linededup.deduplicated(odd).count() == odd.count()
    # equal keys: one document if the texts are equal, else each is cut by what is earlier
    line = prose(random.Random(3), 9)
    same = spark.createDataFrame([(1, line), (1, line), (2, f"x\n{line}"), (2, f"{line}\ny"), (None, line)], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.n_deleted, r.text) for r in linededup.deduplicated(same).collect()))) == sorted(map(str, [(1, 0, line), (1, 0, line), (2, 1, "x"), (2, 1, "y"), (None, 0, line)]))


def test_blocks_are_common_to_one_pair(spark):
    """Lines that two documents hold apart, or with text between, are no block; short lines are one where they follow."""
    rng = random.Random(9)
    docs = [(1, "one two three four\nother"), (2, "five six seven eight"), (3, "one two three four\nfive six seven eight"), (4, "one two three four\n\n five six seven eight"), (5, "one two three four\nx\nfive six seven eight")]
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 9])) for _ in range(15)] + ["", " \t", "odd\x1cspace\u2003here"]
    docs += [(10 + i, "\n".join(rng.choice(["", " "]) + rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_deleted, r.text) for r in linededup.deduplicated(df).collect()}
    assert got == brute.lines_left(docs)
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 2, 0] and sum(n > 0 for n, _ in got.values()) > 20
    found = {r.k: r.blocks for r in linededup.blocks(df).collect()}
    assert [(b.owner, b.place, b.owner_place, b.size, b.moved) for b in found[4]] == [(3, 0, 0, 2, False)]


def test_lines_in_another_order(spark):
    """Blocks that moved, and one that hundreds of documents hold, go as well."""
    rng = random.Random(9)
    common, a, b, c, d = (prose(rng, 12) for _ in range(5))
    docs = [(1, f"{a}\n{b}\n{common}"), (2, f"{common}\n{a}\n{b}")] + [(10 + i, f"{common}\n{prose(rng, 5)}") for i in range(200)]
    docs += [(500, f"{c}\nx1\n{d}\n"), (501, f"{d}\ny1\n{c}"), (502, f"{d}\nz1\n{c}\n{c}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_deleted, r.text) for r in linededup.deduplicated(df).collect()}
    assert got == brute.lines_left(docs)
    assert got[1][0] == 0 and got[2] == (3, "") and all(got[10 + i][0] == 1 for i in range(200)) and got[501] == (2, "y1") and got[502] == (2, f"z1\n{c}")
    moved = {r.k: [b.moved for b in r.blocks] for r in linededup.blocks(df).collect()}
    assert sum(moved[2]) == 1 and sum(moved[501]) == 1


def test_patience_decides(spark, monkeypatch):
    """Of what a document repeats patience diff tells which is the owner's; without it another line would go."""
    rng = random.Random(6)
    a, b, c = (prose(rng, 10) for _ in range(3))
    docs = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}\n{a}\n{b}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = (2, f"{b}\n{c}")
    assert brute.lines_left(docs)[2] == want == {r.doc_id: (r.n_deleted, r.text) for r in linededup.deduplicated(df).collect()}[2]
    shared = [(1, [2], [0]), (1, [0, 3], [1])]
    assert [p for p, *_ in linededup.aligned(shared)] == [2, 3]
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert [p for p, *_ in linededup.aligned(shared)] == [0, 2]


def test_documents_meet_at_rare_lines():
    """A line that no other document has ends a run; the rarest of a run is where documents meet."""
    line = lambda place, held, words=4: (place, bytes([held]) * 16, words, held)
    made = linededup.runs([line(0, 9), line(1, 3), line(2, 7), line(4, 5), line(6, 2, 8), line(7, 8)])
    assert {(k[0], size, tuple(at)) for (k, _), (size, at) in ((x, y) for x, y in made.items())} == {(3, 2, (0,)), (3, 2, (1,)), (2, 1, (6,)), (2, 2, (6,))}


def test_patience():
    assert linededup.patience(list("abcde"), list("abXde")) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert linededup.patience(list("xaby"), list("yabx"))[0] in [(1, 1), (0, 3), (3, 0)]
    assert linededup.patience([], list("a")) == []


def test_sharding(odd):
    for limit in (400, 3000, 10**9):
        out = sharded = sharding.sharded(odd, limit).withColumn("b", F.coalesce(F.octet_length("text"), F.lit(0)))
        assert out.count() == odd.count() and out.filter("shard is null").count() == 0
        sizes = sharded.groupBy("shard", "overflow").agg(F.sum("b").alias("b"), F.countDistinct("doc_id", "text").alias("n")).collect()
        assert all(r.b <= limit or (r.overflow and r.n <= 1) for r in sizes)
        names = {r.shard for r in sizes}
        assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_sharding_against_brute_force(spark):
    """Thousands of shards: each is the shortest prefix that fits, so that its parent does not; deep ones, too."""
    import hashlib
    from collections import Counter

    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 120)) for i in range(12_000)] + [(20_000, "y" * 40)] * 3 + [(30_000, chr(65 + i) * 500) for i in range(8)]
    bits = lambda t: "".join(f"{x:08b}" for x in hashlib.md5(t.encode()).digest())
    of = {r: bits(str(r[0])) + bits(r[1]) for r in set(rows)}
    limit = 600
    total = Counter()
    for r in rows:
        for d in range(257):
            total[of[r][:d]] += len(r[1])
    want = Counter((*r, next(of[r][:d] for d in range(257) if total[of[r][:d]] <= limit)) for r in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.sharded(df, limit)
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in got) == want and all(r.depth == len(r.shard) and not r.overflow for r in got)
    names = {r.shard for r in got}
    assert len(names) > 1500 and max(map(len, names)) > 128 and all(total[x[:-1]] > limit for x in names)


def test_sharding_against_sql(spark, duck, same):
    """The oracle's SQL with a limit that splits these tables into many shards."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_bytes", F.octet_length("text").cast("long"))
    limit = docs.agg(F.max("n_bytes")).first()[0] + 1
    out = sharding.sharded(docs, limit, carry=["doc_id", "n_bytes"])
    assert out.select("shard").distinct().count() > 5
    same(out, duck.sql(sharding.op5_sql(limit)))


def test_sharding_writes_folders(spark, odd):
    path = shared_path(spark, "shards")
    sharding.write(odd.drop("shard"), path, 3000)
    back = spark.read.parquet(path)
    assert back.count() == odd.count()
    sizes = back.groupBy("shard", "overflow").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()
    assert len(sizes) > 1 and all(r.b <= 3000 or r.overflow for r in sizes)


def test_mixing(spark, odd):
    docs = spark.createDataFrame([(i, "x" * 10, "en", f"src{i % 2}", 10) for i in range(4000)], DOCS)
    out = mixing.mixed(docs, {"src0": 3.0, "src1": 1.0}).groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    n = {r.source: r.n for r in out}
    assert abs(n["src0"] - 3000) < 250 and abs(n["src1"] - 1000) < 150
    a = [(r.doc_id, r.copy) for r in mixing.mixed(odd).select("doc_id", "copy").collect()]
    assert sorted(a, key=str) == sorted(((r.doc_id, r.copy) for r in mixing.mixed(odd.repartition(3)).collect()), key=str)
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    long = "é\r\n\r\nWARC/1.1\r\nfake: 1\r\n\r\n" * 5000
    rows = [(1, "u", "same"), (2, None, None), (3, "v\r\nx", "same"), (4, "w", ""), (5, "z", long), (None, "q", "same"), (6, "s", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = shared_path(spark, compression)
    warc.write(pages, path, compression)
    for split in ("0", "97", "100000"):
        got = {r.record_id[10:-1]: r for r in warc.read(spark, path, splitBytes=split, verify="true").collect()}
        assert len(got) == len(rows) and bytes(got["5"].payload).decode() == long
        assert {k: r.record_type for k, r in got.items()} == {"1": "revisit", "2": "revisit", "3": "revisit", "4": "response", "5": "response", "6": "response", "null": "revisit"}
        assert got["1"].refers_to == "<urn:page:6>" and got["1"].payload_length == 4 and got["1"].payload_digest == got["6"].payload_digest
    some = warc.read(spark, path, payload="false").filter("record_type = 'response' and payload_length > 1")
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:5>", "<urn:page:6>"]
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString() or "isnotnull" in some._jdf.queryExecution().optimizedPlan().toString()
    small = shared_path(spark, "small")
    warc.write(pages, small, min_bytes=5)
    assert warc.read(spark, small).filter("record_type = 'revisit'").count() == 0


def _archive(tmp_path, name, *records):
    (tmp_path / name).write_bytes(b"".join(head.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body + b"\r\n\r\n" for head, body in records))
    return f"file://{tmp_path / name}"


def test_warc_of_others(spark, tmp_path):
    """Records with HTTP headers, broken headers, payloads cut short and of many chunks."""
    import base64
    import hashlib

    body = b"<p>\r\n\r\n" + bytes(range(256)) * 4000
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = lambda i, n, more="": f"WARC/1.0\nWARC-Type: response\nWARC-Record-ID: <{i}>\nContent-Length: {n}{more}"
    good = (head(1, len(http), f"\nContent-Type: application/http; msgtype=response\nWARC-Payload-Digest: sha1:{digest}"), http)
    path = _archive(tmp_path, "a.warc", good, (head(2, 0), b""), (head(3, 2, f"\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'ok').hexdigest()}"), b"ok"))
    for split in ("0", "100000"):
        got = {r.record_id: bytes(r.payload) for r in warc.read(spark, path, verify="true", splitBytes=split).collect()}
        assert got == {"<1>": http, "<2>": b"", "<3>": b"ok"}
    wrong = _archive(tmp_path, "b.warc", (good[0], http[:-1] + b"?"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, wrong, verify="true").collect()
    for i, bad in enumerate(("WARC/1.0\nWARC-Type: response\nWARC-Record-ID: <8>", head(8, "many"), head(8, "-5"), head(8, ""))):
        path = _archive(tmp_path, f"c{i}.warc", good, (bad, b"lost"), (head(9, 4), b"kept"))
        with pytest.raises(Exception, match="no valid Content-Length"):
            warc.read(spark, path).collect()
        assert sorted(r.record_id for r in warc.read(spark, path, malformed="skip").collect()) == ["<1>", "<9>"]
    (tmp_path / "d.warc").write_bytes((tmp_path / "a.warc").read_bytes()[: len(http) // 2])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, f"file://{tmp_path / 'd.warc'}").collect()
    assert warc.read(spark, f"file://{tmp_path / 'd.warc'}", malformed="skip").count() == 0


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "a  b", " a", "a ", "a\n\nb ", "I'll they've 'tis", "x<|endoftext|>y", "　wide\xa0space  x"]
    texts += ["".join(rng.choice(" \n\tabcAB'123.,!éß漢🙂‍\xa0") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        assert packing.token_ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_tokens_of_long_white_space():
    """tiktoken alone gives up on such a run."""
    ids = packing.token_ids("a" + " " * 1_100_000 + "b\n")
    assert packing._tokenizer("byte_bpe_50k").decode(ids.tolist()) == "a" + " " * 1_100_000 + "b\n"


def test_packing(odd):
    out = packing.packed(packing.pieces(odd)).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    ids = np.append(packing.token_ids({r.doc_id: r.text for r in odd.collect()}[50]), np.uint32(0)).astype("<u4")
    own = sorted((r for r in out if r.doc_id == 50), key=lambda r: r.piece)
    assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert sum(r.doc_id is None for r in out) == 2 and sum(r.doc_id == 4 for r in out) == 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (np.minimum(2048, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1), rng.integers(1, 2049, 500), np.full(999, 700), np.array([], int)):
        counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
        plan, got = packing.plan(counts), {}
        for pattern, k in plan:
            assert sum(pattern) <= 2048
            for n in pattern:
                got[n] = got.get(n, 0) + k
        assert got == counts
        if len(lengths) == 20_000:
            assert sum(k for _, k in plan) <= -(-int(lengths.sum()) // 2048) + 3
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(60)] + [(20, [0.25] * 16), (20, [0.25] * 16), (40, [-1.0] * 16)]
    rows += [(400, None), (420, []), (440, [1.0] * 15 + [None]), (460, [float("nan")] * 16), (480, [float("inf")] * 16), (500, [1.0] * 4), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect())
    v = [(i, np.floor(64 * np.array(x, np.float32).astype(float)).astype(int).tolist()) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    assert got == sorted(brute.best(v, 20))
    assert sum(r[0] == 20 for r in got) == 40 and sum(r[0] == 40 for r in got) == 40  # a repeated id is a query for each of its vectors


def test_topk_of_many_lengths_and_blocks(spark, monkeypatch):
    """More lengths than any list of them would hold, and blocks that the first one's threshold decides about."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(1 + i % 1200)]) for i in range(2400)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, factor=1).collect())
    assert got == sorted(brute.best([(i, [int(x) for x in v]) for i, v in rows], 20))
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rows = [(i, [rng.gauss(0, 1 + i // 300) for _ in range(12)]) for i in range(900)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect())
    assert got == sorted(brute.best([(i, [math.floor(64 * x) for x in v]) for i, v in rows], 5))


def test_topk_broadcasts_neither_queries_nor_index(spark, monkeypatch):
    """Parts of queries and blocks of the index meet by merges: none of them passes the driver, however small its files."""
    plans, write = {}, topk.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(topk, "written", noted)
    monkeypatch.setattr(topk, "BLOCK", 100)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(600)]
    assert topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 600
    assert "MapInPandas" in plans["first_block"] and "Broadcast" not in plans["first_block"]
    assert "MapInPandas" in plans["other_blocks"] and "Broadcast" not in plans["other_blocks"]


@pytest.mark.parametrize("scale", [1, 40, 3000, 10**6, 10**17])
def test_topk_stops_on_proof_only(scale):
    """Members hold the best k with all ties, whatever the quantum, and processing stops before all postings are read."""
    rng = np.random.default_rng(scale)
    for spread in (0, 1.5):  # like components, and few that are much larger than the rest
        vectors = np.clip(np.floor(scale * rng.normal(size=(900, 24)) * rng.lognormal(0, spread, (900, 24))), -(2.0**62), 2.0**62).astype(np.int64)
        vectors[100:130] = vectors[7]
        queries = np.vstack([vectors[:40], np.zeros((1, 24), np.int64)])
        index = topk.Postings.of(vectors)
        found = index.members(queries.astype(np.float64), 21, np.full(41, -np.inf))
        scores = vectors.astype(object) @ queries.T.astype(object)
        for i, rows in enumerate(found):
            s = scores[:, i]
            least = sorted(s)[-21]
            assert {j for j in range(900) if s[j] >= least} <= set(rows.tolist())
        if scale > 1:
            assert np.mean([len(x) for x in found[:-1]]) < 300
        floor = np.array([float(sorted(s)[-5]) for s in scores.T])
        before, index.read = index.read, 0
        for i, rows in enumerate(index.members(queries.astype(np.float64), 21, floor)):
            least = sorted(scores[:, i])[-5]
            assert {j for j in range(900) if scores[j, i] >= least} <= set(rows.tolist())
        assert index.read <= before
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        got = list(topk.top_of_block(np.arange(40), vectors[:40], np.arange(900), vectors, 20))
        want = [(i, c, -s) for i in range(40) for s, c in sorted((-min(max(scores[c, i], low), high), c) for c in range(900) if c != i)[:20]]
        assert got == want
    # an id that many rows repeat, and components at the ends of longs
    ids, same = np.repeat([5, 6, 7], [30, 40, 40]), np.vstack([np.full((30, 4), 9), np.ones((80, 4), np.int64)])
    assert [x[1] for x in topk.top_of_block(np.array([5]), same[:1], ids, same, 20)] == [6] * 20
    ends = np.array([[np.iinfo(np.int64).min, 1], [np.iinfo(np.int64).max, 1], [1, 1]])
    assert [x[1] for x in topk.top_of_block(np.array([2]), ends[2:], np.arange(3), ends, 2)] == [1, 0]
    # a block whose largest components cannot reach the threshold is not read
    index = topk.Postings.of(np.ones((50, 4), np.int64))
    assert not list(topk.top_of_block(np.array([1]), np.ones((1, 4), np.int64), np.arange(50), np.ones((50, 4), np.int64), 3, np.array([5.0]), index)) and index.read == 0


def test_quality(spark, odd):
    rng = random.Random(5)
    good = [(i, "\n".join(prose(rng, 15) + "." for _ in range(rng.randint(1, 6)))) for i in range(300)]
    bad = [(1000 + i, "\n".join([prose(rng, 10)] * rng.randint(0, 1) + ["*** ".join(prose(rng, 12).split()) for _ in range(3)])) for i in range(100)]
    texts = [t.encode() for _, t in good + bad]
    labels = np.array([1.0] * 300 + [0.0] * 100)
    field = quality.fit(texts[::2], labels[::2], steps=40)
    s = quality.score(field, texts[1::2])
    assert ((s >= 0.3) == labels[1::2]).mean() > 0.97
    assert np.allclose(quality.score(field, texts[1::2], batch=1), s)
    lines = [(i, good) for i, (p, size, n) in enumerate(quality.marginals(field, [b"a b c\n\n*** ###"])) for good in p]
    labelled = quality.line_labels(odd, field).collect()
    assert len(lines) == 3 and len(labelled) == sum((r.text or "").count("\n") + 1 for r in odd.collect()) and all(r.good == (r.p_good >= 0.5) for r in labelled)
    out = quality.scored(odd, field).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    # marginals of the chain against the sum over all labellings
    e, t = np.array([0.3, -1.0, 0.8]), np.array([[0.2, -0.4], [0.1, 0.5]])
    p, z, _ = quality.chain(e, np.array([3]), t)
    weight = {y: np.exp(sum(e[i] * y[i] for i in range(3)) + t[y[0], y[1]] + t[y[1], y[2]]) for y in np.ndindex(2, 2, 2)}
    assert np.isclose(np.exp(z[0]), sum(weight.values()))
    assert np.allclose(p, [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(3)])


def test_quality_of_long_texts(monkeypatch):
    """A text in slices, and lines in parts, give what they give as a whole (but for words on either side of a cut)."""
    rng = random.Random(8)
    texts = ["\n".join(prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 60))).encode() for _ in range(30)] + [b"", b"\n", b"\n\n\n", prose(rng, 3000).encode()]
    field = quality.fit(texts, np.array([float(i % 3 > 0) for i in range(len(texts))]), steps=10)
    whole = quality.score(field, texts)
    assert np.allclose([quality.score(field, [t])[0] for t in texts], whole)
    for part in (40, 700):
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(quality.score(field, texts, part), whole, atol=0.02)
    monkeypatch.setattr(quality, "PART", 40)
    assert b"".join(quality._parts(b"x" * 100 + b" " + b"y" * 10)) == b"x" * 100 + b" " + b"y" * 10
    got = [x for y in quality._slices(b"aa\nb\n\n" + b"c" * 90 + b"\n") for x in y]
    assert got == (b"aa\nb\n\n" + b"c" * 90 + b"\n").split(b"\n")


def test_quality_query(spark):
    """Held-out documents by crc32, and scores that tell them apart by labels the fit has not seen."""
    rows = catalog.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.97


def test_pipeline(spark):
    """Every stage against its brute-force version, on what the stage before it left; columns that clash are carried."""
    from collections import Counter

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {x: F.concat(F.lit(f"{x} "), F.col("doc_id")) for x in ("kept", "n_words", "fail_mask", "n_deleted", "copy", "rate", "shuffle_key", "carried_0", "places")}
    docs, columns = plain.withColumns(clash), [*plain.columns, *clash]
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            rows = [r for r in rows if brute.passes_rules(r["text"])]
        elif name == "line_dedup":
            left = brute.lines_left([(r["doc_id"], r["text"]) for r in rows])
            rows = [r | ({"text": left[r["doc_id"]][1], "n_chars": len(left[r["doc_id"]][1])} if left[r["doc_id"]][0] else {}) for r in rows]
            rows = [r for r in rows if brute.words(r["text"]) or not left[r["doc_id"]][0]]
        elif name == "near_dedup":
            root = brute.near_copies([(r["doc_id"], r["text"]) for r in rows])
            rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
        else:
            copies = brute.poisson_copies([(r["doc_id"], r["source"], r["text"]) for r in rows], mixing.WEIGHTS)
            rows = [r for i, r in enumerate(rows) for _ in range(copies[i])]
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert Counter(map(str, (r.asDict() for r in docs.collect()))) == Counter(map(str, rows)), name
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(x for r in rows for x in brute.piece_rows(r["doc_id"], [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0]))
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), corpus_pipeline.run(spark, SF).collect()):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        in_order = sorted((r.sequence_id, r.offset, r.length) for r in out)
        for (a, at, n), (b, then, _) in zip([(None, 0, 0), *in_order], in_order):
            assert then == (at + n if a == b else 0) and then < 2048
        assert all(at + n <= 2048 for _, at, n in in_order)
        assert len({x[0] for x in in_order}) <= -(-sum(x[2] for x in in_order) // 2048) + 2
