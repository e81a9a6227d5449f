"""Repair of conversations, pieces with offsets and Merkle manifests against brute force and the library."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import merkle, pieces, repair

ROLES = ["user", "assistant", "system", "User", "tool", "", "admin"]


def conversations(rng, n, longest):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["", " \t\n", "One.", "Two!  ", "no end", "Why? \x0b", "x. y", "One.", None, "É…"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(ROLES[:2] * 3 + [*ROLES, None]), text))
    return rows


def in_order(rows):
    """Rows of each conversation in the operator's order: turn (nulls first), role, the digest of role and text."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        said = "" if not text.strip(brute.SPACE) else brute.sha(f"{len(role)}:{role}{text}")
        out.setdefault(conv, []).append(((turn is not None, turn or 0, role, said != "", said), turn, role, text))
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


@pytest.mark.parametrize(("size", "longest"), [(4096, 9), (1, 12), (3, 60)])
def test_repair_against_brute_force(spark, size, longest):
    """Conversations of one segment and of many; nulls in all columns, roles of other initials, repeats."""
    rows = conversations(random.Random(longest), 80, longest)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(3)
    made = repair.repaired(df, size=size)
    report = {r.conv_id: r for r in made.report.join(repair.digests(made.turns), "group_id").collect()}
    want = in_order(rows)
    assert report.keys() == want.keys()
    for conv, own in want.items():
        r, turns = report[conv], [t for t, _, _ in own if t is not None]
        *counts, audit, lines = brute.repaired([(role, text) for _, role, text in own])
        assert [r.blank, r.duplicate, r.truncated, r.illegal, r.cost] == counts, conv
        assert r.audit == audit and r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_one_long_conversation(spark):
    """Segments are cut anywhere: the same edits as in one piece."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice(ROLES[:3]), rng.choice([f"t{i}.", f"t{i}", "", "same."])) for i in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = []
    for size in (64, 8192):
        made = repair.repaired(df, size=size)
        r = made.report.join(repair.digests(made.turns), "group_id").first()
        audits.append((r.audit, r.repaired_sha256, r.cost, r.illegal))
    assert audits[0] == audits[1] and len(audits[0][0]) >= 5000


def test_distances_by_relaxation():
    """Dial's distances are those of relaxing all arcs until nothing changes."""
    rng = random.Random(2)
    for _ in range(200):
        rows = tuple((rng.choice("suax"), rng.choice([0, 0, repair.BLANK, repair.DUPLICATE, repair.CUT])) for _ in range(rng.randint(0, 8)))
        end = [rng.choice([0, 1, 5, 9, repair.FAR]) for _ in range(4)]
        far = [[repair.FAR] * 4 for _ in rows] + [[*end]]
        before = None
        while before != far:
            before = [[*x] for x in far]
            for i, row in enumerate(rows):
                for q in range(4):
                    far[i][q] = min([far[i][q], *(cost + far[i + passed][to] for _, cost, passed, to in repair.arcs(q, *row))])
        assert repair.distances(rows, end) == [[min(x, repair.FAR) for x in layer] for layer in far]


def test_no_rows_after_damage(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(rows).report.count() == 0 and repair.damaged(rows).count() == 0


@pytest.fixture(scope="module")
def nfkc(tmp_path_factory):
    """The public model with a compiled character map of the library, which replaces and joins characters and cleans white space."""
    import public_tokenizers
    import sentencepiece

    rules = next(v for k, v, _ in pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if k == 3)
    path = tmp_path_factory.mktemp("model") / "nfkc.model"
    data = open(public_tokenizers.path(pieces.MODEL), "rb").read()
    path.write_bytes(b"".join(w for k, _, w in pieces._fields(data) if k != 3) + pieces._message(3, rules))
    return str(path)


ODD = " \n\t▁aAbB1é́の中👍　\x00  .-Ⅷﬁ①ｶﾞ가ẹ́"


@pytest.mark.parametrize("which", ["plain", "nfkc"])
def test_pieces_equal_the_library(which, nfkc):
    """Ids, spans of pieces that are no bytes, and what ids decode to, of texts of characters that normalisation changes."""
    import public_tokenizers
    import sentencepiece

    path = nfkc if which == "nfkc" else public_tokenizers.path(pieces.MODEL)
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path), random.Random(8)
    texts = ["", " ", "   ", "\n", "a", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    for text in texts:
        ids, starts = pieces.encoded(text, model)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert model.processor.decode(ids.tolist()) == library.decode(ids.tolist())
        assert (np.diff(starts) >= 0).all() and starts[-1] <= len(text.encode())
        if which == "plain":
            assert starts[0] == 0 and starts[-1] == len(text.encode())
        for k, p in enumerate(library.encode(text, return_type="proto").pieces):
            if not library.is_byte(p.id):
                assert (starts[k], starts[k + 1]) == (p.begin, p.end)


def test_longest_prefix(nfkc):
    """Every key of the map is found whole, and no longer prefix than the map has."""
    known = pieces.load(nfkc).map
    keys = {k.encode() for k in known._keys()}
    assert len(keys) > 4000
    for key in random.Random(1).sample(sorted(keys), 500):
        size, _ = known.longest(b"x" + key + b"\xcc\x81zz", 1)
        assert (key + b"\xcc\x81zz")[:size] in keys and size == max(n for n in range(1, len(key) + 5) if (key + b"\xcc\x81zz")[:n] in keys)


def test_encode_and_decode(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash; what decodes is the text."""
    long_ = "hiß wörld\n" * 60_000
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "é👍"), (4, long_)]
    df = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in rows], "doc_id long, text string, ids string, starts string, TEXT_ string")
    out = pieces.encode(df)
    assert out.columns == ["doc_id", "TEXT_", "ids", "starts", "n_bytes"]
    got = {(r.doc_id, r.n_bytes): r for r in out.collect()}
    assert got[1, 0].ids == [2] and got[1, 0].starts == [0, 0] and out.count() == 6
    assert all(r.starts[-1] == n and len(r.starts) == len(r.ids) + 1 for (_, n), r in got.items())
    back = sorted(((r.doc_id or 0, r.text) for r in pieces.decode(out).collect()))
    assert back == sorted((k or 0, t or "") for k, t in rows)


def test_unfit_models_are_refused(tmp_path):
    import public_tokenizers

    data = open(public_tokenizers.path(pieces.MODEL), "rb").read()
    bad = tmp_path / "unigram.model"
    bad.write_bytes(b"".join(w if k != 2 else pieces._message(2, b"\x18\x01") for k, _, w in pieces._fields(data)))
    with pytest.raises(ValueError, match="merges"):
        pieces.load(str(bad))


@pytest.mark.parametrize("fan", [2, 4, 16])
def test_merkle_against_brute_force(spark, fan):
    """Groups of one, of a whole power, of a third of all rows, and without a name; rows that repeat a key."""
    rng = random.Random(fan)
    sizes = {None: 5, "": 1, "b": fan, "a": fan * fan + 1, "Z": 300, "é": 1, **{f"s{i}": 1 + i % 3 for i in range(20)}}
    rows = [(k if rng.random() < 0.9 else None, g, f"{g}{k}{rng.random()}") for g, n in sizes.items() for k in rng.sample(range(1000), n)]
    rows += [rows[-1]] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    made = merkle.build(df.select("doc_id", "source", merkle.leaf("doc_id", "source", "text").alias("digest"), F.lit("x").alias("pos"), F.col("text").alias("Kids")), fan=fan)
    got = merkle.proofs(made).withColumn("found", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    item = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digests = {}
    for k, g, t in rows:
        digests.setdefault(g, []).append((k is not None, k or 0, brute.sha(item(k), item(g), item(t))))
    order = sorted(digests, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute.merkle([d for *_, d in sorted(digests[g])], fan) for g in order}
    root, tops = brute.merkle([trees[g][0] for g in order], fan)
    want = sorted((d, trees[g][0], root, str(p + tops[i])) for i, g in enumerate(order) for (*_, d), p in zip(sorted(digests[g]), trees[g][1]))
    assert sorted((r.leaf, r.subroot, r.root, str([(s.before, s.after) for s in r.proof])) for r in got) == want
    assert all(r.found == root for r in got) and made.root().collect()[0].root == root
    assert {r.Kids for r in got} == {t for *_, t in rows} and {r.pos for r in got} == {"x"}


def test_merkle_tells_changes(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.proofs(merkle.build(docs.select("doc_id", "source", merkle.leaf(*merkle.FIELDS).alias("digest"))))
    joined = made.join(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("text"))), ["doc_id", "source"])
    bad = joined.filter(merkle.folded(merkle.leaf(*merkle.FIELDS), F.col("proof")) != F.col("root"))
    assert sorted(r.doc_id for r in bad.collect()) == list(range(0, 50, 7))


def test_empty_manifest(spark):
    made = merkle.build(spark.createDataFrame([], "doc_id long, source string, digest string"))
    assert made.root().count() == 0 and merkle.proofs(made).count() == 0


def test_fields_are_told_apart(spark):
    """Nulls, empty strings and where one value ends: rows that differ have different leaves."""
    rows = [(None, None, None, None, None), (None, "", None, None, None), (None, "a", "b", None, ""), (None, "ab", "", None, ""), (None, "a", "b", None, None), (None, "-", "b", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert df.select(merkle.leaf(*merkle.FIELDS)).distinct().count() == len(rows)
