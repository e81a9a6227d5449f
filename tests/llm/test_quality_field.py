"""The quality classifier's parts against plain loops, finite differences and all labellings."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from copse.llm import quality

SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"


def plain_features(lines, doc):
    """A loop over lines, words and bytes."""
    out, seen, heads = [], set(), []
    for line, d in zip(lines, doc):
        chars = [b for b in line if 32 < b < 127 or b > 127]
        letters = [b for b in line if chr(b).isalpha() and b < 128 or b > 127]
        words = bytes(b if 32 < b < 127 or b > 127 else 32 for b in line).split(b" ")
        words = [w for w in words if w]
        n, c = max(1, len(words)), max(1, len(chars))
        count = lambda hit, of=line: sum(map(hit, of))  # noqa: E731, B008
        punctuation = count(lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in SYMBOLS)
        repeats = (d, line) in seen and bool(words)
        seen.add((d, line))
        head = bool(heads) and heads[-1] == (d, line[:12])
        heads.append((d, line[:12]))
        out.append([
            np.log1p(len(line)) / 8, not words, count(lambda b: 65 <= b <= 90) / max(1, len(letters)), count(lambda b: 48 <= b <= 57) / c, count(lambda b: b in SYMBOLS) / c, punctuation / c,
            line.count(b"!") / n, sum(map(len, words)) / n / 10, count(lambda w: len(w) <= 2, words) / n, count(lambda w: len(w) > 14, words) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, head, repeats, count(lambda b: b > 127) / c])
    return np.array(out, float)


def lines_of(rng, n):
    word = lambda: rng.choice(["a", "of", "The", "x1", "word", "word", "LONGESTWORDEVER", "a!", "#tag", "é", "ß.", "$5", "\x7f", "(ok)"])
    return [rng.choice([" ", "\t", ""]).join(word() for _ in range(rng.randint(0, 9))).encode() for _ in range(n)]


def test_features_of_lines():
    rng = random.Random(5)
    lines = lines_of(rng, 400)
    lines += [lines[i] for i in range(0, 100, 3)]
    doc = np.sort(np.array([rng.randint(0, 30) for _ in lines]))
    got, size, _, _ = quality.line_features(lines, doc)
    assert got.shape[1] == len(quality.NAMES) and np.allclose(got, plain_features(lines, doc)) and (size == [len(x) for x in lines]).all()


def test_features_of_long_lines(monkeypatch):
    """Lines that are counted in parts have the features of the whole."""
    rng = random.Random(6)
    lines = [b" ".join(lines_of(rng, 60)) for _ in range(6)] + [b"x" * 500, b"x" * 500]
    doc = np.zeros(len(lines), int)
    whole = quality.line_features(lines, doc)
    monkeypatch.setattr(quality, "PART", 64)
    parts = quality.line_features(lines, doc)
    same = [i for i, name in enumerate(quality.NAMES) if name not in ("repeated_word", "long_words", "short_words", "word_bytes", "exclamations")]
    assert np.allclose(whole[0][:, same], parts[0][:, same]) and (whole[2] == parts[2]).all() and (whole[3] == parts[3]).all()


def test_likelihood_that_all_lines_are_good():
    """Against the sum over all labellings."""
    rng = np.random.default_rng(3)
    n, t = np.array([1, 3, 6]), rng.normal(size=(2, 2))
    e = rng.normal(size=n.sum())
    _, z, _ = quality.chain(e, n, t)
    got, start = quality._all_good(e, n, t, z), 0
    for k, size in enumerate(n):
        own = e[start : start + size]
        weight = lambda y: sum(own[i] for i in range(size) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        total = np.logaddexp.reduce([weight(y) for y in itertools.product((0, 1), repeat=int(size))])
        assert abs(total - z[k]) < 1e-9 and abs(got[k] - (weight((1,) * size) - total)) < 1e-9
        start += size


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    n = np.array([2, 5, 1, 4])
    doc = np.repeat(np.arange(4), n)
    xs, w, t, positive = rng.normal(size=(n.sum(), 3)), rng.normal(size=3), rng.normal(size=(2, 2)), np.array([True, False, False, True])

    def value(w, t, ridge=0.01):
        e = xs @ w
        lp = quality._all_good(e, n, t, quality.chain(e, n, t)[1])
        return np.where(positive, lp, np.log(-np.expm1(lp))).mean() - ridge / 2 * ((w**2).sum() + (t**2).sum())

    gw, gt = quality._gradient(xs, doc, n, w, t, positive, 0.01)
    step = 1e-6
    for i in range(3):
        d = np.eye(3)[i] * step
        assert abs((value(w + d, t) - value(w - d, t)) / (2 * step) - gw[i]) < 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = step
        assert abs((value(w, t + d) - value(w, t - d)) / (2 * step) - gt[i, j]) < 1e-6


def test_limits_of_the_sample(spark):
    """Rows and bytes at most, whole texts, none that is not to be used; the first by hash whatever their order."""
    texts = {i: "x" * (10 + i % 50) for i in range(300)} | {300: "y" * 5000, 301: None}
    docs = spark.createDataFrame([*texts.items(), (5, "a smaller text"), (None, "no key")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(302)] + [(400, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    pick = lambda df, **k: quality.sample(df, labels, F.col("doc_id") % 3 != 0, **k)
    got, y = pick(docs, size=40, size_bytes=8 * 100)
    assert 0 < len(got) == len(y) <= 40 and sum(map(len, got)) <= 800 and set(y) <= {0.0, 1.0} and all(len(x) <= 100 for x in got)
    again = pick(docs.orderBy(F.desc("text")).repartition(5), size=40, size_bytes=8 * 100)
    assert got == again[0] and (y == again[1]).all()
    everything, _ = pick(docs, size=10_000, size_bytes=1 << 20)
    used = {i for i, t in texts.items() if i % 3 and t is not None}
    assert sorted(everything) == sorted(("a smaller text" if i == 5 else texts[i]).encode() for i in used)
    assert pick(docs.limit(0)) [0] == [] and quality.fit(*pick(docs.limit(0))).quality.sum() == 0
