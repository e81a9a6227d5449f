"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's score comes from features of itself, of the lines before and after it, and of whether
it repeats an earlier line; transitions tie neighbours together. Labels are given for documents only: all lines of a
good document are good, and a bad one has bad lines, but which is not known, so that its likelihood sums over all
labellings that are not good throughout. A document's quality is the mean of its lines' forward-backward marginals,
weighted by length, on a logistic scale fitted to the labels.

Features are counted over the bytes of many lines at once with numpy; there is no work by character in Python, and no text
is held in more than parts of itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.llm.common import fresh, table, written

#: Labelled documents that the classifier is fitted on, at most: those with the smallest hash, whatever their order.
SAMPLE = 2000
#: Bytes of all of them together, at most; they are whole texts, and one alone has an eighth at most.
SAMPLE_BYTES = 12 << 20

_CLASS = np.zeros(256, np.uint8)  # of bytes: 1 letter or part of one, 2 capital, 3 digit, 4 symbol, 5 other punctuation, 0 white space
_CLASS[33:127] = 5
_CLASS[128:] = 1
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@"]] = 4
_MIX = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
_EXCLAMATION = ord("!")

NAMES = ("log_bytes", "no_word", "capitals", "digits", "symbols", "punctuation", "exclamations", "word_bytes", "short_words", "long_words", "repeated_word", "first_of_line_repeats", "repeats_earlier_line", "high_bytes")


def _odd(place: np.ndarray) -> np.ndarray:
    """An odd number for each place, so that sums of products tell the order of bytes."""
    return (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


#: Bytes that are counted at a time. Longer lines are counted in parts of so many at most, cut behind white space where
#: there is any; longer texts, in parts of whole lines.
PART = 1 << 20


def _counts(parts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part (of a line, from the byte ``places`` of it on): sums that add up to the line's, the sum that is the
    line's hash, and that of its first bytes."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    width = np.array([len(x) for x in parts])
    ends = np.cumsum(width + 1) - 1
    starts = ends - width
    kind = _CLASS[data]
    per_part = lambda hit: np.add.reduceat(hit, starts, dtype=np.int64).astype(np.float64)
    inside = kind > 0
    c = np.zeros((len(parts), len(SUMS)))
    c[:, 0], c[:, 1], c[:, 2] = width, per_part((kind == 1) | (kind == 2)), per_part(inside)
    for i, hit in enumerate((kind == 2, kind == 3, kind == 4, kind == 5, data == _EXCLAMATION, data >= 128)):
        c[:, 3 + i] = per_part(hit)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    w0, w1 = edge[::2], edge[1::2]  # where words begin and end
    if len(w0):
        size = w1 - w0
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        hashes = np.add.reduceat(_MIX[data[inside]] * _odd(place), first, dtype=np.uint64)
        own = np.searchsorted(ends, w0)
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1]))
        for i, hit in enumerate((None, size, size <= 2, size > 14, same)):
            c[:, 9 + i] = np.bincount(own, hit, len(parts))
    place = np.arange(len(data)) - np.repeat(starts, width + 1) + np.repeat(places, width + 1)
    mixed = _MIX[data] * _odd(place)
    mixed[ends] = 0
    return c, np.add.reduceat(mixed, starts, dtype=np.uint64), np.add.reduceat(np.where(place < 12, mixed, np.uint64(0)), starts, dtype=np.uint64)


SUMS = ("bytes", "letters", "chars", "capitals", "digits", "symbols", "punctuation", "exclamations", "high", "words", "word_bytes", "short", "long", "same")


def _parts(line: bytes) -> list[bytes]:
    out = []
    while len(line) > PART:
        at = max(line.rfind(x, 0, PART) for x in (b" ", b"\t")) + 1 or PART
        out.append(line[:at])
        line = line[at:]
    return [*out, line]


def line_features(lines: list[bytes], doc: np.ndarray, before: tuple[np.ndarray, np.uint64] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x NAMES) of all lines (doc: of each, the number of its document), their bytes, hashes and the hashes
    of their first bytes. before: of earlier lines of the first document all hashes, and the hash of the last one's first bytes."""
    if max(map(len, lines)) <= PART:
        c, line_hash, head = _counts(lines, np.zeros(len(lines), np.int64))
    else:  # parts of a line come one by one, so that what is held is bounded
        rows = []
        for line in lines:
            at = 0
            sums = [np.zeros(len(SUMS)), np.uint64(0), np.uint64(0)]
            for part in _parts(line):
                with np.errstate(over="ignore"):
                    sums = [x + y[0] for x, y in zip(sums, _counts([part], np.array([at])))]
                at += len(part)
            rows.append(sums)
        c, line_hash, head = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], np.uint64)
    of = {name: c[:, i] for i, name in enumerate(SUMS)}
    f = np.zeros((len(lines), len(NAMES)))
    many, chars, letters = np.maximum(of["words"], 1), np.maximum(of["chars"], 1), np.maximum(of["letters"], 1)
    order = np.lexsort((np.arange(len(lines)), line_hash, doc))
    again = np.zeros(len(lines))
    again[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    f[1:, 11] = (head[1:] == head[:-1]) & (doc[1:] == doc[:-1])
    if before is not None:
        again = np.maximum(again, (doc == 0) & np.isin(line_hash, before[0]))
        f[0, 11] = head[0] == before[1]
    f[:, 0] = np.log1p(of["bytes"]) / 8
    f[:, 1] = of["words"] == 0
    f[:, 2] = of["capitals"] / letters
    f[:, 3], f[:, 4], f[:, 5] = of["digits"] / chars, of["symbols"] / chars, of["punctuation"] / chars
    f[:, 6] = of["exclamations"] / many
    f[:, 7] = of["word_bytes"] / many / 10
    f[:, 8], f[:, 9], f[:, 10] = of["short"] / many, of["long"] / many, of["same"] / many
    f[:, 12] = again * (of["words"] > 0)
    f[:, 13] = of["high"] / chars
    return f, of["bytes"], line_hash, head


def _with_neighbours(f: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Inputs of the field for each line: its features, their square roots and the mean of both neighbours', and a constant.
    first, last: whether a line is its document's first or last one."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = np.where(first[1:, None], 0, f[:-1]), np.where(last[:-1, None], 0, f[1:])
    edge = np.stack([first, last], axis=1).astype(np.float64)
    return np.hstack([f, np.sqrt(f), (before + after) / 2, np.sqrt(np.maximum(before, after)), edge, np.ones((len(f), 1))])


def observations(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all lines of ``texts``, with bytes and document of each line, and the number of lines of each document; each
    text has one line at least."""
    lines = [t.split(b"\n") for t in texts]
    n = np.array([len(x) for x in lines])
    doc = np.repeat(np.arange(len(texts)), n)
    f, size, _, _ = line_features([x for y in lines for x in y], doc)
    edge = np.append(True, doc[1:] != doc[:-1])
    return _with_neighbours(f, edge, np.append(edge[1:], True)), size, doc, n


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, about ``PART`` bytes of them at a time."""
    at = 0
    while at <= len(text):
        end = text.find(b"\n", min(len(text), at + PART))
        end = len(text) if end < 0 else end
        yield text[at:end].split(b"\n")
        at = end + 1


@dataclass(frozen=True)
class Field:
    """Weights of a line's score for good over bad, transition scores (from, to; 0 bad, 1 good), and the map to quality."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray  # of the logit of the length-weighted marginal, and a constant

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def _padded(values: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length side by side: their numbers, the places of their lines (lines x documents), what is a line."""
    first = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        longest = int(n[order[i]])
        while j < len(order) and (int(n[order[j]]) <= max(8, 2 * longest)) and (j - i + 1) * int(n[order[j]]) <= 1 << 20:
            j += 1
        docs = order[i:j]
        t = np.arange(int(n[docs].max()))[:, None]
        real = t < n[docs][None, :]
        yield docs, np.where(real, first[docs][None, :] + t, 0), real
        i = j


def chain(e: np.ndarray, n: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of ``n`` lines with scores ``e`` for good: P(good) of each line, log Z and the expected
    transitions (chains x 2 x 2) of each chain."""
    good, z, moves = np.zeros(len(e)), np.zeros(len(n)), np.zeros((len(n), 2, 2))
    for docs, at, real in _padded(e, n):
        steps, width = at.shape
        s = np.stack([np.zeros((steps, width)), np.where(real, e[at], 0)], axis=-1)
        a = np.empty((steps, width, 2))
        a[0] = s[0]
        for t in range(1, steps):
            to = np.logaddexp(a[t - 1][:, :1] + transitions[0], a[t - 1][:, 1:] + transitions[1]) + s[t]
            a[t] = np.where(real[t][:, None], to, a[t - 1])
        total = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
        b = np.zeros((width, 2))
        z[docs] = total
        for t in range(steps - 1, -1, -1):
            p = np.exp(np.minimum(a[t][:, 1] + b[:, 1] - total, 0))
            good[at[t][real[t]]] = p[real[t]]
            if t:
                m = np.exp(np.minimum(a[t - 1][:, :, None] + transitions[None] + (s[t] + b)[:, None, :] - total[:, None, None], 0))
                moves[docs] += np.where(real[t][:, None, None], m, 0)
                back = np.logaddexp(transitions[:, 0] + (s[t] + b)[:, :1], transitions[:, 1] + (s[t] + b)[:, 1:])
                b = np.where(real[t][:, None], back, b)
    return good, z, moves


def _all_good(e: np.ndarray, n: np.ndarray, transitions: np.ndarray, z: np.ndarray) -> np.ndarray:
    """log P(all lines are good) of each chain."""
    ends = np.cumsum(n)
    total = np.append(0, np.cumsum(e))
    return np.minimum(total[ends] - total[ends - n] + (n - 1) * transitions[1, 1] - z, -1e-9)


def _signals(good: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each document: logit of the mean of its lines' P(good), weighted by length, and 1."""
    first = np.cumsum(n) - n
    share = np.clip(np.add.reduceat(good * (size + 1), first) / np.add.reduceat(size + 1, first), 1e-4, 1 - 1e-4)
    return np.stack([np.log(share / (1 - share)), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gradient(xs: np.ndarray, doc: np.ndarray, n: np.ndarray, w: np.ndarray, t: np.ndarray, positive: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log-likelihood of the documents' labels less a ridge, with respect to weights and transitions."""
    e = xs @ w
    good, z, moves = chain(e, n, t)
    lp = _all_good(e, n, t, z)
    moves_all = np.zeros((len(n), 2, 2))
    moves_all[:, 1, 1] = n - 1
    # of log p for good documents, of log(1 - p) for bad ones
    factor = np.where(positive, 1.0, -np.exp(lp) / -np.expm1(lp))
    factor = np.clip(factor, -50, 50) / len(n)
    return xs.T @ ((1 - good) * factor[doc]) - ridge * w, ((moves_all - moves) * factor[:, None, None]).sum(0) - ridge * t


def fit(texts: list[bytes], labels: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> Field:
    """Maximum likelihood by gradient steps (Adam) on documents' labels; then a logistic map to quality. Without labelled
    texts all weights are 0: every score is 0.5."""
    if not texts:
        width = observations([b""])[0].shape[1]
        return Field(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), np.zeros(2))
    x, size, doc, n = observations(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    xs = (x - mean) / scale
    w, t = np.zeros(x.shape[1]), np.array([[0.5, 0.0], [0.0, 0.5]])
    w[-1] = 1.0
    m = [np.zeros(len(w)), np.zeros((2, 2))]
    v = [np.zeros(len(w)), np.zeros((2, 2))]
    positive = labels == 1
    for k in range(1, steps + 1):
        gw, gt = _gradient(xs, doc, n, w, t, positive, ridge)
        for i, (p, g) in enumerate(((w, gw), (t, gt))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    s, q = _signals(chain(xs @ w, n, t)[0], size, n), np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a ridge
        p = _logistic(s @ q)
        h = (s * (p * (1 - p))[:, None]).T @ s + 1e-2 * np.eye(2) * len(s) / 100
        q = q + np.linalg.solve(h, s.T @ (labels - p) - 1e-2 * q * len(s) / 100)
    return Field(w, t, mean, scale, q)


def _long(field: Field, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """P(good) and bytes of each line of one text, whose lines' inputs are made and forgotten slice by slice: what is held of
    a line is three numbers."""
    scores, sizes, hashes, held, head = [], [], [], None, None
    slices = _slices(text)
    ahead = next(slices)
    while ahead is not None:
        lines, ahead = ahead, next(slices, None)
        f, size, line_hash, heads = line_features(lines, np.zeros(len(lines), np.int64), (np.concatenate(hashes), head) if hashes else None)
        head = heads[-1]
        hashes.append(line_hash)
        sizes.append(size)
        # of the slice before, the last two lines are held: one waits for its neighbour, and has one itself
        own = f if held is None else np.vstack([held, f])
        first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        first[0], last[-1] = held is None or len(held) == 1, ahead is None
        e = field.emissions(_with_neighbours(own, first, last))
        scores.append(e[0 if held is None else len(held) - 1 : len(own) if ahead is None else -1])
        held = own[-2:]
    n = np.array([sum(map(len, sizes))])
    return chain(np.concatenate(scores), n, field.transitions)[0], np.concatenate(sizes)


def marginals(field: Field, texts: list[bytes], batch: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """P(good) and bytes of the lines of all ``texts``, and the number of lines of each: texts of about ``batch`` bytes at a
    time, longer ones alone."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > batch:
            good, size = _long(field, texts[i])
            yield good, size, np.array([len(good)])
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= batch):
            total += len(texts[j]) + 1
            j += 1
        x, size, _, n = observations(texts[i:j])
        yield chain(field.emissions(x), n, field.transitions)[0], size, n
        i = j


def score(field: Field, texts: list[bytes], batch: int = PART) -> np.ndarray:
    """Quality of each text."""
    if not texts:
        return np.zeros(0)
    return np.concatenate([_logistic(_signals(good, size, n) @ field.quality) for good, size, n in marginals(field, texts, batch)])


def sample(docs: DataFrame, labels: DataFrame, use: Column, size: int = SAMPLE, size_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text") -> tuple[list[bytes], np.ndarray]:
    """The whole texts and labels the classifier is fitted on: of the ``size`` labelled rows with the smallest hash of key
    among those that ``use`` picks and that have a text which is used, the first by hash that have ``size_bytes`` together.
    Texts of over an eighth of that, and rows with a null key, text or label, or another label than 0 and 1, are not used.
    Of rows with equal keys the smallest text is.
    """
    known = labels.filter(use & F.col("quality").isin(0, 1)).groupBy(key).agg(F.min("quality").alias("quality"))
    usable = docs.select(key, F.octet_length(F.encode(text, "UTF-8")).alias("n")).filter(F.col("n") <= size_bytes // 8).select(key).distinct()
    known = written(known.join(usable, key, "left_semi").orderBy(F.xxhash64(key), key).limit(size), "labelled")
    found = docs.select(key, F.encode(text, "UTF-8").alias("t")).filter(F.octet_length("t") <= size_bytes // 8).join(F.broadcast(known), key)  # ``size`` rows at most
    rows = written(found.groupBy(key).agg(F.min("t").alias("t"), F.first("quality").alias("quality")), "sample")
    sizes = rows.select(key, F.octet_length("t").alias("n")).orderBy(F.xxhash64(key), key).toArrow()
    within = np.cumsum(sizes.column("n").to_numpy()) <= size_bytes
    picked = [k for k, w in zip(sizes.column(key).to_pylist(), within) if w]
    got = rows.filter(F.col(key).isin(picked)).orderBy(key).toArrow()
    return [bytes(x.as_py()) for x in got.column("t")], got.column("quality").to_numpy().astype(np.float64)


def scored(docs: DataFrame, field: Field, threshold: float = 0.3, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on) to every row of ``docs``.

    Null and empty texts are one line without words and are scored as such. Columns that clash give way.
    """
    made = ("score", "predicted")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    (whole,) = fresh([*kept, *made], "whole")
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(whole).cast(pa.binary()).to_pylist()]
            rest = batch.drop_columns([whole])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score(field, texts))], names=[*rest.schema.names, "score"])

    out = docs.select(*kept, F.col(text).alias(whole)).mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def line_labels(docs: DataFrame, field: Field, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line of each row of ``docs``: key, line (from 0), n_bytes, p_good (its marginal) and good (from
    ``threshold`` on). Null and empty texts are one empty line."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string("line long, n_bytes long, p_good double, good boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], 0
            for good, size, n in marginals(field, texts):
                which = pa.array(np.repeat(np.arange(at, at + len(n)), n))
                lines = np.arange(len(good)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(lines), pa.array(size.astype(np.int64)), pa.array(good), pa.array(good >= threshold)], names=schema.names)
                at += len(n)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a field fitted on labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    field = fit(*sample(docs, labels, ~held_out))
    return scored(docs, field, carry=["doc_id"]).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
