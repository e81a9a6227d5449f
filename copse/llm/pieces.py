"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, by the character map that is compiled into the model: at every place the longest prefix of what
is left that the map has is replaced. With each byte of the result goes the place in the source that it comes from, so
that every piece has a span of the source's bytes. Merges are the library's, on the normalised text and with a model whose
own normaliser is taken out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.llm.common import fresh, table

MODEL = "piece_bpe_32k.model"
#: White space as it is written in pieces.
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, all bytes) of the fields of a message in protocol-buffer encoding."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        start = at
        number, kind = divmod(varint(), 8)
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield number, value, data[start:at]


def _message(number: int, body: bytes) -> bytes:
    size, out = len(body), bytearray([number * 8 + 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + body


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, whose values are places of replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.blob = compiled[4 + size :]
        keys = list(self._keys())
        singles = {k for k in keys if len(k) == 1}
        behind = {k[1] for k in keys if len(k) > 1}
        of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        parts = ([of(singles)] if singles else []) + ([f"[\\s\\S](?={of(behind)})"] if behind else [])
        #: Where a replacement may begin: at a character that is a key, or before one that goes on in a key.
        self.candidates = re.compile("|".join(parts)) if parts else None

    @staticmethod
    def _down(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The unit that ``byte`` leads to from ``node`` (a unit's place less its label), if there is one."""
        to = node ^ byte
        if to >= len(self.units) or self.units[to] & 0x800000FF != byte:
            return None
        return to

    def _keys(self) -> Iterator[str]:
        units, labels = np.array(self.units, np.uint32), np.arange(1, 256)
        todo = [(self._down(self.units[0]), b"")] if self.units else []
        while todo:
            node, key = todo.pop()
            to = node ^ labels
            fits = to < len(units)
            fits[fits] = units[to[fits]] & 0x800000FF == labels[fits]
            for byte, place in zip(labels[fits].tolist(), to[fits].tolist()):
                unit = self.units[place]
                if unit >> 8 & 1:
                    yield (key + bytes([byte])).decode()
                todo.append((place ^ self._down(unit), key + bytes([byte])))

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that ``data`` goes on with at ``at``, and their replacement."""
        node, found = self._down(self.units[0]), None
        for i in range(at, len(data)):
            to = self._step(node, data[i])
            if to is None:
                break
            unit = self.units[to]
            node = to ^ self._down(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.blob[found[1] : self.blob.index(b"\0", found[1])]


@dataclass
class Model:
    processor: object  # as it is
    merges: object  # with its normaliser taken out
    map: CharacterMap
    dummy_prefix: bool
    lean: bool  # white space at the ends goes, runs of it are one
    escape: bool
    lengths: np.ndarray  # bytes of the normalised text that each id stands for


@functools.cache
def load(path: str) -> Model:
    """The model at ``path``, or of that name among the public tokenizers."""
    import public_tokenizers
    import sentencepiece

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        data = f.read()
    rest, pieces, rules, trainer = [], [], {}, {}
    for number, value, whole in _fields(data):
        if number == 3:
            rules = {n: v for n, v, _ in _fields(value)}
            continue
        if number == 1:
            one = {n: v for n, v, _ in _fields(value)}
            pieces.append((one[1].decode(), one.get(3, 1)))
        if number == 2:
            trainer = {n: v for n, v, _ in _fields(value)}
        rest.append(whole)
    if trainer.get(3) != 2 or not trainer.get(35):
        raise ValueError("only models of byte-pair merges that fall back to bytes are encoded with offsets")
    if any(kind == 4 for _, kind in pieces) or trainer.get(24):
        raise ValueError("models with symbols of their users' or with white space as a suffix are not encoded with offsets")
    plain = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"  # no prefix, no cleaning, nothing escaped
    processor, merges = (sentencepiece.SentencePieceProcessor(model_proto=x) for x in (data, b"".join(rest) + _message(3, plain)))
    lengths = [1 if kind == 6 else 0 if kind in (2, 3) else len(p.encode()) for p, kind in pieces]
    return Model(processor, merges, CharacterMap(rules.get(2, b"")), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)), np.array(lengths, np.int32))


def normalised(text: str, model: Model) -> tuple[bytes, np.ndarray]:
    """The normalised text in UTF-8, and of each of its bytes, and of its end, the byte of ``text`` that it comes from. Bytes of a
    replacement all come from the first of what they replace; what a model adds in front comes from the first byte."""
    source = text.encode()
    out, sizes = source, None
    if model.map.candidates and (found := _replacements(text, source, model.map)):
        parts, origins, at = [], [], 0
        for start, size, new in found:
            parts += [source[at:start], new]
            origins += [np.arange(at, start), np.full(len(new), start)]
            at = start + size
        out, sizes = b"".join([*parts, source[at:]]), np.concatenate([*origins, np.arange(at, len(source) + 1)])
    origin = np.arange(len(source) + 1) if sizes is None else sizes
    if model.lean:
        out, origin = _lean(out, origin)
    if not out:
        return b"", np.array([origin[-1]])
    white = (MARK if model.escape else " ").encode()
    if model.escape:
        wide = np.where(np.frombuffer(out, np.uint8) == 32, len(white), 1)
        origin = np.append(np.repeat(origin[:-1], wide), origin[-1])
        out = out.replace(b" ", white)
    if model.dummy_prefix:
        out, origin = white + out, np.concatenate([np.full(len(white), origin[0]), origin])
    return out, origin


def _replacements(text: str, source: bytes, known: CharacterMap) -> list[tuple[int, int, bytes]]:
    """(place, bytes replaced, replacement) in order: the map's longest prefix at every place that no other covers."""
    out, seen, at, end = [], 0, 0, 0
    for m in known.candidates.finditer(text):
        at += len(text[seen : m.start()].encode())
        seen = m.start()
        if at >= end and (hit := known.longest(source, at)):
            out.append((at, *hit))
            end = at + hit[0]
    return out


def _lean(out: bytes, origin: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Without spaces at the ends and but the first of those that follow each other."""
    space = np.frombuffer(out, np.uint8) == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(out):
        keep[0] = not space[0]
        if keep.any() and space[last := np.flatnonzero(keep)[-1]]:
            keep[last] = False
    where = np.flatnonzero(keep)
    end = origin[-1] if not len(out) or not space[-1] or not len(where) else origin[where[-1] + 1]
    return np.frombuffer(out, np.uint8)[where].tobytes(), np.append(origin[where], end)


def encoded(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a whole text, with an end id, and the byte of the text that each piece starts at, and the last ends at."""
    whole, origin = normalised(text, model)
    ids = model.merges.encode(whole.decode(), add_eos=True, return_type="numpy")
    places = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(model.lengths[ids], out=places[1:])
    return ids, origin[places]


def _few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at a time: what is made of a batch is larger than the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` without ``text``, with ids (as the library gives them, and an end id), starts (the byte of the text where each
    piece's span starts; the last entry is where the last one ends) and n_bytes (of the text).

    Spans follow each other without gaps: the text's bytes from starts[i] to starts[i + 1] are piece i's. Replacements and
    pieces that a model puts in front have the span of what they come from, which may be empty, as the end id's is. A null
    text is empty: its only id is the end. Columns ids, starts and n_bytes of ``docs`` give way.
    """
    kept = [c for c in docs.columns if c != text and c.lower() not in ("ids", "starts", "n_bytes")]
    schema = T.StructType([*[docs.schema[c] for c in kept], *T._parse_datatype_string("ids array<int>, starts array<long>, n_bytes long").fields])
    types = to_arrow_schema(schema)
    (own,) = fresh(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = batch.column(own).to_pylist()
            made = [encoded(x, load(model)) for x in texts]
            columns = [_lists([x[i] for x in made], types.field(f).type) for i, f in enumerate(("ids", "starts"))]
            n_bytes = pc.binary_length(batch.column(own)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([own]).columns, *columns, n_bytes], schema=types)

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(own)).mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind.value_type), type=kind)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` without ``ids``, with ``text``: what the library decodes the ids to. Null ids are none; a column text of
    ``encoded`` gives way."""
    kept = [c for c in encoded.columns if c != ids and c.lower() != "text"]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("text", T.StringType())])
    types = to_arrow_schema(schema)
    (own,) = fresh(kept, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model).processor
        for batch in _few(batches):
            texts = pa.array([processor.decode(x.values.to_numpy()) if x.is_valid else "" for x in batch.column(own)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([own]).columns, texts], schema=types)

    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias(own)).mapInArrow(run, schema)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: digests of both, and the bytes of the text that the pieces' spans cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("ids")
    digest = F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256")
    covered = (F.element_at("starts", -1) - F.get("starts", F.lit(0))).alias("covered")
    found = decode(encode(docs).select("doc_id", "ids", F.size(ids).cast("long").alias("n_tokens"), digest, covered))
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "covered")
