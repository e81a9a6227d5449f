"""WARC archives: a writer and a Python data source that reads them.

Records are written by Spark's text writer, with the two line ends that close every WARC record as its separator: any
file system that Spark writes to will do, and its commit protocol drops what lost tasks have left. Of pages with equal
payloads one is stored and the others become revisit records that refer to it.

The data source plans partitions of whole files and, if asked to, of byte ranges of uncompressed ones; a range starts at
the first record in it. Filters on record type and headers are taken over by the reader: it parses the headers of a record
first, and where they do not pass, or where payloads are not asked for, skips the payload's bytes without decoding them.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from copse.llm.common import shared_path, table, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows and bytes of payload of a batch handed to Spark, at most (a single larger payload is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_length long, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Columns that hold a header, which filters on them are pushed down by.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_length": "content-length",
    "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to",
}
NUMBERS = ("content_length", "payload_length")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 (20 bytes: no padding), from eight numbers of 20 bits."""
    digits = F.sha1(data)
    number = lambda i: F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, k: F.substring(F.lit(BASE32), F.call_function("shiftright", number(i), F.lit(5 * k)).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(i, k) for i in range(8) for k in (3, 2, 1, 0)])


def records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row ``value`` for each row of ``pages``: its WARC record without the closing line ends.

    Null payloads are empty ones. Of payloads of at least ``min_bytes`` bytes that are equal the record with the largest
    key is the response and holds the payload; others revisit it. Digests are gathered as one maximum for each, combined
    before the shuffle; those that occur once are left out, so that the payloads themselves are not joined by digest unless
    they have copies, and a payload with a third of all rows is a skewed join that Spark splits. Rows with equal keys and
    payloads are one response and revisits of it; null keys are less than any other and named ``null``. A null url has no
    target header.
    """
    p = pages.select(F.col(key).alias("k"), F.translate(F.col(url), "\r\n", "").alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p"))
    p = p.withColumn("d", base32_sha1(F.encode("p", "UTF-8"))).withColumn("n", F.octet_length("p").cast("long"))
    ids = written(p.select("k", "d", "n").filter(F.col("n") >= min_bytes), "digests")
    copies = ids.groupBy("d").agg(F.max("k").alias("first"), F.count("*").alias("c"), F.max("n").alias("size")).filter("c > 1").select(F.col("d").alias("of"), "first")
    copies = written(copies, "copies")
    return p.join(copies, (F.col("d") == F.col("of")) & (F.col("n") >= min_bytes), "left").select(_record(date).alias("value"))


def _record(date: str) -> Column:
    id_ = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.coalesce(F.col("of").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")), F.lit(False))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", id_(F.col("k"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("u")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", id_(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("p")),
    )


def write(pages: DataFrame, path: str, compression: str = "none", **options) -> None:
    """Write ``pages`` as archives in the folder ``path``: one file for each partition. compression: none or gzip."""
    records(pages, **options).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end of a file that can't be split


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """file: and plain paths are local or mounted; others as far as pyarrow knows their scheme."""
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split, self.verify = int(options.get("splitbytes", 0)), options.get("verify", "false").lower() == "true"
        self.malformed = options.get("malformed", "error").lower()
        if self.malformed not in ("error", "skip"):
            raise ValueError("malformed must be error or skip")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over comparisons and memberships of header columns; the others go back to Spark."""
        ops = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in ops and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], ops[type(f)], tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory else [fs.get_file_info(root)]
        out = []
        for f in sorted((f for f in found if f.is_file and f.size and not re.match(r"[._]", f.base_name)), key=lambda f: f.path):
            if f.base_name.endswith(".gz"):
                out.append(Part(f.path, 0, None))
            else:
                step = self.split or f.size
                out += [Part(f.path, i, min(i + step, f.size)) for i in range(0, f.size, step)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _filesystem(self.path)
        schema = _arrow_schema()
        rows: list[list] = [[] for _ in schema]
        size = 0
        with fs.open_input_file(part.path) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if part.end is None else raw
            for values in self._records(stream, part):
                for v, to in zip(values, rows):
                    to.append(v)
                size += len(values[-1] or b"")
                if len(rows[0]) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)
                    rows, size = [[] for _ in schema], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    def _passes(self, values: dict[str, object]) -> bool:
        for name, op, want in self.tests:
            v = values[name]
            if v is None or not (v in want if op == "in" else v == want if op == "==" else v > want if op == ">" else v >= want if op == ">=" else v < want if op == "<" else v <= want):
                return False
        return True

    def _records(self, stream, part: Part) -> Iterator[tuple]:
        """Those records that start within the part; one is found at its start or by the line ends before it.

        A payload may hold what looks like a record: ranges begin at a version line that follows two line ends and whose
        headers, up to an empty line, name a type, an id and a length. Payloads that hold archives themselves can deceive
        that, which is why whole files are the default.
        """
        buffer = _Buffer(stream, max(0, part.start - 4))
        if part.start and not buffer.to_record(part.end):
            return
        while part.end is None or buffer.at < part.end:
            head = buffer.head()
            if head is None:
                return
            headers = {}
            for line in head.split(b"\r\n")[1:]:
                name, colon, value = line.partition(b":")
                if colon:
                    headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
            size = headers.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                if self.malformed == "error":
                    raise ValueError(f"{part.path}: the record that ends its headers at byte {buffer.at} has no valid Content-Length")
                buffer.next, buffer.at = max(0, buffer.next - 4), buffer.at - min(4, buffer.next)  # the next record may follow at once
                if not buffer.to_record(part.end):
                    return
                continue
            length = int(size)
            values = {c: headers.get(h) for c, h in HEADERS.items()}
            values |= {c: int(v) if (v := values[c]) is not None and v.isascii() and v.isdigit() else None for c in NUMBERS}
            wanted = self._passes(values)
            if wanted and (self.payload or self.verify):
                payload = buffer.take(length)
                if len(payload) < length:
                    if self.malformed == "error":
                        raise EOFError(f"{part.path} ends within the payload of {values['record_id']}")
                    return
            else:
                payload = None
                buffer.skip(length)
            buffer.skip(4)
            if not wanted:
                continue
            if self.verify and length and not _verified(payload, headers):
                raise ValueError(f"payload of {values['record_id']} in {part.path} does not match its digest")
            yield (*values.values(), list(headers.items()), payload if self.payload else None)


def _verified(block: bytes, headers: dict[str, str]) -> bool:
    """Whether a block has the SHA-1 that its headers tell, if they do: of the payload, which is what follows the HTTP
    headers where the block is a message with such."""
    import base64
    import hashlib

    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1" or not digest:
        return True
    if headers.get("content-type", "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    found = hashlib.sha1(block)
    return digest.upper() == base64.b32encode(found.digest()).decode() or digest.lower() == found.hexdigest()


def _arrow_schema() -> pa.Schema:
    headers = [(c, pa.int64() if c in NUMBERS else pa.string()) for c in HEADERS]
    return pa.schema([*headers, ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


class _Buffer:
    """Sequential reading of a stream with little held; skipping seeks where the stream can."""

    CHUNK = 1 << 18

    def __init__(self, stream, at: int) -> None:
        self.stream, self.at, self.held, self.next = stream, at, bytearray(), 0  # at: place in the file of held[next]
        if at:
            stream.seek(at)

    def more(self) -> bool:
        data = self.stream.read(self.CHUNK)
        if self.next:
            del self.held[: self.next]
            self.next = 0
        self.held += data
        return bool(data)

    def _pass(self, n: int) -> None:
        self.next += n
        self.at += n

    def head(self) -> bytes | None:
        """Version line and headers; None at the end."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", self.next + seen)) < 0:
            seen = max(0, len(self.held) - self.next - 3)
            if not self.more():
                if self.held.strip():
                    raise EOFError("an archive ends within a header")
                return None
        out = bytes(self.held[self.next : end])
        self._pass(end + 4 - self.next)
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or fewer at the end; what is not held is read in one go."""
        out = [bytes(self.held[self.next : self.next + n])]
        left = n - len(out[0])
        self._pass(len(out[0]))
        while left and (data := self.stream.read(left)):
            out.append(data)
            self.at += len(data)
            left -= len(data)
        return b"".join(out)

    def skip(self, n: int) -> None:
        ahead = n - (len(self.held) - self.next)
        if ahead > 0:
            self.stream.seek(ahead, 1)
            self.held, self.next = bytearray(), 0
            self.at += n
        else:
            self._pass(n)

    MARK = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")

    def to_record(self, end: int | None) -> bool:
        """Go to the next record that starts before ``end``: behind two line ends, with a type, an id and a length."""
        seen = 0
        while True:
            while (found := self.MARK.search(self.held, self.next + seen)) is None:
                seen = max(seen, len(self.held) - self.next - 14)
                self._pass(seen)
                seen = 0
                if (end is not None and self.at >= end) or not self.more():
                    return False
            while (stop := self.held.find(b"\r\n\r\n", found.end())) < 0:
                before = self.next
                if not self.more():
                    return False
                found = self.MARK.search(self.held, found.start() - before)
            names = {line.partition(b":")[0].strip().lower() for line in bytes(self.held[found.end() : stop]).split(b"\r\n")[1:]}
            if end is not None and self.at + found.end() - self.next >= end:
                return False
            if {b"warc-type", b"warc-record-id", b"content-length"} <= names:
                self._pass(found.end() - self.next)
                return True
            seen = found.end() - self.next


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``. Options: payload (true: give payloads; false: skip them all), verify (true:
    compare payloads with their SHA-1 digests, an error if one differs), splitBytes (of ranges of uncompressed files; 0:
    whole files) and malformed (error: a record without a valid Content-Length, or an archive that ends within a payload,
    is an error; skip: reading goes on at the next record that can be told, and a payload cut short is left out). The column
    payload holds a record's whole block."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: what their records say. Digests and lengths of responses are those of
    the payloads read; revisits have their response's, which their own headers repeat."""
    path = shared_path(spark, "archives")
    write(table(spark, sf_dir, "pages"), path)
    r = read(spark, path, verify="true")
    page = lambda c: F.when(F.regexp_extract(c, "<urn:page:(.*)>", 1) != "null", F.regexp_extract(c, "<urn:page:(.*)>", 1)).cast("long")
    response = F.col("record_type") == "response"
    return r.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS d FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
