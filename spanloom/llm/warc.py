"""WARC archives: a Spark data source that reads them and a writer that makes one archive for each partition.

The reader plans one partition for each file, takes equality and IN predicates on ``record_type``, ``record_id``,
``target_uri``, ``payload_digest`` and ``refers_to``, parses the headers of a record first and decodes its payload only
if the record passes and the schema asks for it. Records are gzip members of their own, as is usual for WARC.

Writing: of records with equal payloads of ``least_bytes`` at least, the one with the largest page_id is a response and
the others revisit it.

Results on odd input: null html is an empty payload; a null page_id never is the original of a group, and its record
gets the id ``null``; rows that repeat the largest page_id of a group are all responses; no pages give no archive and no
rows; an empty, truncated or damaged file gives the records before the damage (one whose length is no number ends it); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from .. import runtime

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary, payload_bytes long, payload_sha1 string"
HEADERS = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}
PREFIX = "urn:page:"
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Members:
    """The gzip members of a stream, or its plain bytes, as one stream of decompressed bytes with bounded buffers: no read
    takes over chunk bytes and no step of decompression gives over most, whatever the ratio."""

    def __init__(self, source, chunk: int = 1 << 18, most: int = 1 << 20):
        self.source, self.chunk, self.most, self.data, self.at, self.raw, self.unzip = source, chunk, most, b"", 0, b"", None
        self.raw = source.read(chunk)
        self.zipped = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.chunk)
            if not self.raw and self.unzip is None:
                return False
        if not self.zipped:
            new, self.raw = self.raw, b""
        else:
            self.unzip = self.unzip or zlib.decompressobj(31)
            ended = not self.raw
            try:
                new = self.unzip.decompress(self.raw, self.most)
            except zlib.error:  # a damaged member: what lies behind it cannot be told
                self.raw, self.unzip = b"", None
                self.source = io.BytesIO()
                return False
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.unzip = None
            elif ended and not new:  # cut short
                return False
        self.data, self.at = self.data[self.at :] + new, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (found := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - self.at - len(mark))
            if not self._more():
                return None
        out, self.at = self.data[self.at : found], found + len(mark)
        return out

    def take(self, n: int, keep: bool = True) -> bytes | None:
        parts, left = [], n
        while left:
            if self.at == len(self.data) and not self._more():
                return None
            part = self.data[self.at : self.at + left]
            self.at += len(part)
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def _fields(block: bytes) -> dict[bytes, bytes]:
    lines = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {name.strip().lower(): value.strip() for name, value in lines}


def _bare(column: str, value: bytes | None) -> str | None:
    if value is None:
        return None
    text = value.decode("utf-8", "replace")
    if column in ("record_id", "refers_to"):
        return text.strip("<>")
    return text.removeprefix("sha1:") if column == "payload_digest" else text


def records(source, columns: list[str], allowed: dict[str, set]) -> Iterator[dict]:
    """Rows of the columns asked for. A record that the predicates exclude is passed over without its block being kept."""
    stream = Members(source)
    wanted = any(c in ("payload", "payload_bytes", "payload_sha1") for c in columns)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head[head.find(b"WARC/") :])
        length = fields.get(b"content-length", b"0")
        if not length.isdigit():
            return
        n = int(length)
        row = {c: _bare(c, fields.get(h)) for c, h in HEADERS.items()}
        if any(row[c] not in values for c, values in allowed.items()):
            if stream.take(n + 4, keep=False) is None:
                return
            continue
        whole = wanted and row["record_type"] != "revisit"
        if whole or "http_length" in columns:
            block = stream.take(n)
            if block is None or stream.take(4) is None:
                return
            http, payload = {}, block
            if fields.get(b"content-type", b"").startswith(b"application/http"):
                cut = block.find(b"\r\n\r\n")
                http, payload = _fields(block[:cut]), block[cut + 4 :]
            row["http_length"] = int(http[b"content-length"]) if http.get(b"content-length", b"").isdigit() else None
            if whole:
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest() if "payload_sha1" in columns else None}
        elif stream.take(n + 4, keep=False) is None:
            return
        yield {c: row.get(c) for c in columns}


class WarcFile(InputPartition):
    pass


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.allowed = path, schema.names, {}
        self.arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield f

    def partitions(self):
        fs, folder = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(folder).type == pafs.FileType.File:
            return [WarcFile(folder)]
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [WarcFile(i.path) for i in sorted(found, key=lambda i: i.path) if i.path.endswith((".warc", ".warc.gz"))] or [WarcFile(None)]

    def read(self, partition):
        if partition.value is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.value, compression=None) as source:
            rows, size = [], 0
            for row in records(source, self.columns, self.allowed):
                rows.append(row)
                size += len(row.get("payload") or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder or file); a schema with fewer columns spares what they need."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)


def reader(spark: SparkSession):
    """Registers the source and lets the session push predicates down to Python sources, which stays so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc")


def with_originals(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to. Only digests that occur twice are joined back; they are counted
    before they are shuffled, and joined on a salt of the page too, so a payload of a third of all pages is spread over
    SALTS tasks."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = own.filter(F.octet_length("payload") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.count("*").alias("__n"), F.max("page_id").alias("__original")).filter("__n > 1 and __original is not null").drop("__n")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = large.select("page_id", "payload_digest", salt.alias("__salt")).join(groups, ["payload_digest", "__salt"]).drop("__salt").filter("page_id is null or page_id <> __original").distinct()
    # rows of one page may differ, so the digest is part of the key
    revisits = revisits.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "__original")
    marked = own.join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return marked.select("page_id", "url", "payload", "payload_digest", F.col("__original").alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join((url or "about:blank").split())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
    return zipped.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + zipped.flush()


def write(pages: DataFrame, to: str, least_bytes: int = 1000) -> DataFrame:
    """Writes the archives and returns their manifest. A task that runs again replaces its archive."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs, folder = pafs.FileSystem.from_uri(to)
                fs.create_dir(folder, recursive=True)
                final = f"{folder}/pages-{task.partitionId():06d}.warc.gz"
                draft = f"{final}.{task.taskAttemptId()}"
                out = fs.open_output_stream(draft, compression=None)
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                out.write(_record(*(v.as_py() for v in row)))
                n += 1
        if out is not None:
            out.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "n_records": [n]})

    return runtime.written(with_originals(pages, least_bytes).mapInArrow(part, "path string, n_records long"), "warc-manifest")


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A row for each record, from the archives: responses by their payloads, and revisits by their headers alone. Each kind
    is read by a predicate that the source takes over, so the blocks of the other are passed by."""
    spark = pages.sparkSession
    to = runtime.scratch(spark, "warc")
    write(pages, to, least_bytes)
    head = "record_id string, record_type string, payload_digest string, refers_to string, http_length long"
    responses = reader(spark).schema(f"{head}, payload_bytes long, payload_sha1 string").load(to).filter("record_type = 'response'")
    revisits = reader(spark).schema(head).load(to).filter("record_type = 'revisit'")
    rows = responses.unionByName(revisits, allowMissingColumns=True)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) as long)")
    return rows.select(
        number("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "http_length").alias("payload_bytes"),
        F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
