"""Operator 8: WARC archives as a Python data source, read and written.

A record is a gzip member of its own whose extra field "sl" (the skip lengths of the WARC standard's annex) tells the
member's length, so a reader goes from header to header. It inflates no more than a record's head, decides by the
pushed predicates on record type and headers, and inflates the payload only if that column is asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from quarrygraph.llm.common import cut, fresh_path, table

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_length long, payload_digest string, refers_to string, payload binary"
#: Revisits need payloads of so many bytes at least; bytes of a file that one read task takes.
LEAST, SPLIT = 100, 64 << 20
_DATE = "1970-01-01T00:00:00Z"  # the table has none; a fixed one keeps files reproducible


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member with skip lengths."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in (url or "") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(plain) + z.flush()
    total = 24 + len(body) + 8
    # header with FEXTRA; the subfield has the lengths of the member and of what it inflates to
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(plain) & 0xFFFFFFFF)
    return start + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _head(inflate, member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and what was inflated behind them; no more is inflated than needed."""
    plain, rest = b"", member
    while b"\r\n\r\n" not in plain:
        got = inflate.decompress(rest, 512)
        if not got and not inflate.unconsumed_tail:
            raise ValueError("a record without the end of its header")
        plain, rest = plain + got, inflate.unconsumed_tail
    head, _, more = plain.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:]), more


def _id(field: str | None) -> int | None:
    x = (field or "").removeprefix("<urn:page:").rstrip(">")
    return int(x) if x else None


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    """Options: path (a URI), payload ("false": not decoded). A split takes the records that start in it."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters):  # noqa: N802
        own = {"record_type", "record_id", "page_id", "payload_digest", "target_uri", "refers_to"}
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in own:
                values = ({f.value} if isinstance(f, EqualTo) else set(f.value)) - {None}  # null equals nothing
                at = f.attribute[0]
                self.tests[at] = self.tests[at] & values if at in self.tests else values
            elif not isinstance(f, IsNotNull) or f.attribute != ("record_type",):
                yield f

    def partitions(self) -> list[Split]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        files = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.path.endswith(".warc.gz") and x.size]
        return [Split(x.path, a, min(x.size, a + SPLIT)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, SPLIT)] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[tuple]:
        if not split.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(split.path) as f:
            size, at = f.size(), 0
            if split.start:
                at = self._next(f, split.start, size)
            while at < split.end and at < size:
                f.seek(at)
                start = f.read(24)
                total, plain = struct.unpack("<II", start[16:24])
                member = f.read(total - 24)
                at += total
                inflate = zlib.decompressobj(-15)
                head, more = _head(inflate, member)
                page, refers = _id(head["WARC-Record-ID"]), _id(head.get("WARC-Refers-To"))
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                row = {"record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "target_uri": head["WARC-Target-URI"], "page_id": page, "payload_digest": digest, "refers_to": None if refers is None else str(refers)}
                if any(row[k] not in v for k, v in self.tests.items()):
                    continue
                payload = None
                if self.payload and head["WARC-Type"] == "response":
                    block = (more + inflate.decompress(inflate.unconsumed_tail) + inflate.flush())[: int(head["Content-Length"])]
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{row['record_id']}: the payload does not have its digest")
                yield (row["record_id"], row["record_type"], row["target_uri"], page, int(head["X-Payload-Length"]), digest, row["refers_to"], payload)

    @staticmethod
    def _next(f, at: int, size: int) -> int:
        """The first member at or behind a place: where a gzip start with skip lengths is followed by another or by the end."""
        sign = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
        f.seek(at)
        held = b""
        base = at
        while True:
            i = held.find(sign)
            while i < 0 or len(held) < i + 24:
                got = f.read(1 << 20)
                if not got:
                    return size
                if i < 0 and len(held) > len(sign):
                    base, held = base + len(held) - len(sign), held[-len(sign) :]
                held += got
                i = held.find(sign)
            total = struct.unpack("<I", held[i + 16 : i + 20])[0]
            here = f.tell()
            f.seek(min(size, base + i + total))
            after = f.read(16) if base + i + total <= size else b"?"
            f.seek(here)
            if after in (b"", sign):
                return base + i
            base, held = base + i + 1, held[i + 1 :]


@dataclass
class Done(WriterCommitMessage):
    path: str
    records: int


class Writer(DataSourceArrowWriter):
    """Rows (page_id, url, record_type, refers_to, size, digest, payload); a task's file gets its name when it is complete."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        tmp, n = f"{name}.{task.taskAttemptId()}.tmp", 0
        with fs.open_output_stream(tmp) as f:
            for batch in iterator:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    r = {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}
                    f.write(record(r["page_id"], r["url"], r["record_type"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"]))
                    n += 1
        fs.move(tmp, name)
        return Done(name, n)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "qg_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) under the URI path.

    Null html is an empty payload and null url an empty target. Of equal payloads of at least LEAST bytes the smallest
    page_id is the response and others revisit it (null page_id only refers, and is a response where no other is);
    smaller payloads are all responses. Rows that repeat a page_id are written as often. No rows, no files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = x.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    revisits = cut(x.select("page_id", "digest").join(first, "digest").where("page_id is null or page_id <> first").where("first is not null").groupBy(F.col("page_id").alias("p"), "digest").agg(F.min("first").alias("refers_to")), "warc-revisits")
    on = F.col("p").eqNullSafe(F.col("page_id")) & (revisits.digest == x.digest)
    x = x.join(revisits, on, "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to", "size", x.digest.alias("digest"), F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))
    x.write.format("qg_warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("qg_warc").option("path", path).option("payload", str(payload).lower()).load()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), at)
    x = read_warc(spark, at)
    revisit = F.col("record_type") == "revisit"
    # of a response the figures are those of the payload that was read, of a revisit those of its headers
    return x.select(
        "page_id",
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
x AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM x WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM x LEFT JOIN f USING (payload_digest)
"""
