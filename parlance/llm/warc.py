"""WARC archives: written with an index beside them, read back by the index.

Writing: pages of equal payloads share one record of type response, the others revisit it. Every task writes an archive
of its own, a gzip member for each record, and returns an index row for each: archive, offset, length, URL, digest. A
task that runs again writes a file of another name; the index, a Parquet table, names only the files of the tasks that
count.

Reading: the selected index rows are sorted by archive and offset, ranges that touch or nearly touch are read at once,
and the records are taken from the bytes. Payloads of revisits are those of the records that they refer to.

A null payload counts as empty. Rows that repeat a page_id and a payload are one capture: all of them are responses, or
all revisits. A null page_id has no response to refer to by, so such rows are responses. The folder of the archives is
any that pyarrow's file systems open; all executors must share it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import in_arrow, shared_dir, table

#: Ranges that are no further apart are read at once, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
_NO_NAME = "urn:none:"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: forty hex digits as four numbers of eight base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    # fixed values: the digits of base 32 in Spark and in RFC 4648
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, digest, payload_bytes and refers_to (null: a response), a row for each distinct pair of id and payload."""
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), payload_digest(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    rows = rows.where("page_id is not null").distinct()
    last = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(last.select("digest", "response"), "digest", "left")
    big = F.col("payload_bytes") >= least_bytes
    return joined.select("page_id", "digest", "payload_bytes", F.when(big & (F.col("response") != F.col("page_id")), F.col("response")).alias("refers_to"))


def _record(page: int | None, url: str, digest: str, refers: int | None, payload: bytes, size: int, date: str) -> bytes:
    kind = "response" if refers is None else "revisit"
    name = lambda i: f"<urn:page:{i}>" if i is not None else f"<{_NO_NAME}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("WARC-Target-URI", "".join(url.splitlines())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n") + z.flush()


INDEX = "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, archive string, offset bigint, length bigint"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and their index under folder; returns the index."""
    known = roles(pages, id_col, html_col, least_bytes).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    # only what refers to another record needs to be looked up
    revisits = known.where("refers_to is not null")
    rows = rows.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "digest", "payload_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives")
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            offsets, lengths = [], []
            for page, url, digest, size, refers, payload in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                record = _record(page, url, digest, refers, payload or b"", size, date)
                out.write(record)
                offsets.append(at)
                lengths.append(len(record))
                at += len(record)
            kinds = ["response" if r is None else "revisit" for r in batch.column(4).to_pylist()]
            columns = [*batch.columns[:4], pa.array(kinds, pa.string()), pa.array([name] * len(kinds), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "digest", "payload_bytes", "record_type", "archive", "offset", "length"])
        if out is not None:
            out.close()

    in_arrow(rows, run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Of (offset, length) in order: start, end, and the places of the rows in it."""
    start = end = None
    held: list[int] = []
    for k, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP or offset + length - start > READ):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        held.append(k)
        end = max(end, offset + length)
    if held:
        yield start, end, held


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index rows name: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit)."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def parsed(data: bytes) -> tuple:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        h = dict(x.split(": ", 1) for x in lines[1:])
        number = lambda s: int(s[len("<urn:page:") : -1]) if s and s.startswith("<urn:page:") else None
        payload = rest[: int(h["Content-Length"])]
        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                raise ValueError(f"damaged record {h['WARC-Record-ID']}")
        out = (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], number(h.get("WARC-Refers-To")), digest, size)
        return (*out, payload if h["WARC-Type"] == "response" else None) if payloads else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives")
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            archives, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(archives):
                stop = at
                while stop < len(archives) and archives[stop] == archives[at]:
                    stop += 1
                with fs.open_input_file(f"{path}/{archives[at]}") as f:
                    for start, end, held in _ranges(list(zip(offsets[at:stop], lengths[at:stop]))):
                        data = f.read_at(end - start, start)
                        rows = [parsed(zlib.decompress(data[offsets[at + k] - start : offsets[at + k] - start + lengths[at + k]], 31)) for k in held]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                at = stop

    chosen = index.select("archive", "offset", "length")
    return in_arrow(chosen.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset"), run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and what is read back of them."""
    folder = shared_dir(spark)
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False)


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, url, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
d AS (SELECT page_id, coalesce(url, '') AS url, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31), 1)), '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS r FROM d)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM m
"""
