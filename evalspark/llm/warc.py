"""WARC archives with revisits resolved by payload digest.

Pages are written once with their payloads' digests. Headers only (row, page_id, url, digest, size) are then shuffled by digest: of the
records with equal payloads of at least MIN_BYTES that with the largest page_id is the response, the others
become revisits of it, whose records are made of headers alone. The payloads of responses go from their table to the archives;
they are shuffled only if there are too many revisits to tell all tasks which rows these are. Records get fresh headers. A row of the text sink
is a record and its line separator the two line ends that close a WARC record, so Spark's own
committer writes the archives and a task that is lost is simply run again. Records are put into files
by classes of size (CLASSES), so that a file has at most FILE_BYTES of payloads, or one record.

The archives are read back as streams, record by record, by their Content-Length (payloads may contain any line ends). Revisits
are resolved by joining the record they refer to.

A null payload is empty. Rows that repeat a page_id are records of their own, with ids of their own: of repeated rows of the largest page_id one
is the response and the others revisit it. NULL page_ids are written as "null", sort below all others, and come back as NULL. Urls lose control characters.
An empty table gives archives without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import BROADCAST_KEYS, shared_path, written

MIN_BYTES, FILE_BYTES = 0, 64 << 20
#: Upper ends of the classes of payload sizes; a file has as many records of a class as fill FILE_BYTES.
CLASSES = (64 << 10, 4 << 20, FILE_BYTES)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "refers_to_id", "url", "digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("html", T.StringType())]
)
ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in SCHEMA.fields])
_HEADERS = ["_row", "page_id", "url", "digest", "bytes"]


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a text in UTF-8, in base 32: forty bits, ten hexadecimal digits, are eight digits of it."""
    h = F.sha1(F.encode(text, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def stored(pages: DataFrame) -> DataFrame:
    """_row (unique), page_id, url, digest, bytes, html of every page, written to the shared folder."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "").alias("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url, F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"), "html")
    path = shared_path(pages.sparkSession, "warc-pages")
    rows.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(rows.schema).parquet(path)


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The headers of the rows that revisit another, with _of, that one's row."""
    large = headers.where(F.col("bytes") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max(F.struct("page_id", "_row")).alias("_top"), F.count("*").alias("_n")).where("_n > 1")
    met = large.join(groups.select("digest", F.col("_top._row").alias("_of")), "digest").where("_row <> _of")
    return met.select(*_HEADERS, "_of")


def record_id(row: Column) -> Column:
    h = F.md5(F.concat(F.lit("row:"), row.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """A WARC record, without its closing line ends, for each of rows (headers, html, _of: NULL for a response)."""
    revisit = F.col("_of").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(_END))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("_row"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("_of"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    block_bytes = F.octet_length(http) + F.octet_length("html")
    return rows.select(F.concat(head, F.lit("Content-Length: "), block_bytes, F.lit(_END), http, F.col("html")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes the records of pages (page_id, url, html) to gzipped archives below path."""
    rows = stored(pages)
    again = written(revisits(rows.select(*_HEADERS), min_bytes), "warc-revisits")
    few = again.count() <= BROADCAST_KEYS
    gone = again.select("_row")
    whole = rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti").withColumn("_of", F.lit(None).cast("long"))
    largest = rows.agg(F.max("bytes")).first()[0] or 0

    def write(part: DataFrame, each: int) -> None:
        records(part).write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)

    low = 0
    for high in CLASSES:
        last = high == CLASSES[-1]
        if largest >= low:
            write(whole.where((F.col("bytes") >= low) & (F.lit(last) | (F.col("bytes") < high))), FILE_BYTES // high)
        low = high
    write(again.withColumn("html", F.lit("")), FILE_BYTES // CLASSES[0])


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, which is unpacked as far as it is read."""
    with gzip.open(io.BytesIO(content)) as stream:
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError("this is no WARC record")
            lines = iter(stream.readline, b"\r\n")
            head = dict((x.decode().rstrip("\r\n").split(": ", 1) + [""])[:2] for x in lines)
            block = stream.read(int(head["Content-Length"]))
            yield head, block
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"the record {head['WARC-Record-ID']} doesn't end where it says")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record below path: page_id, record_type, record_id, refers_to_id, url, digest, payload_bytes, html.

    payload_bytes is measured on the payloads of responses, and their digests are compared with them;
    revisits have the digest of their header and no payload_bytes. html is NULL unless payloads are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parsed(content.as_py()):
                    payload, digest = block.partition(b"\r\n\r\n")[2], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = head["WARC-Type"] == "response"
                    if whole and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't have its digest")
                    page = head["X-Page-ID"]
                    rows.append((None if page == "null" else int(page), head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Target-URI"], digest, len(payload) if whole else None, payload.decode() if whole and payloads else None))
                    size += len(payload) if payloads else 0
                    if len(rows) == 500 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], schema=ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], schema=ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, SCHEMA)


def resolved(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a revisit has its response's payload.

    archive: what read_archives gives. A revisit of a record that isn't there, or has another digest, is an error.
    """
    archive = written(archive.drop("html", "url"), "warc-read")
    whole, again = (archive.where(F.col("record_type") == kind) for kind in ("response", "revisit"))
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type"]
    target = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    met = again.join(target, "refers_to_id", "left")
    lost = F.raise_error(F.concat(F.lit("no such response: "), F.col("refers_to_id"))).cast("long")
    met = met.withColumn("payload_bytes", F.when(F.col("digest") == F.col("_digest"), F.col("_bytes")).otherwise(lost))
    return whole.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(met.select(*columns, "refers_to"))
