r"""Content-addressed WARC archive.

``write_archive`` stores each distinct payload once, under its SHA-256, and every record's exact header bytes in a separate
table. ``read_archive`` joins both again, recomputes every digest, and gives the original records back byte for byte.
``parse_records`` and ``to_warc`` read and write ordinary WARC files (plain or gzip).

Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest id is a ``response``, the others are
``revisit`` records that refer to it; smaller payloads are always responses.

Defined cases: a null payload is an empty one. A null URL leaves WARC-Target-URI out. A null id ranks after all others, and
such a record never is what a revisit refers to: if all ids of a payload are null, all its records are responses. Rows that
repeat the smallest id are responses all. Line ends in a URL are percent-encoded, so that they can't end a header. Extra
columns of the input are left out. An empty table makes an empty archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

CRLF = "\r\n"
#: The header of a record; WARC-Date is a parameter so that archives are reproducible.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))


def _header(date: str) -> Column:
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    ident = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", ident),
        _line("WARC-Target-URI", url),
        F.lit(f"WARC-Date: {date}{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}")).otherwise(F.lit("")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``payloads`` and ``headers`` under ``path``.

    Both groupings by digest sum up within each task first, so a payload shared by a third of the pages is one row a task.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = narrow.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id")).where(F.col("first_id").isNotNull())
    # Written first, so that the join can split a payload that very many pages share.
    first = cut(first, "first-records")
    marked = narrow.join(first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = marked.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))
    marked.select("page_id", "digest", F.encode(_header(date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: ``page_id, header, payload``, and what its header and its stored bytes say.

    ``payload_digest`` and ``payload_bytes`` are computed anew from the stored payload; a stored payload that doesn't have
    the digest it is kept under stops the job. A revisit's ``payload`` is that of the record it refers to.
    """
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload_digest", F.sha2("payload", 256))
    stored = stored.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))
    stored = stored.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    heads = spark.read.parquet(f"{path}/headers")
    kind = heads.schema["page_id"].dataType
    heads = heads.withColumn("record_type", _field("WARC-Type")).withColumn("refers_to", F.nullif(F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind))
    return heads.join(stored, "digest").drop("digest")


def records(archive: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of each WARC record of ``read_archive``."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def to_warc(rows: list[bytes], compress: bool = True) -> bytes:
    """A WARC file of the records, each a gzip member of its own."""
    return b"".join(gzip.compress(r, mtime=0) if compress else r for r in rows)


def _records_in(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    raw = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        head = b""
        while line := raw.readline():
            head += line
            if line == b"\r\n":
                break
        if not head.strip():
            return
        size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        block = raw.read(size)
        if len(block) != size or raw.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield head, block


def parse_records(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(header, payload) of each record of WARC files read with ``spark.read.format("binaryFile")``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if data.is_valid:
                    for head, block in _records_in(data.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([block], pa.binary())], ["header", "payload"])

    return files.select(content_col).mapInArrow(run, "header binary, payload binary")
