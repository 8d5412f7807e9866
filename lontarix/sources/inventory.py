"""JSON-lines inventories of acquired files, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import SHA256

SCHEMA = "portal string, source_url string, integrity_status string, portal_fields map<string, array<string>>, pdfs array<struct<kind: string, error: string, sha256: string, path: string, bytes: bigint>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records; a line that isn't such a record stops the job."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def candidates(records: DataFrame) -> DataFrame:
    """(sha256, path, bytes, portal, source_url, year): one row a primary file, from the first portal and URL that has it.

    Only valid records and files without an error count; a malformed receipt stops the job.
    """
    rows = records.where("integrity_status = 'valid'").select("portal", "source_url", F.coalesce(F.element_at(F.element_at("portal_fields", "year"), 1), F.lit("unknown")).alias("year"), F.explode("pdfs").alias("p"))
    rows = rows.where("coalesce(p.error, '') = '' AND p.kind = 'document'")
    fine = F.col("p.sha256").rlike(SHA256) & (F.col("p.path") == F.concat(F.lit("blobs/"), F.col("p.sha256"), F.lit(".pdf"))) & (F.col("p.bytes") > 0)
    sha = F.when(fine, F.col("p.sha256")).otherwise(F.raise_error(F.lit("invalid file receipt")).cast("string"))
    rows = rows.select(sha.alias("sha256"), F.struct("portal", "source_url").alias("k"), F.struct(F.col("p.path").alias("path"), F.col("p.bytes").alias("bytes"), "portal", "source_url", "year").alias("v"))
    return rows.groupBy("sha256").agg(F.min_by("v", "k").alias("v")).select("sha256", "v.*")
