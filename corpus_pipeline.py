"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; it is written as
Parquet and read again before the next stage starts. All but the last return the columns of ``documents``. Rows go by a number
that a stage writes with them, so rows without an id, or that share one, are judged each. A stage's result depends on tables in
the shared folder, which stay until ``run``, or whoever called the stage, releases them; so stages can also be nested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontarix.llm import linededup, minhash, packing, quality
from lontarix.sources.shared import gathered, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can't express min-max hashing and packing; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def _texts(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines that too many documents of their host repeat."""
    return _texts(quality.clean(docs.select(*COLUMNS)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in at least 10 documents. A document left empty stays, empty."""
    return _texts(linededup.LineDedup(spark, min_docs=10).insert(docs).apply(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.one_of_each(docs.select(*COLUMNS), k=5, pct=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, with a digest of its ids."""
    pieces = packing.tokenize_pieces(docs, "byte_bpe_50k", 2048)
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``. A stage's tables go when its result is written, its result when the next
    stage's is; what the last result is read from stays: its pieces, which are written before their places are known."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with gathered() as tables:
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        release(spark, tables + before)
        docs, before = spark.read.parquet(path), [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(spark, before)
    return out
