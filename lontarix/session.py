"""Session settings and table loading shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan relies on: UTC timestamps, runtime re-planning and skew splitting.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages")


def build(master: str = "local[8]", app: str = "lontarix", **extra: str) -> SparkSession:
    """A session with the defaults; ``extra`` holds further settings, dots written as double underscores."""
    conf = DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder.

    Texts that come in fewer splits than there are cores are dealt out first: what is done with them costs far more than
    moving them. A table of many files is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
