"""Event-time windows that run as a batch or as a stream, and streams that run until all input is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch


def _cents(value: str) -> F.Column:
    """Exact sums of amounts: whole hundredths, so the order of addition doesn't matter."""
    return F.floor(F.sum(F.floor(F.col(value) * 100)) + 0.5) / F.lit(100.0)


def tumbling(events: DataFrame, size: str) -> DataFrame:
    w = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), _cents("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    w = events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours."""
    w = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = 16) -> DataFrame:
    """The files of a table, which is one file or a folder of them, as a stream, ``files`` at a time (None: all that are there).

    The schema comes from the table, it isn't inferred from the stream. Where files come in no order of time, a watermark that earlier
    ones have raised drops rows of later ones; it is raised between batches alone, so none are dropped of files that come at once.
    """
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files is not None:
        stream = stream.option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: The store that keyed state with timers needs; it holds state outside the heap.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a streaming plan over a table, see ``all_available``."""
    return all_available(plan(read_stream(spark, sf_dir, name)), name, mode)


def all_available(rows: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a streaming plan once all that is there has been read; it is a table in the shared folder.

    Each batch writes a folder of its own, named by its number; a batch that is run again writes the same folder anew.
    """
    spark = rows.sparkSession
    spark.conf.set(*STORE)
    path, last = scratch(spark, f"stream-{name}"), [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[0] = max(last[0], number)

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "progress")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:  # nothing has come
        return spark.createDataFrame([], rows.schema)
    if mode == "complete":
        return spark.read.parquet(f"{path}/{last[0]}")
    return spark.read.parquet(*(f"{path}/{i}" for i in range(last[0] + 1)))


def merge_latest(spark: SparkSession, sf_dir: str, name: str, keys: list[str], order: list[str], values: list[str], state: str | None = None) -> DataFrame:
    """The newest row of each key over a stream.

    A batch writes its own newest row of each key to a folder with its number, so its cost goes by the batch, not by all that came
    before, and one that is run again writes the same folder anew. The folders' rows are merged once, where the result is
    read. With ``state``, a folder of the caller's, a later call goes on where this one, or one that was stopped, ended.
    """
    path = state or scratch(spark, f"latest-{name}")

    def newest(rows: DataFrame) -> DataFrame:
        top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("r"))
        return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (*order, *values)))

    def keep(batch: DataFrame, number: int) -> None:
        newest(batch.select(*keys, *order, *values)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    query = read_stream(spark, sf_dir, name).writeStream.option("checkpointLocation", f"{path}/progress").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(spark.read.parquet(f"{path}/rows/*"))
