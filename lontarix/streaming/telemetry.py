"""Late and unfinished requests: a stream of scheduled requests meets a stream of completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Microseconds that times are put ahead by inside the join: a watermark starts at 1970, so whatever is older would be late at once.
_AHEAD = 10**17


def _once(rows: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    rows = rows.withColumn(at, F.timestamp_micros(F.unix_micros(at) + _AHEAD))
    if rows.isStreaming:
        rows = rows.withWatermark(at, delay)
    return rows.dropDuplicates([key, at])


def outcomes(scheduled: DataFrame, completed: DataFrame, deadline_s: int, delay: str) -> DataFrame:
    """(request_id, at, latency_ms) of ``scheduled`` (request_id, at) and ``completed`` (request_id, done_at), timestamps both.

    A request without a completion within ``deadline_s`` seconds has an infinite latency. Streamed, it comes out once the watermark,
    ``delay`` behind the newest row of the slower stream, has passed its deadline, and is held until then; finished ones come out
    at once. Spark's watermark counts whole milliseconds and lets go of what is two or more of them behind it. Rows that repeat an id and its
    time count once, and a request has a row for each completion in time. Those without an id or a time are left out, since no
    request can be told from them; a completion without an id still tells how far its stream is.
    """
    s = _once(scheduled.where("request_id IS NOT NULL AND at IS NOT NULL").select("request_id", "at"), "request_id", "at", delay)
    c = completed.where("done_at IS NOT NULL").select(F.col("request_id").alias("done_id"), "done_at")
    c = _once(c, "done_id", "done_at", delay).where("done_id IS NOT NULL")
    in_time = F.expr(f"request_id = done_id AND done_at >= at AND done_at <= at + INTERVAL {int(deadline_s)} SECONDS")
    took = (F.unix_micros("done_at") - F.unix_micros("at")) / 1000
    at = F.timestamp_micros(F.unix_micros("at") - _AHEAD).alias("at")
    return s.join(c, in_time, "left_outer").select("request_id", at, F.coalesce(took, F.lit(float("inf"))).alias("latency_ms"))
