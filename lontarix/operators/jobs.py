"""Job ledger views: idempotent submission, claiming, transitions, retries, checkpoints, paging, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of the stages of a job, and its allowed state changes.
STAGES = {s: i for i, s in enumerate(("ACQUIRE", "PARSE", "STRUCTURE", "BIND", "CHUNK", "EXTRACT", "RESOLVE", "ASSEMBLE", "INDEX"), 1)}
TRANSITIONS = (
    ("QUEUED", "RUNNING"), ("RUNNING", "SUCCEEDED"), ("RUNNING", "FAILED"), ("RUNNING", "QUEUED"), ("RUNNING", "WAITING_REVIEW"), ("WAITING_REVIEW", "QUEUED"),
    ("QUEUED", "CANCELLED"), ("RUNNING", "CANCELLED"), ("QUEUED", "SUSPENDED"), ("SUSPENDED", "QUEUED"),
)


def stage_rank(stage: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv)), stage)


def submit(requests: DataFrame, keys: list[str], hash_col: str, order: str) -> DataFrame:
    """Every request with ``outcome``: CREATED for the first of its key, REUSED for one of the same hash, CONFLICT else."""
    part = ", ".join(keys)
    first = F.expr(f"first_value({hash_col}) OVER (PARTITION BY {part} ORDER BY {order})")
    nth = F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY {order})")
    return requests.withColumn("__first", first).withColumn("outcome", F.when(nth == 1, "CREATED").when(F.col("__first") == F.col(hash_col), "REUSED").otherwise("CONFLICT")).drop("__first")


def claim(jobs: DataFrame, by: str, *order: str) -> DataFrame:
    """The oldest eligible job of each worker pool: one aggregate, no sort of all jobs."""
    rest = [c for c in jobs.columns if c not in (by, *order)]
    return jobs.groupBy(by).agg(F.min(F.struct(*order, *rest)).alias("j")).select(by, *(F.col(f"j.{c}").alias(c) for c in (*order, *rest)))


def illegal_transitions(states: DataFrame, job: str, state: str, *order: str) -> DataFrame:
    """Changes of state that aren't allowed. The allowed ones are a fixed short list."""
    before = F.expr(f"lag({state}) OVER (PARTITION BY {job} ORDER BY {', '.join(order)})")
    rows = states.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    return rows.where(~F.array_contains(allowed, F.concat("before", F.lit(">"), F.col(state))))


def retry_state(attempts: Column, maximum: Column, base_seconds: int = 30) -> tuple[Column, Column]:
    """(state, delay): FAILED when attempts are used up, else QUEUED again after a doubling delay."""
    spent = attempts >= maximum
    return F.when(spent, "FAILED").otherwise("QUEUED"), F.when(~spent, (base_seconds * F.pow(F.lit(2.0), attempts)).cast("long"))


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(order).alias(order), *(F.max_by(v, order).alias(v) for v in values))


def page_after(rows: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """Keyset paging: the next ``size`` rows after ``last`` in key order; the filter reaches the scan."""
    return rows.where(F.col(key) > last).orderBy(key).limit(size)


def within_budget(rows: DataFrame, part: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows up to the one with which the running size first exceeds the budget (that one left out)."""
    run = rows.withColumn("__size", size.cast("long")).withColumn("running", F.expr(f"sum(__size) OVER (PARTITION BY {part} ORDER BY {order})"))
    return run.where(F.col("running") <= budget).drop("__size")


def guard_total(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """The rows, or an error if their sizes sum up to more than ``limit``: never a silent cut."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("__total"))
    checked = F.when(F.col("__total") > limit, F.raise_error(F.lit("byte budget exceeded")).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(total)).where(checked).drop("__total")


def first_seen(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def publish_ready(receipts: DataFrame, backends: list[str]) -> DataFrame:
    """(snapshot, ready): a snapshot may be published when every backend has given a receipt."""
    want = F.array(*(F.lit(b) for b in backends))
    return receipts.groupBy("snapshot").agg((F.size(F.array_except(want, F.collect_set("backend"))) == 0).alias("ready"))


def outbox(published: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` with one for each published snapshot that has none yet; running it again adds nothing.

    ``published``: publication_id, snapshot_id. ``events``: event_id, topic, aggregate_id, payload, delivered. Only ids are joined.
    """
    new = published.distinct().select(
        F.concat(F.lit("snapshot-published:"), "publication_id").alias("event_id"),
        F.lit("snapshot.published").alias("topic"),
        F.col("snapshot_id").cast("string").alias("aggregate_id"),
        F.to_json(F.struct(F.col("publication_id").cast("string").alias("publication_id"), F.col("snapshot_id").cast("string").alias("snapshot_id"))).alias("payload"),
        F.lit(False).alias("delivered"),
    )
    return events.select(*new.columns).unionByName(new.join(events.select("event_id"), "event_id", "left_anti"))
