"""Estimators: ranking quality, ratios, nearest-rank quantiles, error rates, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..sources.shared import cut

#: Gate statuses, worst last.
STATUS_ORDER = ("PASS", "NOT_MEASURED", "BLOCKED", "FAIL")


def ratio(num: Column, den: Column) -> Column:
    """num / den of counts: den must be positive and num within 0 .. den."""
    bad = (den <= 0) | (num < 0) | (num > den)
    return F.when(bad, F.raise_error(F.lit("not a ratio")).cast("double")).otherwise(num.cast("double") / den)


def quotient(num: Column, den: Column) -> Column:
    """num / den of non-negative numbers, den positive."""
    bad = (den <= 0) | (num < 0)
    return F.when(bad, F.raise_error(F.lit("not a quotient")).cast("double")).otherwise(num.cast("double") / den)


def _or_error(value: Column, bad: Column, said: str) -> Column:
    """``value``, or an error where ``bad`` holds or can't be told."""
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(said)).cast("double")).otherwise(value)


def samples(value: Column) -> Column:
    """Durations: null is unfinished and counts as infinite; one that is negative or no number is an error."""
    v = F.coalesce(value.cast("double"), F.lit(float("inf")))
    return _or_error(v, F.isnan(v) | (v < 0), "duration samples must be non-negative")


def maximum(value: Column) -> Column:
    """The greatest of a group's samples, as an aggregate; there must be some, all finite and not negative."""
    v = value.cast("double")
    return _or_error(F.max(v), (F.count(F.lit(1)) == 0) | (F.count(v) != F.count(F.lit(1))) | (F.min(v) < 0) | F.isnan(F.max(v)) | (F.max(v) == float("inf")), "resource samples must be finite and non-negative")


def per_second(completed: Column, seconds: Column) -> Column:
    """Completed over seconds, both positive."""
    seconds = seconds.cast("double")
    return _or_error(completed / seconds, (completed <= 0) | (seconds <= 0) | F.isnan(seconds) | (seconds == float("inf")), "throughput needs a positive count and duration")


def mean_score(score: Column) -> Column:
    """The mean of group scores within 0 .. 1, as an aggregate."""
    return _or_error(F.avg(score), (F.count(score) == 0) | (F.count(score) != F.count(F.lit(1))) | (F.min(score) < 0) | (F.max(score) > 1) | F.isnan(F.max(score)), "group score outside [0, 1]")


def least_slice(name: Column | str, numerator: Column, denominator: Column, required: list) -> Column:
    """The smallest ratio of a group's slices, as an aggregate; they must be exactly the ``required`` ones, a row each."""
    want = F.array_sort(F.array(*map(F.lit, required)))
    bad = (F.count(F.lit(1)) != len(required)) | (F.array_sort(F.collect_set(name)) != want)
    return _or_error(F.min(ratio(numerator, denominator)), bad, "slice evidence does not match required slices")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    bad = (tp < 0) | (fp < 0) | (fn < 0) | (2 * tp + fp + fn == 0)
    return _or_error(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), bad, "confusion counts must be non-negative, not all zero")


def constant_rate(requests: DataFrame, at_ns: str, interval_ns: int, *by: str, order: str = "request_id") -> DataFrame:
    """(by, n, n_broken, follows): whether each next arrival of an open loop is exactly ``interval_ns`` after the one before."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    gap = F.col(at_ns) - F.expr(f"lag({at_ns}) OVER ({part}ORDER BY {at_ns}, {order})")
    out = requests.withColumn("__gap", gap).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("__gap") != interval_ns).alias("n_broken"))
    return out.withColumn("follows", F.col("n_broken") == 0)


def rebuild(changed: Column, update_seconds: Column, rebuild_seconds: Column, state_diff: Column) -> Column:
    """Struct (ratio, denominator, ancillary): an update's time over that of a full rebuild. A state that differs from the rebuild's fails besides."""
    bad = (changed <= 0) | (state_diff < 0) | (update_seconds < 0) | (rebuild_seconds <= 0) | F.isnan(update_seconds) | F.isnan(rebuild_seconds)
    value = _or_error(update_seconds / F.nullif(rebuild_seconds, F.lit(0.0)), bad, "incremental/full-rebuild evidence is invalid")
    said = F.when(state_diff > 0, F.array(F.lit("incremental state differs from full rebuild"))).otherwise(F.array().cast("array<string>"))
    return F.struct(value.alias("ratio"), changed.alias("denominator"), said.alias("ancillary"))


def isolation(requests: DataFrame, interval_ns: int, deadline_ms: float, p95_ms: float, p99_ms: float, least_success: float, least_seconds: float = 0.0) -> DataFrame:
    """One row (ratio, denominator, ancillary): p95 with ingestion over p95 without, of two runs of one open-loop schedule.

    ``requests``: request_id, mixed, scheduled_ns, latency_ms (null: unfinished), succeeded. An error: populations of different size or too short for
    ``least_seconds``, arrivals that aren't ``interval_ns`` apart, a baseline p95 that isn't positive and finite, or a run whose successes aren't
    its answers within the deadline. Absolute limits that a run misses are named in ``ancillary``.
    """
    v = requests.withColumn("v", samples(F.col("latency_ms")))
    q = nearest_rank(v, "v", {"p95": 0.95, "p99": 0.99}, "mixed")
    on_time = F.count_if(F.col("v") <= deadline_ms)
    counts = v.groupBy("mixed").agg(F.count("*").alias("n"), F.count_if("succeeded").alias("ok"), on_time.alias("on_time"))
    rate = constant_rate(requests, "scheduled_ns", interval_ns, "mixed").select("mixed", "follows")
    arms = q.join(counts, "mixed").join(rate, "mixed")
    pick = lambda c, mixed: F.max(F.when(F.col("mixed") == mixed, F.col(c)))
    one = arms.agg(*(pick(c, m).alias(f"{c}_{int(m)}") for c in ("p95", "p99", "n", "ok", "on_time", "follows") for m in (True, False)))
    bad = (F.col("n_1") != F.col("n_0")) | ~F.col("follows_1") | ~F.col("follows_0") | (F.col("p95_0") <= 0) | (F.col("p95_0") == float("inf"))
    bad = bad | (F.col("ok_1") != F.col("on_time_1")) | (F.col("ok_0") != F.col("on_time_0")) | (F.col("n_1") * interval_ns < least_seconds * 1e9)
    said = F.array_compact(F.array(
        F.when(F.col("p95_1") > p95_ms, "mixed query p95 exceeds its absolute limit"), F.when(F.col("p99_1") > p99_ms, "mixed query p99 exceeds its absolute limit"),
        F.when(F.col("ok_1") / F.col("n_1") < least_success, "mixed query success is below its absolute limit"), F.when(F.col("ok_0") / F.col("n_0") < least_success, "baseline query success is below its absolute limit"),
    ))
    return one.select(_or_error(F.col("p95_1") / F.nullif("p95_0", F.lit(0.0)), bad, "mixed/baseline evidence is invalid").alias("ratio"), F.col("n_1").alias("denominator"), said.alias("ancillary"))


#: The invariants, and whether each is the share of good outcomes or the number of bad ones.
INVARIANTS = {"SOURCE_MAPPING": "ratio", "ORPHAN_EDGES": "count", "SNAPSHOT_MISMATCH": "count", "UNCHANGED_REEXTRACTION": "count", "REPLAY_DIFF": "count", "WIRE_PARITY": "ratio"}


def invariants(outcomes: DataFrame) -> DataFrame:
    """(gate, value, denominator) of all six invariants. ``outcomes``: gate, id, good.

    An error: an id that is missing, comes twice or is both good and bad, an invariant without outcomes, one that isn't known.
    """
    once = outcomes.groupBy("gate", "id").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))
    sums = once.groupBy("gate").agg(F.sum("n_good").alias("good"), F.count("*").alias("total"), (F.max("n") > 1).alias("twice"), (F.count("id") != F.count("*")).alias("unnamed"))
    known = outcomes.sparkSession.createDataFrame(list(INVARIANTS.items()), "gate string, statistic string")
    all_ = known.join(sums, "gate", "full")
    bad = F.col("statistic").isNull() | F.col("total").isNull() | F.col("twice") | F.col("unnamed")
    value = F.when(F.col("statistic") == "ratio", F.col("good") / F.col("total")).otherwise((F.col("total") - F.col("good")).cast("double"))
    return all_.select("gate", _or_error(value, bad, "invariant outcomes overlap, repeat or are missing").alias("value"), F.col("total").alias("denominator"))


def nearest_rank(values: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Nearest-rank quantiles of each group: the value at place ceil(p * n), 1 at least. A null value counts as infinite;
    one that is negative or no number is an error, and so are no values at all where there are no groups.

    Values are counted first and written in range partitions. A running count within a partition, plus the counts of the
    group's partitions before it, gives each value's place, so no task sees all values of a group.
    """
    v = samples(F.col(value))
    sizes = values.select(*by, v.alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n"))
    sizes = cut(sizes.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()), "sizes")
    group = f"PARTITION BY {', '.join(by)}" if by else ""
    parts = sizes.groupBy(*by, "part").agg(F.sum("n").alias("size"))
    # A null group equals itself here: places are joined on a key that tells it from every other.
    parts = parts.select(F.struct(*by, "part").alias("at"), F.expr(f"sum(size) OVER ({group} ORDER BY part) - size").alias("before"), F.expr(f"sum(size) OVER ({group})").alias("all"))
    inner = ", ".join((*by, "part"))
    placed = sizes.withColumn("upto", F.expr(f"sum(n) OVER (PARTITION BY {inner} ORDER BY v)")).withColumn("at", F.struct(*by, "part"))
    placed = placed.join(parts, placed["at"].eqNullSafe(parts["at"])).withColumn("upto", F.col("upto") + F.col("before"))
    picks = {name: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("all")), F.lit(1)), F.col("v"))) for name, p in shares.items()}
    picks = [(v if by else _or_error(v, F.count(F.lit(1)) == 0, "empty samples")).alias(name) for name, v in picks.items()]
    return placed.groupBy(*by).agg(*picks)


def throughput_ratio(ts: Column, one: Column, other: Column) -> Column:
    """Rows a second among ``one`` over rows a second among ``other``, as an aggregate."""

    def rate(which: Column) -> Column:
        at = F.when(which, F.unix_micros(ts.cast("timestamp")))
        return quotient(F.count(at), (F.max(at) - F.min(at)) / 1e6)

    return quotient(rate(one), rate(other))


def _rank_of(share: float):
    def rank(column: str) -> Column:
        value = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY coalesce(cast(`{column}` AS double), double('infinity')))")
        return _or_error(value, (F.count(F.lit(1)) == 0) | (F.min(samples(F.col(column))) < 0), "empty samples")

    return rank


#: What each statistic is computed from: aggregates, or for samples and scores the name of a column of the rows. Quantiles count a
#: group's distinct values in one buffer; ``nearest_rank`` is for groups of more than memory holds.
_ESTIMATES = {
    "p50": (("samples",), _rank_of(0.5)),
    "p95": (("samples",), _rank_of(0.95)),
    "p99": (("samples",), _rank_of(0.99)),
    "max": (("samples",), lambda column: maximum(F.col(column))),
    "throughput": (("completed", "duration_seconds"), per_second),
    "ratio": (("numerator", "denominator"), quotient),
    "micro_ratio": (("numerator", "denominator"), ratio),
    "pairwise_ratio": (("numerator", "denominator"), ratio),
    "macro_mean": (("group_scores",), lambda column: mean_score(F.col(column))),
    "minimum_slice_ratio": (("slice", "numerator", "denominator"), least_slice),
    "micro_f1": (("true_positive", "false_positive", "false_negative"), f1),
    "corpus_cer": (("edits", "gold_units"), quotient),
    "count": (("value", "denominator"), lambda value, denominator: _or_error(value.cast("double"), (denominator <= 0) | (value < 0), "a count needs a population and isn't negative")),
    "difference": (("value", "denominator"), lambda value, denominator: F.when(denominator > 0, value / denominator).otherwise(F.raise_error(F.lit("no population")))),
}


def estimate(statistic: str, required_slices: list | None = None, **evidence: Column | str) -> Column:
    """The aggregate of a statistic by its name; its evidence must have exactly the fields that the statistic is computed from.

    Samples and slices are names of columns of the rows. Evidence that no such statistic can have stops the job.
    """
    if statistic not in _ESTIMATES:
        raise ValueError(f"unsupported statistic: {statistic}")
    fields, make = _ESTIMATES[statistic]
    if set(evidence) != set(fields):
        raise ValueError(f"{statistic} is computed from {sorted(fields)}")
    return make(*(evidence[f] for f in fields), *([required_slices or []] if statistic == "minimum_slice_ratio" else []))


def populations(questions: DataFrame) -> DataFrame:
    """(population, n): the questions of the test split that each kind of quality gate counts. ``questions``: record_id, test, answerable, slices."""
    test, ok = questions.where("test"), F.col("answerable")
    kinds = {"answerable": ok, "multi_hop": ok & F.array_contains("slices", "multi_hop"), "temporal": ok & F.array_contains("slices", "temporal"), "unanswerable": ~ok}
    sums = test.agg(*(F.count_distinct(F.when(c, F.col("record_id"))).alias(n) for n, c in kinds.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("population"), F.col(n).alias("n")) for n in kinds))
    return sums.select(F.inline(pairs))


def recall_at(found: DataFrame, gold: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """(by, recall): found rows of grade 3 within rank k over ``n_gold``; questions without gold are left out."""
    hits = found.where(F.col("rank") <= k).groupBy(by).agg(F.count_if(F.col("grade") == 3).alias("hits"))
    out = gold.where("n_gold > 0").join(hits, by, "left")
    return out.select(by, rounded(ratio(F.coalesce("hits", F.lit(0)), F.col("n_gold"))).alias("recall"))


def ndcg_at(found: DataFrame, gold: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """(by, ndcg) with gain 2^grade - 1 and discount log2(rank + 1). ``gold``: how many rows have each grade, best first."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    real = found.where(F.col("rank") <= k).groupBy(by).agg(F.sum(gain).alias("dcg"))
    ideal = gold.select(by, F.explode(F.slice(F.flatten(F.transform("gold", lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int")))), 1, k)).alias("grade"))
    ideal = ideal.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY grade DESC)")).groupBy(by).agg(F.sum(gain).alias("best"))
    out = ideal.where("best > 0").join(real, by, "left")
    return out.select(by, rounded(F.coalesce("dcg", F.lit(0.0)) / F.col("best")).alias("ndcg"))


def required_sets(found: DataFrame, sets: DataFrame, k: int, by: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(by, complete): whether any of a question's required sets is within its k first rows."""
    top = found.where(F.col("rank") <= k).groupBy(by).agg(F.collect_set(key).alias("top"))
    some = F.exists("sets", lambda x: F.size(F.array_except(x, F.col("top"))) == 0)
    return sets.join(top, by, "left").select(by, F.coalesce(some, F.lit(False)).alias("complete"))


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return 2 * tp / (2 * tp + fp + fn)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over reference characters, summed over all rows."""
    return F.sum(F.levenshtein(reference, hypothesis)) / F.sum(F.length(reference))


def gate_status(value: Column, threshold: Column, upper: Column, samples: Column, minimum: Column) -> Column:
    """PASS or FAIL by the threshold (``upper``: value may not exceed it); too few samples block; no value is not measured."""
    ok = F.when(upper, value <= threshold).otherwise(value >= threshold)
    return F.when(value.isNull(), "NOT_MEASURED").when(samples < minimum, "BLOCKED").when(ok, "PASS").otherwise("FAIL")


def worst_status(status: Column) -> Column:
    """The worst of a group of statuses, as an aggregate."""
    names = F.array(*(F.lit(s) for s in STATUS_ORDER))
    return F.element_at(names, F.max(F.array_position(names, status)).cast("int"))
