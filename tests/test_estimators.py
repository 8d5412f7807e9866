"""What estimators refuse, and gates that compare runs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lontarix.operators import metrics as m


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v double")


def test_nearest_rank_takes_unfinished_requests_and_nothing_negative(spark):
    got = m.nearest_rank(values(spark, [3.0, None, 1.0, 2.0]), "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got.p50, got.p95) == (2.0, math.inf)
    for bad, said in (([-5.0, 1.0], "non-negative"), ([float("nan")], "non-negative"), ([], "empty samples")):
        with pytest.raises(Exception, match=said):
            m.nearest_rank(values(spark, bad), "v", {"p50": 0.5}).collect()
    assert m.nearest_rank(values(spark, []).withColumn("g", F.lit(1)), "v", {"p50": 0.5}, "g").count() == 0


@pytest.mark.parametrize("bad", [[], [1.0, None], [-1.0, 2.0], [1.0, float("inf")], [float("nan")]])
def test_maximum_needs_finite_samples(spark, bad):
    assert values(spark, [0.0, 7.0]).agg(m.estimate("max", samples="v").alias("x")).first().x == 7.0
    with pytest.raises(Exception, match="finite and non-negative"):
        values(spark, bad).agg(m.estimate("max", samples="v")).collect()


def test_estimates_of_percentiles_count_unfinished_ones(spark):
    rows = values(spark, [1.0, 2.0, None, 4.0])
    got = rows.agg(*(m.estimate(p, samples="v").alias(p) for p in ("p50", "p95", "p99"))).first()
    assert tuple(got) == (2.0, math.inf, math.inf)
    for bad in ([], [-1.0]):
        with pytest.raises(Exception, match="samples"):
            values(spark, bad).agg(m.estimate("p50", samples="v")).collect()


def test_slices_must_be_the_required_ones(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "slice string, n int, d int")
    worst = lambda df, need: df.agg(m.estimate("minimum_slice_ratio", need, slice="slice", numerator=F.col("n"), denominator=F.col("d")).alias("x")).first().x
    assert worst(rows, ["b", "a"]) == 0.5
    for df, need in ((rows, ["a"]), (rows, ["a", "b", "c"]), (rows, ["a", "c"]), (rows.unionByName(rows), ["a", "b"]), (rows.limit(0), ["a"])):
        with pytest.raises(Exception, match="required slices"):
            worst(df, need)
    with pytest.raises(Exception, match="not a ratio"):
        worst(rows.withColumn("n", F.col("n") + 9), ["a", "b"])


@pytest.mark.parametrize(
    ("statistic", "evidence"),
    [
        ("throughput", {"completed": 0, "duration_seconds": 1.0}), ("throughput", {"completed": 1, "duration_seconds": 0.0}), ("ratio", {"numerator": 1, "denominator": 0}), ("ratio", {"numerator": -1, "denominator": 2}),
        ("micro_ratio", {"numerator": 3, "denominator": 2}), ("micro_f1", {"true_positive": 0, "false_positive": 0, "false_negative": 0}), ("micro_f1", {"true_positive": 1, "false_positive": -1, "false_negative": 0}),
        ("corpus_cer", {"edits": 1, "gold_units": 0}), ("count", {"value": -1, "denominator": 2}), ("count", {"value": 1, "denominator": 0}), ("difference", {"value": 1, "denominator": 0}),
    ],
)
def test_evidence_that_cannot_be(spark, statistic, evidence):
    with pytest.raises(Exception, match="not a|throughput|confusion|a count needs|no population"):
        spark.range(1).select(m.estimate(statistic, **{k: F.lit(v) for k, v in evidence.items()})).collect()


def test_statistics_by_name(spark):
    assert spark.range(1).select(m.estimate("micro_f1", true_positive=F.lit(3), false_positive=F.lit(1), false_negative=F.lit(2)).alias("x")).first().x == pytest.approx(6 / 9)
    rows = values(spark, [0.5, 1.0])
    assert rows.agg(m.estimate("macro_mean", group_scores="v").alias("x")).first().x == 0.75
    with pytest.raises(Exception, match="outside"):
        values(spark, [0.5, 1.5]).agg(m.estimate("macro_mean", group_scores="v")).collect()
    with pytest.raises(ValueError):
        m.estimate("median", samples="v")
    with pytest.raises(ValueError):
        m.estimate("p50", values="v")


def test_constant_rate(spark):
    rows = spark.createDataFrame([("a", i, 100 * i) for i in range(5)] + [("b", i, 100 * i + (i == 3)) for i in range(5)] + [("c", 1, 7)], "run string, request_id int, at long")
    got = {r.run: (r.n, r.n_broken, r.follows) for r in m.constant_rate(rows, "at", 100, "run").collect()}
    assert got == {"a": (5, 0, True), "b": (5, 2, False), "c": (1, 0, True)}


def test_rebuild_names_a_state_that_differs(spark):
    one = lambda *x: spark.range(1).select(m.rebuild(*map(F.lit, x)).alias("x")).select("x.*").first()
    assert tuple(one(3, 1.0, 4.0, 0)) == (0.25, 3, []) and one(3, 1.0, 4.0, 2).ancillary == ["incremental state differs from full rebuild"]
    for bad in ((0, 1.0, 4.0, 0), (3, -1.0, 4.0, 0), (3, 1.0, 0.0, 0), (3, 1.0, 4.0, -1)):
        with pytest.raises(Exception, match="evidence is invalid"):
            one(*bad)


def runs(spark, mixed, base, gap=20):
    rows = [(f"{k}{i}", k == "m", gap * i, v, v is not None and v <= 100) for k, xs in (("m", mixed), ("b", base)) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "request_id string, mixed boolean, scheduled_ns long, latency_ms double, succeeded boolean")


def test_isolation_compares_equal_runs(spark):
    base, mixed = [10.0] * 20, [10.0] * 18 + [30.0, None]
    got = m.isolation(runs(spark, mixed, base), 20, 100.0, 25.0, 50.0, 0.99).first()
    assert (got.ratio, got.denominator) == (3.0, 20)
    assert [x.split(" ", 2)[2].split(" is")[0].split(" exceeds")[0] for x in got.ancillary] == ["p95", "p99", "success"]
    assert m.isolation(runs(spark, base, base), 20, 100.0, 25.0, 50.0, 0.99).first().ancillary == []
    broken = runs(spark, mixed, base).withColumn("succeeded", F.lit(True))
    for bad in (runs(spark, mixed[:-1], base), runs(spark, mixed, [None] * 20), runs(spark, mixed, base, 21), broken):
        with pytest.raises(Exception, match="evidence is invalid"):
            m.isolation(bad, 20, 100.0, 25.0, 50.0, 0.99).collect()
    with pytest.raises(Exception, match="evidence is invalid"):
        m.isolation(runs(spark, mixed, base), 20, 100.0, 25.0, 50.0, 0.99, least_seconds=1.0).collect()


def test_all_six_invariants_are_asked_for(spark):
    rows = [(g, f"{g}{i}", i > 0) for g in m.INVARIANTS for i in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "gate string, id string, good boolean")
    got = {r.gate: (r.value, r.denominator) for r in m.invariants(frame(rows)).collect()}
    assert got == {g: (0.75 if s == "ratio" else 1.0, 4) for g, s in m.INVARIANTS.items()}
    for bad in (rows[4:], [*rows, ("OTHER", "x", True)], [*rows, rows[0]], [*rows, (rows[0][0], rows[0][1], True)], [*rows, ("REPLAY_DIFF", None, True)]):
        with pytest.raises(Exception, match="invariant outcomes"):
            m.invariants(frame(bad)).collect()
