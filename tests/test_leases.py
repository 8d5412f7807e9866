"""Leases from a ledger of commands, folded and streamed; late and unfinished requests."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lontarix.operators import leases
from lontarix.streaming import leases as stream
from lontarix.streaming import telemetry, windows

HOUR = 3600
COLS = "job long, at string, seq long, action string, owner string, fence long, desired string, delay_s long"


def ledger(spark, rows):
    rows = [(r + (None,) * 8)[:8] for r in rows]
    return spark.createDataFrame(rows, COLS).withColumn("at", F.col("at").cast("timestamp"))


def outcomes(df):
    return [(r.seq, r.outcome, r.state, r.fence) for r in sorted(df.collect(), key=lambda r: (r.job, r.expires_us or 0, r.seq or 0))]


def told(df):
    return {r.seq: (r.outcome, r.state, r.fence) for r in df.where("seq IS NOT NULL").collect()}


def at(h, m=0):
    return f"2024-01-01 {h:02d}:{m:02d}:00"


def test_a_refused_claim_changes_nothing(spark):
    rows = [(1, at(0), 1, "CLAIM", "a"), (1, at(0, 59), 2, "CLAIM", "b"), (1, at(1, 30), 3, "CLAIM", "b"), (1, at(2), 4, "CLAIM", "c")]
    got = told(leases.decide(ledger(spark, rows), HOUR, 5))
    assert got == {1: ("CLAIMED", "RUNNING", 1), 2: ("REFUSED", "RUNNING", 1), 3: ("CLAIMED", "RUNNING", 2), 4: ("REFUSED", "RUNNING", 2)}


def test_the_last_moment_of_a_lease_still_counts(spark):
    got = told(leases.decide(ledger(spark, [(1, at(0), 1, "CLAIM", "a"), (1, at(1), 2, "CLAIM", "b"), (1, at(1), 3, "RENEW", "a", 1)]), HOUR, 5))
    assert got == {1: ("CLAIMED", "RUNNING", 1), 2: ("REFUSED", "RUNNING", 1), 3: ("RENEWED", "RUNNING", 1)}


def test_renewal_is_for_the_holder_of_the_fence(spark):
    rows = [
        (1, at(0), 1, "CLAIM", "a"), (1, at(0, 30), 2, "RENEW", "b", 1), (1, at(0, 31), 3, "RENEW", "a", 2), (1, at(0, 50), 4, "RENEW", "a", 1), (1, at(1, 40), 5, "CLAIM", "b"),
        (1, at(1, 51), 6, "CLAIM", "b"), (1, at(1, 52), 7, "RENEW", "a", 1), (1, at(1, 53), 8, "COMPLETE", "a", 1, "SUCCEEDED"), (1, at(1, 54), 9, "COMPLETE", "b", 2, "SUCCEEDED"), (1, at(9), 10, "CLAIM", "c"),
    ]
    got = {k: v[0] for k, v in told(leases.decide(ledger(spark, rows), HOUR, 5)).items()}
    assert got == {1: "CLAIMED", 2: "STALE", 3: "STALE", 4: "RENEWED", 5: "REFUSED", 6: "CLAIMED", 7: "STALE", 8: "STALE", 9: "COMPLETED", 10: "REFUSED"}


def test_retries_wait_and_run_out(spark):
    rows = []
    for i in range(3):
        rows += [(1, at(2 * i), 4 * i, "CLAIM", "a"), (1, at(2 * i, 5), 4 * i + 1, "COMPLETE", "a", i + 1, "RETRY_WAIT", 1800), (1, at(2 * i, 20), 4 * i + 2, "CLAIM", "a")]
    got = told(leases.decide(ledger(spark, rows), HOUR, 3))
    assert [got[k][0] for k in sorted(got)] == ["CLAIMED", "COMPLETED", "REFUSED"] * 3
    assert [got[4 * i + 1][1] for i in range(3)] == ["RETRY_WAIT", "RETRY_WAIT", "FAILED"]


def test_cancellation_waits_for_the_holder(spark):
    rows = [
        (1, at(0), 1, "CANCEL"), (1, at(1), 2, "CLAIM", "a"),
        (2, at(0), 3, "CLAIM", "a"), (2, at(0, 10), 4, "CANCEL"), (2, at(0, 20), 5, "RENEW", "a", 1), (2, at(0, 30), 6, "COMPLETE", "a", 1, "SUCCEEDED"),
        (3, at(0), 7, "CLAIM", "a"), (3, at(0, 10), 8, "CANCEL"), (3, at(2), 9, "CLAIM", "b"), (3, at(3), 10, "CANCEL"),
    ]
    got = told(leases.decide(ledger(spark, rows), HOUR, 5))
    assert got[1] == ("CANCELLING", "CANCELLED", 0) and got[2] == ("REFUSED", "CANCELLED", 0)
    assert got[4] == ("CANCELLING", "RUNNING", 1) and got[5] == ("STALE", "RUNNING", 1) and got[6] == ("COMPLETED", "CANCELLED", 1)
    assert got[9] == ("REFUSED", "CANCELLED", 1) and got[10] == ("REFUSED", "CANCELLED", 1)


def test_suspended_jobs_are_not_claimed_and_resume_with_all_attempts(spark):
    rows = [
        (1, at(0), 1, "SUSPEND"), (1, at(1), 2, "CLAIM", "a"), (1, at(2), 3, "RESUME"), (1, at(3), 4, "RESUME"), (1, at(4), 5, "CLAIM", "a"), (1, at(4, 1), 6, "SUSPEND"),
        (1, at(4, 2), 7, "COMPLETE", "a", 1, "RETRY_WAIT", 60), (1, at(5), 8, "SUSPEND"), (1, at(6), 9, "RESUME"), (1, at(7), 10, "CLAIM", "a"), (1, at(7, 1), 11, "COMPLETE", "a", 2, "RETRY_WAIT", 60),
    ]
    got = told(leases.decide(ledger(spark, rows), HOUR, 2))
    assert [got[k][0] for k in range(1, 12)] == ["SUSPENDED", "REFUSED", "RESUMED", "REFUSED", "CLAIMED", "REFUSED", "COMPLETED", "SUSPENDED", "RESUMED", "CLAIMED", "COMPLETED"]
    assert got[11][1] == "RETRY_WAIT"


def test_empty_ledger_and_a_job_without_a_name(spark):
    assert leases.decide(ledger(spark, []), HOUR, 5).count() == 0
    assert told(leases.decide(ledger(spark, [(None, at(0), 1, "CLAIM", "a"), (None, at(0, 1), 2, "CLAIM", "b")]), HOUR, 5)) == {1: ("CLAIMED", "RUNNING", 1), 2: ("REFUSED", "RUNNING", 1)}


def test_stream_decides_like_the_fold_whatever_order_files_come_in(spark, tmp_path):
    rng = random.Random(5)
    actions = ["CLAIM"] * 4 + ["RENEW"] * 3 + ["COMPLETE", "COMPLETE", "CANCEL", "SUSPEND", "RESUME"]
    rows = []
    for seq in range(400):
        minute = rng.randrange(4 * 24 * 60)
        action = actions[rng.randrange(len(actions))]
        if action == "CANCEL" and rng.random() < 0.7:
            action = "CLAIM"
        when = f"2024-01-{1 + minute // 1440:02d} {minute % 1440 // 60:02d}:{minute % 60:02d}:00"
        rows.append((rng.randrange(6), when, seq, action, "ab"[rng.randrange(2)], None, ("RETRY_WAIT", "RETRY_WAIT", "SUCCEEDED")[rng.randrange(3)], 600))
    df = ledger(spark, rows)
    path = str(tmp_path / "ledger")
    df.repartition(5, "seq").write.parquet(path)
    last = ledger(spark, [(9, "2024-01-20 00:00:00", 400, "CLAIM", "a")])
    last.coalesce(1).write.mode("append").parquet(path)
    df = df.unionByName(last)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = windows.all_available(stream.decide(source, HOUR, 6, "5 days"), "leases", "append").collect()
    newest = df.agg(F.unix_micros(F.max("at"))).first()[0]
    want = leases.decide(df, HOUR, 6, until_us=newest - 5 * 86_400_000_000).collect()
    assert len(want) > 20 and any(r.outcome == "EXPIRED" for r in want)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_state_goes_by_its_keys_not_by_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "SHARDS", 3)
    rng = random.Random(9)
    names = [None, "", 'a"b', "ü\n\\", *(f"job {i}" for i in range(200))]
    actions = ("CLAIM", "CLAIM", "CLAIM", "RENEW", "COMPLETE", "CANCEL", "SUSPEND", "RESUME")
    rows = [(name, at(rng.randrange(24), rng.randrange(60)), 10 * n + i, rng.choice(actions), rng.choice("ab"), rng.choice((None, 1)), "RETRY_WAIT", 600) for n, name in enumerate(names) for i in range(8)]
    rows.append(("last", "2024-01-03 00:00:00", 9999, "CLAIM", "a", None, None, None))
    df = spark.createDataFrame(rows, COLS.replace("job long", "job string")).withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "ledger"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ledger"))
    spark.conf.set(*windows.STORE)
    query = stream.decide(source, HOUR, 3, "1 day").writeStream.format("memory").queryName("by_keys").outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3
    until = df.agg(F.unix_micros(F.max("at"))).first()[0] - 86_400_000_000
    want = leases.decide(df, HOUR, 3, until_us=until).collect()
    assert len(want) > 8 * len(names) and {"EXPIRED", "CANCELLING", "COMPLETED", "RENEWED"} <= {r.outcome for r in want}
    assert sorted(map(str, spark.table("by_keys").collect())) == sorted(map(str, want))


def test_no_command_of_a_table_of_many_files_is_dropped_as_late(spark, tmp_path):
    from conftest import SF
    from oracle import assert_same, connect

    from lontarix import queries

    spark.read.parquet(f"{SF}/events.parquet").repartition(40, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 32
    assert_same(queries.queries()["stream_leases"](spark, str(tmp_path)), connect(SF), queries.oracles()["stream_leases"])


def test_no_request_of_a_table_of_many_files_is_dropped_as_late(spark, tmp_path):
    from conftest import SF
    from oracle import assert_same, connect

    from lontarix import queries

    spark.read.parquet(f"{SF}/clicks.parquet").repartition(48, "click_id").write.parquet(str(tmp_path / "clicks.parquet"))
    assert_same(queries.queries()["late_requests"](spark, str(tmp_path)), connect(SF), queries.oracles()["late_requests"])


def test_late_and_unfinished_requests(spark, tmp_path):
    def written(name, rows, schema):
        df = spark.createDataFrame(rows, schema).withColumn(schema.split()[2], F.expr(f"timestamp_seconds(1700000000 + {schema.split()[2]})"))
        far = F.col("request_id") == 99
        df.where(~F.coalesce(far, F.lit(False))).repartition(3).write.parquet(str(tmp_path / name))
        df.where(far).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    day = 86_400
    asked = [(i, 60 * i) for i in range(20)] + [(3, 180), (None, 50), (99, 9 * day), (98, None)]
    done = [(i, 60 * i + 5 * i) for i in range(20) if i % 3] + [(4, 260), (5, 4000), (99, 9 * day + 1), (97, 77)]
    done = [d for d in done if d != (5, 325)]
    static, streamed = zip(written("asked", asked, "request_id long, at long"), written("done", done, "request_id long, done_at long"), strict=True)
    want = {i: math.inf if i % 3 == 0 or i == 5 else 5000.0 * i for i in range(20)} | {99: 1000.0}
    assert {r.request_id: r.latency_ms for r in telemetry.outcomes(*static, 600, "2 days").collect()} == want
    rows = windows.all_available(telemetry.outcomes(*streamed, 600, "2 days"), "requests", "append").collect()
    assert sorted((r.request_id, r.latency_ms) for r in rows) == sorted(want.items())


@pytest.mark.parametrize("answered", (True, False))
def test_requests_at_the_bound_repeated_old_and_without_an_id(spark, tmp_path, answered):
    import duckdb
    from oracle import assert_same

    from lontarix import queries

    newest, hour, us = datetime(2024, 4, 29, 12, 43, 34, 38_607), timedelta(hours=1), timedelta(microseconds=1)
    bound, day, kind = newest - timedelta(days=4) - hour, datetime(2024, 4, 1), "view" if answered else "error"
    rows = [(100 + i, bound + n * us, bound + 2 * hour, kind) for i, n in enumerate((-2000, -1000, -607, -1, 0, 1, 1000))]
    rows += [(1, newest, newest + us, kind), (2, day, day + us, kind), (2, day + hour, day + hour + us, kind), (3, day, day + 2 * hour, kind), (3, day, day + 5 * us, kind), (3, day, day + 9 * us, kind)]
    rows += [(None, day, day + us, kind), (None, day + us, day + hour, kind), (4, day, None, kind), (5, None, day, kind), (6, day, day + us, None), (7, day, day + us, "error")]
    rows += [(8 + i, datetime(1960, 1, 1), datetime(1960, 1, 1) + n * hour, kind) for i, n in enumerate((1, 2))]
    rows += rows[:4]
    spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string").repartition(3).write.parquet(str(tmp_path / "clicks.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW clicks AS SELECT * FROM '{tmp_path}/clicks.parquet/*.parquet'")
    got = queries.queries()["late_requests"](spark, str(tmp_path))
    assert got.count() == (16 if answered else 14)
    assert_same(got, con, queries.oracles()["late_requests"])


def test_a_table_in_a_folder_streams_as_one_in_a_file_does(spark, tmp_path):
    from conftest import SF
    from oracle import assert_same, connect

    from lontarix import queries

    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    clicks.sort("ts").coalesce(1).write.option("maxRecordsPerFile", clicks.count() // 3).parquet(str(tmp_path / "clicks.parquet"))
    assert len(list((tmp_path / "clicks.parquet").glob("*.parquet"))) > 2
    got = queries.queries()["late_requests"](spark, str(tmp_path))
    assert_same(got, connect(SF), queries.oracles()["late_requests"])
    clicks.limit(0).write.parquet(str(tmp_path / "none" / "clicks.parquet"))
    none = queries.queries()["late_requests"](spark, str(tmp_path / "none"))
    assert none.columns == got.columns and none.count() == 0
