"""The telemetry data source: frames, splits, commits, damage."""

from __future__ import annotations

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lontarix.sources import telemetry

number, text = st.integers(0, 2**63 - 1), st.text(max_size=12)
stage = st.fixed_dictionaries({"stage": text, "duration_ns": number, "queue_ns": number})


@given(st.tuples(text, text, number, number, st.integers(0, 2**31 - 1), st.one_of(st.none(), number), st.lists(stage, max_size=3)))
@settings(max_examples=200, deadline=None)
def test_messages_come_back(row):
    message = telemetry.encode((*row[:-1], [(s["stage"], s["duration_ns"], s["queue_ns"]) for s in row[-1]]))
    assert telemetry.decode(message) == row
    assert list(telemetry.frames(telemetry.varint(len(message)) + message)) == [message]


def test_the_wire_format_is_the_known_one():
    """Bytes worked out by hand from the wire format's rules."""
    assert telemetry.varint(0) == b"\0" and telemetry.varint(127) == b"\x7f" and telemetry.varint(300) == b"\xac\x02"
    assert telemetry.encode(("r", "é", 300, 0, 1, 0, [("s", 1, 0)])) == b"\x0a\x01r\x12\x02\xc3\xa9\x18\xac\x02\x28\x01\x30\x00\x3a\x05\x0a\x01s\x10\x01"
    assert telemetry.encode((None, "", 0, 0, 0, None, None)) == b""


@pytest.mark.parametrize(
    ("damage", "said"),
    [(b"\x05\x0a\x01", "beyond its file"), (b"\x80", "varint"), (b"\xff\xff\xff\x7f", "a message of"), (b"\x02\x40\x01", "unknown field 8"), (b"\x02\x0d\x01", "unknown field 1"), (b"\x02\x0a\x05", "beyond its message"), (b"\x03\x0a\x01\xff", "UTF-8"), (b"\x0b\x18" + b"\xff" * 9 + b"\x01", "negative")],
)
def test_damage_is_an_error(damage, said):
    with pytest.raises(telemetry.TelemetryError, match=said):
        [telemetry.decode(m) for m in telemetry.frames(damage)]


def rows(spark, n, run="r1"):
    return spark.range(n).selectExpr(
        f"'{run}' AS run_id", "concat('q', id) AS request_id", "id * 1000 AS scheduled_ns", "id * 7 AS completion_ns", "cast(id % 3 AS int) AS outcome", "IF(id % 2 = 0, id, null) AS first_token_ns",
        "transform(sequence(1, cast(id % 4 AS int) + 1), i -> named_struct('stage', concat('s', i), 'duration_ns', cast(i AS long), 'queue_ns', id)) AS stages",
    )


def test_round_trip_over_many_files_and_splits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = rows(spark, 5000)
    telemetry.write(df.repartition(5), path, split_bytes=10_000)
    got = telemetry.read(spark, path)
    assert got.rdd.getNumPartitions() > 5 and len([n for n in os.listdir(tmp_path / "t") if n.startswith("part-")]) == 5
    assert got.exceptAll(df).count() == 0 and got.count() == 5000
    telemetry.write(rows(spark, 10, "r2"), path)
    assert telemetry.read(spark, path).groupBy("run_id").count().collect() and telemetry.read(spark, path).count() == 5010
    telemetry.write(rows(spark, 3), path, mode="overwrite")
    assert telemetry.read(spark, path).count() == 3
    telemetry.write(rows(spark, 0), path, mode="overwrite")
    assert telemetry.read(spark, path).count() == 0 and os.listdir(tmp_path / "t") == ["manifest.json"]


def test_a_failed_write_leaves_all_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    telemetry.write(rows(spark, 20), path)
    bad = rows(spark, 400).selectExpr("* except (completion_ns)", "IF(request_id = 'q399', -1, completion_ns) AS completion_ns").repartition(4)
    with pytest.raises(Exception, match="negative"):
        telemetry.write(bad, path, mode="overwrite")
    assert telemetry.read(spark, path).count() == 20


def test_torn_and_changed_files_are_errors(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="no telemetry"):
        telemetry.read(spark, path).count()
    telemetry.write(rows(spark, 50).coalesce(1), path)
    manifest = json.loads((tmp_path / "t/manifest.json").read_text())
    name = tmp_path / "t" / manifest["files"][0]["name"]
    whole = name.read_bytes()
    name.write_bytes(whole[:-3])
    with pytest.raises(Exception, match="bytes, not"):
        telemetry.read(spark, path).count()
    name.write_bytes(whole[:-3] + b"\xff\xff\xff")
    with pytest.raises(Exception, match="TelemetryError"):
        telemetry.read(spark, path).collect()


def test_issues_of_a_run(spark):
    df = rows(spark, 4).unionByName(rows(spark, 1)).unionByName(rows(spark, 1, "r2").selectExpr("* except (request_id, stages)", "'' AS request_id", "array(stages[0], stages[0]) AS stages"))
    assert sorted(map(tuple, telemetry.run_issues(df, "r1").collect())) == [("", "repeated_stage"), ("", "request_id"), ("", "run_id"), ("q0", "repeated_request"), ("q0", "repeated_request")]
