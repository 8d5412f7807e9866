"""Plans whose cost goes by the rows there are: what is dealt out, what is sent to tasks, and that both ways give the same rows."""

from __future__ import annotations

import hashlib

import pytest

from lontarix.operators import evidence as ev
from lontarix.operators import graph, traversal
from lontarix.sources import shared


@pytest.fixture
def no_broadcast(spark):
    """Only what an operator itself sends to tasks is sent."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_few_sources_of_many_claims(spark, no_broadcast, monkeypatch):
    claims = spark.range(600).selectExpr("id div 6 AS claim_id", "id % 4 AS source_id", "id % 3 AS start", "id % 3 + id % 2 AS stop")
    sources = spark.range(50).selectExpr("id AS source_id", "concat(if(id = 3, 'ftp', 'https'), '://a.org/', id) AS url")
    out = ev.cite(claims, sources, 2)
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ev, "SENT", 0)
    by_join = ev.cite(claims, sources, 2)
    assert "SortMergeJoin" in plan_of(by_join)
    assert rows_of(out) == rows_of(by_join) and out.count() == 200


def test_chunks_are_dealt_out_and_grouped_once(spark, no_broadcast):
    chunks = spark.createDataFrame([(1, [1, 2, 2, 3]), (2, [3, None, 9]), (3, [9]), (4, []), (5, None)], "chunk_id long, version_ids array<long>")
    versions = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "c")], "version_id long, source_id string")
    out = ev.provenance(chunks, versions)
    assert sorted(map(tuple, out.collect())) == [(1, 3, 2), (2, 1, 0)]
    assert "Expand" not in plan_of(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_level_of_exceptions_meets_only_what_waits(spark, monkeypatch):
    """1 waits for 2 and 3, which are done on different levels; the texts of those that nothing waits for are written once."""
    a = spark.createDataFrame([(i, f"c{i}") for i in range(1, 200)], "assertion_id long, content string")
    refs = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 4), (4, 5), (3, 5)], "assertion_id long, exception_id long")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (sha(f"c{i}"), 0) for i in range(5, 200)}
    want[4] = (sha(f"c4|{want[5][0]}"), 1)
    want[3] = (sha(f"c3|{want[5][0]}"), 1)
    want[2] = (sha(f"c2|{want[4][0]}"), 2)
    want[1] = (sha("c1|" + ",".join(sorted([want[2][0], want[3][0], want[3][0]]))), 3)
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, *a, **k: written.append(t := shared.cut(df, *a, **k)) or t)
    got = {r.assertion_id: (r.canonical_id, r.level) for r in graph.exception_ids(a, refs).collect()}
    assert got == want
    assert [t.count() for t in written] == [199, 2, 2, 1]


def test_paths_by_frontiers_sent_or_joined(spark, no_broadcast, monkeypatch):
    e = spark.range(400).selectExpr("concat('e', id) AS assertion_id", "concat('n', id % 37) AS subject", "concat('n', id % 11 * 5) AS object")
    seeds = spark.range(3).selectExpr("concat('n', id) AS node")
    sent = graph.paths(e, seeds, 2)
    near = graph.of_nodes(graph.directions(e), seeds)
    assert "BroadcastHashJoin" in plan_of(near) and "Exchange hashpartitioning" not in plan_of(near)
    got = rows_of(sent)
    monkeypatch.setattr(graph, "SENT", 0)
    assert "SortMergeJoin" in plan_of(graph.of_nodes(graph.directions(e), seeds))
    assert got == rows_of(graph.paths(e, seeds, 2)) and len(got) > 100


def test_ends_of_a_search_need_no_supports(spark):
    e = spark.createDataFrame([("a", "x", "y"), ("b", "y", "z")], "assertion_id string, subject string, object string")
    supports = spark.createDataFrame([("a", "s")], "assertion_id string, told_by string").withColumnRenamed("told_by", "support_id")
    found, ends = traversal.search(e, supports, spark.createDataFrame([("x",), ("w",)], "node string"), 2, 5)
    assert "support_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "support_id" not in ends._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.seed, r.n_paths, r.exhausted) for r in ends.collect()) == [("w", 0, True), ("x", 2, False)]
