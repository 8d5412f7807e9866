"""Bounded path search against a walk in plain Python, and plans that depend on lookups."""

from __future__ import annotations

import random

import pytest

from lontarix.operators import graph, traversal


def walk(edges, supports, seed, hops, max_paths, max_assertions):
    """Breadth first, edges of a node by id: the rule in plain Python."""
    near = {}
    for a, s, o in sorted(edges):
        near.setdefault(s, []).append((a, o))
        if s != o:
            near.setdefault(o, []).append((a, s))
    paths, reasons, front = [], set(), [([seed], [])]
    for _ in range(hops):
        for nodes, _a in front:
            if max_assertions is not None and len(near.get(nodes[-1], [])) > max_assertions:
                reasons.add("assertion_budget")
        after = []
        for nodes, taken in front:
            for a, other in sorted(near.get(nodes[-1], []))[:max_assertions]:
                if other in nodes:
                    continue
                if len(paths) + len(after) >= max_paths:
                    return paths + after, reasons | {"path_budget"}
                after.append((nodes + [other], taken + [a]))
        paths, front = paths + after, after
        if not front:
            break
    if front:
        reasons.add("hop_budget")
    return paths, reasons


@pytest.mark.parametrize(("hops", "max_paths", "max_assertions"), [(3, 1000, None), (3, 7, None), (2, 40, 2), (4, 25, 3), (1, 1, 1)])
def test_search_like_the_walk(spark, hops, max_paths, max_assertions):
    rng = random.Random(hops * 100 + max_paths)
    edges = {(f"a{i:03d}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(30)} | {("a900", "x", "y")}
    supports = [(a, f"s{rng.randrange(50):02d}") for a, _, _ in edges for _ in range(rng.randrange(3))]
    seeds = [f"n{i}" for i in range(14)] + ["x", "alone"]
    e = spark.createDataFrame(sorted(edges), "assertion_id string, subject string, object string")
    found, ends = traversal.search(e, spark.createDataFrame(supports, "assertion_id string, support_id string"), spark.createDataFrame([(s,) for s in seeds], "node string"), hops, max_paths, max_assertions)
    least = {}
    for a, s in supports:
        least[a] = min(s, least.get(a, s))
    got = {}
    for r in found.orderBy("seed", "rank").collect():
        assert r.rank == len(got.setdefault(r.seed, [])) + 1 and r.hop == len(r.assertions) and r.supports == [least.get(a) for a in r.assertions]
        got[r.seed].append((r.nodes, r.assertions))
    told = {r.seed: r for r in ends.collect()}
    assert set(told) == set(seeds)
    for seed in seeds:
        paths, reasons = walk(edges, supports, seed, hops, max_paths, max_assertions)
        assert got.get(seed, []) == paths
        assert (told[seed].n_paths, set(told[seed].stop_reasons), told[seed].exhausted) == (len(paths), reasons, not reasons)


def test_a_hub_stays_bounded(spark):
    """A node of 100,000 edges, walked over from many seeds: what a hop keeps goes by the budgets."""
    e = spark.range(100_000).selectExpr("concat('e', lpad(id, 6, '0')) AS assertion_id", "'hub' AS subject", "concat('n', id) AS object")
    none = spark.createDataFrame([], "assertion_id string, support_id string")
    seeds = spark.range(50).selectExpr("concat('n', id * 7) AS node")
    found, ends = traversal.search(e, none, seeds, 3, 20, 30)
    assert found.count() == 50 * 20
    assert {tuple(r.stop_reasons) for r in ends.collect()} == {("assertion_budget", "path_budget")}
    found, ends = traversal.search(e, none, spark.createDataFrame([("hub",)], "node string"), 2, 5)
    assert [r.assertions for r in found.orderBy("rank").collect()] == [[f"e{i:06d}"] for i in range(5)]


def test_search_needs_sound_budgets(spark):
    e = spark.createDataFrame([("a", "x", "y")], "assertion_id string, subject string, object string")
    s, n = spark.createDataFrame([], "assertion_id string, support_id string"), spark.createDataFrame([("x",)], "node string")
    for bad in ((0, 5, None), (17, 5, None), (1, 0, None), (1, 1, 0)):
        with pytest.raises(ValueError):
            traversal.search(e, s, n, *bad)


def test_an_empty_lookup_is_a_dependency(spark):
    state = [(i, "c", "p") for i in range(6)]
    before = spark.createDataFrame(state, "item_id long, content_hash string, producer string")
    after = spark.createDataFrame([(i, "d" if i == 5 else "c", "p") for i in range(6)], before.schema)
    deps = spark.createDataFrame([(3, 1), (4, 3)], "item_id long, dependency_id long")
    versions = spark.createDataFrame([("law", 2, 5), ("act", 1, None), ("new", 7, None)], "scope string, from_rev long, to_rev long")
    index = graph.scope_index(versions, "scope")
    assert {tuple(r) for r in index.collect()} == {("law", 2, 1), ("law", 5, 0), ("act", 1, 1), ("new", 7, 1)}
    asked = spark.createDataFrame([(0, "act"), (1, "new"), (2, "law"), (5, "new"), (0, "nothing")], "item_id long, scope string")
    seen = {at: {(r.item_id, r.scope): (r.revision, r.empty) for r in graph.looked_up(asked, index, "scope", at).collect()} for at in (4, 6, 7)}
    assert seen[4] == {(0, "act"): (1, False), (0, "nothing"): (0, True), (1, "new"): (0, True), (2, "law"): (2, False), (5, "new"): (0, True)}
    assert seen[6][2, "law"] == (5, True) and seen[7][1, "new"] == (7, False)
    plan = graph.update_plan(before, after, deps, lookups=(graph.looked_up(asked, index, "scope", 6), graph.looked_up(asked, index, "scope", 7)))
    got = {r.item_id: (r.bucket, r.reason) for r in plan.collect()}
    assert got == {
        0: ("REUSE", "UNCHANGED"), 1: ("RECOMPUTE", "LOOKUP"), 2: ("REUSE", "UNCHANGED"), 3: ("RECOMPUTE", "DEPENDENCY"), 4: ("RECOMPUTE", "DEPENDENCY"), 5: ("RECOMPUTE", "CONTENT"),
    }


def test_dependencies_come_before_lookups_and_conflicts_stop_the_plan(spark):
    one = spark.createDataFrame([(1, "c", "p"), (2, "c", "p")], "item_id long, content_hash string, producer string")
    deps = spark.createDataFrame([], "item_id long, dependency_id long")
    own = [spark.createDataFrame(x, "item_id long, dependency_id long, hash string") for x in ([(1, 9, "h")], [(1, 9, "g")])]
    looked = [spark.createDataFrame(x, "item_id long, scope string, revision long, empty boolean") for x in ([(1, "s", 0, True), (2, "s", 0, True)], [(1, "s", 1, False), (2, "s", 1, False)], [(1, "s", 1, False), (2, "s", 1, True)])]
    got = {r.item_id: r.reason for r in graph.update_plan(one, one, deps, tuple(own), (looked[0], looked[1])).collect()}
    assert got == {1: "DEPENDENCY", 2: "LOOKUP"}
    with pytest.raises(Exception, match="conflicting lookup revisions of s"):
        graph.update_plan(one, one, deps, None, (looked[0], looked[2])).collect()
