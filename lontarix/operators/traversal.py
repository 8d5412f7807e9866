"""Bounded path search: a frontier that is cut, hop by hop, to what a seed may still return.

Paths are found breadth first, by the edges taken. Those of one hop beyond a seed's budget can't be among its first paths, nor can any
that goes on from them be, so each hop keeps a budget's rows a seed and is written; what a node may bring is bounded by
``max_assertions``, the first of its assertions by id. Neither a hub nor a long walk makes all paths first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, working
from .graph import MAX_HOPS, directions, of_nodes


def _near(edges: DataFrame, frontier: DataFrame, max_assertions: int | None) -> DataFrame:
    """(node, assertion_id, other, more): the edges of the frontier's nodes, ``more`` where a node has others beyond the limit."""
    near = of_nodes(edges, frontier)
    if max_assertions is None:
        return near.withColumn("more", F.lit(False))
    place = F.expr("row_number() OVER (PARTITION BY node ORDER BY assertion_id, other)")
    # One more than the limit tells that there are others.
    near = near.withColumn("place", place).where(F.col("place") <= max_assertions + 1)
    return near.withColumn("more", F.expr("max(place) OVER (PARTITION BY node)") > max_assertions).where(F.col("place") <= max_assertions).drop("place")


def search(assertions: DataFrame, supports: DataFrame, seeds: DataFrame, hops: int, max_paths: int, max_assertions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``max_paths`` simple paths of each seed, and why each seed's search ended.

    ``assertions``: assertion_id, subject, object; ``supports``: assertion_id, support_id; ``seeds``: node, distinct.
    Paths: (seed, rank, hop, nodes, assertions, supports), supports the smallest of each edge (null for an edge without one).
    Ends: (seed, n_paths, stop_reasons, exhausted): path_budget where a path more was there, assertion_budget where a node that was
    walked from had more assertions than were read, hop_budget where paths could go on after ``hops``; exhausted without any of these.
    A seed without edges has no path and is exhausted. A seed that has used up its paths is not walked from any more.
    """
    if not 0 < hops <= MAX_HOPS:
        raise ValueError("hops")
    if max_paths < 1 or (max_assertions is not None and max_assertions < 1):
        raise ValueError("budget")
    kind = dict(assertions.dtypes)["assertion_id"]
    with working(assertions.sparkSession):
        least = supports.groupBy("assertion_id").agg(F.min("support_id").alias("support_id"))
        edges = directions(assertions.select("assertion_id", "subject", "object"))
        start = F.array().cast(f"array<{kind}>")
        level = seeds.select(F.col("node").alias("seed"), F.array("node").alias("nodes"), start.alias("assertions"), F.lit(0).cast("long").alias("used"))
        found, told = [], []
        for hop in range(1, hops + 1):
            last = level.withColumn("node", F.element_at("nodes", -1))
            near = cut(_near(edges, last, max_assertions), "near")
            told.append(last.join(near.where("more").select("node").distinct(), "node", "left_semi").select("seed", F.lit("assertion_budget").alias("reason")))
            step = last.join(near, "node").where(~F.array_contains("nodes", F.col("other")))
            step = step.select("seed", F.concat("nodes", F.array("other")).alias("nodes"), F.concat("assertions", F.array("assertion_id")).alias("assertions"), "used")
            place = F.expr("row_number() OVER (PARTITION BY seed ORDER BY assertions, nodes)")
            # What is left of the budget differs by seed; the fixed bound comes first, since it holds within tasks already.
            step = step.withColumn("place", place).where(F.col("place") <= max_paths + 1).where(F.col("used") + F.col("place") <= max_paths + 1)
            step = cut(step.withColumn("rank", F.col("used") + F.col("place")).drop("place"), "hop", keep=True)
            over = step.where(F.col("rank") > max_paths).select("seed").distinct()
            told.append(over.select("seed", F.lit("path_budget").alias("reason")))
            kept = step.where(F.col("rank") <= max_paths)
            found.append(kept.select("seed", F.col("rank").cast("int").alias("rank"), F.lit(hop).alias("hop"), "nodes", "assertions"))
            total = kept.groupBy("seed").agg(F.max("rank").alias("used"))
            level = kept.drop("used", "rank").join(over, "seed", "left_anti").join(total, "seed")
            level = level.select("seed", "nodes", "assertions", "used")
        told.append(level.select("seed", F.lit("hop_budget").alias("reason")))
        paths, reasons = found[0], told[0]
        for more in found[1:]:
            paths = paths.unionByName(more)
        for more in told[1:]:
            reasons = reasons.unionByName(more)
        reasons = cut(reasons.groupBy("seed").agg(F.array_sort(F.collect_set("reason")).alias("stop_reasons")), "stops", keep=True)
    n = paths.groupBy("seed").agg(F.count("*").alias("n_paths"))  # before supports are met, which no end depends on
    edge = paths.select("seed", "rank", F.posexplode("assertions").alias("at", "assertion_id")).join(least, "assertion_id", "left")
    chosen = edge.groupBy("seed", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "support_id"))).alias("s"))
    paths = paths.join(chosen.select("seed", "rank", F.col("s.support_id").alias("supports")), ["seed", "rank"])
    ends = seeds.select(F.col("node").alias("seed")).join(n, "seed", "left").join(reasons, "seed", "left")
    why = F.coalesce("stop_reasons", F.array().cast("array<string>"))
    return paths, ends.select("seed", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), why.alias("stop_reasons"), (F.size(why) == 0).alias("exhausted"))
