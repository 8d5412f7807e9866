"""Reciprocal rank fusion, its input checks, reranking order, and retrieval profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Branch kinds in the order in which their contributions are summed; the RRF constant; branches of profiles.
BRANCH_ORDER = ("dense", "bm25", "graph")
RRF_K = 60
PROFILES = {"VECTOR": ("dense",), "HYBRID": ("dense", "bm25"), "GRAPH": ("graph",), "HYBRID_GRAPH": ("dense", "bm25", "graph")}


def branches_of(profile: str, available: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The branches of a profile; one that is missing is an error, never left out."""
    missing = [b for b in PROFILES[profile] if b not in available]
    if missing:
        raise ValueError(f"profile {profile} needs {', '.join(missing)}")
    return {b: available[b] for b in PROFILES[profile]}


def checked_branch(branch: DataFrame, question: str = "question_id", key: str = "key", budget: int = 1000) -> DataFrame:
    """The branch itself; a repeated key, a rank that does not rise, or too many rows stop the job."""
    marked = branch.withColumn("__prev", F.expr(f"lag(rank) OVER (PARTITION BY {question} ORDER BY rank, {key})"))
    marked = marked.withColumn("__same", F.expr(f"count(*) OVER (PARTITION BY {question}, {key})"))
    bad = (F.col("rank") < 1) | (F.col("rank") > budget) | (F.col("rank") <= F.coalesce("__prev", F.lit(0))) | (F.col("__same") > 1)
    checked = F.when(bad, F.raise_error(F.lit("bad branch")).cast("int")).otherwise(F.col("rank"))
    return marked.withColumn("rank", checked).drop("__prev", "__same")


def branch_issues(branch: DataFrame, question: str = "question_id", key: str = "key") -> DataFrame:
    """(question, n_reversed, n_repeated): what ``checked_branch`` would reject."""
    marked = branch.withColumn("__prev", F.expr(f"lag(rank) OVER (PARTITION BY {question} ORDER BY rank, {key})"))
    marked = marked.withColumn("__same", F.expr(f"count(*) OVER (PARTITION BY {question}, {key})"))
    return marked.groupBy(question).agg(F.count_if(F.col("rank") <= F.col("__prev")).alias("n_reversed"), F.count_if(F.col("__same") > 1).alias("n_repeated"))


def fuse(branches: dict[str, DataFrame], weights: dict[str, float] | None = None, question: str = "question_id", key: str = "key", k: int = RRF_K) -> DataFrame:
    """(question, key, score, best_rank, rank, provenance) over up to three branches of (question, key, rank).

    Contributions are summed in branch order, whatever order the branches come in. One shuffle by (question, key).
    """
    if not branches or set(branches) - set(BRANCH_ORDER):
        raise ValueError(f"branches are {BRANCH_ORDER}")
    rows = reduce(DataFrame.unionByName, [df.select(question, key, F.col("rank").cast("int").alias("r"), F.lit(BRANCH_ORDER.index(b)).alias("b")) for b, df in branches.items()])
    parts = [F.coalesce(F.max(F.when(F.col("b") == i, F.lit(float((weights or {}).get(name, 1.0))) / (k + F.col("r")))), F.lit(0.0)) for i, name in enumerate(BRANCH_ORDER)]
    names = F.array(*(F.lit(b) for b in BRANCH_ORDER))
    seen = F.array_sort(F.collect_list(F.struct("b", "r")))
    text = F.array_join(F.transform(seen, lambda x: F.concat(F.element_at(names, x["b"] + 1), F.lit(":"), x["r"].cast("string"))), " ")
    out = rows.groupBy(question, key).agg((parts[0] + parts[1] + parts[2]).alias("score"), F.min("r").alias("best_rank"), text.alias("provenance"))
    order = f"row_number() OVER (PARTITION BY {question} ORDER BY score DESC, best_rank, {key})"
    return out.withColumn("rank", F.expr(order))


def rerank(candidates: DataFrame, scores: DataFrame, question: str = "question_id", key: str = "key") -> DataFrame:
    """Candidates ordered by score, then by the rank they had; every candidate must have exactly one score."""
    paired = candidates.join(scores.select(question, key, F.col("score").alias("rerank_score")), [question, key], "left")
    checked = F.when(F.col("rerank_score").isNull(), F.raise_error(F.lit("candidate without a score")).cast("double")).otherwise(F.col("rerank_score"))
    paired = paired.withColumn("rerank_score", checked)
    return paired.withColumn("new_rank", F.expr(f"row_number() OVER (PARTITION BY {question} ORDER BY rerank_score DESC, rank)"))


def batches(rows: DataFrame, part: str, order: str, size: Column, max_items: int, max_bytes: int) -> DataFrame:
    """``batch``: rows of each part in order, a batch closed before it exceeds items or bytes. A fold over one part's rows."""
    packed = rows.withColumn("__size", size.cast("long")).groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__size")))).alias("rows"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("bytes"), F.expr(f"cast(array() as array<struct<k:{dict(rows.dtypes)[order]},batch:int>>)").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        full = (acc["items"] > 0) & ((acc["items"] >= max_items) | (acc["bytes"] + row["__size"] > max_bytes))
        batch = acc["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(
            batch.alias("batch"),
            F.when(full, 1).otherwise(acc["items"] + 1).alias("items"),
            F.when(full, row["__size"]).otherwise(acc["bytes"] + row["__size"]).alias("bytes"),
            F.concat(acc["out"], F.array(F.struct(row[order].alias("k"), batch.alias("batch")))).alias("out"),
        )

    folded = packed.select(part, F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return folded.select(part, F.col("o.k").alias(order), F.col("o.batch").alias("batch"))


def one_over(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """``limit`` rows and ``overflow``: whether there were more. One row over is fetched to know."""
    some = rows.orderBy(*order).limit(limit + 1)
    over = some.agg((F.count("*") > limit).alias("overflow"))
    return some.orderBy(*order).limit(limit).crossJoin(F.broadcast(over))
