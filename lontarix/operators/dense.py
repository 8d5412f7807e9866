"""Exact vector search in blocks, and vector checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..sources.shared import cut

#: Vectors count as normalised within this distance of length 1.
NORM_TOLERANCE = 0.01
#: Scores that a task holds at once.
TILE = 1 << 21


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, component by component in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def max_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def _best(ids: np.ndarray, y: np.ndarray, q: np.ndarray, x: np.ndarray, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of each query's k best rows, some queries at a time. ``y`` and ``x`` are the rows' and queries' vectors of length 1."""
    step = max(1, TILE // len(y))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ y.T
        s *= 10**digits
        s += 0.5
        np.floor(s, out=s)
        s /= 10**digits
        kth = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
        row, at = np.nonzero(s >= kth)
        order = np.lexsort((ids[at], -s[row, at], row))
        row, at = row[order], at[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield q[a + row[first]], ids[at[first]], s[row[first], at[first]]


def cosine_top_k(
    rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", digits: int = 6, row_block: int = 65536, query_block: int = 4096
) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine for each query; ties to the smaller id.

    Blocks of rows and of queries meet in a grid of bounded tasks, each a matrix product that keeps its k best; only those
    are ranked across blocks. Scores are rounded to ``digits`` before they are ranked. A query may find its own row. Vectors that
    have no direction take no part on either side: null, of length 0, or with a null or non-finite component; nor do rows of
    another number of components than the query's.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # Numbers are written with the rows: all copies of a row below must go by the same one.
    number = F.monotonically_increasing_id().alias("number")
    own = cut(rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), number), "vectors")
    asked = cut(queries.where(usable).select(F.col(query_id).cast("long").alias("q"), F.col(vector_col).alias("v"), number), "queries")
    n_rows, n_queries = own.count(), asked.count()
    row_groups, query_groups = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))

    def spread(df: DataFrame, mine: str, groups: int, other: str, others: int) -> DataFrame:
        group = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")
        return df.select("*", group.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def vectors(part: pa.Table, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of components, ids, vectors of length 1), apart by that number."""
        v, ids = part["v"].combine_chunks(), part[key].to_numpy()
        sizes = pc.list_value_length(v).to_numpy()
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            m = pc.list_flatten(v.take(pa.array(own))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            # By the largest component first: squares of very large or very small ones leave the doubles.
            m /= np.abs(m).max(1, keepdims=True)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            yield n, ids[own], m

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            asked = {n: (q, x) for n, q, x in vectors(right, "q")}
            out += [found for n, ids, y in vectors(left, "id") if n in asked for found in _best(ids, y, *asked[n], k, digits)]
        return pa.table(dict(zip(("q", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    left, right = spread(own, "rg", row_groups, "qg", query_groups), spread(asked, "qg", query_groups, "rg", row_groups)
    near = left.groupBy("rg", "qg").cogroup(right.groupBy("rg", "qg")).applyInArrow(search, "q long, id long, score double")
    ranked = near.withColumn("rank", F.expr("row_number() OVER (PARTITION BY q ORDER BY score DESC, id)")).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def checked_norm(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, norm, ok): whether a vector has ``dim`` finite components and length 1."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = v.isNotNull() & finite & (F.abs(norm(v) - 1) <= NORM_TOLERANCE)
    ok = ok & (F.size(v) == dim) if dim else ok
    return rows.select(id_col, rounded(norm(v)).alias("norm"), F.coalesce(ok, F.lit(False)).alias("ok"))
