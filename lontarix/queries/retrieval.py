"""Dense search, fusion, profiles, reranking and retrieval metrics over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import dense, fusion, metrics
from ..operators import lexical as lx
from ..plans import evidence as plan
from ..session import table
from .lexical import INDEX, _T, r6


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(s, d, "embeddings").where("vec_id % 100 = 0").withColumn("query_id", F.col("vec_id"))


def dense_norm_check(s, d):
    return dense.checked_norm(table(s, d, "embeddings"), dim=64)


def dense_topk(s, d):
    return dense.cosine_top_k(table(s, d, "embeddings"), _questions(s, d), 20)


def visible(rows: DataFrame, seq: int) -> DataFrame:
    """Rows of knowledge visible at ``seq``: from_seq <= seq, and not closed by then."""
    return rows.where((F.col("from_seq") <= seq) & ~F.coalesce(F.col("to_seq") <= seq, F.lit(False)))


def _versioned(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.withColumn("from_seq", F.col("vec_id") % 10).withColumn("to_seq", F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 10 + 4))


def dense_topk_filtered(s, d):
    return dense.cosine_top_k(visible(_versioned(s, d), 5), _questions(s, d), 20)


def dense_parity(s, d):
    """Each vector against its components rounded to two digits, as a second model's output."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 0.5) / 100.0).alias("b"))
    return e.select("vec_id", rounded(dense.max_difference(F.col("a"), F.col("b"))).alias("max_abs_diff"), rounded(dense.cosine(F.col("a"), F.col("b"))).alias("cosine"))


def _branches(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Dense and lexical branches for the same questions: the question's document is the lexical query."""
    vec = dense_topk(s, d).select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("key"), "rank")
    docs = table(s, d, "documents").select("doc_id", "text")
    asked = _questions(s, d).select("query_id").join(docs.withColumnRenamed("doc_id", "query_id"), "query_id")
    top = lx.search(lx.index(docs), asked, 20, "query_id", distinct=True)
    return {"dense": vec, "bm25": top.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("key"), "rank")}


def _fused(df: DataFrame) -> DataFrame:
    return df.select("question_id", "key", rounded(F.col("score"), 9).alias("score"), "best_rank", "rank")


def rrf_fusion(s, d):
    return _fused(fusion.fuse({k: fusion.checked_branch(v) for k, v in _branches(s, d).items()}))


def rrf_weighted(s, d):
    return _fused(fusion.fuse(_branches(s, d), {"dense": 1.0, "bm25": 2.0}))


def rrf_provenance(s, d):
    return fusion.fuse(_branches(s, d)).select("question_id", "key", "provenance")


def profile_vector(s, d):
    return _fused(fusion.fuse(fusion.branches_of("VECTOR", _branches(s, d))))


def rank_check(s, d):
    return fusion.branch_issues(_branches(s, d)["bm25"])


def rerank_order(s, d):
    found = dense_topk(s, d).select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("key"), "rank", "score")
    scores = found.select("question_id", "key", ((F.col("key") * 7919) % 13).cast("double").alias("score"))
    return fusion.rerank(found.drop("score"), scores)


def rerank_batches(s, d):
    turns = table(s, d, "conversations")
    return fusion.batches(turns, "conv_id", "turn", F.octet_length("text"), 4, 600)


def overflow_probe(s, d):
    rows = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return fusion.one_over(rows.select("o_orderkey"), 50, F.col("o_orderkey"))


def _graded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Grades of the found rows (same label 3, a neighbouring label 1), and how many rows of each grade a question has."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    q = _questions(s, d).select("query_id", F.col("label").alias("q_label"))
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    have = q.join(sizes, F.abs(F.col("label") - F.col("q_label")) <= 1).groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("label") == F.col("q_label"), F.col("n"))), F.lit(0)).alias("n3"), F.coalesce(F.sum(F.when(F.col("label") != F.col("q_label"), F.col("n"))), F.lit(0)).alias("n1"))
    found = dense_topk(s, d).join(e, "vec_id").join(q, "query_id")
    gap = F.abs(F.col("label") - F.col("q_label"))
    return found.select("query_id", "vec_id", "rank", F.when(gap == 0, 3).when(gap == 1, 1).otherwise(0).alias("grade")), have


def recall_at_k(s, d):
    found, have = _graded(s, d)
    return metrics.recall_at(found, have.select("query_id", F.col("n3").alias("n_gold")), 10)


def ndcg_at_k(s, d):
    found, have = _graded(s, d)
    return metrics.ndcg_at(found, have.select("query_id", F.array(F.struct(F.lit(3).alias("grade"), F.col("n3").alias("n")), F.struct(F.lit(1).alias("grade"), F.col("n1").alias("n"))).alias("gold")), 10)


def required_set_complete(s, d):
    """A question needs its own vector and the next one, or its own and the vector 100 on."""
    found, _ = _graded(s, d)
    sets = _questions(s, d).select("query_id", F.array(F.array("query_id", F.col("query_id") + 1), F.array("query_id", F.col("query_id") + 100)).alias("sets"))
    return metrics.required_sets(found, sets, 20)


def evidence_query(s, d):
    """The whole evidence query over a pinned snapshot, for every question of the stated set; one without a document has the dense branch alone."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), "text", (F.col("doc_id") % 10).alias("from_seq"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10 + 4).alias("to_seq"))
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = _questions(s, d).select(F.col("query_id").alias("question_id"), "embedding").join(docs.select(F.col("key").alias("question_id"), "text"), "question_id", "left")
    return plan.answer_context(plan.Corpus(docs, vectors, 5), plan.Request(asked, "HYBRID", 20, 1500))


QUERIES = {f.__name__: f for f in (evidence_query, dense_norm_check, dense_topk, dense_topk_filtered, dense_parity, rrf_fusion, rrf_weighted, rrf_provenance, profile_vector, rank_check, rerank_order, rerank_batches, overflow_probe, recall_at_k, ndcg_at_k, required_set_complete)}

_DENSE = f"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
en AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
sim AS (SELECT q.vec_id AS query_id, r.vec_id, {r6("list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))")} AS score FROM en q JOIN en r ON q.vec_id % 100 = 0),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM sim) WHERE rank <= 20)"""
_BOTH = f"""{INDEX}, {_DENSE},
lq AS (SELECT DISTINCT doc_id AS query_id, term FROM post WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
ls AS (SELECT query_id, doc_id, {r6("sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * dw.weight)")} AS score FROM lq JOIN df USING (term) JOIN dw USING (term), st GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ls) WHERE rank <= 20),
u AS (SELECT coalesce(d.query_id, l.query_id) AS question_id, coalesce(d.vec_id, l.doc_id) AS key, d.rank AS dr, l.rank AS lr
      FROM den d FULL JOIN lex l ON d.query_id = l.query_id AND d.vec_id = l.doc_id)"""


def _rrf(score: str, where: str = "true", best: str = "least(dr, lr)") -> str:
    return f"""WITH {_BOTH}, f AS (SELECT question_id, key, {score} AS raw, {best} AS best_rank FROM u WHERE {where})
SELECT question_id, key, floor(raw * 1e9 + 0.5e0) / 1e9 AS score, best_rank, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, best_rank, key)::INTEGER AS rank FROM f"""


_GRADE = f"""{_DENSE}, g AS (SELECT d.query_id, d.vec_id, d.rank, CASE abs(r.label - q.label) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS grade
FROM den d JOIN embeddings r ON r.vec_id = d.vec_id JOIN embeddings q ON q.vec_id = d.query_id),
h AS (SELECT q.vec_id AS query_id, count(*) FILTER (r.label = q.label) AS n3, count(*) FILTER (r.label <> q.label) AS n1
      FROM embeddings q JOIN embeddings r ON abs(r.label - q.label) <= 1 WHERE q.vec_id % 100 = 0 GROUP BY 1)"""

_SEEN = "{0} % 10 <= 5 AND NOT ({0} % 3 = 0 AND {0} % 10 + 4 <= 5)"
_EVIDENCE = f"""WITH RECURSIVE {INDEX.replace("FROM documents", "FROM seen").replace("tok AS", "seen AS (SELECT * FROM documents WHERE " + _SEEN.format("doc_id") + "), tok AS", 1)}, {_DENSE},
dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r2 FROM sim WHERE {_SEEN.format("vec_id")} AND vec_id IN (SELECT doc_id FROM documents)) WHERE r2 <= 20),
lq AS (SELECT DISTINCT doc_id AS query_id, unnest({_T.format("text")}) AS term FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
ls AS (SELECT query_id, doc_id, {r6("sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * dw.weight)")} AS score FROM lq JOIN df USING (term) JOIN dw USING (term), st GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r2 FROM ls) WHERE r2 <= 20),
u AS (SELECT coalesce(d.query_id, l.query_id) AS question_id, coalesce(d.vec_id, l.doc_id) AS key, d.r2 AS dr, l.r2 AS lr FROM dv d FULL JOIN lex l ON d.query_id = l.query_id AND d.vec_id = l.doc_id),
f AS (SELECT *, coalesce(1e0 / (60 + dr), 0e0) + coalesce(1e0 / (60 + lr), 0e0) AS raw FROM u),
k AS (SELECT question_id, key, raw, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, least(dr, lr), key)::INTEGER AS rank, len({_T.format("text")}) AS t FROM f JOIN documents ON doc_id = key),
g AS (SELECT question_id, rank, key, raw, t <= 1500 AS packed, CASE WHEN t <= 1500 THEN t ELSE 0 END AS total FROM k WHERE rank = 1 UNION ALL
SELECT k.question_id, k.rank, k.key, k.raw, g.total + t <= 1500, CASE WHEN g.total + t <= 1500 THEN g.total + t ELSE g.total END FROM g JOIN k ON k.question_id = g.question_id AND k.rank = g.rank + 1)
SELECT question_id, rank, key, floor(raw * 1e9 + 0.5e0) / 1e9 AS score, 'COMPLETE' AS state, packed, total::BIGINT AS total FROM g"""

ORACLES = {
    "evidence_query": _EVIDENCE,
    "dense_norm_check": f"WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m FROM embeddings) SELECT vec_id, {r6('m')} AS norm, abs(m - 1) <= 0.01e0 AS ok FROM n",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM den",
    "dense_topk_filtered": f"WITH {_DENSE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM sim WHERE vec_id % 10 <= 5 AND NOT (vec_id % 3 = 0 AND vec_id % 10 + 4 <= 5)) SELECT * FROM f WHERE rank <= 20",
    "dense_parity": f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x: floor(x::DOUBLE * 100 + 0.5e0) / 100e0) AS b FROM embeddings)
SELECT vec_id, {r6("list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))")} AS max_abs_diff,
{r6("list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))))")} AS cosine FROM p""",
    "rrf_fusion": _rrf("coalesce(1e0 / (60 + dr), 0e0) + coalesce(1e0 / (60 + lr), 0e0)"),
    "rrf_weighted": _rrf("coalesce(1e0 / (60 + dr), 0e0) + coalesce(2e0 / (60 + lr), 0e0)"),
    "rrf_provenance": f"WITH {_BOTH} SELECT question_id, key, concat_ws(' ', 'dense:' || dr, 'bm25:' || lr) AS provenance FROM u",
    "profile_vector": _rrf("1e0 / (60 + dr)", "dr IS NOT NULL", "dr"),
    "rank_check": f"WITH {_BOTH} SELECT query_id AS question_id, 0::BIGINT AS n_reversed, (count(*) - count(DISTINCT doc_id))::BIGINT AS n_repeated FROM lex GROUP BY 1",
    "rerank_order": f"""WITH {_DENSE}, r AS (SELECT query_id AS question_id, vec_id AS key, rank, ((vec_id * 7919) % 13)::DOUBLE AS rerank_score FROM den)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank)::INTEGER AS new_rank FROM r""",
    "rerank_batches": """WITH RECURSIVE o AS (SELECT conv_id, turn, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, 0 AS batch, 1 AS items, b AS bytes FROM o WHERE n = 1 UNION ALL
SELECT o.conv_id, o.turn, o.n, f.batch + CASE WHEN f.items >= 4 OR f.bytes + o.b > 600 THEN 1 ELSE 0 END, CASE WHEN f.items >= 4 OR f.bytes + o.b > 600 THEN 1 ELSE f.items + 1 END,
CASE WHEN f.items >= 4 OR f.bytes + o.b > 600 THEN o.b ELSE f.bytes + o.b END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id, turn, batch::INTEGER AS batch FROM f""",
    "overflow_probe": "SELECT o_orderkey, (SELECT count(*) > 50 FROM orders WHERE o_orderstatus = 'P') AS overflow FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50",
    "recall_at_k": f"WITH {_GRADE}, t AS (SELECT query_id, count(*) FILTER (grade = 3) AS k FROM g WHERE rank <= 10 GROUP BY 1) SELECT query_id, {r6('coalesce(k, 0) / n3::DOUBLE')} AS recall FROM h LEFT JOIN t USING (query_id) WHERE n3 > 0",
    "ndcg_at_k": f"""WITH {_GRADE}, a AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum((CASE WHEN p <= n3 THEN 7e0 WHEN p <= n3 + n1 THEN 1e0 ELSE 0e0 END) / log2(p + 1)) AS best FROM h, range(1, 11) t(p) GROUP BY 1)
SELECT query_id, {r6('coalesce(dcg, 0) / best')} AS ndcg FROM i LEFT JOIN a USING (query_id) WHERE best > 0""",
    "required_set_complete": f"""WITH {_DENSE}, t AS (SELECT query_id, list(vec_id) AS top FROM den GROUP BY 1)
SELECT query_id, (list_contains(top, query_id) AND (list_contains(top, query_id + 1) OR list_contains(top, query_id + 100))) AS complete FROM t""",
}
