"""Lexical family: analyzer, statistics, dictionary, BM25 and preview search over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_space, rounded, surface, units
from ..operators import lexical as lx
from ..session import table


def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(s, d, "documents").select("doc_id", "text")
    lengths = lx.document_lengths(docs)
    post = lx.postings(docs)
    return post, lengths, lx.document_frequency(post), lx.corpus_stats(lengths)


def lex_tf(s, d):
    return lx.postings(table(s, d, "documents"))


def lex_lengths(s, d):
    return lx.document_lengths(table(s, d, "documents"))


def lex_df(s, d):
    return _index(s, d)[2]


def lex_corpus_stats(s, d):
    return _index(s, d)[3]


def lex_idf(s, d):
    _, _, df, stats = _index(s, d)
    return df.crossJoin(F.broadcast(stats)).select("term", rounded(lx.idf(F.col("df"), F.col("n"))).alias("idf"))


def lex_doc_weight(s, d):
    post, lengths, _, stats = _index(s, d)
    return lx.document_weights(post, lengths, stats).select("doc_id", "term", rounded(F.col("weight")).alias("weight"))


def lex_query_weight(s, d):
    _, _, df, stats = _index(s, d)
    return lx.query_weights(table(s, d, "benchmark"), df, stats).select("item_id", "term", rounded(F.col("weight")).alias("weight"))


def lex_oov(s, d):
    return lx.out_of_vocabulary(table(s, d, "conversations").select("conv_id", "text"), _index(s, d)[2], "conv_id")


def bm25_topk(s, d):
    return lx.search(lx.index(table(s, d, "documents").select("doc_id", "text")), table(s, d, "benchmark"), 10)


def preview_search_topk(s, d):
    """Distinct query terms without stop words; one hit a distinct text, whose documents all score alike: that of the smallest id; 12 at most."""
    docs = table(s, d, "documents").select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"))
    return lx.search(lx.index(docs), table(s, d, "benchmark"), 12, distinct=True, without=tuple(lx.PREVIEW_STOPWORDS), among=first)


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    first = lx.postings(table(s, d, "documents").where("lang = 'en'"))
    return lx.allocate(s.createDataFrame([], "term string, term_id long, from_revision long"), first, 1)


def dictionary_allocate(s, d):
    return _dictionary(s, d)


def dictionary_incremental(s, d):
    return lx.allocate(_dictionary(s, d), lx.postings(table(s, d, "documents")), 2)


def stats_remove_upsert(s, d):
    """English documents leave, benchmark passages come."""
    post, _, df, _ = _index(s, d)
    gone = lx.postings(table(s, d, "documents").where("lang = 'en'"))
    return lx.changed_frequency(df, gone, lx.postings(table(s, d, "benchmark"), "item_id"))


def population_fingerprint(s, d):
    return lx.fingerprint(table(s, d, "documents"), "doc_id", "text")


def unit_tokens(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(units("text")).alias("unit", "token"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_units"), F.sum(F.octet_length("token")).alias("unit_bytes"), F.max("token").alias("last_token"))


def surface_norm(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2(surface("text"), 256).alias("surface_sha256"))


def question_normalize(s, d):
    return table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", collapse_space("text").alias("search"))


QUERIES = {f.__name__: f for f in (lex_tf, lex_lengths, lex_df, lex_corpus_stats, lex_idf, lex_doc_weight, lex_query_weight, lex_oov, bm25_topk, preview_search_topk, dictionary_allocate, dictionary_incremental, stats_remove_upsert, population_fingerprint, unit_tokens, surface_norm, question_normalize)}

_T = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:\p{{L}}+(?:-\p{{L}}+)*|[0-9]+(?:/[0-9]+)*)+', 0)"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


#: The index of documents: post(doc_id, term, tf), len(doc_id, len), df(term, df), st(n, total_tokens, zero_docs).
INDEX = f"""
tok AS (SELECT doc_id, unnest({_T.format("text")}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, coalesce(len({_T.format("text")}), 0)::BIGINT AS len FROM documents),
df AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY 1),
st AS (SELECT count(*)::BIGINT AS n, sum(len)::BIGINT AS total_tokens, count(*) FILTER (len = 0)::BIGINT AS zero_docs FROM len),
qpost AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM (SELECT item_id, unnest({_T.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
dw AS (SELECT p.doc_id, p.term, p.tf * 2.2e0 / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.len / (st.total_tokens / st.n))) AS weight FROM post p JOIN len l USING (doc_id), st),
qw AS (SELECT item_id, term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf, qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS weight FROM qpost JOIN df USING (term), st)"""
_STOP = ", ".join(f"'{w}'" for w in lx.PREVIEW_STOPWORDS)
_ALLOC = f"""
t1 AS (SELECT DISTINCT unnest({_T.format("text")}) AS term FROM documents WHERE lang = 'en'),
t2 AS (SELECT DISTINCT unnest({_T.format("text")}) AS term FROM documents),
d1 AS (SELECT term, row_number() OVER (ORDER BY term)::BIGINT AS term_id, 1::BIGINT AS from_revision FROM t1),
d2 AS (SELECT term, (SELECT count(*) FROM d1) + row_number() OVER (ORDER BY term) AS term_id, 2::BIGINT AS from_revision FROM t2 ANTI JOIN d1 USING (term))"""

ORACLES = {
    "lex_tf": f"WITH {INDEX} SELECT * FROM post",
    "lex_lengths": f"WITH {INDEX} SELECT * FROM len",
    "lex_df": f"WITH {INDEX} SELECT * FROM df",
    "lex_corpus_stats": f"WITH {INDEX} SELECT * FROM st",
    "lex_idf": f"WITH {INDEX} SELECT term, {r6('ln(1 + (n - df + 0.5e0) / (df + 0.5e0))')} AS idf FROM df, st",
    "lex_doc_weight": f"WITH {INDEX} SELECT doc_id, term, {r6('weight')} AS weight FROM dw",
    "lex_query_weight": f"WITH {INDEX} SELECT item_id, term, {r6('weight')} AS weight FROM qw",
    "lex_oov": f"""WITH {INDEX}, c AS (SELECT DISTINCT conv_id, unnest({_T.format("text")}) AS term FROM conversations)
SELECT conv_id, count(*)::BIGINT AS n_terms, count(*) FILTER (df.term IS NULL)::BIGINT AS n_oov FROM c LEFT JOIN df USING (term) GROUP BY 1""",
    "bm25_topk": f"""WITH {INDEX}, s AS (SELECT item_id, doc_id, {r6('sum(qw.weight * dw.weight)')} AS score FROM qw JOIN dw USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "preview_search_topk": f"""WITH {INDEX}, s AS (SELECT item_id, doc_id, {r6('sum(idf * dw.weight)')} AS score FROM qw JOIN dw USING (term) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
o AS (SELECT s.*, row_number() OVER (PARTITION BY item_id, sha256(text) ORDER BY score DESC, doc_id) AS nth FROM s JOIN documents USING (doc_id)),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM o WHERE nth = 1) SELECT * FROM r WHERE rank <= 12""",
    "dictionary_allocate": f"WITH {_ALLOC} SELECT * FROM d1",
    "dictionary_incremental": f"WITH {_ALLOC} SELECT * FROM d1 UNION ALL SELECT term, term_id::BIGINT, from_revision FROM d2",
    "stats_remove_upsert": f"""WITH {INDEX}, g AS (SELECT term, count(DISTINCT doc_id) AS k FROM (SELECT doc_id, unnest({_T.format("text")}) AS term FROM documents WHERE lang = 'en') GROUP BY 1),
a AS (SELECT term, count(DISTINCT item_id) AS k FROM qpost GROUP BY 1)
SELECT term, (coalesce(df, 0) - coalesce(g.k, 0) + coalesce(a.k, 0))::BIGINT AS df FROM df FULL JOIN g USING (term) FULL JOIN a USING (term)
WHERE coalesce(df, 0) - coalesce(g.k, 0) + coalesce(a.k, 0) > 0""",
    "population_fingerprint": """WITH d AS (SELECT sha256(doc_id::VARCHAR || chr(31) || text) AS d FROM documents),
p AS (SELECT d[1:6] || sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY d[1:6]),
q AS (SELECT d[1:3] || sha256(string_agg(d, '' ORDER BY d)) AS d, sum(n) AS n FROM p GROUP BY d[1:3])
SELECT sha256(string_agg(d, '' ORDER BY d)) AS fingerprint, sum(n)::BIGINT AS members FROM q""",
    "unit_tokens": r"""WITH u AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')) AS token FROM conversations)
SELECT conv_id, turn, count(*)::BIGINT AS n_units, sum(strlen(token))::BIGINT AS unit_bytes, max(token) AS last_token FROM u GROUP BY 1, 2""",
    "surface_norm": r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS surface_sha256 FROM conversations",
    "question_normalize": r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS search FROM conversations WHERE role = 'user'",
}
