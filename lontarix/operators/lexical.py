"""Inverted index and BM25: postings, statistics, dictionary, weights, scores, incremental changes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyzed_composed, checked_term, checked_terms, composed
from ..sources.shared import cut

#: BM25 defaults, and the words the preview search leaves out of a question.
K1, B = 1.2, 0.75
PREVIEW_STOPWORDS = (
    "apa apakah siapa bagaimana mengapa kapan dimana di mana yang dan atau untuk pada dalam adalah itu ini saya bisa tolong "
    "jelaskan sebutkan menurut tentang the a an is are what how of to in"
).split()


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf). Texts are shuffled by id, no posting is; see ``measured_postings``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(id_col, composed(text_col).alias("text")).repartition(parts, id_col).select(id_col, F.explode_outer(analyzed_composed("text")).alias("term"))
    return found.where("term IS NOT NULL").select(id_col, checked_term("term").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len): number of terms, 0 for documents without any. No shuffle."""
    return docs.select(F.col(id_col), F.coalesce(F.size(checked_terms(composed(text_col))), F.lit(0)).cast("long").alias("len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents (those without terms too), terms, documents without terms."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_tokens"), F.count_if(F.col("len") == 0).alias("zero_docs"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def document_weights(post: DataFrame, lengths: DataFrame, stats: DataFrame, id_col: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(id, term, weight); ``stats`` is one row."""
    avg = F.col("total_tokens") / F.col("n")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / avg)
    joined = post.join(lengths.hint("shuffle_hash"), id_col).crossJoin(F.broadcast(stats))
    return joined.select(id_col, "term", (F.col("tf") * (k1 + 1) / norm).alias("weight"))


def query_weights(queries: DataFrame, df: DataFrame, stats: DataFrame, dictionary: DataFrame | None = None, id_col: str = "item_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(id, term, weight): query frequency times idf. With a ``dictionary`` of terms, others are dropped and df may be 0.

    ``distinct`` counts a repeated query term once.
    """
    return query_weights_of(postings(queries, id_col, text_col), df, stats, id_col, distinct, dictionary)


def query_weights_of(own: DataFrame, df: DataFrame, stats: DataFrame, id_col: str, distinct: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """``query_weights`` of the queries' postings."""
    known = dictionary.select("term") if dictionary is not None else df.select("term")
    own = own.join(known, "term").join(df, "term", "left").crossJoin(F.broadcast(stats))
    qtf = F.lit(1) if distinct else F.col("tf")
    return own.select(id_col, "term", (qtf * idf(F.coalesce("df", F.lit(0)), F.col("n"))).alias("weight"))


def out_of_vocabulary(queries: DataFrame, dictionary: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, n_terms, n_oov): distinct terms of each query, and those missing from the dictionary."""
    own = postings(queries, id_col, text_col).join(dictionary.select("term", F.lit(1).alias("hit")), "term", "left")
    return own.groupBy(id_col).agg(F.count("*").alias("n_terms"), F.count_if(F.col("hit").isNull()).alias("n_oov"))


def sparse_scores(query: DataFrame, docs: DataFrame, query_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Dot products of sparse (id, term, weight) rows: only postings of the queries' terms are touched."""
    left = query.select(query_id, "term", F.col("weight").alias("qw"))
    return left.join(docs, "term").groupBy(query_id, doc_id).agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


@dataclass
class Index:
    """A tokenized corpus: ``post`` (id, len, term, tf) as a written table, and the numbers of documents and terms in one row."""

    post: DataFrame
    stats: DataFrame
    id_col: str


def measured_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len, term, tf): postings with their document's number of terms. Texts are shuffled by id, no posting is. Ids must be unique.

    Texts are composed before the shuffle, since what Python returns has no known partitions. The outer explode plans no filter of
    its own on the terms, which would find them once more.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(id_col, composed(text_col).alias("text")).repartition(parts, id_col).select(id_col, analyzed_composed("text").alias("terms"))
    found = found.select(id_col, F.size("terms").cast("long").alias("len"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    return found.select(id_col, "len", checked_term("term").alias("term")).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Texts are tokenized once: statistics come from the written postings. Ids must be unique."""
    post = cut(measured_postings(docs, id_col, text_col), "postings")
    stats = docs.agg(F.count("*").alias("n")).crossJoin(post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total_tokens")))
    return Index(post, cut(stats, "corpus-stats"), id_col)


#: Documents of a block, queries scored at once, and terms of a block whose products are made by matrices.
DOC_BLOCK, QUERY_BLOCK, DENSE_TERMS = 16_384, 512, 256


def best_of_block(docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], counts: list[np.ndarray], k: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document id, score) of the k best documents of a block for each query, both given by their terms; rows without a shared term are none.

    ``docs``, ``terms`` and ``weights`` are the block's postings. Terms of most documents go by a matrix product, those of some by
    the rows and columns that have them, and the rest pair by pair.
    """
    ids, row = np.unique(docs, return_inverse=True)
    order = np.argsort(terms, kind="stable")
    row, weight = row[order], weights[order]
    known, start, size = np.unique(terms[order], return_index=True, return_counts=True)
    dense = np.argsort(-size, kind="stable")[:DENSE_TERMS]
    column = np.full(len(known), -1)
    column[dense] = np.arange(len(dense))
    matrix = np.zeros((len(dense), len(ids)))
    for i, t in enumerate(dense):
        matrix[i, row[start[t] : start[t] + size[t]]] = weight[start[t] : start[t] + size[t]]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), QUERY_BLOCK):
        asked, times = queries[a : a + QUERY_BLOCK], counts[a : a + QUERY_BLOCK]
        q, t, n = np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked), np.concatenate(times).astype(np.float64)
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        hit = known[at] == t
        q, at, n = q[hit], at[hit], n[hit]
        wanted = np.zeros((len(asked), len(dense)))
        often = column[at] >= 0
        wanted[q[often], column[at[often]]] = n[often]
        score = wanted @ matrix
        q, at, n = q[~often], at[~often], n[~often]
        by = np.argsort(at, kind="stable")
        q, at, n = q[by], at[by], n[by]
        some = size[at] >= 32
        rows, factors, columns = q[some], n[some], at[some]
        for lo, hi in _runs(columns):
            span = slice(start[columns[lo]], start[columns[lo]] + size[columns[lo]])
            score[rows[lo:hi, None], row[span]] += factors[lo:hi, None] * weight[span]
        q, at, n = q[~some], at[~some], n[~some]
        for lo in range(0, len(q), 65_536):
            part = slice(lo, lo + 65_536)
            long = size[at[part]]
            place = np.repeat(start[at[part]] - np.cumsum(long) + long, long) + np.arange(long.sum())
            np.add.at(score.reshape(-1), np.repeat(q[part], long) * len(ids) + row[place], np.repeat(n[part], long) * weight[place])
        for i, s in enumerate(score):
            shown = np.floor(s * 10**digits + 0.5) / 10**digits
            kth = np.partition(shown, -k)[-k] if len(s) > k else -np.inf
            best = np.flatnonzero((shown >= kth) & (s > 0))
            best = best[np.lexsort((ids[best], -shown[best]))[:k]]
            out.append((np.full(len(best), a + i), ids[best], shown[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def search(corpus: Index, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", distinct: bool = False, without: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """(query id, id, score, rank): each query's k documents of highest BM25 score, rounded to 6 digits; ties to the smaller id.

    Only documents that share a term with the query are found, and with ``among`` only those whose id it has. ``without``: terms left out
    of the queries; ``distinct`` counts a repeated query term once. Blocks of documents meet all queries in bounded tasks that keep their k
    best, so no score of a pair is shuffled, only postings of the queries' terms. Ids are whole numbers.
    """
    ident = corpus.id_col
    asked = cut(postings(queries, id_col, text_col).where(~F.col("term").isin(list(without))), "query-terms")
    df = corpus.post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # Numbers are written with the terms: both sides below must go by the same one.
    terms = cut(df.select("term", "df", F.monotonically_increasing_id().alias("t")), "query-dictionary")
    avg = F.col("total_tokens") / F.col("n")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg)) * idf(F.col("df"), F.col("n"))
    hits = corpus.post.join(terms, "term").crossJoin(F.broadcast(corpus.stats)).where(F.col(ident).isNotNull())
    if among is not None:
        hits = hits.join(among.select(ident).distinct(), ident, "left_semi")
    groups = max(1, -(-corpus.stats.first()["n"] // DOC_BLOCK))
    left = hits.select(F.pmod(F.xxhash64(ident), F.lit(groups)).cast("int").alias("g"), F.col(ident).cast("long").alias("id"), "t", weight.alias("w"))
    own = asked.join(terms, "term").groupBy(id_col).agg(F.collect_list("t").alias("ts"), F.collect_list((F.lit(1) if distinct else F.col("tf")).cast("int")).alias("ns"))
    own = cut(own.select("*", F.monotonically_increasing_id().alias("q")), "query-vectors")
    right = own.select("q", "ts", "ns", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64", "score": "float64"})
        q, found, score = best_of_block(left["id"].to_numpy(), left["t"].to_numpy(), left["w"].to_numpy(), list(right["ts"]), list(right["ns"]), k)
        return pd.DataFrame({"q": right["q"].to_numpy()[q], "id": found, "score": score})

    near = left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(best, "q long, id long, score double")
    ranked = top_k(near, k, "q", [F.desc("score"), F.asc("id")])
    return ranked.join(own.select("q", id_col), "q").select(id_col, F.col("id").alias(ident), "score", "rank")


def top_k(scores: DataFrame, k: int, part: str, order: list[Column]) -> DataFrame:
    """``rank`` from 1 and the k first rows of each ``part``; cut within tasks before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def allocate(dictionary: DataFrame, found: DataFrame, revision: int) -> DataFrame:
    """``dictionary`` (term, term_id, from_revision) with new terms of ``found`` appended in term order.

    Ids never change and are never used twice. Ids come from ranges: terms are numbered within range partitions and offset by
    the counts of the partitions before, so no task sees all terms.
    """
    last = dictionary.agg(F.coalesce(F.max("term_id"), F.lit(0)).alias("last"))
    fresh = found.select("term").distinct().join(dictionary.select("term"), "term", "left_anti")
    parts = fresh.repartitionByRange("term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id())
    # The number within a sorted partition is the low part of the increasing id.
    parts = parts.withColumn("nth", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33) + 1)
    parts = cut(parts, "terms")  # partitions must be numbered alike where they are counted and where they are used
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    ids = parts.join(offsets, "part").crossJoin(F.broadcast(last)).select("term", (F.col("last") + F.col("before") + F.col("nth")).alias("term_id"), F.lit(revision).cast("long").alias("from_revision"))
    return dictionary.select("term", "term_id", "from_revision").unionByName(ids)


def changed_frequency(df: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Document frequencies after taking ``removed`` postings away and adding ``added``; terms without documents leave."""
    minus = document_frequency(removed).withColumn("df", -F.col("df"))
    return df.unionByName(minus).unionByName(document_frequency(added)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def fingerprint(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 of an ordered population: of the sorted digests of its (key, digest) rows, by way of a tree of partial digests.

    Digests of rows are digested together by their first six hex digits, those by the first three, and these once more: at most
    4,096 a list on the upper levels, and a 2^24th of the rows on the lowest, so no task holds the whole population.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(value).cast("string")), 256)

    def level(df: DataFrame, width: int, n: Column) -> DataFrame:
        parts = df.groupBy(F.substring("d", 1, width).alias("p")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d"), n.alias("n"))
        return parts.select(F.concat("p", "d").alias("d"), "n")

    low = level(rows.select(digest.alias("d")), 6, F.count("*"))
    high = level(low, 3, F.sum("n"))
    return high.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("fingerprint"), F.sum("n").alias("members"))
