"""The evidence query for many questions at once: branches, fusion, hydration, visibility, context packing. One plan, no loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded, terms
from ..operators import dense, evidence, fusion
from ..operators import lexical as lx
from ..operators.temporal import visible
from ..sources.shared import cut


@dataclass
class Corpus:
    """One pinned snapshot: texts (key, text, from_seq, to_seq) and vectors (key, embedding)."""

    texts: DataFrame
    vectors: DataFrame
    snapshot: int
    graph: DataFrame | None = None


@dataclass
class Request:
    """Questions (question_id, text, embedding) and how to answer them."""

    questions: DataFrame
    profile: str = "HYBRID"
    per_branch: int = 20
    budget: int = 400
    weights: dict[str, float] = field(default_factory=dict)


def branches(corpus: Corpus, request: Request) -> dict[str, DataFrame]:
    """The branches that the profile asks for; others aren't planned."""
    seen = corpus.texts.where(visible(F.col("from_seq"), F.col("to_seq"), corpus.snapshot)).select("key", "text")
    wanted, out = fusion.PROFILES[request.profile], {}
    if "dense" in wanted:
        vectors = corpus.vectors.join(seen.select("key"), "key", "left_semi")
        found = dense.cosine_top_k(vectors, request.questions, request.per_branch, "key", "embedding", "question_id")
        out["dense"] = found.select("question_id", "key", "rank")
    if "bm25" in wanted:
        found = lx.search(lx.index(seen, "key"), request.questions, request.per_branch, "question_id", distinct=True)
        out["bm25"] = found.select("question_id", "key", "rank")
    if "graph" in wanted and corpus.graph is not None:
        out["graph"] = corpus.graph
    return fusion.branches_of(request.profile, out)


def answer_context(corpus: Corpus, request: Request) -> DataFrame:
    """(question_id, rank, key, score, state, packed, total): every fused candidate, and whether it is in the packed context."""
    fused = fusion.fuse({k: fusion.checked_branch(v) for k, v in branches(corpus, request).items()}, request.weights)
    # Only texts of found keys are tokenized.
    fused = cut(fused, "fused")
    texts = corpus.texts.join(fused.select("key").distinct(), "key", "left_semi").select("key", F.size(terms("text")).alias("tokens"))
    held = evidence.hydrate(fused, corpus.texts.select("key"), texts)
    packed = evidence.pack(held.where("state = 'COMPLETE'"), "question_id", "rank", "tokens", request.budget)
    out = held.join(packed, ["question_id", "rank"], "left")
    return out.select("question_id", "rank", "key", rounded(F.col("score"), 9).alias("score"), "state", F.coalesce("packed", F.lit(False)).alias("packed"), "total")
