"""What an answer and the paths behind it must hold: tiling, support, citations, omissions, status; references that close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import tiling

#: Texts of answers that claim nothing.
TEMPLATES = {
    "ABSTAIN": "Bukti yang tersedia belum cukup untuk menjawab pertanyaan ini.",
    "NEEDS_CLARIFICATION": "Pertanyaan ini memerlukan informasi tambahan sebelum dapat dijawab.",
}
#: Statuses whose text must be covered by claims.
ANSWERED = ("COMPLETE", "PARTIAL", "CONFLICT")


def _flag(rows: DataFrame, issue: str) -> DataFrame:
    return rows.select("answer_id", F.lit(issue).alias("issue"))


def issues(answers: DataFrame, claims: DataFrame, citations: DataFrame, selected: DataFrame, omitted: DataFrame) -> DataFrame:
    """(answer_id, issue): each rule that an answer breaks, once. No row for an answer without fault.

    ``answers``: answer_id, status, text, context_complete, missing (array), n_conflicts, n_paths. ``claims``: answer_id, claim_id,
    support, start, stop (characters), evidence (array). ``citations``: answer_id, evidence_id, claim_ids. ``selected``: the evidence
    (answer_id, evidence_id) in the rendered context. ``omitted``: (answer_id, ref) that it had to leave out.
    """
    claims = claims.withColumn("supported", F.coalesce(F.col("support") == "SUPPORTED", F.lit(False)))
    cited = citations.select("answer_id", F.explode("claim_ids").alias("claim_id")).distinct()
    used = claims.select("answer_id", F.explode("evidence").alias("evidence_id"))
    empty_span = F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") >= F.col("stop"))
    spans = claims.where(~empty_span).select("answer_id", "start", "stop")
    covered = tiling(spans, answers.select("answer_id", "text"), "answer_id")
    per = claims.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("supported")).alias("n_open"), F.max("stop").alias("last"), F.count_if(empty_span).alias("n_empty"))
    a = answers.join(per, "answer_id", "left").join(covered, "answer_id", "left")
    a = a.join(citations.groupBy("answer_id").agg(F.count("*").alias("n_citations")), "answer_id", "left").join(omitted.groupBy("answer_id").agg(F.count("*").alias("n_omitted")), "answer_id", "left")
    a = a.fillna(0, ["n_claims", "n_open", "last", "n_empty", "n_overlaps", "n_gaps", "n_citations", "n_omitted", "n_conflicts", "n_paths"]).withColumn("text", F.coalesce("text", F.lit("")))
    unclaimed = F.when(F.col("n_claims") == F.col("n_empty"), F.col("text").rlike(r"\S")).otherwise(F.col("n_overlaps") + F.col("n_gaps") > 0)
    broken = F.col("status").isin(*ANSWERED) & (unclaimed | (F.col("n_empty") > 0) | (F.col("last") > F.length("text")))
    n_missing = F.greatest(F.coalesce(F.size("missing"), F.lit(0)), F.lit(0))
    open_ = ~F.coalesce("context_complete", F.lit(False)) | (F.col("n_omitted") > 0) | (n_missing > 0) | (F.col("n_conflicts") > 0) | (F.col("n_claims") == 0) | (F.col("n_open") > 0)
    facts = (F.col("n_claims") > 0) | (F.col("n_citations") > 0) | (F.col("n_conflicts") > 0) | (F.col("n_paths") > 0)
    other = F.lit(False)
    for status, text in TEMPLATES.items():
        other = other | ((F.col("status") == status) & (F.col("text") != text))
    rules = {"TILING": broken, "INCOMPLETE": (F.col("status") == "COMPLETE") & open_, "FACTS": F.col("status").isin(*TEMPLATES) & facts, "TEMPLATE": other, "NO_CONFLICT": (F.col("status") == "CONFLICT") & (F.col("n_conflicts") == 0)}
    found = a.select("answer_id", F.explode(F.filter(F.array(*(F.when(c, n) for n, c in rules.items())), lambda x: x.isNotNull())).alias("issue"))
    supported = claims.where("supported")
    hidden = omitted.join(answers.select("answer_id", "missing"), "answer_id").where(~F.coalesce(F.array_contains("missing", F.col("ref")), F.lit(False)))
    for rows, issue in (
        (supported.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "NO_EVIDENCE"),
        (supported.where(empty_span), "NO_SPAN"),
        (supported.join(cited, ["answer_id", "claim_id"], "left_anti"), "NO_CITATION"),
        (used.join(selected, ["answer_id", "evidence_id"], "left_anti"), "FOREIGN_EVIDENCE"),
        (citations.join(selected, ["answer_id", "evidence_id"], "left_anti"), "FOREIGN_CITATION"),
        (hidden, "HIDDEN_OMISSION"),
    ):
        found = found.unionByName(_flag(rows, issue))
    return found.distinct()


def path_coverage(paths: DataFrame, assertions: DataFrame, supports: DataFrame, items: DataFrame, date: Column) -> DataFrame:
    """(path_id, coverage, n_items, n_missing): COMPLETE, or PARTIAL where any member leaves something open.

    ``paths``: path_id, assertions, supports (arrays). ``assertions``: assertion_id, n_exceptions, qualified, inferred, effective.
    ``supports``: support_id, complete (its span is covered). ``items``: assertion_id, evidence_id, legal_status. An assertion
    leaves open: exceptions, a qualifier that names an entity, being inferred, another date; a support: an uncovered span; an
    item: an unknown or disputed status. An unknown member counts as open. A path without items is PARTIAL.
    """
    states = assertions.select("assertion_id", ((F.col("n_exceptions") > 0) | F.col("qualified") | F.col("inferred") | ~F.coalesce(F.col("effective") == date, F.lit(False))).alias("open"))
    doubtful = items.groupBy("assertion_id").agg(F.bool_or(F.col("legal_status").isin("UNKNOWN", "CONFLICT")).alias("doubtful"), F.collect_set("evidence_id").alias("ids"))
    a = paths.select("path_id", F.explode("assertions").alias("assertion_id")).join(states, "assertion_id", "left").join(doubtful, "assertion_id", "left")
    a = a.groupBy("path_id").agg(F.count_if(F.coalesce("open", F.lit(True))).alias("n_open"), F.coalesce(F.bool_or("doubtful"), F.lit(False)).alias("doubtful"), F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("long").alias("n_items"))
    s = paths.select("path_id", F.explode("supports").alias("support_id")).join(supports.select("support_id", "complete"), "support_id", "left")
    s = s.groupBy("path_id").agg(F.count_if(~F.coalesce("complete", F.lit(False))).alias("n_uncovered"))
    j = paths.select("path_id").join(a, "path_id", "left").join(s, "path_id", "left").fillna(0, ["n_open", "n_items", "n_uncovered"]).fillna(False, ["doubtful"])
    whole = (F.col("n_open") == 0) & (F.col("n_uncovered") == 0) & ~F.col("doubtful") & (F.col("n_items") > 0)
    return j.select("path_id", F.when(whole, "COMPLETE").otherwise("PARTIAL").alias("coverage"), "n_items", (F.col("n_open") + F.col("n_uncovered")).alias("n_missing"))


def reference_issues(spans: DataFrame, texts: DataFrame, key: str = "span_id", ref: str = "doc_id") -> DataFrame:
    """(key, issue) of spans (key, ref, start, stop in bytes): ORPHAN without its text, SPAN beyond it or empty, DUPLICATE id.

    Only the texts' lengths are joined.
    """
    sizes = texts.select(ref, F.octet_length("text").alias("__size"))
    j = spans.join(sizes.withColumn("__there", F.lit(True)), ref, "left")
    fine = (F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.coalesce("__size", F.lit(0)))
    issue = F.when(F.col("__there").isNull(), "ORPHAN").when(~F.coalesce(fine, F.lit(False)), "SPAN")
    one = j.select(key, issue.alias("issue")).where("issue IS NOT NULL").distinct()
    twice = spans.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("DUPLICATE").alias("issue"))
    return one.unionByName(twice)
