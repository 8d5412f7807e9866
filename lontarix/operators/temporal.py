"""Two time axes: visibility of knowledge by sequence, and legal intervals whose bounds may be unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is known of a bound.
KNOWN, UNBOUNDED, UNKNOWN, CONFLICT = "KNOWN", "UNBOUNDED", "UNKNOWN", "CONFLICT"
POLICIES = ("EXCLUDE", "REPORT", "REQUIRE_REVIEW")


def visible(from_seq: Column, to_seq: Column, seq: int | Column) -> Column:
    """[from, to) holds ``seq``; a null ``to`` is open."""
    return (from_seq <= seq) & ~F.coalesce(to_seq <= seq, F.lit(False))


def applicability(start_kind: Column, start: Column, end_kind: Column, end: Column, date: Column) -> Column:
    """OUTSIDE if a known bound excludes the date, whatever the other is; else UNRESOLVED if a bound is neither known nor unbounded; else APPLICABLE."""
    outside = ((start_kind == KNOWN) & (date < start)) | ((end_kind == KNOWN) & (date >= end))
    firm = start_kind.isin(KNOWN, UNBOUNDED) & end_kind.isin(KNOWN, UNBOUNDED)
    firm = firm & ~((start_kind == KNOWN) & start.isNull()) & ~((end_kind == KNOWN) & end.isNull())
    return F.when(F.coalesce(outside, F.lit(False)), "OUTSIDE").when(F.coalesce(firm, F.lit(False)), "APPLICABLE").otherwise("UNRESOLVED")


def select_as_of(versions: DataFrame, date: Column, policy: str, by: tuple[str, ...] = ("provision",), key: str = "version_id") -> DataFrame:
    """One row a provision: ``decision`` and the ids (joined, in order) that are selected, unresolved, to review, excluded.

    ``versions``: start_kind, start_date, end_kind, end_date, legal_status, review_state. Rejected and quarantined versions are
    excluded first. More than one applicable version or a declared conflict is a CONFLICT; then versions to review come
    first; then the policy says what unresolved versions mean.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    out = F.col("review_state").isin("REJECTED", "QUARANTINED")
    how = applicability(F.col("start_kind"), F.col("start_date"), F.col("end_kind"), F.col("end_date"), date)
    rows = versions.withColumn("how", F.when(out, "EXCLUDED").otherwise(how))
    exact = F.col("how") == "APPLICABLE"
    review = exact & ((F.col("review_state") == "UNREVIEWED") | (F.col("legal_status") == "UNKNOWN"))

    def ids(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.col(key)))), lambda x: x.cast("string")), ",")

    agg = rows.groupBy(*by).agg(
        F.count_if(exact).alias("n_exact"),
        F.count_if(F.col("how") == "UNRESOLVED").alias("n_unresolved"),
        F.count_if(review).alias("n_review"),
        F.coalesce(F.bool_or(exact & (F.col("legal_status") == "CONFLICT")), F.lit(False)).alias("declared"),
        ids(exact).alias("selected"),
        ids(F.col("how") == "UNRESOLVED").alias("unresolved"),
        ids(review).alias("to_review"),
        ids(F.col("how") == "EXCLUDED").alias("excluded"),
    )
    resolved = F.when(F.col("n_exact") == 0, "NOT_EFFECTIVE").otherwise("RESOLVED")
    open_ = F.col("n_unresolved") > 0
    by_policy = {"EXCLUDE": resolved, "REPORT": F.when(open_, "UNRESOLVED").otherwise(resolved), "REQUIRE_REVIEW": F.when(open_, "REQUIRES_REVIEW").otherwise(resolved)}
    decision = F.when((F.col("n_exact") > 1) | F.col("declared"), "CONFLICT").when(F.col("n_review") > 0, "REQUIRES_REVIEW").otherwise(by_policy[policy])
    return agg.select(*by, decision.alias("decision"), "selected", "unresolved", "to_review", "excluded")


def timeline_key() -> list[Column]:
    """Order of a timeline: unbounded starts, then known ones by date, then the rest; ties by id."""
    rank = F.when(F.col("start_kind") == UNBOUNDED, 0).when((F.col("start_kind") == KNOWN) & F.col("start_date").isNotNull(), 1).otherwise(2)
    return [rank, F.when(rank == 1, F.col("start_date")), F.col("version_id")]


def undeclared_overlaps(versions: DataFrame, by: str = "provision", key: str = "version_id") -> DataFrame:
    """Approved versions, not declared as conflicts, that start before an earlier one of the provision has ended.

    One sorted sweep a provision with the running latest end, no pairs. An open end counts as the last date.
    """
    ok = versions.where((F.col("review_state") == "APPROVED") & (F.col("legal_status") != "CONFLICT") & F.col("start_kind").isin(KNOWN, UNBOUNDED) & F.col("end_kind").isin(KNOWN, UNBOUNDED))
    start = F.when(F.col("start_kind") == UNBOUNDED, F.to_date(F.lit("0001-01-01"))).otherwise(F.col("start_date"))
    end = F.when(F.col("end_kind") == UNBOUNDED, F.to_date(F.lit("9999-12-31"))).otherwise(F.col("end_date"))
    rows = ok.withColumn("s", start).withColumn("e", end)
    before = F.expr(f"max(e) OVER (PARTITION BY {by} ORDER BY s, e, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return rows.withColumn("latest_end", before).where("s < latest_end").select(by, key, F.col("s").alias("start_date"), "latest_end")


def boundary_agreement(op: Column, effective: Column, start: Column, end: Column) -> Column:
    """Whether a change event's date is the bound it must set: INSERT the start, REPEAL the end, AMEND and RENUMBER either."""
    at_start, at_end = F.coalesce(effective == start, F.lit(False)), F.coalesce(effective == end, F.lit(False))
    return F.when(op == "INSERT", at_start).when(op == "REPEAL", at_end).when(op.isin("AMEND", "RENUMBER"), at_start | at_end).otherwise(F.lit(False))


def evidence_filter(records: DataFrame, date: Column, policy: str, by: str) -> DataFrame:
    """Verdict on records whose text carries several version filters.

    ERROR_MIXED if some filters hold and others don't, ERROR_REVIEW where the policy asks for review, NONE if no filter holds,
    else INCLUDED with ``uncertain``.
    """
    known = (F.col("start_kind") == KNOWN, F.col("end_kind") == KNOWN)
    how = applicability(F.col("start_kind"), F.col("start_date"), F.col("end_kind"), F.col("end_date"), date)
    status = F.col("legal_status")
    doubtful = (how == "UNRESOLVED") | status.isin("UNKNOWN", "CONFLICT") | ((status == "REPEALED") & ~known[1]) | ((status == "NOT_YET_EFFECTIVE") & ~known[0])
    rows = records.withColumn("outside", how == "OUTSIDE").withColumn("doubtful", ~F.col("outside") & doubtful)
    drop = F.col("outside") | (F.col("doubtful") if policy == "EXCLUDE" else F.lit(False))
    agg = rows.groupBy(by).agg(F.count_if(~drop).alias("included"), F.count_if(drop).alias("excluded"), F.count_if("doubtful").alias("n_doubtful"), (F.count_distinct("legal_status") > 1).alias("mixed"))
    review = (F.col("n_doubtful") > 0) if policy == "REQUIRE_REVIEW" else F.lit(False)
    verdict = F.when(review, "ERROR_REVIEW").when((F.col("included") > 0) & (F.col("excluded") > 0), "ERROR_MIXED").when(F.col("included") == 0, "NONE")
    verdict = verdict.when(F.col("mixed"), {"EXCLUDE": F.lit("NONE"), "REQUIRE_REVIEW": F.lit("ERROR_REVIEW"), "REPORT": F.lit("INCLUDED")}[policy]).otherwise("INCLUDED")
    uncertain = ((F.col("n_doubtful") > 0) | F.col("mixed")) if policy == "REPORT" else F.lit(False)
    return agg.select(by, verdict.alias("verdict"), ((verdict == "INCLUDED") & uncertain).alias("uncertain"))


def local_date(ts: Column, zone: str) -> Column:
    """The calendar date of a UTC time in an IANA zone."""
    if zone.lower() == "local":
        raise ValueError("an explicit zone is needed")
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str], grain: str = "month") -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key whose ``right_at`` is not after ``at``.

    In two levels, so a key with very many rows is spread: rows meet in windows of (key, time bucket), and what a bucket
    inherits comes from a window over one summary row a bucket. Right rows of one key and time: the largest values win.
    """
    got = F.struct(F.col(right_at).alias("__t"), *values)
    r = right.select(key, F.col(right_at).alias("__at"), got.alias("__v"), F.lit(0).alias("__side"))
    cols = [c for c in left.columns if c != key]
    both = left.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row")).unionByName(r, allowMissingColumns=True)
    both = both.withColumn("__b", F.date_trunc(grain, "__at"))
    inner = f"max(__v) OVER (PARTITION BY {key}, __b ORDER BY __at, __side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    seen = both.withColumn("__own", F.expr(inner)).where("__side = 1")
    buckets = both.groupBy(key, "__b").agg(F.max("__v").alias("__last"))
    carry = f"max(__last) OVER (PARTITION BY {key} ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    buckets = buckets.select(key, "__b", F.expr(carry).alias("__before"))
    out = seen.join(buckets, [key, "__b"]).withColumn("__got", F.coalesce("__own", "__before"))
    return out.select(key, *(F.col(f"__row.{c}").alias(c) for c in cols), *(F.col(f"__got.{v}").alias(v) for v in values))


def resolve_scope(mode: Column, effective: Column, compare: Column, instant: Column, zone: str | None) -> Column:
    """The dates that a question is asked for, as an array; an error for a scope that can't be resolved.

    AS_OF keeps its date. CURRENT is the calendar date of ``instant`` in the configured zone and takes no dates of the caller's.
    COMPARE gives 2 to 8 distinct dates in their order: discovery runs once, ``applicability`` at each.
    """
    n = F.coalesce(F.greatest(F.size(compare), F.lit(0)), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("temporal scope "), F.coalesce(mode, F.lit("missing")))).cast("array<date>")
    now = F.when(effective.isNull() & (n == 0) & instant.isNotNull(), F.array(local_date(instant, zone))).otherwise(bad) if zone else bad
    many = F.when(effective.isNull() & n.between(2, 8) & (F.size(F.array_distinct(compare)) == n) & ~F.exists(compare, lambda x: x.isNull()), compare).otherwise(bad)
    return F.when(mode == "AS_OF", F.when(effective.isNotNull() & (n == 0), F.array(effective)).otherwise(bad)).when(mode == "CURRENT", now).when(mode == "COMPARE", many).otherwise(bad)
