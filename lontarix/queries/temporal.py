"""Temporal family: orders stand for versions of a customer's provision, priorities and statuses for what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry, temporal
from ..session import table

AS_OF = "1998-07-01"


def _day() -> F.Column:
    return F.to_date(F.lit(AS_OF))


def versions(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("provision"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("start_date"), "o_orderstatus", "o_orderpriority")
    o = o.withColumn("end_date", F.expr("lead(start_date) OVER (PARTITION BY provision ORDER BY start_date, version_id)"))
    o = o.withColumn("start_kind", F.when(F.col("version_id") % 5 == 0, "UNKNOWN").when(F.col("version_id") % 13 == 0, "UNBOUNDED").otherwise("KNOWN"))
    o = o.withColumn("end_kind", F.when(F.col("end_date").isNull(), "UNBOUNDED").when(F.col("version_id") % 7 == 0, "CONFLICT").otherwise("KNOWN"))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "REPEALED").when(F.col("o_orderpriority") == "2-HIGH", "NOT_YET_EFFECTIVE")
    o = o.withColumn("legal_status", status.when(F.col("version_id") % 17 == 0, "UNKNOWN").when(F.col("version_id") % 19 == 0, "CONFLICT").otherwise("IN_FORCE"))
    review = F.when(F.col("version_id") % 11 == 0, "REJECTED").when(F.col("version_id") % 6 == 0, "UNREVIEWED").otherwise("APPROVED")
    return o.withColumn("review_state", review).drop("o_orderstatus", "o_orderpriority")


def version_applicability(s, d):
    how = temporal.applicability(F.col("start_kind"), F.col("start_date"), F.col("end_kind"), F.col("end_date"), _day())
    return versions(s, d).select("version_id", how.alias("applicability"))


def version_as_of(s, d):
    return temporal.select_as_of(versions(s, d), _day(), "REPORT")


def version_policy_exclude(s, d):
    return temporal.select_as_of(versions(s, d), _day(), "EXCLUDE")


def version_policy_review(s, d):
    return temporal.select_as_of(versions(s, d), _day(), "REQUIRE_REVIEW")


def version_overlap(s, d):
    v = versions(s, d).withColumn("end_date", F.date_add("end_date", (F.col("version_id") % 40).cast("int")))
    return temporal.undeclared_overlaps(v)


def timeline_order(s, d):
    v = versions(s, d).withColumn("k0", temporal.timeline_key()[0]).withColumn("k1", F.when(F.col("k0") == 1, F.col("start_date")))
    return v.select("provision", "version_id", F.expr("row_number() OVER (PARTITION BY provision ORDER BY k0, k1 NULLS FIRST, version_id)").alias("place"))


def boundary_agreement(s, d):
    v = versions(s, d)
    ops = F.element_at(F.array(*(F.lit(x) for x in ("INSERT", "REPEAL", "AMEND", "RENUMBER"))), (F.col("version_id") % 4 + 1).cast("int"))
    effective = F.when(F.col("version_id") % 3 == 0, F.col("end_date")).otherwise(F.col("start_date"))
    return v.select("version_id", temporal.boundary_agreement(ops, effective, F.col("start_date"), F.col("end_date")).alias("agrees"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Records that carry the versions of three months of a provision."""
    v = versions(s, d)
    month = F.year("start_date") * 4 + F.floor((F.month("start_date") - 1) / 3)
    return v.withColumn("record_id", F.concat_ws("-", "provision", month.cast("string")))


def evidence_filter_report(s, d):
    return temporal.evidence_filter(_records(s, d), _day(), "REPORT", "record_id")


def evidence_filter_exclude(s, d):
    return temporal.evidence_filter(_records(s, d), _day(), "EXCLUDE", "record_id")


def evidence_filter_review(s, d):
    return temporal.evidence_filter(_records(s, d), _day(), "REQUIRE_REVIEW", "record_id")


def compare_dates(s, d):
    """One discovery, selected anew for each distinct date."""
    dates = F.explode(F.array_distinct(F.array(*(F.to_date(F.lit(x)) for x in ("1996-01-01", "1998-07-01", "2000-12-31", "1996-01-01"))))).alias("as_of")
    rows = versions(s, d).select("*", dates)
    return temporal.select_as_of(rows, F.col("as_of"), "REPORT", ("provision", "as_of")).select("provision", "as_of", "decision", "selected")


def events_by_zone(s, d):
    day = temporal.local_date(F.col("ts"), "Asia/Jakarta")
    return table(s, d, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def latest_before(s, d):
    """Every event with the latest earlier error of its user."""
    e = table(s, d, "events").select("event_id", "ts", "user_id")
    errors = table(s, d, "events").where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return temporal.as_of(e, errors, "user_id", "ts", "error_ts", ["error_id"], "day").select("event_id", "error_id")


def _aliases(s: SparkSession, d: str) -> DataFrame:
    """Aliases: a customer's market segment names it from one order's year until the next change."""
    c = table(s, d, "customer")
    a = c.select(F.col("c_mktsegment").alias("normalized"), F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("canonical_id"), (F.col("c_custkey") % 20).alias("from_rev"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 20 + 6).alias("to_rev"))
    return a


def alias_as_of(s, d):
    asked = table(s, d, "nation").select(F.col("n_nationkey").alias("scope"), F.lit("BUILDING").alias("normalized"))
    return registry.alias_lookup(_aliases(s, d), asked, ["normalized", "scope"], 12)


def alias_ambiguous(s, d):
    return registry.ambiguous(_aliases(s, d).where(temporal.visible(F.col("from_rev"), F.col("to_rev"), 12)), ["normalized", "scope"])


def alias_limit(s, d):
    asked = table(s, d, "nation").select(F.col("n_nationkey").alias("scope"), F.lit("BUILDING").alias("normalized"))
    return registry.limited_lookup(_aliases(s, d), asked, ["normalized", "scope"], 12, 3)


def history_as_of(s, d):
    """The latest revision of each customer's history not after a given one."""
    h = table(s, d, "orders").select(F.col("o_custkey").alias("lookup"), F.col("o_orderkey").alias("revision"), "o_totalprice")
    return registry.latest_at(h, ["lookup"], "revision", 9000, ["o_totalprice"])


def scope_counts_incl_empty(s, d):
    scopes = table(s, d, "nation").select(F.col("n_nationkey").alias("scope"))
    return registry.counts_with_empty(scopes, _aliases(s, d).where("normalized = 'BUILDING' AND canonical_id % 31 = 0"), ["scope"], "canonical_id")


QUERIES = {f.__name__: f for f in (version_applicability, version_as_of, version_policy_exclude, version_policy_review, version_overlap, timeline_order, boundary_agreement, evidence_filter_report, evidence_filter_exclude, evidence_filter_review, compare_dates, events_by_zone, latest_before, alias_as_of, alias_ambiguous, alias_limit, history_as_of, scope_counts_incl_empty)}

VER = """
v0 AS (SELECT o_custkey AS provision, o_orderkey AS version_id, o_orderdate::DATE AS start_date, o_orderpriority AS p,
       lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_date FROM orders),
ver AS (SELECT *, CASE WHEN version_id % 5 = 0 THEN 'UNKNOWN' WHEN version_id % 13 = 0 THEN 'UNBOUNDED' ELSE 'KNOWN' END AS start_kind,
       CASE WHEN end_date IS NULL THEN 'UNBOUNDED' WHEN version_id % 7 = 0 THEN 'CONFLICT' ELSE 'KNOWN' END AS end_kind,
       CASE WHEN p = '1-URGENT' THEN 'REPEALED' WHEN p = '2-HIGH' THEN 'NOT_YET_EFFECTIVE' WHEN version_id % 17 = 0 THEN 'UNKNOWN' WHEN version_id % 19 = 0 THEN 'CONFLICT' ELSE 'IN_FORCE' END AS legal_status,
       CASE WHEN version_id % 11 = 0 THEN 'REJECTED' WHEN version_id % 6 = 0 THEN 'UNREVIEWED' ELSE 'APPROVED' END AS review_state FROM v0)"""


def _how(date: str) -> str:
    return f"""CASE WHEN (start_kind = 'KNOWN' AND {date} < start_date) OR (end_kind = 'KNOWN' AND {date} >= end_date) THEN 'OUTSIDE'
WHEN start_kind IN ('KNOWN', 'UNBOUNDED') AND end_kind IN ('KNOWN', 'UNBOUNDED') THEN 'APPLICABLE' ELSE 'UNRESOLVED' END"""


def _select(policy: str, by: str = "provision", source: str = "ver", date: str = f"DATE '{AS_OF}'") -> str:
    done = "CASE WHEN n_exact = 0 THEN 'NOT_EFFECTIVE' ELSE 'RESOLVED' END"
    last = {"EXCLUDE": done, "REPORT": f"CASE WHEN n_un > 0 THEN 'UNRESOLVED' ELSE {done} END", "REQUIRE_REVIEW": f"CASE WHEN n_un > 0 THEN 'REQUIRES_REVIEW' ELSE {done} END"}[policy]
    ids = "coalesce(string_agg(version_id::VARCHAR, ',' ORDER BY version_id) FILTER ({}), '')"
    review = "how = 'APPLICABLE' AND (review_state = 'UNREVIEWED' OR legal_status = 'UNKNOWN')"
    return f"""h AS (SELECT *, CASE WHEN review_state = 'REJECTED' THEN 'EXCLUDED' ELSE {_how(date)} END AS how FROM {source}),
a AS (SELECT {by}, count(*) FILTER (how = 'APPLICABLE') AS n_exact, count(*) FILTER (how = 'UNRESOLVED') AS n_un, count(*) FILTER ({review}) AS n_rev,
bool_or(how = 'APPLICABLE' AND legal_status = 'CONFLICT') AS declared, {ids.format("how = 'APPLICABLE'")} AS selected, {ids.format("how = 'UNRESOLVED'")} AS unresolved,
{ids.format(review)} AS to_review, {ids.format("how = 'EXCLUDED'")} AS excluded FROM h GROUP BY {by}),
sel AS (SELECT {by}, CASE WHEN n_exact > 1 OR declared THEN 'CONFLICT' WHEN n_rev > 0 THEN 'REQUIRES_REVIEW' ELSE {last} END AS decision, selected, unresolved, to_review, excluded FROM a)"""


def _filter(policy: str) -> str:
    drop = "(outside OR doubtful)" if policy == "EXCLUDE" else "outside"
    review = "n_doubtful > 0" if policy == "REQUIRE_REVIEW" else "false"
    mixed = {"EXCLUDE": "NONE", "REQUIRE_REVIEW": "ERROR_REVIEW", "REPORT": "INCLUDED"}[policy]
    return f"""WITH {VER}, r AS (SELECT *, provision || '-' || (year(start_date) * 4 + floor((month(start_date) - 1) / 3)::BIGINT) AS record_id, {_how(f"DATE '{AS_OF}'")} AS how FROM ver),
x AS (SELECT *, how = 'OUTSIDE' AS outside, how <> 'OUTSIDE' AND (how = 'UNRESOLVED' OR legal_status IN ('UNKNOWN', 'CONFLICT') OR (legal_status = 'REPEALED' AND end_kind <> 'KNOWN')
OR (legal_status = 'NOT_YET_EFFECTIVE' AND start_kind <> 'KNOWN')) AS doubtful FROM r),
g AS (SELECT record_id, count(*) FILTER (NOT {drop}) AS inc, count(*) FILTER ({drop}) AS exc, count(*) FILTER (doubtful) AS n_doubtful, count(DISTINCT legal_status) > 1 AS mixed FROM x GROUP BY 1),
z AS (SELECT *, CASE WHEN {review} THEN 'ERROR_REVIEW' WHEN inc > 0 AND exc > 0 THEN 'ERROR_MIXED' WHEN inc = 0 THEN 'NONE' WHEN mixed THEN '{mixed}' ELSE 'INCLUDED' END AS verdict FROM g)
SELECT record_id, verdict, (verdict = 'INCLUDED' AND {"(n_doubtful > 0 OR mixed)" if policy == "REPORT" else "false"}) AS uncertain FROM z"""


ALIASES = """al AS (SELECT c_mktsegment AS normalized, c_nationkey AS scope, c_custkey AS canonical_id, c_custkey % 20 AS from_rev, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 + 6 END AS to_rev FROM customer),
seen AS (SELECT * FROM al WHERE from_rev <= 12 AND (to_rev IS NULL OR to_rev > 12))"""

ORACLES = {
    "version_applicability": f"WITH {VER} SELECT version_id, {_how(f'DATE {AS_OF!r}')} AS applicability FROM ver",
    "version_as_of": f"WITH {VER}, {_select('REPORT')} SELECT * FROM sel",
    "version_policy_exclude": f"WITH {VER}, {_select('EXCLUDE')} SELECT * FROM sel",
    "version_policy_review": f"WITH {VER}, {_select('REQUIRE_REVIEW')} SELECT * FROM sel",
    "version_overlap": f"""WITH {VER}, e AS (SELECT provision, version_id, CASE WHEN start_kind = 'UNBOUNDED' THEN DATE '0001-01-01' ELSE start_date END AS s,
CASE WHEN end_kind = 'UNBOUNDED' THEN DATE '9999-12-31' ELSE end_date + (version_id % 40)::INTEGER END AS e FROM ver
WHERE review_state = 'APPROVED' AND legal_status <> 'CONFLICT' AND start_kind <> 'UNKNOWN' AND end_kind <> 'CONFLICT'),
w AS (SELECT *, max(e) OVER (PARTITION BY provision ORDER BY s, e, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end FROM e)
SELECT provision, version_id, s AS start_date, latest_end FROM w WHERE s < latest_end""",
    "timeline_order": f"""WITH {VER}, k AS (SELECT *, CASE start_kind WHEN 'UNBOUNDED' THEN 0 WHEN 'KNOWN' THEN 1 ELSE 2 END AS k0 FROM ver)
SELECT provision, version_id, row_number() OVER (PARTITION BY provision ORDER BY k0, CASE WHEN k0 = 1 THEN start_date END NULLS FIRST, version_id)::INTEGER AS place FROM k""",
    "boundary_agreement": f"""WITH {VER}, e AS (SELECT *, CASE WHEN version_id % 3 = 0 THEN end_date ELSE start_date END AS eff FROM ver)
SELECT version_id, CASE version_id % 4 WHEN 0 THEN coalesce(eff = start_date, false) WHEN 1 THEN coalesce(eff = end_date, false) ELSE coalesce(eff = start_date, false) OR coalesce(eff = end_date, false) END AS agrees FROM e""",
    "evidence_filter_report": _filter("REPORT"),
    "evidence_filter_exclude": _filter("EXCLUDE"),
    "evidence_filter_review": _filter("REQUIRE_REVIEW"),
    "compare_dates": f"""WITH {VER}, dv AS (SELECT ver.*, as_of FROM ver, (VALUES (DATE '1996-01-01'), (DATE '1998-07-01'), (DATE '2000-12-31')) t(as_of)), {_select('REPORT', 'provision, as_of', 'dv', 'as_of')}
SELECT provision, as_of, decision, selected FROM sel""",
    "events_by_zone": "SELECT (ts + INTERVAL 7 HOUR)::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "latest_before": """WITH x AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error')
SELECT e.event_id, x.event_id AS error_id FROM events e ASOF LEFT JOIN x ON e.user_id = x.user_id AND e.ts >= x.ts""",
    "alias_as_of": f"WITH {ALIASES} SELECT n_nationkey AS scope, 'BUILDING' AS normalized, canonical_id FROM nation JOIN seen ON scope = n_nationkey AND normalized = 'BUILDING'",
    "alias_ambiguous": f"WITH {ALIASES} SELECT normalized, scope, count(DISTINCT canonical_id)::BIGINT AS n_ids FROM seen GROUP BY 1, 2 HAVING count(DISTINCT canonical_id) > 1",
    "alias_limit": f"""WITH {ALIASES}, r AS (SELECT normalized, scope, canonical_id, row_number() OVER (PARTITION BY normalized, scope ORDER BY canonical_id) AS n, count(*) OVER (PARTITION BY normalized, scope) AS k
FROM seen JOIN nation ON scope = n_nationkey WHERE normalized = 'BUILDING') SELECT normalized, scope, canonical_id, k > 3 AS overflow FROM r WHERE n <= 3""",
    "history_as_of": "SELECT o_custkey AS lookup, max(o_orderkey) AS revision, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderkey <= 9000 GROUP BY 1",
    "scope_counts_incl_empty": f"WITH {ALIASES} SELECT n_nationkey AS scope, count(canonical_id)::BIGINT AS n FROM nation LEFT JOIN al ON scope = n_nationkey AND normalized = 'BUILDING' AND canonical_id % 31 = 0 GROUP BY 1",
}
