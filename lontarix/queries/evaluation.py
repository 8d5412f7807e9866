"""Evaluation family: events are requests (an error never finished), labels are judgements, conversations are answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, rounded
from ..operators import metrics as m
from ..session import table
from ..sources import telemetry
from ..sources.shared import scratch


def _latency(s: SparkSession, d: str) -> DataFrame:
    """Latency is null for an unfinished request."""
    return table(s, d, "events").withColumn("latency", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("slice", F.col("user_id") % 10)


def latency_quantiles(s, d):
    return m.nearest_rank(_latency(s, d), "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "slice")


def latency_overall(s, d):
    return m.nearest_rank(_latency(s, d).where("event_type <> 'error'"), "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "worst": 1.0})


def _observations(s: SparkSession, d: str) -> DataFrame:
    """Events as observations of one run; odd ones have a second stage, one in five a first token."""
    e, k = table(s, d, "events"), F.col("event_id")
    took = F.floor(F.abs(F.col("value")) * 1000).cast("long")
    stage = F.struct(F.lit("search").alias("stage"), took.alias("duration_ns"), (k % 100).alias("queue_ns"))
    second = F.struct(F.col("event_type").alias("stage"), (k % 7).alias("duration_ns"), F.lit(0).cast("long").alias("queue_ns"))
    return e.select(
        F.lit("run-1").alias("run_id"), F.concat(F.lit("q"), k).alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("scheduled_ns"), took.alias("completion_ns"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("outcome"), F.when(k % 5 == 0, k).alias("first_token_ns"), F.when(k % 2 == 1, F.array(stage, second)).otherwise(F.array(stage)).alias("stages"),
    )


def telemetry_roundtrip(s, d):
    """Observations written as length-delimited messages and read back."""
    path = scratch(s, "telemetry")
    telemetry.write(_observations(s, d), path)
    back = telemetry.read(s, path)
    spent = F.aggregate("stages", F.lit(0).cast("long"), lambda t, x: t + x.duration_ns + x.queue_ns)
    return back.select("request_id", "scheduled_ns", "completion_ns", "outcome", "first_token_ns", F.array_join(F.transform("stages", lambda x: x.stage), ",").alias("stages"), spent.alias("stages_ns"))


def success_ratio(s, d):
    e = _latency(s, d).groupBy("slice").agg(F.count("latency").alias("ok"), F.count("*").alias("n"))
    return e.select("slice", rounded(m.ratio(F.col("ok"), F.col("n"))).alias("success"))


def min_slice(s, d):
    """The worst of exactly the ten slices that are required."""
    e = _latency(s, d).groupBy("slice").agg(F.count("latency").alias("ok"), F.count("*").alias("n"))
    worst = m.estimate("minimum_slice_ratio", list(range(10)), slice="slice", numerator=F.col("ok"), denominator=F.col("n"))
    return e.agg(rounded(worst).alias("worst"), F.min_by("slice", F.struct(F.col("ok") / F.col("n"), "slice")).alias("worst_slice"), F.count("*").alias("n_slices"))


def throughput(s, d):
    e = _latency(s, d)
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(rounded(m.quotient(F.count("latency"), span / 1e6)).alias("per_second"))


def macro_mean(s, d):
    per = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("score"))
    return per.agg(rounded(F.avg("score")).alias("macro_mean"), F.count("*").alias("n_groups"))


def _predicted(s: SparkSession, d: str) -> DataFrame:
    """A document of at least 1,000 characters is predicted to be good."""
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("guess", (F.col("n_chars") >= 1000).cast("int"))


def micro_f1(s, d):
    c = [F.count_if((F.col("guess") == g) & (F.col("quality") == q)) for g, q in ((1, 1), (1, 0), (0, 1))]
    return _predicted(s, d).groupBy("lang").agg(*(x.alias(n) for x, n in zip(c, ("tp", "fp", "fn"), strict=True))).select("lang", "tp", "fp", "fn", rounded(m.micro_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"))


def precision_recall(s, d):
    c = _predicted(s, d).agg(F.count_if((F.col("guess") == 1) & (F.col("quality") == 1)).alias("tp"), F.count_if(F.col("guess") == 1).alias("n_guess"), F.count_if(F.col("quality") == 1).alias("n_gold"))
    p, r = F.col("tp") / F.col("n_guess"), F.col("tp") / F.col("n_gold")
    return c.select(rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(2 * p * r / (p + r)).alias("f1"))


def pairwise_precision_recall(s, d):
    """Pairs put together by guess and by judgement, counted from group sizes, never listed."""
    x = _predicted(s, d)

    def pairs(*by: str) -> DataFrame:
        return x.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n"))

    both, guess, gold = pairs("lang", "guess", "quality"), pairs("lang", "guess"), pairs("lang", "quality")
    j = both.select(F.col("n").alias("b")).crossJoin(guess.select(F.col("n").alias("g"))).crossJoin(gold.select(F.col("n").alias("q")))
    return j.select(rounded(F.col("b") / F.col("g")).alias("precision"), rounded(F.col("b") / F.col("q")).alias("recall"))


def cer(s, d):
    c = table(s, d, "conversations")
    return c.groupBy("role").agg(rounded(m.character_error_rate(F.col("text"), ascii_lower("text"))).alias("cer"))


def abstention(s, d):
    """Answers abstain on toxic documents; denominators of the two ratios are separate."""
    x = _predicted(s, d)
    said_no = F.col("guess") == 0
    return x.agg(
        rounded(F.count_if((F.col("toxic") == 1) & said_no) / F.count_if(F.col("toxic") == 1)).alias("abstention_recall"),
        rounded(F.count_if((F.col("toxic") == 0) & said_no) / F.count_if(F.col("toxic") == 0)).alias("false_abstention"),
    )


def citation_ratios(s, d):
    li = table(s, d, "lineitem")
    ok = F.col("l_returnflag") != "R"
    c = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return c.agg(rounded(F.sum("ok") / F.sum("n")).alias("precision"), rounded(F.count_if(F.col("ok") > 0) / F.count("*")).alias("coverage"))


def _gates(s: SparkSession, d: str) -> DataFrame:
    q = m.nearest_rank(_latency(s, d), "latency", {"p50": 0.5, "p95": 0.95}, "slice")
    n = _latency(s, d).groupBy("slice").agg(F.count("*").alias("samples"))
    j = q.join(n, "slice")
    one = j.select("slice", F.lit("P50").alias("gate"), F.col("p50").alias("value"), F.lit(70.0).alias("threshold"), "samples")
    return one.unionByName(j.select("slice", F.lit("P95").alias("gate"), F.when(F.col("slice") != 3, F.col("p95")), F.lit(150.0).alias("threshold"), "samples").toDF(*one.columns))


def gate_status(s, d):
    g = _gates(s, d)
    return g.select("slice", "gate", m.gate_status(F.col("value"), F.col("threshold"), F.lit(True), F.col("samples"), F.lit(100)).alias("status"))


def release_status(s, d):
    g = gate_status(s, d)
    return g.groupBy("gate").agg(m.worst_status(F.col("status")).alias("worst"), F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count_if(F.col("status") == "FAIL").alias("n_fail"))


def rebuild_ratio(s, d):
    """Documents whose number ends in 7 changed; an update goes over these, a rebuild over all, a character a microsecond. Some changes were missed."""
    docs, k = table(s, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h")), F.col("doc_id")
    full = docs.withColumn("h", F.when(k % 10 == 7, F.lit("new")).otherwise(F.col("h")))
    updated = docs.withColumn("h", F.when((k % 10 == 7) & (k % 100 != 37), F.lit("new")).otherwise(F.col("h")))
    diff = full.join(updated.select("doc_id", F.col("h").alias("u")), "doc_id", "full").agg(F.count_if(~F.col("h").eqNullSafe(F.col("u"))).alias("diff"))
    changed = k % 10 == 7
    sums = docs.agg(F.count_if(changed).alias("n"), (F.sum(F.when(changed, F.col("n_chars"))) / 1e6).alias("update_s"), (F.sum("n_chars") / 1e6).alias("rebuild_s")).crossJoin(F.broadcast(diff))
    out = sums.select(m.rebuild(F.col("n"), F.col("update_s"), F.col("rebuild_s"), F.col("diff")).alias("x")).select("x.*")
    return out.select(rounded(F.col("ratio")).alias("ratio"), "denominator", F.array_join("ancillary", ",").alias("ancillary"))


def _arms(s: SparkSession, d: str) -> DataFrame:
    """Two runs of an open loop of fifty requests a second: events of even and of odd number. Some errors never finished."""
    k = F.col("event_id")
    took = F.when((F.col("event_type") != "error") | (F.expr("event_id div 2") % 25 > 0), F.abs(F.col("value")))
    return table(s, d, "events").select(k.alias("request_id"), (k % 2 == 1).alias("mixed"), (F.expr("event_id div 2") * 20_000_000).alias("scheduled_ns"), took.alias("latency_ms"), F.coalesce(took <= 150, F.lit(False)).alias("succeeded"))


def isolation_ratio(s, d):
    out = m.isolation(_arms(s, d), 20_000_000, 150.0, 100.0, 1e9, 0.9, 5.0)
    return out.select(rounded(F.col("ratio")).alias("ratio"), "denominator", F.array_join("ancillary", ",").alias("ancillary"))


def gate_sets(s, d):
    """Matched, missed and surplus ids of predicted and gold sets, which are disjoint by making."""
    p = _predicted(s, d).select("doc_id", F.col("guess") == 1, F.col("quality") == 1).toDF("doc_id", "g", "q")
    return p.where("g OR q").select("doc_id", F.when(F.col("g") & F.col("q"), "MATCHED").when(F.col("q"), "MISSED").otherwise("SURPLUS").alias("outcome"))


def invariant_gates(s, d):
    """All six: documents with a label are mapped, orders without their customer are orphans, and so on."""
    docs, labels, orders, customers = (table(s, d, t) for t in ("documents", "labels", "orders", "customer"))
    events, li = table(s, d, "events"), table(s, d, "part")

    def outcome(rows: DataFrame, gate: str, key: str, good: F.Column) -> DataFrame:
        return rows.select(F.lit(gate).alias("gate"), F.col(key).cast("string").alias("id"), good.alias("good"))

    mapped = docs.join(labels.select("doc_id", F.lit(True).alias("l")).distinct(), "doc_id", "left")
    owned = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("c")).where("o_custkey % 50 <> 3"), "o_custkey", "left")
    k, e = F.col("doc_id"), F.col("event_id")
    parts = [
        outcome(mapped, "SOURCE_MAPPING", "doc_id", F.col("l").isNotNull()), outcome(owned, "ORPHAN_EDGES", "o_orderkey", F.col("c").isNotNull()), outcome(events, "SNAPSHOT_MISMATCH", "event_id", e % 400 != 7),
        outcome(docs, "UNCHANGED_REEXTRACTION", "doc_id", (F.length("text") != F.col("n_chars")) | (k % 90 != 1)), outcome(events, "REPLAY_DIFF", "event_id", F.col("value") >= 0), outcome(li, "WIRE_PARITY", "p_partkey", F.unhex(F.hex("p_name")) == F.col("p_name").cast("binary")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return m.invariants(rows).select("gate", rounded(F.col("value")).alias("value"), "denominator")


def run_admission(s, d):
    """Slices with too few samples, or ids that repeat."""
    e = table(s, d, "events").groupBy((F.col("user_id") % 150).alias("slice")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))
    return e.select("slice", ((F.col("n") >= 60) & (F.col("n") == F.col("n_ids"))).alias("admitted"))


def corpus_eligibility(s, d):
    x = _predicted(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return x.select("lang", "n", "n_good", "n_toxic", ((F.col("n") >= 40) & (F.col("n_good") >= 20) & (F.col("n_toxic") >= 3)).alias("eligible"))


def stage_durations(s, d):
    """Events of a user within an hour as stages: their values may not sum up over 600, and names may not repeat."""
    e = table(s, d, "events").withColumn("job", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    g = e.groupBy("user_id", "job").agg(F.floor(F.sum(F.floor(F.col("value") * 100)) / 100).alias("total"), (F.count_distinct("event_type") == F.count("*")).alias("unique_names"))
    return g.groupBy((F.col("total") <= 600).alias("within"), "unique_names").agg(F.count("*").alias("n"))


def answer_tokens(s, d):
    c = table(s, d, "conversations").where("role = 'assistant'").withColumn("tokens", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    return m.nearest_rank(c, "tokens", {"p50": 0.5, "p90": 0.9})


def constant_rate(s, d):
    """Arrivals of each user's open loop, twenty milliseconds apart; each 97th event came a millisecond late."""
    k = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)")
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("request_id"), (k * 20_000_000 + F.when(F.col("event_id") % 97 == 0, 1_000_000).otherwise(0)).alias("scheduled_ns"))
    return m.constant_rate(e, "scheduled_ns", 20_000_000, "user_id")


QUERIES = {f.__name__: f for f in (latency_quantiles, latency_overall, success_ratio, min_slice, throughput, macro_mean, micro_f1, precision_recall, pairwise_precision_recall, cer, abstention, citation_ratios, gate_status, release_status, rebuild_ratio, isolation_ratio, gate_sets, invariant_gates, run_admission, corpus_eligibility, stage_durations, answer_tokens, constant_rate, telemetry_roundtrip)}


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def _q(p: str, name: str) -> str:
    return f"list_sort(list(v))[greatest(ceil({p}::DOUBLE * count(*)), 1)::BIGINT] AS {name}"


_LAT = "lat AS (SELECT *, user_id % 10 AS slice, CASE WHEN event_type <> 'error' THEN value END AS latency, coalesce(CASE WHEN event_type <> 'error' THEN value END, 'infinity'::DOUBLE) AS v FROM events)"
_PRED = "pr AS (SELECT l.*, n_chars, lang, (n_chars >= 1000)::INTEGER AS guess FROM labels l JOIN documents USING (doc_id))"
_GATE = f"""{_LAT}, q AS (SELECT slice, {_q("0.5", "p50")}, {_q("0.95", "p95")}, count(*) AS k FROM lat GROUP BY 1),
g AS (SELECT slice, 'P50' AS gate, p50 AS x, 70e0 AS t, k FROM q UNION ALL SELECT slice, 'P95', CASE WHEN slice <> 3 THEN p95 END, 150e0, k FROM q),
st AS (SELECT slice, gate, CASE WHEN x IS NULL THEN 'NOT_MEASURED' WHEN k < 100 THEN 'BLOCKED' WHEN x <= t THEN 'PASS' ELSE 'FAIL' END AS status FROM g)"""
_SUCC = f"{_LAT}, su AS (SELECT slice, {r6('count(latency) / count(*)::DOUBLE')} AS success FROM lat GROUP BY 1)"

ORACLES = {
    "latency_quantiles": f"WITH {_LAT} SELECT slice, {_q('0.5', 'p50')}, {_q('0.95', 'p95')}, {_q('0.99', 'p99')} FROM lat GROUP BY 1",
    "latency_overall": f"WITH {_LAT} SELECT {_q('0.5', 'p50')}, {_q('0.95', 'p95')}, {_q('0.99', 'p99')}, max(v) AS worst FROM lat WHERE event_type <> 'error'",
    "telemetry_roundtrip": """WITH e AS (SELECT *, floor(abs(value) * 1000)::BIGINT AS took FROM events)
SELECT 'q' || event_id AS request_id, epoch_us(ts) * 1000 AS scheduled_ns, took AS completion_ns, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS outcome, CASE WHEN event_id % 5 = 0 THEN event_id END AS first_token_ns,
'search' || CASE WHEN event_id % 2 = 1 THEN ',' || event_type ELSE '' END AS stages, took + event_id % 100 + CASE WHEN event_id % 2 = 1 THEN event_id % 7 ELSE 0 END AS stages_ns FROM e""",
    "success_ratio": f"WITH {_SUCC} SELECT * FROM su",
    "min_slice": f"WITH {_LAT}, su AS (SELECT slice, count(latency) / count(*)::DOUBLE AS success FROM lat GROUP BY 1) SELECT {r6('min(success)')} AS worst, (SELECT slice FROM su ORDER BY success, slice LIMIT 1) AS worst_slice, count(*)::BIGINT AS n_slices FROM su",
    "throughput": f"WITH {_LAT} SELECT event_type, {r6('count(latency) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)')} AS per_second FROM lat GROUP BY 1",
    "macro_mean": f"WITH p AS (SELECT source, avg(quality::DOUBLE) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT {r6('avg(s)')} AS macro_mean, count(*)::BIGINT AS n_groups FROM p",
    "micro_f1": f"""WITH {_PRED}, c AS (SELECT lang, count(*) FILTER (guess = 1 AND quality = 1)::BIGINT AS tp, count(*) FILTER (guess = 1 AND quality = 0)::BIGINT AS fp, count(*) FILTER (guess = 0 AND quality = 1)::BIGINT AS fn FROM pr GROUP BY 1)
SELECT *, {r6('2e0 * tp / (2 * tp + fp + fn)')} AS f1 FROM c""",
    "precision_recall": f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (guess = 1 AND quality = 1) / (count(*) FILTER (guess = 1))::DOUBLE AS p, count(*) FILTER (guess = 1 AND quality = 1) / (count(*) FILTER (quality = 1))::DOUBLE AS r FROM pr)
SELECT {r6('p')} AS precision, {r6('r')} AS recall, {r6('2 * p * r / (p + r)')} AS f1 FROM c""",
    "pairwise_precision_recall": f"""WITH {_PRED}, b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM pr GROUP BY lang, guess, quality)),
g AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT count(*) AS n FROM pr GROUP BY lang, guess)), q AS (SELECT sum(n * (n - 1) / 2) AS z FROM (SELECT count(*) AS n FROM pr GROUP BY lang, quality))
SELECT {r6('x::DOUBLE / y')} AS precision, {r6('x::DOUBLE / z')} AS recall FROM b, g, q""",
    "cer": f"""SELECT role, {r6("sum(levenshtein(text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) / sum(length(text))::DOUBLE")} AS cer FROM conversations GROUP BY 1""",
    "abstention": f"WITH {_PRED} SELECT {r6('count(*) FILTER (toxic = 1 AND guess = 0) / (count(*) FILTER (toxic = 1))::DOUBLE')} AS abstention_recall, {r6('count(*) FILTER (toxic = 0 AND guess = 0) / (count(*) FILTER (toxic = 0))::DOUBLE')} AS false_abstention FROM pr",
    "citation_ratios": f"WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) SELECT {r6('sum(ok) / sum(n)::DOUBLE')} AS precision, {r6('count(*) FILTER (ok > 0) / count(*)::DOUBLE')} AS coverage FROM c",
    "gate_status": f"WITH {_GATE} SELECT * FROM st",
    "release_status": f"""WITH {_GATE} SELECT gate, ['PASS', 'NOT_MEASURED', 'BLOCKED', 'FAIL'][max(list_position(['PASS', 'NOT_MEASURED', 'BLOCKED', 'FAIL'], status))] AS worst,
count(*) FILTER (status = 'PASS')::BIGINT AS n_pass, count(*) FILTER (status = 'FAIL')::BIGINT AS n_fail FROM st GROUP BY 1""",
    "rebuild_ratio": f"""SELECT {r6('(sum(n_chars) FILTER (doc_id % 10 = 7) / 1e6) / (sum(n_chars) / 1e6)')} AS ratio, count(*) FILTER (doc_id % 10 = 7)::BIGINT AS denominator,
CASE WHEN count(*) FILTER (doc_id % 100 = 37) > 0 THEN 'incremental state differs from full rebuild' ELSE '' END AS ancillary FROM documents""",
    "isolation_ratio": f"""WITH lat AS (SELECT event_id % 2 = 1 AS mixed, CASE WHEN event_type <> 'error' OR event_id // 2 % 25 > 0 THEN abs(value) ELSE 'infinity'::DOUBLE END AS v FROM events),
q AS (SELECT mixed, {_q('0.95', 'p95')}, count(*) AS n, count(*) FILTER (v <= 150) / count(*)::DOUBLE AS ok FROM lat GROUP BY 1), p AS (SELECT * FROM (SELECT p95 AS a, n, ok AS oa, (SELECT list_sort(list(v))[greatest(ceil(0.99e0 * count(*)), 1)::BIGINT] FROM lat WHERE mixed) AS a99 FROM q WHERE mixed), (SELECT p95 AS b, ok AS ob FROM q WHERE NOT mixed))
SELECT {r6('a / b')} AS ratio, n::BIGINT AS denominator, array_to_string(list_filter([CASE WHEN a > 100 THEN 'mixed query p95 exceeds its absolute limit' END, CASE WHEN a99 > 1e9 THEN 'mixed query p99 exceeds its absolute limit' END,
CASE WHEN oa < 0.9 THEN 'mixed query success is below its absolute limit' END, CASE WHEN ob < 0.9 THEN 'baseline query success is below its absolute limit' END], lambda x: x IS NOT NULL), ',') AS ancillary FROM p""",
    "gate_sets": f"WITH {_PRED} SELECT doc_id, CASE WHEN guess = 1 AND quality = 1 THEN 'MATCHED' WHEN quality = 1 THEN 'MISSED' ELSE 'SURPLUS' END AS outcome FROM pr WHERE guess = 1 OR quality = 1",
    "invariant_gates": f"""WITH g AS (SELECT 'SOURCE_MAPPING' AS gate, (doc_id IN (SELECT doc_id FROM labels)) AS good FROM documents
UNION ALL SELECT 'ORPHAN_EDGES', o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 3) FROM orders UNION ALL SELECT 'SNAPSHOT_MISMATCH', event_id % 400 <> 7 FROM events
UNION ALL SELECT 'UNCHANGED_REEXTRACTION', length(text) <> n_chars OR doc_id % 90 <> 1 FROM documents UNION ALL SELECT 'REPLAY_DIFF', value >= 0 FROM events UNION ALL SELECT 'WIRE_PARITY', true FROM part)
SELECT gate, {r6("CASE WHEN gate IN ('SOURCE_MAPPING', 'WIRE_PARITY') THEN count(*) FILTER (good) / count(*)::DOUBLE ELSE count(*) FILTER (NOT coalesce(good, false)) END")} AS value, count(*)::BIGINT AS denominator FROM g GROUP BY 1""",
    "run_admission": "SELECT user_id % 150 AS slice, count(*) >= 60 AND count(*) = count(DISTINCT event_id) AS admitted FROM events GROUP BY 1",
    "corpus_eligibility": f"""WITH {_PRED}, c AS (SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS n_good, count(*) FILTER (toxic = 1)::BIGINT AS n_toxic FROM pr GROUP BY 1)
SELECT *, n >= 40 AND n_good >= 20 AND n_toxic >= 3 AS eligible FROM c""",
    "stage_durations": """WITH g AS (SELECT user_id, date_trunc('hour', ts) AS job, floor(sum(floor(value * 100)) / 100) AS total, count(DISTINCT event_type) = count(*) AS unique_names FROM events GROUP BY 1, 2)
SELECT total <= 600 AS within, unique_names, count(*)::BIGINT AS n FROM g GROUP BY 1, 2""",
    "answer_tokens": r"WITH lat AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::DOUBLE AS v FROM conversations WHERE role = 'assistant') SELECT " + f"{_q('0.5', 'p50')}, {_q('0.9', 'p90')} FROM lat",
    "constant_rate": """WITH g AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 20000000 + CASE WHEN event_id % 97 = 0 THEN 1000000 ELSE 0 END AS t FROM events),
x AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM g)
SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (gap <> 20000000)::BIGINT AS n_broken, count(*) FILTER (gap <> 20000000) = 0 AS follows FROM x GROUP BY 1""",
}
