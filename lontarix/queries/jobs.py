"""Job and stream family: a user's events are the ledger of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, jobs, leases, registry
from ..session import table
from ..streaming import leases as stream
from ..streaming import telemetry, windows

#: Seconds of a lease and attempts of a job.
LEASE, ATTEMPTS = 21_600, 5
_STATE = {"signup": "QUEUED", "view": "RUNNING", "click": "WAITING_REVIEW", "purchase": "SUCCEEDED", "error": "FAILED"}


def _ledger(s: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*(F.lit(x) for kv in _STATE.items() for x in kv))
    return table(s, d, "events").select("event_id", "ts", "user_id", F.element_at(m, F.col("event_type")).alias("state"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def job_submit(s, d):
    out = jobs.submit(_ledger(s, d), ["user_id", "k"], "state", "ts, event_id")
    return out.select("event_id", "outcome")


def job_claim(s, d):
    return jobs.claim(_ledger(s, d).where("state = 'QUEUED'").select("user_id", "ts", "event_id", "k"), "user_id", "ts", "event_id").drop("ts")


def _commands_of(events: DataFrame) -> DataFrame:
    """Views claim, clicks renew, purchases complete; one in ten errors cancels, the others claim too; signups suspend and resume."""
    k = F.col("event_id")
    action = F.when(F.col("event_type") == "click", "RENEW").when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "signup", F.when(k % 2 == 0, "SUSPEND").otherwise("RESUME"))
    action = action.when((F.col("event_type") == "error") & (k % 10 == 0), "CANCEL").otherwise("CLAIM")
    desired = F.when(k % 40 == 0, "SUCCEEDED").when(k % 40 == 1, "FAILED").otherwise("RETRY_WAIT")
    return events.select(
        F.col("user_id").alias("job"), F.col("ts").alias("at"), k.alias("seq"), action.alias("action"), F.concat(F.lit("w"), k % 3).alias("owner"),
        F.when(k % 5 == 0, 1).alias("fence"), desired.alias("desired"), F.lit(600).alias("delay_s"),
    )


def job_leases(s, d):
    return leases.decide(_commands_of(table(s, d, "events")), LEASE, ATTEMPTS)


def stream_leases(s, d):
    """The same ledger as a stream; what the watermark, a day behind the newest command, has passed is decided. A table's files are in no order of time, so they come at once."""
    rows = windows.read_stream(s, d, "events", files=None)
    return windows.all_available(stream.decide(_commands_of(rows), LEASE, ATTEMPTS, "1 day"), "leases", "append")


def illegal_transitions(s, d):
    return jobs.illegal_transitions(_ledger(s, d), "user_id", "state", "ts", "event_id").groupBy("before", "state").agg(F.count("*").alias("n"))


def retry_exhausted(s, d):
    a = _ledger(s, d).groupBy("user_id").agg(F.count_if(F.col("state") == "FAILED").alias("attempts"))
    state, delay = jobs.retry_state(F.col("attempts") % 8, F.lit(5))
    return a.select("user_id", state.alias("state"), delay.alias("delay_s"))


def job_latest_checkpoint(s, d):
    return jobs.latest(_ledger(s, d).where("state = 'SUCCEEDED'"), "user_id", "event_id", "k")


def stage_order(s, d):
    names = F.array(*(F.lit(x) for x in jobs.STAGES))
    rows = _ledger(s, d).withColumn("stage", F.element_at(names, F.col("k") % 9 + 1)).withColumn("rank", jobs.stage_rank(F.col("stage")))
    rows = rows.withColumn("before", F.expr("lag(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id)"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("rank") < F.col("before")).alias("n_back"))


def keyset_page(s, d):
    return jobs.page_after(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 4200, 64)


def byte_guard(s, d):
    return jobs.guard_total(table(s, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n")), F.col("n"), 1 << 40)


def byte_budget(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n"))
    return jobs.within_budget(rows, "conv_id", "turn", F.col("n"), 500)


def first_seen(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id")
    return jobs.first_seen(e, ["user_id", "event_type"], "ts", "event_id").drop("ts")


def queue_progress(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    done = table(s, d, "labels").select("doc_id", F.lit(True).alias("done"))
    return docs.join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("done").alias("acquired"), F.count_if(F.col("done").isNull()).alias("pending"))


def snapshot_ready(s, d):
    receipts = table(s, d, "events").select((F.col("user_id")).alias("snapshot"), F.col("event_type").alias("backend")).where("event_type <> 'error' AND snapshot % 3 <> 0 OR event_type = 'view'").distinct()
    return jobs.publish_ready(receipts, ["view", "click", "signup"])


def unassigned_jobs(s, d):
    """Anti-join: customers without an order after a date; semi-join: those with one of high priority."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    late = o.where(F.to_date("o_orderdate") >= "2001-01-01").select(F.col("o_custkey").alias("c_custkey"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(late, "c_custkey", "left_anti").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def authority_join(s, d):
    """All of a line item's owners must exist: order, customer, part, supplier and both nations."""
    li, o, c, p, su, n, r = (table(s, d, t) for t in ("lineitem", "orders", "customer", "part", "supplier", "nation", "region"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
    j = j.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(sn, "s_nationkey")
    return j.groupBy("r_name", "s_nation").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def review_accept(s, d):
    """Reviews that name the revision they saw: the first that names the current one is accepted."""
    current = table(s, d, "customer").where("c_custkey % 4 <> 0").select("c_custkey", (F.col("c_custkey") % 3).alias("revision"))
    asked = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).alias("expected"), F.col("o_orderkey").alias("proposal_id"))
    return registry.compare_and_set(current, asked, ["c_custkey"])


def batch_dependencies(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    return registry.used_identities(o.select("o_custkey"), li.select("l_partkey"), li.select("l_suppkey"))


def hit_accounting(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"))
    return evidence.account(docs.where("key % 11 <> 4"), docs.where("key % 2 = 0"), docs.where("key % 2 = 1 AND key % 13 <> 5").unionByName(docs.where("key % 34 = 0")))


def rollup_inventory(s, d):
    return table(s, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.grouping_id().alias("level"))


def events_tumbling(s, d):
    return windows.tumbling(table(s, d, "events"), "1 hour")


def events_sliding(s, d):
    return windows.sliding(table(s, d, "events"), "2 hours", "1 hour")


def events_session(s, d):
    return windows.sessions(table(s, d, "events"), "2 hours")


def stream_tumbling(s, d):
    """The tumbling counts again, by a stream over the files that runs until all is read."""
    return windows.run_available(s, d, "events", lambda df: windows.tumbling(df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 days"), "1 hour"), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_latest(s, d):
    """Latest state of each user, merged batch by batch as a stream comes in."""
    return windows.merge_latest(s, d, "events", ["user_id"], ["ts", "event_id"], ["event_type"])


def late_requests(s, d):
    """Clicks are scheduled requests, their arrivals completions unless they are errors; both are streams, whose files come at once as in ``stream_leases``. An hour is the deadline.

    Unfinished ones are those due before four days behind the slower stream's newest row, to the microsecond: the stream's watermark is a
    second ahead of that, and what isn't due is left out at the end. A click without an id is a request that nothing completes, so ids are in
    a struct. What is no completion goes without an id, so that time passes where all are errors.
    """

    def stream():
        return windows.read_stream(s, d, "clicks", files=None).withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "arrived_at")})

    done, ident = F.expr("kind <> 'error' AND arrived_at IS NOT NULL"), F.struct("click_id")
    asked = stream().select(ident.alias("request_id"), F.col("ts").alias("at"))
    completed = stream().select(F.when(done & F.col("click_id").isNotNull(), ident).alias("request_id"), F.when(done, F.col("arrived_at")).otherwise(F.greatest("ts", "arrived_at")).alias("done_at"))
    out = telemetry.outcomes(asked, completed, 3600, "3 days 23 hours 59 minutes 59 seconds")
    newest = table(s, d, "clicks").agg(F.least(F.max("ts"), F.max(F.when(F.col("kind") != "error", F.col("arrived_at")))).cast("timestamp").alias("newest"))
    rows = windows.all_available(out, "requests", "append").crossJoin(F.broadcast(newest))
    return rows.where("latency_ms < double('inf') OR at + INTERVAL 1 HOUR < newest - INTERVAL 4 DAYS").select(F.col("request_id.click_id").alias("request_id"), "latency_ms")


def outbox_pending(s, d):
    """Events to deliver after two runs over the orders that are published; half of them had an event before, some delivered."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("publication_id"), F.concat(F.lit("s"), "o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("k"))
    before = o.where("k % 2 = 0").select(F.concat(F.lit("snapshot-published:"), "publication_id").alias("event_id"), F.lit("snapshot.published").alias("topic"), F.col("snapshot_id").alias("aggregate_id"), F.lit("{}").alias("payload"), (F.col("k") % 4 == 0).alias("delivered"))
    published = o.where("k % 3 <> 0").drop("k")
    return jobs.outbox(published, jobs.outbox(published, before)).where("NOT delivered").drop("delivered")


QUERIES = {f.__name__: f for f in (job_submit, job_claim, job_leases, stream_leases, late_requests, illegal_transitions, retry_exhausted, job_latest_checkpoint, stage_order, keyset_page, byte_guard, byte_budget, first_seen, queue_progress, snapshot_ready, unassigned_jobs, authority_join, review_accept, batch_dependencies, hit_accounting, rollup_inventory, events_tumbling, events_sliding, events_session, stream_tumbling, stream_latest, outbox_pending)}

_LED = """led AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'WAITING_REVIEW' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS state,
value, (props ->> '$.k')::INTEGER AS k FROM events)"""
_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in jobs.TRANSITIONS)
_STAGE = ", ".join(f"'{x}'" for x in jobs.STAGES)
_TUMBLE = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, floor(sum(floor(value * 100)) + 0.5e0) / 100 AS total FROM events GROUP BY 1, 2"

#: A job's commands one by one: what is so before a command, whether it may be done, what is so after it.
_LEASES = f"""c AS (SELECT user_id AS job, event_id AS seq, epoch_us(ts) AS t, 'w' || event_id % 3 AS owner, CASE WHEN event_id % 5 = 0 THEN 1 END AS fence,
CASE event_type WHEN 'click' THEN 'RENEW' WHEN 'purchase' THEN 'COMPLETE' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'SUSPEND' ELSE 'RESUME' END
WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'CANCEL' ELSE 'CLAIM' END ELSE 'CLAIM' END AS action,
CASE event_id % 40 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS desired, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 'QUEUED' AS st, NULL::VARCHAR AS own, 0::BIGINT AS f, NULL::BIGINT AS ex, 0::BIGINT AS att, NULL::BIGINT AS nx,
false AS can, false AS told, false AS ran, NULL::BIGINT AS ran_f, NULL::BIGINT AS ran_ex FROM c
UNION ALL SELECT job, n, seq, outcome, after, CASE WHEN outcome = 'CLAIMED' THEN owner WHEN outcome = 'COMPLETED' OR after = 'CANCELLED' THEN NULL ELSE own END,
f + (outcome = 'CLAIMED')::BIGINT, CASE WHEN outcome IN ('CLAIMED', 'RENEWED') THEN t + {1_000_000 * LEASE} WHEN outcome = 'COMPLETED' OR after = 'CANCELLED' THEN NULL ELSE ex END,
CASE outcome WHEN 'RESUMED' THEN 0 WHEN 'CLAIMED' THEN att + 1 ELSE att END, CASE WHEN outcome = 'COMPLETED' THEN t + 600000000 ELSE nx END, can OR outcome = 'CANCELLING',
outcome <> 'CLAIMED' AND (told OR ran), ran, ran_f, ran_ex
FROM (SELECT *, CASE outcome WHEN 'CLAIMED' THEN 'RUNNING' WHEN 'SUSPENDED' THEN 'SUSPENDED' WHEN 'RESUMED' THEN 'QUEUED'
        WHEN 'COMPLETED' THEN CASE WHEN can THEN 'CANCELLED' WHEN desired = 'RETRY_WAIT' AND att >= {ATTEMPTS} THEN 'FAILED' ELSE desired END
        WHEN 'CANCELLING' THEN CASE WHEN over OR s1 IN ('QUEUED', 'RETRY_WAIT', 'SUSPENDED') THEN 'CANCELLED' ELSE s1 END ELSE s1 END AS after
  FROM (SELECT *, CASE action
          WHEN 'CLAIM' THEN CASE WHEN NOT can AND (s1 = 'QUEUED' OR (s1 = 'RETRY_WAIT' AND nx <= t AND att < {ATTEMPTS}) OR over) THEN 'CLAIMED' ELSE 'REFUSED' END
          WHEN 'RENEW' THEN CASE WHEN held AND NOT can THEN 'RENEWED' ELSE 'STALE' END WHEN 'COMPLETE' THEN CASE WHEN held THEN 'COMPLETED' ELSE 'STALE' END
          WHEN 'CANCEL' THEN CASE WHEN s1 IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN 'REFUSED' ELSE 'CANCELLING' END
          WHEN 'SUSPEND' THEN CASE WHEN s1 IN ('QUEUED', 'RETRY_WAIT') THEN 'SUSPENDED' ELSE 'REFUSED' END ELSE CASE WHEN s1 = 'SUSPENDED' THEN 'RESUMED' ELSE 'REFUSED' END END AS outcome
    FROM (SELECT *, s1 = 'RUNNING' AND own = owner AND (fence IS NULL OR fence = f) AND ex >= t AS held, late AND s1 = 'RUNNING' AS over
      FROM (SELECT r.* EXCLUDE (n, seq, outcome, ran, ran_f, ran_ex), c.* EXCLUDE (job), st = 'RUNNING' AND ex < t AS late, st = 'RUNNING' AND ex < t AND NOT told AS ran, f AS ran_f, ex AS ran_ex,
              CASE WHEN can AND (st IN ('QUEUED', 'RETRY_WAIT', 'SUSPENDED') OR (st = 'RUNNING' AND ex < t)) THEN 'CANCELLED' ELSE st END AS s1
            FROM r JOIN c ON c.job = r.job AND c.n = r.n + 1))))),
decided AS (SELECT job, seq, outcome, st AS state, f AS fence, ex AS expires_us FROM r WHERE n > 0),
ran_out AS (SELECT job, NULL::BIGINT, 'EXPIRED', 'RUNNING', ran_f, ran_ex FROM r WHERE ran)"""

ORACLES = {
    "outbox_pending": """SELECT 'snapshot-published:' || o_orderkey AS event_id, 'snapshot.published' AS topic, 's' || o_custkey AS aggregate_id,
CASE WHEN o_orderkey % 2 = 0 THEN '{}' ELSE '{"publication_id":"' || o_orderkey || '","snapshot_id":"s' || o_custkey || '"}' END AS payload FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0) OR (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0)""",
    "job_submit": f"""WITH {_LED} SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'CREATED' WHEN first_value(state) OVER w = state THEN 'REUSED' ELSE 'CONFLICT' END AS outcome
FROM led WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)""",
    "job_claim": f"WITH {_LED} SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(k, (ts, event_id)) AS k FROM led WHERE state = 'QUEUED' GROUP BY 1",
    "job_leases": f"WITH RECURSIVE {_LEASES} SELECT * FROM decided UNION ALL SELECT * FROM ran_out",
    "stream_leases": f"""WITH RECURSIVE until AS (SELECT (epoch_ms(max(ts)) - 86400000) * 1000 AS w FROM events), {_LEASES.replace("FROM events)", "FROM events WHERE epoch_us(ts) < (SELECT w FROM until))")}
SELECT * FROM decided UNION ALL SELECT * FROM ran_out
UNION ALL SELECT job, NULL, 'EXPIRED', st, f, ex FROM r WHERE st = 'RUNNING' AND NOT told AND ex < (SELECT w FROM until) AND n = (SELECT max(n) FROM r x WHERE x.job = r.job)""",
    "late_requests": """WITH s AS (SELECT DISTINCT click_id, ts FROM clicks WHERE ts IS NOT NULL), d AS (SELECT DISTINCT click_id, arrived_at FROM clicks WHERE kind <> 'error'),
w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(arrived_at) FROM d)) - INTERVAL 4 DAY AS w)
SELECT s.click_id AS request_id, coalesce((epoch_us(arrived_at) - epoch_us(ts)) / 1000e0, 'infinity'::DOUBLE) AS latency_ms
FROM s LEFT JOIN d ON s.click_id = d.click_id AND arrived_at BETWEEN ts AND ts + INTERVAL 1 HOUR WHERE arrived_at IS NOT NULL OR ts + INTERVAL 1 HOUR < (SELECT w FROM w)""",
    "illegal_transitions": f"""WITH {_LED}, b AS (SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM led)
SELECT before, state, count(*)::BIGINT AS n FROM b WHERE before <> state AND before || '>' || state NOT IN ({_ALLOWED}) GROUP BY 1, 2""",
    "retry_exhausted": f"""WITH {_LED}, a AS (SELECT user_id, count(*) FILTER (state = 'FAILED') % 8 AS n FROM led GROUP BY 1)
SELECT user_id, CASE WHEN n >= 5 THEN 'FAILED' ELSE 'QUEUED' END AS state, CASE WHEN n < 5 THEN (30 * pow(2, n))::BIGINT END AS delay_s FROM a""",
    "job_latest_checkpoint": f"WITH {_LED} SELECT user_id, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM led WHERE state = 'SUCCEEDED' GROUP BY 1",
    "stage_order": f"""WITH {_LED}, g AS (SELECT [{_STAGE}][k % 9 + 1] AS stage, k % 9 AS r, lag(k % 9) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM led)
SELECT stage, count(*)::BIGINT AS n, count(*) FILTER (r < b)::BIGINT AS n_back FROM g GROUP BY 1""",
    "keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 4200 ORDER BY o_orderkey LIMIT 64",
    "byte_guard": "SELECT conv_id, turn, strlen(text)::INTEGER AS n FROM conversations",
    "byte_budget": "WITH r AS (SELECT conv_id, turn, strlen(text)::BIGINT AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running FROM conversations) SELECT * FROM r WHERE running <= 500",
    "first_seen": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "queue_progress": "SELECT source, count(*)::BIGINT AS n, count(l.doc_id)::BIGINT AS acquired, (count(*) - count(l.doc_id))::BIGINT AS pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "snapshot_ready": """WITH r AS (SELECT DISTINCT user_id AS snapshot, event_type AS b FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0 OR event_type = 'view')
SELECT snapshot, count(*) FILTER (b IN ('view', 'click', 'signup')) = 3 AS ready FROM r GROUP BY 1""",
    "unassigned_jobs": """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "authority_join": """SELECT r_name, sn.n_name AS s_nation, count(*)::BIGINT AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""",
    "review_accept": """WITH p AS (SELECT o_orderkey AS proposal_id, o_custkey AS c_custkey, o_orderkey % 3 = CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 3 ELSE 0 END AS hit FROM orders),
f AS (SELECT c_custkey, min(proposal_id) AS first FROM p WHERE hit GROUP BY 1)
SELECT proposal_id, c_custkey, CASE WHEN hit AND proposal_id = first THEN 'ACCEPTED' ELSE 'STALE' END AS outcome FROM p LEFT JOIN f USING (c_custkey)""",
    "batch_dependencies": "SELECT o_custkey AS canonical_id FROM orders UNION SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem",
    "hit_accounting": """WITH x AS (SELECT doc_id AS key, (doc_id % 11 <> 4)::INTEGER AS h, (doc_id % 2 = 0)::INTEGER + (doc_id % 2 = 1 AND doc_id % 13 <> 5)::INTEGER + (doc_id % 34 = 0)::INTEGER AS o FROM documents)
SELECT key, CASE WHEN h = 0 THEN 'UNKNOWN' WHEN o = 0 THEN 'LOST' ELSE 'TWICE' END AS issue FROM x WHERE (h = 0 AND o > 0) OR (h = 1 AND o <> 1)""",
    "rollup_inventory": "SELECT source, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "events_tumbling": _TUMBLE,
    "stream_tumbling": _TUMBLE,
    "events_sliding": """WITH x AS (SELECT *, date_trunc('hour', ts) - unnest([0, 1]) * INTERVAL 1 HOUR AS window_start FROM events)
SELECT window_start, event_type, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""",
    "events_session": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true)::INTEGER AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*)::BIGINT AS n FROM k GROUP BY user_id, s""",
    "stream_latest": "SELECT user_id, max(ts) AS ts, max(event_id) FILTER (n = 1) AS event_id, max(event_type) FILTER (n = 1) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY 1",
}
