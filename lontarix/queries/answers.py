"""Answer, path and projection family: rules that answers keep, what paths leave open, ranges between raw and normalized text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.questions import trace
from ..functions.text import analyzed, byte_length
from ..operators import answers, structure, temporal
from ..session import table
from .structure import _KIND, _LEVEL, _LINE, _NORM, _RAW, _documents, _raw


def answer_issues(s, d):
    """Answers for orders, a claim a line item: a text of two letters and a space a claim, with faults by the order's number."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("answer_id"))
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("supp"))
    k, n = F.col("answer_id"), F.col("n")
    evidence = F.concat(F.lit("s"), "supp")
    m = rows.groupBy("answer_id").agg(F.max("n").alias("m"))
    status = F.element_at(F.array(*map(F.lit, ("COMPLETE", "PARTIAL", "CONFLICT", "ABSTAIN", "NEEDS_CLARIFICATION"))), (k % 5 + 1).cast("int"))
    text = F.when((k % 5 == 3) & (k % 2 == 0), answers.TEMPLATES["ABSTAIN"]).otherwise(F.repeat(F.lit("ab "), F.coalesce("m", F.lit(0)).cast("int")))
    own = o.join(m, "answer_id", "left").select("answer_id", status.alias("status"), text.alias("text"), (k % 2 == 0).alias("context_complete"), F.when(k % 26 == 0, F.array(F.concat(F.lit("r"), k))).otherwise(F.array().cast("array<string>")).alias("missing"), (k % 10 == 2).cast("int").alias("n_conflicts"), F.lit(0).alias("n_paths"))
    start = (3 * (n - 1)).cast("int")
    claims = rows.select("answer_id", n.alias("claim_id"), F.when((k + n) % 4 == 0, "UNVERIFIED").otherwise("SUPPORTED").alias("support"), start.alias("start"), (start + F.when(k % 7 == 0, 4).otherwise(2)).alias("stop"), F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(evidence)).alias("evidence"))
    citations = rows.where(k % 3 != 0).select("answer_id", evidence.alias("evidence_id"), F.array("n").alias("claim_ids"))
    selected = rows.where("supp % 11 <> 0").select("answer_id", evidence.alias("evidence_id")).distinct()
    omitted = o.where(k % 13 == 0).select("answer_id", F.concat(F.lit("r"), k).alias("ref"))
    return answers.issues(own, claims, citations, selected, omitted)


def path_evidence(s, d):
    """A path an order through its line items; what a line item leaves open goes by its part and supplier."""
    li = table(s, d, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("a"), "l_partkey", "l_suppkey", "l_linenumber").distinct()
    paths = li.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_set("a").alias("assertions"), F.collect_set("a").alias("supports"))
    assertions = li.select(F.col("a").alias("assertion_id"), (F.col("l_partkey") % 17 == 0).cast("int").alias("n_exceptions"), (F.col("l_suppkey") % 19 == 0).alias("qualified"), F.lit(False).alias("inferred"), F.when(F.col("l_partkey") % 23 == 0, F.to_date(F.lit("2021-01-01"))).otherwise(F.to_date(F.lit("2020-01-01"))).alias("effective"))
    supports = li.select(F.col("a").alias("support_id"), (F.col("l_linenumber") != 6).alias("complete"))
    items = li.where("l_linenumber % 2 = 1").select(F.col("a").alias("assertion_id"), F.concat(F.lit("s"), "l_suppkey").alias("evidence_id"), F.when(F.col("l_suppkey") % 29 == 0, "UNKNOWN").otherwise("IN_FORCE").alias("legal_status"))
    return answers.path_coverage(paths, assertions, supports, items, F.to_date(F.lit("2020-01-01")))


def reference_closure(s, d):
    """Labels as spans of documents: some end behind the text, some have no document, and a span of three shares its id."""
    lb = table(s, d, "labels").select("doc_id")
    docs = table(s, d, "documents").select("doc_id", "text")
    size = docs.select("doc_id", byte_length("text").alias("n"))
    spans = lb.join(size, "doc_id").select(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id")).alias("span_id"), F.when(F.col("doc_id") % 5 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.lit(0).alias("start"), (F.col("n") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("stop"))
    return answers.reference_issues(spans, docs)


def raw_line_cover(s, d):
    """Each line of the normalized texts and the raw bytes that it comes from."""
    return structure.raw_cover_of(_raw(s, d), structure.line_ranges)


def normalized_text_cover(s, d):
    """All bytes of each raw text but its first: what they became, whole transformations included."""
    return structure.normalized_cover_of(_raw(s, d), lambda t: (np.array([1]), np.array([len(t.encode())]))).select("doc_id", "norm_start", "norm_stop")


def owned_text(s, d):
    return structure.owned(_documents(s, d)).select("doc_id", "label", "start", "stop")


def _solid(text: str) -> int:
    """A token for every four characters that aren't white space, for a query that needs no vocabulary."""
    return -(-len("".join(text.split())) // 4)


def chunk_fit(s, d):
    """Chunks of the documents' owned text within 64 tokens of an injected counter; without overlap they hold all that isn't white space."""
    c = structure.owned_chunks(table(s, d, "documents"), _solid, 64, overlap=0)
    solid = F.length(F.regexp_replace("body", r"\s+", ""))
    return c.groupBy("doc_id").agg((F.max("tokens") <= 64).alias("within"), (F.max(F.abs(F.ceil(solid / 4) - F.col("tokens"))) == 0).alias("counted"), F.sum(solid).alias("solid_chars"))


def question_trace(s, d):
    """Questions with white space around them and a quotation behind: the quotation keeps its bytes, the rest is collapsed."""
    q = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit(" \n"), "text", F.lit('\t"dua  kata "  é ')).alias("q"))
    t = q.select("conv_id", "turn", trace("q").alias("t"))
    return t.select("conv_id", "turn", F.col("t.search").alias("search"), F.size(F.filter("t.edits", lambda e: e["kind"] == "nfc")).alias("n_nfc"))


def question_dates(s, d):
    """Scopes of all three modes, current ones at an event's time in Jakarta."""
    e = table(s, d, "events").select("event_id", "ts")
    kind = F.element_at(F.array(F.lit("AS_OF"), F.lit("CURRENT"), F.lit("COMPARE")), (F.col("event_id") % 3 + 1).cast("int"))
    day = F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("event_id") % 365).cast("int"))
    e = e.withColumn("mode", kind).withColumn("effective", F.when(F.col("mode") == "AS_OF", day)).withColumn("compare", F.when(F.col("mode") == "COMPARE", F.array(day, F.date_add(day, 30))))
    dates = temporal.resolve_scope(F.col("mode"), F.col("effective"), F.col("compare"), F.col("ts"), "Asia/Jakarta")
    return e.select("event_id", "mode", F.posexplode(dates).alias("nth", "date"))


def lex_composed(s, d):
    """Terms of texts whose every a carries a combining accent: the analyzer composes them first."""
    t = table(s, d, "documents").select("doc_id", F.explode(analyzed(F.replace("text", F.lit("a"), F.lit("á")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (answer_issues, path_evidence, reference_closure, raw_line_cover, normalized_text_cover, owned_text, chunk_fit, question_trace, question_dates, lex_composed)}

_TERM = r"(?:\p{L}+(?:-\p{L}+)*|[0-9]+(?:/[0-9]+)*)+"
ORACLES = {
    "answer_issues": f"""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, (k + n) % 4 <> 0 AS ok FROM r), g AS (SELECT k, count(*) AS c, max(n) AS m, count(*) FILTER (NOT ok) AS bad FROM c GROUP BY 1),
a AS (SELECT o_orderkey AS k, coalesce(c, 0) AS c, coalesce(m, 0) AS m, coalesce(bad, 0) AS bad, o_orderkey % 5 AS st FROM orders LEFT JOIN g ON g.k = o_orderkey)
SELECT k AS answer_id, 'TILING' AS issue FROM a WHERE st < 3 AND (c <> m OR (k % 7 = 0 AND c > 0)) UNION SELECT k, 'INCOMPLETE' FROM a WHERE st = 0 AND (k % 2 <> 0 OR k % 13 = 0 OR k % 10 = 2 OR c = 0 OR bad > 0)
UNION SELECT k, 'FACTS' FROM a WHERE st >= 3 AND c > 0 UNION SELECT k, 'TEMPLATE' FROM a WHERE (st = 3 AND k % 2 <> 0) OR st = 4 UNION SELECT k, 'NO_CONFLICT' FROM a WHERE st = 2 AND k % 10 <> 2
UNION SELECT k, 'NO_EVIDENCE' FROM c WHERE ok AND n % 6 = 0 UNION SELECT k, 'NO_CITATION' FROM c WHERE ok AND k % 3 = 0 UNION SELECT k, 'FOREIGN_EVIDENCE' FROM c WHERE n % 6 <> 0 AND supp % 11 = 0
UNION SELECT k, 'FOREIGN_CITATION' FROM c WHERE k % 3 <> 0 AND supp % 11 = 0 UNION SELECT k, 'HIDDEN_OMISSION' FROM a WHERE k % 13 = 0 AND k % 26 <> 0""",
    "path_evidence": """WITH l AS (SELECT DISTINCT l_orderkey AS path_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
g AS (SELECT path_id, count(DISTINCT CASE WHEN n % 2 = 1 THEN s END) AS n_items, count(*) FILTER (p % 17 = 0 OR s % 19 = 0 OR p % 23 = 0) + count(*) FILTER (n = 6) AS n_missing, count(*) FILTER (n % 2 = 1 AND s % 29 = 0) AS q FROM l GROUP BY 1)
SELECT path_id, CASE WHEN n_missing = 0 AND q = 0 AND n_items > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage, n_items::BIGINT AS n_items, n_missing::BIGINT AS n_missing FROM g""",
    "reference_closure": """WITH x AS (SELECT l.doc_id AS d, CASE WHEN l.doc_id % 3 = 0 THEN 0 ELSE l.doc_id END AS span_id, strlen(text) AS n FROM labels l JOIN documents USING (doc_id))
SELECT DISTINCT span_id, CASE WHEN d % 5 = 0 THEN 'ORPHAN' ELSE 'SPAN' END AS issue FROM x WHERE d % 5 = 0 OR d % 7 = 0 OR n = 0 UNION ALL SELECT span_id, 'DUPLICATE' FROM x GROUP BY 1 HAVING count(*) > 1""",
    "raw_line_cover": rf"""WITH {_RAW}, p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$') AS x FROM raw)),
q AS (SELECT doc_id, i, piece, regexp_replace(piece, '[\r\n]+$', '') AS text FROM p), l AS (SELECT doc_id, i, strlen(piece) AS whole, strlen(text) AS r, strlen({_NORM}) AS n FROM q),
c AS (SELECT *, sum(whole) OVER w - whole AS a, sum(n + 1) OVER w - n - 1 AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, b::BIGINT AS start, (b + n)::BIGINT AS stop, a::BIGINT AS raw_start, (a + r)::BIGINT AS raw_stop FROM c WHERE n > 0""",
    "normalized_text_cover": rf"""WITH {_RAW} SELECT doc_id, CASE WHEN regexp_matches(text, '^(\r\n|[ \t][ \t])') THEN 0 ELSE 1 END::BIGINT AS norm_start, strlen({_NORM})::BIGINT AS norm_stop FROM raw""",
    "owned_text": f"""WITH x AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders), l AS (SELECT doc_id, k, {_LINE} AS line, {_LEVEL} AS level, {_KIND} AS kind FROM x),
p AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS start, (sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS total FROM l),
h0 AS (SELECT *, max(CASE WHEN level < 50 THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS big_k FROM p WHERE level IS NOT NULL),
v AS (SELECT h0.* FROM h0 LEFT JOIN l b ON b.doc_id = h0.doc_id AND b.k = big_k WHERE h0.level < 50 OR b.kind = 'ARTICLE'),
n AS (SELECT doc_id, CASE level WHEN 50 THEN '(2)' WHEN 60 THEN 'a.' ELSE line END AS label, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY k) - 1, total) AS stop FROM v),
f AS (SELECT p.doc_id, any_value(p.total) AS total, min(v.start) AS first FROM p LEFT JOIN v ON v.doc_id = p.doc_id GROUP BY 1)
SELECT * FROM n UNION ALL SELECT doc_id, 'document', 0::BIGINT, coalesce(first - 1, total)::BIGINT FROM f WHERE first IS NULL OR first > 0""",
    "chunk_fit": r"SELECT doc_id, true AS within, true AS counted, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS solid_chars FROM documents WHERE regexp_matches(text, '\S')",
    "question_trace": r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' "dua  kata " ' || chr(233) AS search, 1::INTEGER AS n_nfc FROM conversations WHERE role = 'user'""",
    "question_dates": """WITH e AS (SELECT event_id, event_id % 3 AS m, DATE '2020-01-01' + (event_id % 365)::INTEGER AS day, (ts + INTERVAL 7 HOUR)::DATE AS now FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'AS_OF' WHEN 1 THEN 'CURRENT' ELSE 'COMPARE' END AS mode, 0::INTEGER AS nth, CASE m WHEN 1 THEN now ELSE day END AS date FROM e UNION ALL SELECT event_id, 'COMPARE', 1, day + 30 FROM e WHERE m = 2""",
    "lex_composed": f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(translate(replace(text, 'a', chr(225)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents) GROUP BY 1",
}
