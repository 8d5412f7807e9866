"""Evidence family over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import span_of_quote, terms, trusted_url
from ..operators import evidence as ev
from ..session import table
from ..sources.shared import dealt


def line_spans(s, d):
    return ev.lines_of(table(s, d, "documents"), texts=False).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start", "stop")


def _windows(s: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("(octet_length(text) - 1) div 700"))).alias("w"), size.alias("size")).where("size > 0").select("doc_id", "w", (F.col("w") * 700).cast("long").alias("a_start"), F.least(F.col("w") * 700 + 1000, F.col("size")).cast("long").alias("a_stop"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    return ev.lines_of(table(s, d, "documents"), texts=False).where("stop > start").select("doc_id", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))


def evidence_overlap(s, d):
    found = ev.overlaps(_windows(s, d), _spans(s, d), "doc_id")
    size = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    return found.groupBy("doc_id", "w").agg(F.count("*").alias("n_lines"), F.sum(size).alias("overlap_bytes"))


def evidence_contained(s, d):
    return ev.contained(_spans(s, d), _windows(s, d), "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n_lines"))


def span_coverage(s, d):
    """How far the lines of at least 40 bytes cover each document from its start."""
    docs = table(s, d, "documents").select("doc_id", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop"))
    parts = ev.lines_of(table(s, d, "documents"), texts=False).where("stop - start >= 40").select("doc_id", F.col("start").alias("p_start"), (F.col("stop") + 1).alias("p_stop"))
    return ev.coverage(docs, parts, "doc_id")


def context_pack(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn", F.size(terms("text")).alias("tokens"))
    return ev.pack(turns, "conv_id", "turn", "tokens", 60)


def context_render(s, d):
    c = table(s, d, "conversations")
    block = ev.render_block(F.concat_ws("-", "conv_id", "turn"), F.array("conv_id", "turn"), F.upper("role"), F.col("text"))
    return c.select("conv_id", "turn", F.sha2(block, 256).alias("block_sha256"))


def claim_tiling(s, d):
    """Lines as claims; every fifth loses its first three characters, every seventh reaches one too far."""
    docs = table(s, d, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    rows = rows.withColumn("stop", F.expr("sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1"))
    rows = rows.withColumn("start", F.col("stop") - F.length("line") + F.when(F.col("n") % 5 == 4, 3).otherwise(0))
    rows = rows.withColumn("stop", F.col("stop") + F.when(F.col("n") % 7 == 6, 2).otherwise(0)).where("start < stop")
    return ev.tiling(rows.select("doc_id", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")), docs.select("doc_id", "text"), "doc_id")


def citation_map(s, d):
    """Orders cite the pages their line items' parts point to."""
    claims = table(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_partkey") % 300).alias("source_id"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + F.col("l_quantity") % 3).cast("long").alias("stop"))
    sources = table(s, d, "pages").select(F.col("page_id").alias("source_id"), "url")
    return ev.cite(claims, sources, 3)


def hydration(s, d):
    hits = table(s, d, "labels").select(F.col("doc_id").alias("key"), "quality")
    records = table(s, d, "documents").where("doc_id % 7 <> 3").select(F.col("doc_id").alias("key"), "source")
    texts = table(s, d, "documents").where("doc_id % 5 <> 2").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("slice"))
    return ev.hydrate(hits, records, texts)


def chunk_provenance(s, d):
    # Dealt out before they are grouped: the chunks of a whole split are too many for one task.
    lines = dealt(table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    chunks = lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.collect_list("l_partkey").alias("version_ids"))
    versions = table(s, d, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("source_id"))
    return ev.provenance(chunks, versions)


def quote_align(s, d):
    """The first line of each document as a quote between what stands around it, where that occurs once."""
    docs = table(s, d, "documents").withColumn("quote", F.substring_index("text", "\n", 1)).withColumn("suffix", F.lit("\n"))
    span = span_of_quote(F.col("text"), F.lit(""), F.col("quote"), F.col("suffix"))
    return docs.select("doc_id", span.alias("span")).select("doc_id", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"))


def url_trust(s, d):
    broken = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("://"), F.lit("://me@"))).when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    return table(s, d, "pages").select("page_id", trusted_url(broken).alias("trusted"))


QUERIES = {f.__name__: f for f in (line_spans, evidence_overlap, evidence_contained, span_coverage, context_pack, context_render, claim_tiling, citation_map, hydration, chunk_provenance, quote_align, url_trust)}

_SP = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
sp AS (SELECT doc_id, line_no, line, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 - strlen(line))::BIGINT AS start,
(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::BIGINT AS stop FROM ln),
win AS (SELECT doc_id, w, w * 700 AS a, least(w * 700 + 1000, strlen(text)) AS z FROM (SELECT *, unnest(range(0, (strlen(text) - 1) // 700 + 1)) AS w FROM documents WHERE strlen(text) > 0))"""
_TOK = r"len(regexp_extract_all(text, '(?:\p{L}+(?:-\p{L}+)*|[0-9]+(?:/[0-9]+)*)+'))"

ORACLES = {
    "line_spans": f"WITH {_SP} SELECT doc_id, line_no::BIGINT AS line_no, start, stop FROM sp",
    "evidence_overlap": f"WITH {_SP} SELECT doc_id, w, count(*)::BIGINT AS n_lines, sum(least(z, stop) - greatest(a, start))::BIGINT AS overlap_bytes FROM win JOIN sp USING (doc_id) WHERE start < stop AND start < z AND stop > a GROUP BY 1, 2",
    "evidence_contained": f"WITH {_SP} SELECT doc_id, w, count(*)::BIGINT AS n_lines FROM win JOIN sp USING (doc_id) WHERE start < stop AND start >= a AND stop <= z GROUP BY 1, 2",
    "span_coverage": f"""WITH {_SP}, g AS (SELECT d.doc_id, min(CASE WHEN stop - start < 40 THEN start END) AS first_gap, strlen(any_value(text)) AS n FROM documents d JOIN sp USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(least(first_gap, n), n)::BIGINT AS covered_to, coalesce(least(first_gap, n), n) >= n AS complete FROM g""",
    "context_pack": f"""WITH RECURSIVE o AS (SELECT conv_id, turn, {_TOK} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, t <= 60 AS packed, CASE WHEN t <= 60 THEN t ELSE 0 END AS total FROM o WHERE n = 1 UNION ALL
SELECT o.conv_id, o.turn, o.n, f.total + t <= 60, CASE WHEN f.total + t <= 60 THEN f.total + t ELSE f.total END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id, turn, packed, total::BIGINT AS total FROM f""",
    "context_render": r"""SELECT conv_id, turn, sha256('Evidence ' || conv_id || '-' || turn || ' versions [' || conv_id || ',' || turn || '] status_at_knowledge_snapshot [' || upper(role) || '] text "'
|| replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"') AS block_sha256 FROM conversations""",
    "claim_tiling": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
a AS (SELECT doc_id, n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS e, length(line) AS k FROM l),
c AS (SELECT doc_id, e - k + CASE WHEN n % 5 = 4 THEN 3 ELSE 0 END AS s, e + CASE WHEN n % 7 = 6 THEN 2 ELSE 0 END AS e FROM a),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER w, 0) AS prev, lead(s) OVER w IS NULL AS last FROM c WHERE s < e WINDOW w AS (PARTITION BY doc_id ORDER BY s, e))
SELECT doc_id, count(*) FILTER (s < prev)::BIGINT AS n_overlaps, count(*) FILTER (regexp_matches(substr(text, (prev + 1)::BIGINT, greatest(s - prev, 0)::BIGINT), '\S') OR (last AND regexp_matches(substr(text, (e + 1)::BIGINT), '\S')))::BIGINT AS n_gaps
FROM p JOIN documents USING (doc_id) GROUP BY 1""",
    "citation_map": """WITH g AS (SELECT l_orderkey AS claim_id, l_partkey % 300 AS source_id, url, min(CASE WHEN l_quantity % 3 > 0 THEN {'a': l_linenumber::BIGINT, 'b': (l_linenumber + l_quantity % 3)::BIGINT} END) AS sp
FROM lineitem JOIN pages ON page_id = l_partkey % 300 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY source_id)::INTEGER AS n, count(*) OVER (PARTITION BY claim_id) AS k FROM g)
SELECT claim_id, source_id, n, url, CASE WHEN k = 1 THEN sp.a END AS span_start, CASE WHEN k = 1 THEN sp.b END AS span_stop FROM r WHERE n <= 3""",
    "hydration": """SELECT l.doc_id AS key, quality, CASE WHEN l.doc_id % 7 <> 3 THEN source END AS source, CASE WHEN l.doc_id % 5 <> 2 THEN sha256(text) END AS slice,
CASE WHEN l.doc_id % 7 = 3 THEN 'MISSING_RECORD' WHEN l.doc_id % 5 = 2 THEN 'MISSING_TEXT' ELSE 'COMPLETE' END AS state FROM labels l JOIN documents USING (doc_id)""",
    "chunk_provenance": "SELECT l_orderkey AS chunk_id, count(DISTINCT l_partkey)::BIGINT AS n_versions, count(DISTINCT p_brand)::BIGINT AS n_sources FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "quote_align": """WITH q AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS quote FROM documents), w AS (SELECT *, quote || chr(10) AS x FROM q),
f AS (SELECT *, strpos(text, x) AS a, strpos(substr(text, strpos(text, x) + 1), x) AS b FROM w)
SELECT doc_id, CASE WHEN a > 0 AND b = 0 AND length(quote) > 0 THEN strlen(substr(text, 1, a - 1)) END AS start, CASE WHEN a > 0 AND b = 0 AND length(quote) > 0 THEN strlen(substr(text, 1, a - 1)) + strlen(quote) END AS stop FROM f""",
    "url_trust": "SELECT page_id, page_id % 5 <> 0 AND page_id % 7 <> 0 AS trusted FROM pages",
}
