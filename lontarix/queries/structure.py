"""Structure, page and record-quality family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import heading_kind, heading_level, is_roman, normalize_text
from ..operators import quality, structure, tables
from ..session import table
from ..sources import store


#: Markup that is put behind each page, in turn.
EXTRAS = (
    "<p>caf&eacute; &#233;&#xE9; &hellip;&nbsp;x &amp;amp; &lt;b&gt;</p>",
    "<table><tr><td> Status :</td><td><b>Masih</b> berlaku</td></tr><tr><td>STATUS<td>Masih berlaku<tr><td>Status</td><td>dicabut</td></table>",
    "<div>Tahun<br><span>20<i>24</i></span></div><dl><dt>Nomor :<dd>12<dt>Lainnya<dd>13</dl><div>Judul <!-- x --> lain<b>y</b></div>",
    "<a href='../z'>a</a><A HREF=./w>b</a><a href=\"?q=1&amp;r=2\">c</a><iframe src=\"//cdn.example/x#f\"></iframe><object data='sub/../y'></object><a href=\"mailto:x@y\">m</a><a href=\"#top\">t</a><a href=\"/%zz\">bad</a><a href=\"../z\">again</a>",
    "<a href=\"/unduh/1\">u</a><a href=\"v?file=/f/Uji.PDF\">v</a><a href=\"/DownloadUjiMateri/2/download/3\">w</a><a href=\"/id/details/9\">d</a><a rel=next href=\"?p=2\">&rsaquo;</a><a href=\"?p=3\"> Selanjutnya </a><a href=\"https://other.example/?p=4\">Next</a>",
    "",
)


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Documents as a converter leaves them: CRLF ends, wide spaces, soft hyphens, ligatures."""
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit("tion"), F.lit("ti­on"))
    return table(s, d, "documents").select("doc_id", F.concat(F.replace(t, F.lit(", "), F.lit(",\t  ")), F.lit("\rﬁn ﬄ")).alias("text"))


def text_normalize(s, d):
    t = normalize_text("text")
    return _raw(s, d).select("doc_id", F.sha2(t, 256).alias("normalized_sha256"), F.octet_length(t).cast("long").alias("n_bytes"))


def byte_map(s, d):
    """The map tiles both texts: its spans' bytes add up to theirs and neighbours touch."""
    m = structure.whole_maps(_raw(s, d))
    gaps = F.filter("raw_start", lambda x, i: x != F.coalesce(F.get("raw_stop", i - 1), F.lit(0)))
    return m.select("doc_id", F.array_max("raw_stop").alias("raw_bytes"), F.array_max("norm_stop").alias("n_bytes"), F.size(gaps).cast("long").alias("n_gaps"))


def _line(n: F.Column) -> F.Column:
    kinds = F.array(F.concat(F.lit("BAB "), n.cast("string")), F.concat(F.lit("Pasal "), n.cast("string")), F.lit("a. huruf"), F.lit("Bagian Kesatu"), F.concat(F.lit("menurut Pasal "), n.cast("string")), F.lit("(2) ayat"), F.lit("PENJELASAN"))
    return F.element_at(kinds, (n % 7 + 1).cast("int"))


def headings(s, d):
    o = table(s, d, "orders").select("o_orderkey", _line(F.col("o_orderkey")).alias("line"))
    return o.select("o_orderkey", heading_level("line").alias("level"), heading_kind("line").alias("kind"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """A text a customer: a line an order."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return o.select("doc_id", F.array_join(F.transform("ks", _line), "\n").alias("text"))


def structure_tree(s, d):
    return structure.trees(_documents(s, d)).where("no > 0").select("doc_id", "kind", "label", "level", "parent_label", "parent_start", "start", "stop")


def chunk_split(s, d):
    """Chunks stay within both limits, and together they hold all that isn't white space."""
    c = structure.chunks(table(s, d, "documents"))
    new = F.expr("decode(substring(encode(body, 'UTF-8'), cast(overlap + 1 as int)), 'UTF-8')")
    return c.groupBy("doc_id").agg((F.max(F.col("stop") - F.col("start")) <= structure.MAX_CHUNK_BYTES).alias("within_bytes"), (F.max("tokens") <= structure.MAX_CHUNK_TOKENS).alias("within_tokens"), F.sum(F.length(F.regexp_replace(new, r"\s+", ""))).alias("solid_chars"))


def preview_windows(s, d):
    return structure.windows(table(s, d, "documents"))


def windows_lateral(s, d):
    """The same windows by a table function in SQL."""
    tables.register(s)
    return s.sql("SELECT d.doc_id, w.start, w.stop FROM {docs} d, LATERAL text_windows(d.text) w", docs=table(s, d, "documents").select("doc_id", "text"))


def embedding_input(s, d):
    c = table(s, d, "conversations")
    labels = F.when(F.col("turn") > 0, F.array(F.upper("role"), F.col("conv_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    text = structure.render_input(labels, F.col("text"))
    return c.select("conv_id", "turn", F.sha2(text, 256).alias("input_sha256"), F.sha2(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit("|model-v1")), 256).alias("reuse_key"))


def roman_check(s, d):
    """Numbers written in Roman numerals and then damaged for every third."""
    n = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 13 + 1).cast("int").alias("n"))
    names = F.array(*(F.lit(x) for x in "I II III IV V VI VII VIII IX X XI XII XIII".split()))
    text = F.concat(F.element_at(names, F.col("n")), F.when(F.col("p_partkey") % 3 == 0, "IIII").otherwise(""))
    return n.select("p_partkey", is_roman(text).alias("ok"))


def unit_projection(s, d):
    """From a turn's first unit to its last: the turn without the white space around it."""
    turns = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.concat(F.lit(" \n"), "text", F.lit("  ")).alias("text"))
    units = structure.unit_spans(turns)
    ranges = units.groupBy("doc_id").agg(F.min("unit").alias("first"), F.max("unit").alias("last"))
    return structure.project_units(ranges, units).select("doc_id", "start", "stop")


def duplicate_ordinal(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", heading_kind(_line(F.col("o_orderkey"))).alias("kind")).where("kind IS NOT NULL")
    return o.withColumn("ordinal", F.expr("row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) - 1"))


def phrase_priority_sample(s, d):
    """Documents ranked by the first of the phrases that they hold, one a text, at least 80 characters."""
    return quality.by_phrase(table(s, d, "documents").where("length(trim(text)) >= 80"), "text", ["the and", "ing", "en la"], "doc_id", 60)


def index_reuse(s, d):
    """Languages whose documents are the same in two builds may be used again."""
    a = table(s, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h"))
    return quality.reusable(a, a.withColumn("h", F.when((F.col("lang") == "de") & (F.col("doc_id") % 100 < 30), "new").otherwise(F.col("h"))), "lang")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages with what portals have besides: references to characters, cells and lists of labels, links of all kinds."""
    more = F.element_at(F.array(*map(F.lit, EXTRAS)), (F.col("page_id") % len(EXTRAS) + 1).cast("int"))
    return html.parse_pages(table(s, d, "pages").select("page_id", "url", F.concat("html", more).alias("html")))


def html_title(s, d):
    return _pages(s, d).select("page_id", "title")


def html_text(s, d):
    return _pages(s, d).select("page_id", F.sha2("text", 256).alias("text_sha256"))


def html_links(s, d):
    p = _pages(s, d).select("page_id", F.posexplode("links").alias("pos", "target"))
    return p.select("page_id", "target", F.col("pos").cast("long").alias("first_pos"))


def html_parse(s, d):
    p = _pages(s, d)
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, "|"))), ";")
    lists = {c: F.array_join(c, " ") for c in ("documents", "related", "details", "next")}
    return p.select("page_id", "title", F.sha2(F.array_join("links", "\n"), 256).alias("links_sha256"), fields.alias("fields"), F.sha2("text", 256).alias("text_sha256"), *(v.alias(c) for c, v in lists.items()))


def link_discovery(s, d):
    """Link targets of all pages that no page has as its own URL yet."""
    found = html_links(s, d).groupBy("target").agg(F.count("*").alias("n_pages"))
    return found.join(table(s, d, "pages").select(F.col("url").alias("target")).distinct(), "target", "left_anti")


def field_rule_issues(s, d):
    e = table(s, d, "events").withColumn("name", F.when(F.col("event_id") % 50 == 0, F.concat("event_type", F.lit(" "))).otherwise(F.col("event_type"))).withColumn("p", F.col("value") / 100)
    return quality.issues(e, "event_id", [("name", "ascii_id"), ("p", "probability"), ("value", "positive"), ("props", "required"), ("name", "sha256")])


def _filters(s: SparkSession, d: str) -> DataFrame:
    f = F.struct(F.col("l_partkey").alias("version"), F.col("l_suppkey").alias("blob"), F.col("l_returnflag").alias("regulation"))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(f).alias("filters"), F.min("l_partkey").alias("low"), F.max("l_suppkey").alias("high"), F.max("l_partkey").alias("top"))


def nested_any_match(s, d):
    return _filters(s, d).select("l_orderkey", quality.any_version(F.col("filters"), F.col("low") + F.col("l_orderkey") % 2).alias("hit"))


def paired_triple_match(s, d):
    """Smallest version, largest blob and flag A need not belong together."""
    return _filters(s, d).select("l_orderkey", quality.any_triple(F.col("filters"), F.col("high"), F.col("low"), F.lit("A")).alias("hit"))


def filter_admission(s, d):
    wanted = F.array("low", F.col("top") + F.when(F.col("l_orderkey") % 5 == 0, 100_000_000).otherwise(0))
    return _filters(s, d).select("l_orderkey", quality.admitted(F.col("filters"), wanted).alias("admitted"))


def stratified_sample(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large").alias("size"))
    return quality.stratified(docs, ["source", "size"], "doc_id", "seed-1", 120)


def exact_field(s, d):
    """Market segments of a nation's customers with odd spellings, as values of one field."""
    c = table(s, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.initcap("c_mktsegment"))).otherwise(F.col("c_mktsegment")))
    rows = c.select((F.col("c_custkey") % 400).alias("record"), F.col("c_nationkey").alias("field"), "v")
    return quality.exact_field(rows, "record", "field", "v")


def page_classes(s, d):
    docs = table(s, d, "documents").select("source", quality.page_class(F.col("n_chars") % 200, F.col("doc_id") % 3).alias("class"))
    g = docs.groupBy("source").agg(*(F.count_if(F.col("class") == c).alias(n) for c, n in (("text", "n_text"), ("scan_candidate", "n_scan"), ("sparse", "n_sparse"))))
    return g.select("source", "n_text", "n_scan", "n_sparse", quality.document_class(F.col("n_text"), F.col("n_scan"), F.col("n_sparse")).alias("class"))


def inventory_audit(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.count("quality").alias("n_labelled"), F.sum("n_chars").alias("n_chars"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"))


def identity_collisions(s, d):
    c = table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return c.where("n > 1")


def orphan_blobs(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob"))
    used = docs.join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("blob")
    return docs.select("blob").distinct().join(used, "blob", "left_anti")


def exact_dup_groups(s, d):
    g = table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep"))
    return g.where("n > 1")


def blob_references(s, d):
    """Documents are blobs of snapshots 0 to 6, a tenth of them of the next one too; snapshot 6 is active, snapshot 2 is leased."""
    docs = table(s, d, "documents").select((F.col("doc_id") % 7).alias("snapshot"), F.sha2("text", 256).alias("sha256"), "doc_id")
    held = docs.where("doc_id % 9 <> 4").select("snapshot", "sha256").unionByName(docs.where("doc_id % 10 = 0").select((F.col("snapshot") + 1).alias("snapshot"), "sha256"))
    return store.references(held, docs, [2, 6])


def readback_diff(s, d):
    e = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a = e.where("s_suppkey % 10 <> 1").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 2, 0.0).otherwise(F.col("s_acctbal")))
    extra = e.where("s_suppkey % 10 = 3").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return quality.state_diff(e, a.unionByName(extra), ["s_suppkey"])


QUERIES = {f.__name__: f for f in (preview_windows, windows_lateral, unit_projection, duplicate_ordinal, phrase_priority_sample, index_reuse, text_normalize, byte_map, headings, structure_tree, chunk_split, embedding_input, roman_check, html_title, html_text, html_links, html_parse, link_discovery, field_rule_issues, nested_any_match, paired_triple_match, filter_admission, stratified_sample, exact_field, page_classes, inventory_audit, identity_collisions, orphan_blobs, exact_dup_groups, readback_diff, blob_references)}

_RAW = "raw AS (SELECT doc_id, replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), 'tion', 'ti' || chr(173) || 'on'), ', ', ',' || chr(9) || '  ') || chr(13) || 'ﬁn ﬄ' AS text FROM documents)"
_NORM = r"replace(replace(replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), chr(173), ''), 'ﬁ', 'fi'), 'ﬄ', 'ffl')"
_LINE = "CASE k % 7 WHEN 0 THEN 'BAB ' || k WHEN 1 THEN 'Pasal ' || k WHEN 2 THEN 'a. huruf' WHEN 3 THEN 'Bagian Kesatu' WHEN 4 THEN 'menurut Pasal ' || k WHEN 5 THEN '(2) ayat' ELSE 'PENJELASAN' END"
_LEVEL = "CASE k % 7 WHEN 0 THEN 10 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 20 WHEN 5 THEN 50 WHEN 6 THEN 5 END"
_KIND = "CASE k % 7 WHEN 0 THEN 'CHAPTER' WHEN 1 THEN 'ARTICLE' WHEN 2 THEN 'ITEM' WHEN 3 THEN 'PART' WHEN 5 THEN 'PARAGRAPH' WHEN 6 THEN 'EXPLANATION' END"
_EXTRA = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in EXTRAS) + "][page_id % 6 + 1]"
_DECODE = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&eacute;", "é"), ("&#233;", "é"), ("&#xE9;", "é"), ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·"), ("&rsaquo;", "›"), ("&amp;", "&"))
_TEXT = r"regexp_replace(regexp_replace(regexp_replace({}, '<(script|style)\b.*?</(?:script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
#: A reference may lack its semicolon, as one does that an element's end cuts off, where its name is one of those that HTML knows without.
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '&(amp|quot|nbsp|eacute|middot);?', '&\1;', 'g'), '&(lt|gt|copy|#39|#233)\b;?', '&\1;', 'g')"
for _a, _b in _DECODE:
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))"
_TITLE = _TEXT.format(r"regexp_extract(html, '<h1\b[^>]*>(.*?)</h1>', 1, 'is')")
_ESCAPED = r"CASE WHEN regexp_matches({0}, '[^A-Za-z0-9\-_.~!$&''()*+,;=:@\[\]/%]') THEN list_aggregate(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9\-_.~$&+,/:;=@]') THEN c ELSE url_encode(c) END), 'string_agg', '') ELSE {0} END"
#: Links by the rules for relative references: the page's own are all absolute paths, those put behind are worked out by hand.
_LINKS = r'''b AS (SELECT page_id, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract(url, '^https?:') AS scheme, regexp_replace(url, '[?#].*$', '') AS whole, regexp_replace(url, '#.*$', '') AS page FROM pages),
dir AS (SELECT *, regexp_replace(whole, '[^/]*$', '') AS f, regexp_replace(regexp_replace(whole, '[^/]*$', ''), '[^/]+/$', '') AS up FROM b),
h AS (SELECT page_id, o || ''' + _ESCAPED.format("href") + r''' AS target, pos FROM (SELECT page_id, o, unnest(x) AS href, generate_subscripts(x, 1) AS pos FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM dir))
UNION ALL SELECT page_id, unnest(CASE page_id % 6
  WHEN 3 THEN [CASE WHEN f = o || '/' THEN f ELSE up END || 'z', f || 'w', whole || '?q=1&r=2', scheme || '//cdn.example/x', f || 'y', page]
  WHEN 4 THEN [o || '/unduh/1', f || 'v?file=/f/Uji.PDF', o || '/DownloadUjiMateri/2/download/3', o || '/id/details/9', whole || '?p=2', whole || '?p=3', 'https://other.example/?p=4'] ELSE [] END), unnest(range(1001, 1008)) FROM dir),
lk AS (SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS first_pos FROM h WHERE target IS NOT NULL GROUP BY 1, 2)'''

_WINDOWS = r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS a, length(text) AS n, substr(text, 1, 1600) AS x FROM documents WHERE length(text) > 0 UNION ALL
SELECT doc_id, text, b, n, substr(text, b + 1, 1600) FROM (SELECT doc_id, text, n, CASE WHEN z - 160 > a THEN z - 160 ELSE z END AS b FROM (
SELECT *, CASE WHEN a + 1600 >= n THEN n WHEN strpos(reverse(x), chr(10)) > 0 AND strlen(substr(x, 1, 1600 - strpos(reverse(x), chr(10)))) > strlen(x) // 2 THEN a + 1601 - strpos(reverse(x), chr(10)) ELSE a + 1600 END AS z FROM w) WHERE z < n)),
e AS (SELECT *, CASE WHEN a + 1600 >= n THEN n WHEN strpos(reverse(x), chr(10)) > 0 AND strlen(substr(x, 1, 1600 - strpos(reverse(x), chr(10)))) > strlen(x) // 2 THEN a + 1601 - strpos(reverse(x), chr(10)) ELSE a + 1600 END AS z FROM w)
SELECT doc_id, strlen(substr(text, 1, a))::BIGINT AS start, strlen(substr(text, 1, z))::BIGINT AS stop FROM e WHERE strlen(regexp_replace(regexp_replace(substr(text, a + 1, z - a), '^\s+', ''), '\s+$', '')) >= 60"""

ORACLES = {
    "text_normalize": f"WITH {_RAW}, n AS (SELECT doc_id, {_NORM} AS t FROM raw) SELECT doc_id, sha256(t) AS normalized_sha256, strlen(t)::BIGINT AS n_bytes FROM n",
    "byte_map": f"WITH {_RAW} SELECT doc_id, strlen(text)::BIGINT AS raw_bytes, strlen({_NORM})::BIGINT AS n_bytes, 0::BIGINT AS n_gaps FROM raw",
    "headings": f"WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, {_LEVEL} AS level, {_KIND} AS kind FROM x",
    "structure_tree": f"""WITH x AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders), l AS (SELECT doc_id, k, {_LINE} AS line, {_LEVEL} AS level, {_KIND} AS kind FROM x),
p AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS start, (sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS total FROM l),
h0 AS (SELECT *, max(CASE WHEN level < 50 THEN k END) OVER w AS lead40, max(CASE WHEN level < 50 THEN kind END) OVER (PARTITION BY doc_id, k) AS z FROM p WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
h1 AS (SELECT h0.*, b.kind AS big FROM h0 LEFT JOIN l b ON b.doc_id = h0.doc_id AND b.k = h0.lead40),
v AS (SELECT * FROM h1 WHERE level < 50 OR big = 'ARTICLE'),
m AS (SELECT a.doc_id, a.k, any_value(a.kind) AS kind, any_value(CASE a.level WHEN 50 THEN '(2)' WHEN 60 THEN 'a.' ELSE a.line END) AS label, any_value(a.level) AS level, any_value(a.start) AS start, any_value(a.total) AS total,
max(b.k) FILTER (b.k < a.k AND b.level < a.level) AS pk, min(b.start) FILTER (b.k > a.k AND b.level <= a.level) AS nx FROM v a JOIN v b ON a.doc_id = b.doc_id GROUP BY 1, 2)
SELECT m.doc_id, m.kind, m.label, m.level, coalesce(CASE q.level WHEN 50 THEN '(2)' WHEN 60 THEN 'a.' ELSE q.line END, 'document') AS parent_label, coalesce(q.start, 0)::BIGINT AS parent_start, m.start, coalesce(nx, m.total)::BIGINT AS stop
FROM m LEFT JOIN v q ON q.doc_id = m.doc_id AND q.k = m.pk""",
    "chunk_split": r"SELECT doc_id, true AS within_bytes, true AS within_tokens, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS solid_chars FROM documents WHERE length(text) > 0",
    "embedding_input": """WITH i AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'Konteks: ' || upper(role) || ' > ' || conv_id || chr(10) || 'Teks: ' || text ELSE text END AS t FROM conversations)
SELECT conv_id, turn, sha256(t) AS input_sha256, sha256(length(t) || ':' || t || '|model-v1') AS reuse_key FROM i""",
    "roman_check": "SELECT p_partkey, p_partkey % 3 <> 0 AS ok FROM part",
    "preview_windows": _WINDOWS,
    "windows_lateral": _WINDOWS,
    "unit_projection": r"SELECT conv_id || '-' || turn AS doc_id, (2 + strlen(regexp_extract(text, '^\s*')))::BIGINT AS start, (2 + strlen(regexp_replace(text, '\s+$', '')))::BIGINT AS stop FROM conversations WHERE regexp_matches(text, '\S')",
    "duplicate_ordinal": f"WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey AS k FROM orders), y AS (SELECT o_custkey, o_orderkey, {_KIND} AS kind FROM x) SELECT *, (row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) - 1)::INTEGER AS ordinal FROM y WHERE kind IS NOT NULL",
    "phrase_priority_sample": """WITH d AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the and') THEN 0 WHEN contains(lower(text), 'ing') THEN 1 WHEN contains(lower(text), 'en la') THEN 2 END AS priority, sha256(text) AS sha FROM documents WHERE length(trim(text)) >= 80),
o AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM d WHERE priority IS NOT NULL) SELECT doc_id, priority::INTEGER AS priority FROM o WHERE n = 1 ORDER BY priority, sha LIMIT 60""",
    "index_reuse": "SELECT lang, lang <> 'de' OR count(*) FILTER (doc_id % 100 < 30) = 0 AS reusable FROM documents GROUP BY 1",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_text": f"SELECT page_id, sha256({_TEXT.format('html || ' + _EXTRA)}) AS text_sha256 FROM pages",
    "html_links": f"WITH {_LINKS} SELECT * FROM lk",
    "html_parse": f"""WITH {_LINKS}, l AS (SELECT page_id, string_agg(target, chr(10) ORDER BY first_pos) AS l FROM lk GROUP BY 1)
SELECT page_id, {_TITLE} AS title, sha256(l) AS links_sha256, sha256({_TEXT.format('html || ' + _EXTRA)}) AS text_sha256,
CASE page_id % 6 WHEN 1 THEN 'portal_status=Masih berlaku|dicabut' WHEN 2 THEN 'number=12;title=y;year=20 24' ELSE '' END AS fields,
CASE page_id % 6 WHEN 4 THEN o || '/unduh/1 ' || o || '/f/Uji.PDF' ELSE '' END AS documents, CASE page_id % 6 WHEN 4 THEN o || '/DownloadUjiMateri/2/download/3' ELSE '' END AS related,
CASE page_id % 6 WHEN 4 THEN o || '/id/details/9' ELSE '' END AS details, CASE page_id % 6 WHEN 4 THEN whole || '?p=2 ' || whole || '?p=3' ELSE '' END AS next FROM dir JOIN l USING (page_id)""",
    "link_discovery": f"WITH {_LINKS} SELECT target, count(*)::BIGINT AS n_pages FROM lk WHERE target NOT IN (SELECT url FROM pages) GROUP BY 1",
    "field_rule_issues": """SELECT event_id, 'name' AS field, 'ascii_id' AS rule FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'p', 'probability' FROM events WHERE value / 100 > 1 OR value < 0
UNION ALL SELECT event_id, 'value', 'positive' FROM events WHERE NOT value > 0 UNION ALL SELECT event_id, 'props', 'required' FROM events WHERE props IS NULL OR props = '' UNION ALL SELECT event_id, 'name', 'sha256' FROM events""",
    "nested_any_match": "WITH m AS (SELECT l_orderkey, min(l_partkey) + l_orderkey % 2 AS v FROM lineitem GROUP BY 1) SELECT m.l_orderkey, bool_or(l_partkey = v) AS hit FROM m JOIN lineitem l ON l.l_orderkey = m.l_orderkey GROUP BY 1",
    "paired_triple_match": "WITH m AS (SELECT l_orderkey, min(l_partkey) AS v, max(l_suppkey) AS b FROM lineitem GROUP BY 1) SELECT m.l_orderkey, bool_or(l_partkey = v AND l_suppkey = b AND l_returnflag = 'A') AS hit FROM m JOIN lineitem l ON l.l_orderkey = m.l_orderkey GROUP BY 1",
    "filter_admission": "SELECT l_orderkey, l_orderkey % 5 <> 0 AND count(DISTINCT (l_partkey, l_suppkey)) = count(*) AS admitted FROM lineitem GROUP BY 1",
    "stratified_sample": """WITH x AS (SELECT doc_id, source, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY sha256('seed-1' || chr(31) || doc_id))::INTEGER AS turn FROM x) SELECT * FROM r ORDER BY turn, source, size LIMIT 120""",
    "exact_field": r"""WITH c AS (SELECT c_custkey % 400 AS record, c_nationkey AS field, CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE c_mktsegment END AS v FROM customer)
SELECT record, field, CASE WHEN count(DISTINCT lower(trim(v))) = 1 THEN min(v) END AS value, CASE WHEN count(DISTINCT lower(trim(v))) = 1 THEN 'EXACT' ELSE 'CONFLICT' END AS state FROM c GROUP BY 1, 2""",
    "page_classes": """WITH x AS (SELECT source, CASE WHEN n_chars % 200 >= 80 THEN 't' WHEN n_chars % 200 <= 20 AND doc_id % 3 > 0 THEN 's' ELSE 'p' END AS c FROM documents),
g AS (SELECT source, count(*) FILTER (c = 't')::BIGINT AS n_text, count(*) FILTER (c = 's')::BIGINT AS n_scan, count(*) FILTER (c = 'p')::BIGINT AS n_sparse FROM x GROUP BY 1)
SELECT *, CASE WHEN n_text > 0 AND n_scan > 0 THEN 'mixed_candidate' WHEN n_scan > 0 THEN 'scan_candidate' WHEN n_text > 0 THEN 'text_candidate' WHEN n_sparse > 0 THEN 'sparse_or_blank' ELSE 'empty' END AS class FROM g""",
    "inventory_audit": "SELECT source, count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS n_langs, count(quality)::BIGINT AS n_labelled, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT sha256(text))::BIGINT AS n_texts FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "identity_collisions": "SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_blobs": "SELECT DISTINCT sha256(text) AS blob FROM documents EXCEPT SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "exact_dup_groups": "SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1",
    "blob_references": """WITH d AS (SELECT doc_id, doc_id % 7 AS s, sha256(text) AS sha256 FROM documents),
h AS (SELECT s, sha256 FROM d WHERE doc_id % 9 <> 4 UNION SELECT s + 1, sha256 FROM d WHERE doc_id % 10 = 0), c AS (SELECT sha256, count(*) AS n, count(*) FILTER (s IN (2, 6)) AS l FROM h GROUP BY 1)
SELECT DISTINCT sha256, coalesce(n, 0)::BIGINT AS n_refs, coalesce(l, 0)::BIGINT AS n_live FROM d LEFT JOIN c USING (sha256)""",
    "readback_diff": "SELECT s_suppkey, CASE s_suppkey % 10 WHEN 1 THEN 'MISSING' ELSE 'CHANGED' END AS state FROM supplier WHERE s_suppkey % 10 = 1 OR (s_suppkey % 10 = 2 AND s_acctbal <> 0) UNION ALL SELECT s_suppkey + 1000000, 'EXTRA' FROM supplier WHERE s_suppkey % 10 = 3",
}
