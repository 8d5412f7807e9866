"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bandjoin, binpack, jaccard, linededup, lm, minhash, packing, quality, sharding, spelling, spm, topk, warc
from .common import scratch


def _docs(spark: SparkSession, sf_dir: str, *cols: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(_docs(spark, sf_dir, "doc_id", "text"), "byte_bpe_50k", 2048)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(narrow, 2048)


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir, "doc_id", "text"), limit=SHARD_BYTES).select("doc_id", "shard", "depth", "n_bytes")


def op3_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "vec_id", "embedding", table="embeddings")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_docs(spark, sf_dir, "doc_id", "text", "source"))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left"]
    return out.select(*cols)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    warc.write_archive(_docs(spark, sf_dir, "page_id", "url", "html", table="pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = spm.encode(_docs(spark, sf_dir, "doc_id", "text"), "piece_bpe_32k.model")
    back = spm.decode(encoded, "piece_bpe_32k.model")
    n = (F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", n.alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "packed")
    binpack.write_matrix(binpack.pack_matrix(_docs(spark, sf_dir, "doc_id", "text"), "byte_bpe_multi_50k", 2048), path)
    packed = spark.read.parquet(path)
    return packed.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "docs", "pieces", "starts")


def op7_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir, "doc_id", "text"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), k=3, pct=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    out = linededup.LineDedup(spark, min_docs=10).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir, "doc_id", "text"), least=5, min_n=3, times=2)


def op12_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(_docs(spark, sf_dir, "doc_id", "text"), k=4, pct=85)


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir, "sale_id", "line_no", "item_id", "quantity", "amount", table="sale_lines")
    return bandjoin.near_prices(lines, _docs(spark, sf_dir, "item_id", "price", table="items"), top=10, within=50, per_mille=5)


#: Bytes of text a shard may hold in op2.
SHARD_BYTES = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_extendible_sharding": op2_extendible_sharding,
    "op3_bit_sliced_topk": op3_bit_sliced_topk,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc_archive": op5_warc_archive,
    "op6_suffix_sentencepiece": op6_suffix_sentencepiece,
    "op7_log_bilinear_lm": op7_log_bilinear_lm,
    "op8_packed_matrix": op8_packed_matrix,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vertical_jaccard": op12_vertical_jaccard,
    "op13_band_join": op13_band_join,
}

_TRIM = r"regexp_replace(regexp_replace({0}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
#: CRC-32 of the UTF-8 text of {0}, unsigned, a bit at a time.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode({0}))), lambda i:
    ('0x' || substr(hex(encode({0})), (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_bit_sliced_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY 1),
ln AS (SELECT doc_id, source, sha256(text) AS sha, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
       FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
lines AS (SELECT *, {_LOWER.format(_TRIM.format("l"))} AS k FROM ln WHERE len(lw) > 0),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM lines GROUP BY 1, 2) GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT sha256(text)) AS docs FROM d GROUP BY 1),
freq AS (SELECT source, k, count(DISTINCT sha) AS n FROM lines GROUP BY 1, 2),
hot AS (SELECT f.source, f.k FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
        WHERE f.n > 20 AND f.n > 0.02e0 * h.docs),
gone AS (SELECT doc_id, sum(len(lw)) AS n FROM lines l JOIN hot h ON l.source IS NOT DISTINCT FROM h.source AND l.k = h.k GROUP BY 1),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                (len(ws) - coalesce(gone.n, 0))::BIGINT AS n_left
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.2e0 * n_words AS kept
FROM base""",
    "op2_extendible_sharding": """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS a FROM documents),
p AS (SELECT doc_id, n_bytes, a, k, substr(a, 1, k) AS shard FROM (SELECT *, unnest(range(0, 61)) AS k FROM d)),
s AS (SELECT shard FROM p GROUP BY 1 HAVING sum(n_bytes) <= 1048576 OR min(a) = max(a)),
f AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, min(k) AS depth, min_by(shard, k) AS shard FROM p SEMI JOIN s USING (shard) GROUP BY 1)
SELECT doc_id, shard, depth::BIGINT AS depth, n_bytes FROM f""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to FROM m""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(_TRIM.format("line"))} AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY 1""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z" + chr(0xC0) + "-" + chr(0xFF) + "]+'))")} AS run FROM documents),
h AS (SELECT run, {_CRC.format("(doc_id || ':' || run)")} AS h FROM r WHERE length(run) > 4),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*)::BIGINT AS n FROM w WHERE length(word) > 4 GROUP BY 1 HAVING count(*) > 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
b AS (SELECT word, count(*)::BIGINT AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
      FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM t JOIN f ON f.form = t.word)
SELECT f.*, root FROM f JOIN t USING (word)""",
    "op12_vertical_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op13_band_join": rf"""
WITH l AS (SELECT *, (2 * a + q - (2 * a + q) % (2 * q)) // (2 * q) AS u FROM (
             SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines
             WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity >= 1 AND isfinite(amount))),
c AS (SELECT *, {_CRC.format("(sale_id || ',' || line_no || ',' || line_item_id)")} AS crc FROM l),
i AS (SELECT item_id, CASE WHEN isfinite(price) THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
j AS (SELECT i.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc
      FROM i JOIN c ON line_item_id <> i.item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
s AS (SELECT item_id, count(*)::BIGINT AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM j GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM j) WHERE rank <= 10)
SELECT item_id, coalesce(rank, 0)::INTEGER AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs,
       coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s USING (item_id) LEFT JOIN r USING (item_id)""",
}
