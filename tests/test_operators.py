"""Published small cases and properties of single operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lontarix.functions import html
from lontarix.functions.text import analyzed, checked_terms, heading_of, is_roman, nfc, span_of_quote, surface, terms
from lontarix.operators import evidence, fusion, graph, jobs, lexical, metrics, quality, registry, structure, temporal


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("UU No. 12/2020 Pasal 3 ayat (2)", "uu no 12/2020 pasal 3 ayat 2"),
        ("Undang-Undang dan peraturan-peraturan", "undang-undang dan peraturan-peraturan"),
        ("Ékonomi ékonomi", "Ékonomi ékonomi"),
        ("pasalⅣ berlaku", "pasal berlaku"),
        ("aͅb", "a b"),
        ("...?!", ""),
        ("tidak wajib", "tidak wajib"),
        ("a-/b 1/-2 3/4/5", "a b 1 2 3/4/5"),
    ],
)
def test_analyzer(spark, text, want):
    assert " ".join(one(spark, terms("t"), t=text)) == want


def test_analyzer_nfc_and_limits(spark):
    assert one(spark, terms(nfc("t")), t="Café dan Café") == ["café", "dan", "café"]
    assert one(spark, nfc("t"), t="a" + "̖" * 40).count("͏") == 1
    with pytest.raises(Exception, match="analyzer limit"):
        one(spark, checked_terms("t"), t="x" * 300)


def test_surface_and_roman(spark):
    assert one(spark, surface("t"), t=" PASAL  1 ") == "pasal 1"
    assert [one(spark, is_roman("t"), t=t) for t in ("IV", "XLII", "MMMCMXCIX", "IIII", "", "VX", "iv")] == [True, True, True, False, False, False, False]


def test_bm25_small_case(spark):
    docs = spark.createDataFrame([("v1", "pasal 12/2020 pasal"), ("v3", "tidak wajib pasal")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "Pasal pasal 12/2020 unknown")], "item_id int, text string")
    post, lengths = lexical.postings(docs), lexical.document_lengths(docs)
    df, stats = lexical.document_frequency(post), lexical.corpus_stats(lengths)
    w = {r["term"]: r["weight"] for r in lexical.query_weights(q, df, stats).collect()}
    assert set(w) == {"pasal", "12/2020"}
    assert w["12/2020"] == pytest.approx(math.log(2)) and w["pasal"] == pytest.approx(2 * math.log(1.2))
    assert lexical.out_of_vocabulary(q, df).first()["n_oov"] == 1
    scores = lexical.sparse_scores(lexical.query_weights(q, df, stats), lexical.document_weights(post, lengths, stats))
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    tf = lambda n: n * 2.2 / (n + 1.2)
    assert got["v1"] == pytest.approx(math.log(2) * tf(1) + 2 * math.log(1.2) * tf(2), abs=1e-6)
    empty = lexical.query_weights(spark.createDataFrame([(1, "nothing here")], "item_id int, text string"), df, stats)
    assert empty.count() == 0


def test_dictionary_ids_stay(spark):
    first = lexical.allocate(spark.createDataFrame([], "term string, term_id long, from_revision long"), spark.createDataFrame([("b",), ("a",)], "term string"), 1)
    second = lexical.allocate(first, spark.createDataFrame([("a",), ("c",), ("0",)], "term string"), 2)
    assert {(r["term"], r["term_id"], r["from_revision"]) for r in second.collect()} == {("a", 1, 1), ("b", 2, 1), ("0", 3, 2), ("c", 4, 2)}
    again = lexical.allocate(second, spark.createDataFrame([("a",)], "term string"), 3)
    assert again.count() == 4


def branch(spark, rows):
    return spark.createDataFrame(rows, "question_id int, key string, rank int")


def test_rrf(spark):
    dense, bm25 = branch(spark, [(1, "v1", 1), (1, "v2", 2)]), branch(spark, [(1, "v2", 1), (1, "v1", 2)])
    out = fusion.fuse({"dense": dense, "bm25": bm25}, {"bm25": 2.0}).orderBy("rank").collect()
    assert [r["key"] for r in out] == ["v2", "v1"]
    assert out[0]["provenance"] == "dense:2 bm25:1"
    flipped = fusion.fuse({"bm25": bm25, "dense": dense}, {"bm25": 2.0}).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in flipped] == [(r["key"], r["score"]) for r in out]


@pytest.mark.parametrize("rows", [[(1, "a", 1), (1, "a", 2)], [(1, "a", 1), (1, "b", 1)], [(1, "a", 0)], [(1, "a", 1001)]])
def test_branch_is_rejected(spark, rows):
    with pytest.raises(Exception, match="bad branch"):
        fusion.checked_branch(branch(spark, rows)).collect()


def test_profiles():
    with pytest.raises(ValueError, match="graph"):
        fusion.branches_of("HYBRID_GRAPH", {"dense": None, "bm25": None})


def test_rerank_needs_every_score(spark):
    c = branch(spark, [(1, "a", 1), (1, "b", 2)])
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "question_id int, key string, score double")
    assert [r["key"] for r in fusion.rerank(c, s).orderBy("new_rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="without a score"):
        fusion.rerank(c, s.where("key = 'a'")).collect()


def test_metrics(spark):
    found = spark.createDataFrame([(1, "b", 1, 2), (1, "a", 2, 3), (1, "c", 3, 0)], "query_id int, vec_id string, rank int, grade int")
    gold = spark.createDataFrame([(1, [(3, 1), (2, 1)])], "query_id int, gold array<struct<grade:int,n:int>>")
    assert metrics.ndcg_at(found, gold, 2).first()["ndcg"] == pytest.approx(0.833991, abs=1e-6)
    sets = spark.createDataFrame([(1, [["a", "x"], ["b"]])], "query_id int, sets array<array<string>>")
    assert metrics.required_sets(found, sets, 2).first()["complete"]
    values = spark.createDataFrame([(1.0,)] * 95 + [(None,)] * 5, "v double")
    q = metrics.nearest_rank(values, "v", {"p95": 0.95, "p99": 0.99}).first()
    assert q["p95"] == 1.0 and q["p99"] == math.inf
    assert one(spark, metrics.micro_f1(F.col("a"), F.col("b"), F.col("c")), a=8, b=1, c=1) == pytest.approx(8 / 9)
    assert one(spark, metrics.ratio(F.col("a"), F.col("b")), a=99, b=100) == 0.99
    with pytest.raises(Exception, match="not a ratio"):
        one(spark, metrics.ratio(F.col("a"), F.col("b")), a=0, b=0)


LINES = "PEMBUKAAN\nBAB I\nKETENTUAN UMUM\nBagian Kesatu\nPasal 1\n(1) satu\na. huruf\n1. angka\n(2) dua\nPasal 2"


def test_structure_tree():
    nodes = structure.parse_tree(LINES)
    assert [n["label"] for n in nodes] == ["document", "BAB I", "Bagian Kesatu", "Pasal 1", "(1)", "a.", "1.", "(2)", "Pasal 2"]
    parent = {n["label"]: nodes[n["parent"]]["label"] for n in nodes[1:]}
    assert parent == {"BAB I": "document", "Bagian Kesatu": "BAB I", "Pasal 1": "Bagian Kesatu", "(1)": "Pasal 1", "a.": "(1)", "1.": "a.", "(2)": "Pasal 1", "Pasal 2": "Bagian Kesatu"}
    assert nodes[3]["stop"] == nodes[8]["start"]
    assert len(structure.parse_tree("Pasal 6 ayat (1) berlaku\n1. lepas")) == 1
    assert len({n["id"] for n in structure.parse_tree("Pasal 1\nPasal 1\nPasal 1")}) == 4


def test_catchword():
    text = "Pasal 1\nf. Nomor . . .\f- 2 -\nf. Nomor satu"
    assert [n["label"] for n in structure.parse_tree(text)] == ["document", "Pasal 1", "f."]
    assert heading_of("BAB XIV")[0] == "CHAPTER" and heading_of("Pasal IV")[1] == 35 and heading_of("Pasal 6 ayat (1)") is None


def test_owned_spans():
    nodes = structure.parse_tree("Pasal 1\nisi\n(1) é satu\nPasal 2")
    spans = structure.owned_spans(nodes, "Pasal 1\nisi\n(1) é satu\nPasal 2")
    raw = "Pasal 1\nisi\n(1) é satu\nPasal 2".encode()
    assert [raw[a:z].decode() for _, a, z in spans] == ["Pasal 1\nisi", "(1) é satu", "Pasal 2"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab é\n.;日 ", max_size=400))
def test_chunks_cover_text(text):
    raw, seen = text.encode(), 0
    for a, z, n in structure.split_chunks(text, 40, 8, 10, 12):
        part = raw[a:z].decode()
        assert part and z - a <= 40 and n <= 8
        assert a <= seen or not raw[seen:a].decode().strip()
        seen = max(seen, z)
    assert not raw[seen:].decode().strip()


@settings(max_examples=60, deadline=None)
@given(st.text("aé \t\r\n­ﬁﬄ日", max_size=80))
def test_byte_map_tiles(text):
    norm, spans = structure.normalize_with_map(text)
    raw, out = text.encode(), norm.encode()
    r = n = 0
    for a, b, c, d, kind in spans:
        assert (a, c) == (r, n)
        assert kind != "IDENTITY" or raw[a:b] == out[c:d]
        r, n = b, d
    assert (r, n) == (len(raw), len(out)) and "\r" not in norm


def test_timeline(spark):
    d = dt.date
    rows = [
        (1, 1, "KNOWN", d(2020, 1, 1), "KNOWN", d(2023, 1, 1), "IN_FORCE", "APPROVED"),
        (1, 2, "KNOWN", d(2023, 1, 1), "UNBOUNDED", None, "IN_FORCE", "APPROVED"),
        (2, 3, "KNOWN", d(2020, 1, 1), "UNBOUNDED", None, "IN_FORCE", "REJECTED"),
        (3, 4, "UNKNOWN", None, "KNOWN", d(2021, 1, 1), "IN_FORCE", "APPROVED"),
    ]
    v = spark.createDataFrame(rows, "provision int, version_id int, start_kind string, start_date date, end_kind string, end_date date, legal_status string, review_state string")
    at = lambda day: {r["provision"]: (r["decision"], r["selected"], r["excluded"]) for r in temporal.select_as_of(v, F.lit(day), "REPORT").collect()}
    late = at(d(2024, 1, 1))
    assert late[1] == ("RESOLVED", "2", "") and late[2] == ("NOT_EFFECTIVE", "", "3") and late[3][0] == "NOT_EFFECTIVE"
    assert at(d(2023, 1, 1))[1][1] == "2" and at(d(2020, 6, 1))[3][0] == "UNRESOLVED"
    assert temporal.undeclared_overlaps(v).count() == 0


def test_as_of_ties_and_gaps(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", t(0), 1), ("a", t(100), 2), ("b", t(1), 3)], "k string, at timestamp, n int")
    right = spark.createDataFrame([("a", t(0), 7), ("a", t(0), 8), ("a", t(101), 9)], "k string, rt timestamp, v int")
    got = {r["n"]: r["v"] for r in temporal.as_of(left, right, "k", "at", "rt", ["v"], "day").collect()}
    assert got == {1: 8, 2: 8, 3: None}


def test_blocking(spark):
    alias = spark.createDataFrame([("a:1", "provision", "law:a", "pasal 1"), ("b:1", "provision", "law:b", "pasal 1")], "canonical_id string, entity_type string, scope string, surface string")
    m = spark.createDataFrame([(1, "provision", "law:a", " PASAL  1 ")], "mention_id int, entity_type string, scope string, text string")
    assert [r["canonical_id"] for r in registry.block(m, alias, "text", ["entity_type", "scope"]).collect()] == ["a:1"]


def test_paths_are_simple_and_cut(spark):
    e = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "b"), ("e3", "b", "c"), ("e4", "c", "a"), ("e5", "a", "a")], "assertion_id string, subject string, object string")
    seeds = spark.createDataFrame([("a",)], "node string")
    found = graph.paths(e, seeds, 2)
    assert {(">".join(r["nodes"]), ">".join(r["assertions"])) for r in found.collect()} == {("a>b", "e1"), ("a>b", "e2"), ("a>c", "e4"), ("a>b>c", "e1>e3"), ("a>b>c", "e2>e3"), ("a>c>b", "e4>e3")}


def test_cycles_are_errors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "assertion_id int, content string")
    refs = spark.createDataFrame([(1, 2), (2, 1)], "assertion_id int, exception_id int")
    with pytest.raises(ValueError, match="cycle"):
        graph.exception_ids(a, refs)


def test_greedy_pack_skips(spark):
    items = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40)], "q int, o int, t int")
    got = {r["o"]: r["packed"] for r in evidence.pack(items, "q", "o", "t", 90).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_quote_must_be_unique(spark):
    span = span_of_quote(F.col("t"), F.lit("é"), F.lit("b"), F.lit(""))
    assert tuple(one(spark, span, t="aéb ab")) == (3, 4)
    assert one(spark, span_of_quote(F.col("t"), F.lit(""), F.lit("aa"), F.lit("")), t="aaa") is None


def test_coverage_gap(spark):
    spans = spark.createDataFrame([(1, 0, 10)], "k int, start int, stop int")
    parts = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 6, 10)], "k int, p_start int, p_stop int")
    assert tuple(evidence.coverage(spans, parts, "k").first()) == (1, 5, False)


def test_guards(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "k int, n int")
    assert jobs.guard_total(rows, F.col("n"), 30).count() == 2
    with pytest.raises(Exception, match="byte budget"):
        jobs.guard_total(rows, F.col("n"), 29).collect()


def test_field_rules(spark):
    rows = spark.createDataFrame([(1, "ok", 0.5, [1, 1]), (2, "bad id", 1.5, [])], "k int, name string, p double, xs array<int>")
    got = {tuple(r) for r in quality.issues(rows, "k", [("name", "ascii_id"), ("p", "probability"), ("xs", "unique"), ("xs", "min_items:1")]).collect()}
    assert got == {(1, "xs", "unique"), (2, "name", "ascii_id"), (2, "p", "probability"), (2, "xs", "min_items:1")}


def test_page_parser():
    raw = "<h1> Judul &amp; isi </h1><script>x</script><div>Nomor: <span>12</span></div><div>Tahun</div><div>2020</div><a href='/a.pdf#p'>x</a><a href='/a.pdf'>y</a><a href='mailto:x'>z</a>"
    page = html.parse_page(raw, "https://h.example/dir/page?x=1")
    assert page["title"] == "Judul & isi" and page["links"] == ["https://h.example/a.pdf"]
    assert page["fields"] == {"number": ["12"], "year": ["2020"]} and "x" not in page["text"].split("y")[0].split()[:3]


def test_upsert_and_claims(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in registry.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in registry.upsert(old, new, ["k"], update=False).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_question_trace(spark):
    from lontarix.functions.questions import mechanical, trace

    text = '  apa   "isi  pasal"\t\'kutip  ini\' jum\'at  cafe\u0301 “a  b'
    search, edits = mechanical(text)
    assert search == 'apa "isi  pasal" \'kutip  ini\' jum\'at caf\u00e9 “a  b'
    assert [e[4] for e in edits] == ["whitespace", "whitespace", "whitespace", "whitespace", "nfc"]
    raw, out = text.encode(), search.encode()
    for a, b, c, d, kind in edits:
        assert kind == "nfc" or not raw[a:b].strip() and out[c:d] in (b"", b" ")
    assert mechanical(search) == (search, [])
    row = spark.createDataFrame([(text,), (None,)], "q string").select(trace("q").alias("t")).collect()
    assert row[0]["t"]["search"] == search and len(row[0]["t"]["edits"]) == 5
    with pytest.raises(ValueError, match="nonblank"):
        mechanical(" \n")


def test_estimate_checks_its_evidence(spark):
    from pyspark.sql import functions as F

    from lontarix.operators import metrics

    with pytest.raises(ValueError, match="unsupported"):
        metrics.estimate("p42", samples="value")
    with pytest.raises(ValueError, match="computed from"):
        metrics.estimate("ratio", numerator=F.lit(1))
    rows = spark.createDataFrame([(x, x / 10, g) for g in "ab" for x in (3.0, 1.0, 2.0, 10.0)], "value double, score double, g string")
    got = rows.groupBy("g").agg(metrics.estimate("p50", samples="value").alias("p50"), metrics.estimate("p95", samples="value").alias("p95"), metrics.estimate("macro_mean", group_scores="score").alias("mean")).collect()
    assert {tuple(r) for r in got} == {("a", 2.0, 10.0, 0.4), ("b", 2.0, 10.0, 0.4)}
    with pytest.raises(Exception, match="outside"):  # scores beyond 1 are no scores
        rows.agg(metrics.estimate("macro_mean", group_scores="value")).collect()


def test_listing_walk_ends(spark):
    from lontarix.operators import admission

    pages = spark.createDataFrame([("1", ["2"], []), ("2", ["3"], ["d"]), ("3", ["1"], ["d"]), ("7", ["8"], None)], "url string, next array<string>, details array<string>")
    seeds = spark.createDataFrame([("1",), ("7",)], "url string")
    walked = {tuple(r) for r in admission.walk_listings(seeds, pages, 10, 9)[0].collect()}
    assert walked == {("1", 1, "1", True, 0), ("1", 2, "2", True, 1), ("1", 3, "3", True, 0), ("7", 1, "7", True, 0), ("7", 2, "8", False, 0)}
    assert admission.walk_listings(seeds, pages, 2, 9)[0].count() == 4


def test_analyzer_fixture(spark):
    """Fixed cases of the analyzer, by the whole chain: composition, terms, limits."""
    cases = {
        "UU No. 12/2020 Pasal 3 ayat (2)": ["uu", "no", "12/2020", "pasal", "3", "ayat", "2"],
        "Undang-Undang dan peraturan-peraturan": ["undang-undang", "dan", "peraturan-peraturan"],
        "Ékonomi ékonomi": ["Ékonomi", "ékonomi"],
        "pasalⅣ berlaku": ["pasal", "berlaku"],
        "a\u0345b": ["a", "b"],
        "Cafe\u0301 dan Caf\u00e9": ["café", "dan", "café"],
        "...?!": [],
    }
    for text, want in cases.items():
        assert one(spark, analyzed("t"), t=text) == want
    docs = spark.createDataFrame([(1, "x" * 257)], "doc_id long, text string")
    for over in (lambda: lexical.postings(docs).collect(), lambda: lexical.document_lengths(docs).collect(), lambda: one(spark, analyzed("t"), t="a " * 100_001), lambda: one(spark, analyzed("t"), t="." * 2_000_001)):
        with pytest.raises(Exception, match="limit exceeded"):
            over()
    assert len(one(spark, analyzed("t"), t="a " * 99_999 + "a")) == 100_000


def test_fit_tokens():
    words = lambda t: len(t.split())
    assert structure.fit_tokens("satu dua tiga", 3, words) == ("satu dua tiga", 3)
    part, n = structure.fit_tokens("é " * 50, 7, words)
    assert n <= 7 and ("é " * 50).startswith(part) and part
    with pytest.raises(ValueError, match="one character"):
        structure.fit_tokens("é", 1, lambda t: 2)
    with pytest.raises(ValueError, match="must have tokens"):
        structure.fit_tokens("a", 1, lambda t: 0)


def test_fitted_chunks_cover():
    text = " ".join(f"kata{i} é." for i in range(200))
    raw = text.encode()
    for most, size, least, over in ((5, 96, 40, 16), (3, 30, 8, 0), (500, 96, 40, 16)):
        got = structure.fitted_chunks(text, most, lambda t: len(t.split()), size, least, over)
        held = set()
        for a, z, n in got:
            assert z - a <= size and n <= most and len(raw[a:z].decode().split()) == n
            held.update(range(a, z))
        assert not b"".join(raw[i : i + 1] for i in range(len(raw)) if i not in held).strip()
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_owned_chunks(spark):
    text = "PEMBUKAAN\nBAB I\nKETENTUAN UMUM\nPasal 1\n(1) Setiap warga memenuhi syarat utama.\na. membawa identitas sah;\n(2) Kewajiban berlaku, kecuali keadaan darurat yang dapat dibuktikan.\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = structure.owned_chunks(docs, lambda t: len(t.split()), 512, max_bytes=96, min_split=40, overlap=16).collect()
    assert {r.doc_id for r in rows} == {1} and all(r.stop - r.start <= 96 and r.tokens > 0 for r in rows)
    assert next(r.path for r in rows if "identitas sah" in r.body) == "BAB I > Pasal 1 > (1) > a."
    assert any("PEMBUKAAN" in r.body and r.path == "" for r in rows) and any("kecuali keadaan darurat" in r.body for r in rows)


def test_covers(spark):
    raw = "a\r\nb\t c­deﬁx"
    docs = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    maps = structure.byte_maps(docs)
    norm, spans = structure.normalize_with_map(raw)
    assert norm == "a\nb cdefix"
    n = len(norm.encode())
    asked = [(1, a, z) for a in range(n) for z in range(a + 1, n + 1)]
    got = {(r.start, r.stop): (r.raw_start, r.raw_stop) for r in structure.raw_cover(maps, spark.createDataFrame(asked, "doc_id long, start long, stop long")).collect()}
    for _, a, z in asked:
        hit = [s for s in spans if s[3] > a and s[2] < z]
        first, last = hit[0], hit[-1]
        assert got[a, z] == (first[0] + (max(a - first[2], 0) if first[4] == "IDENTITY" else 0), last[0] + min(z, last[3]) - last[2] if last[4] == "IDENTITY" else last[1])
    size = len(raw.encode())
    back = structure.normalized_cover(maps, spark.createDataFrame([(1, 1, 3), (1, 0, size), (1, 1, 2), (1, 7, 9)], "doc_id long, start long, stop long")).collect()
    # CRLF whole and in part is one line end; the dropped hyphen is an empty range.
    assert {(r.start, r.stop): (r.norm_start, r.norm_stop) for r in back} == {(1, 3): (1, 2), (0, size): (0, n), (1, 2): (1, 2), (7, 9): (5, 5)}


def test_scope_errors(spark):
    def dates(mode, effective=None, compare=None, zone="Asia/Jakarta"):
        row = spark.createDataFrame([(mode, effective, compare, "2024-01-01 18:00:00")], "m string, e string, c array<string>, t string")
        c = temporal.resolve_scope(F.col("m"), F.to_date("e"), F.col("c").cast("array<date>"), F.col("t").cast("timestamp"), zone)
        return [str(x) for x in row.select(c.alias("d")).first().d]

    assert dates("CURRENT") == ["2024-01-02"] and dates("AS_OF", "2020-05-01") == ["2020-05-01"]
    assert dates("COMPARE", None, ["2020-01-01", "2019-01-01"]) == ["2020-01-01", "2019-01-01"]
    for bad in (("AS_OF",), ("CURRENT", "2020-01-01"), ("CURRENT", None, None, None), ("COMPARE", None, ["2020-01-01"]), ("COMPARE", None, ["2020-01-01"] * 2), ("OTHER",)):
        with pytest.raises(Exception, match="temporal scope"):
            dates(*bad)


def test_null_groups_and_empty_lines(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None), ("x", 2.0)], "g string, v double")
    got = {r.g: (r.p50, r.top) for r in metrics.nearest_rank(rows, "v", {"p50": 0.5, "top": 1.0}, "g").collect()}
    assert got == {None: (1.0, 3.0), "x": (2.0, float("inf"))}
    docs = spark.createDataFrame([(1, "é\n\nab"), (2, None), (3, ""), (4, "x\n")], "doc_id long, text string")
    lines = sorted((r.doc_id, r.line_no, r.start, r.stop, r.line) for r in evidence.lines_of(docs).collect())
    assert lines == [(1, 0, 0, 2, "é"), (1, 1, 3, 3, ""), (1, 2, 4, 6, "ab"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 0, 0, 1, "x"), (4, 1, 2, 2, "")]


def test_search_in_blocks_shuffles_no_scores_and_finds_the_best(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["die"] * 60
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(400, None), (401, "w1 w1"), (402, "w1 w1")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(30)] + [(None, "w1 w2 w2"), (98, "unseen"), (99, "")], "item_id long, text string")
    post, stats = lexical.postings(docs), lexical.corpus_stats(lexical.document_lengths(docs))
    weights = lexical.document_weights(post, lexical.document_lengths(docs), stats)
    wants = lexical.sparse_scores(lexical.query_weights(asked, lexical.document_frequency(post), stats), weights)
    wants = lexical.top_k(wants.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6), 7, "item_id", [F.desc("score"), F.asc("doc_id")])
    want = sorted(map(str, wants.select("item_id", "doc_id", "score", "rank").collect()))
    sizes = lexical.DOC_BLOCK, lexical.QUERY_BLOCK, lexical.DENSE_TERMS
    try:
        for lexical.DOC_BLOCK, lexical.QUERY_BLOCK, lexical.DENSE_TERMS in (sizes, (100, 8, 20), (50, 3, 1)):
            found = lexical.search(lexical.index(docs), asked, 7)
            assert sorted(map(str, found.select("item_id", "doc_id", "score", "rank").collect())) == want
    finally:
        lexical.DOC_BLOCK, lexical.QUERY_BLOCK, lexical.DENSE_TERMS = sizes


def test_postings_are_found_without_a_shuffle_of_their_own(spark):
    docs = spark.createDataFrame([(i, "a b a " + "c" * i) for i in range(9)], "doc_id long, text string")
    plan = lexical.measured_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("regexp_extract_all") <= 2


def test_document_weights_shuffle_and_sort_no_postings(spark):
    docs = spark.createDataFrame([(i, "a b a " + "c" * i) for i in range(9)], "doc_id long, text string")
    lengths = lexical.document_lengths(docs)
    plan = lexical.document_weights(lexical.postings(docs), lexical.cut(lengths, "lengths"), lexical.cut(lexical.corpus_stats(lengths), "stats"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2
