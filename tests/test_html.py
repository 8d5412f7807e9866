"""Pages: links, references to characters, labelled fields."""

from __future__ import annotations

import time

import duckdb
import pytest
from oracle import assert_same

from lontarix import queries
from lontarix.functions import html

BASE = "https://h.id/a/b/c.html"


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("../z", "https://h.id/a/z"), ("?q=1", BASE + "?q=1"), ("./w", "https://h.id/a/b/w"), ("../../../../up", "https://h.id/up"), ("w/./x/../y", "https://h.id/a/b/w/y"), ("/x", "https://h.id/x"),
        ("//cdn.example/p", "https://cdn.example/p"), ("HTTP://Other.Example/q", "http://Other.Example/q"), (" https://x.example/a#f ", "https://x.example/a"), ("#top", BASE), (" ", BASE), ("", ""),
        ("mailto:a@b", ""), ("javascript:void(0)", ""), ("ftp://x/y", ""), ("/%zz", ""), ("/a%20b", "https://h.id/a%20b"), ("/a b", "https://h.id/a%20b"), ("/osó", "https://h.id/os%C3%B3"), ("/p?x=ó", "https://h.id/p?x=ó"), ("http://[bad", ""),
    ],
)
def test_links_are_resolved(target, want):
    assert html.resolve(BASE, target) == want


def test_all_quotings_and_elements_link():
    page = html.parse_page("<a href='/x'>1</a><A HREF=/y>2</A><iframe src=\"z\"></iframe><embed src=e><object data=o></object><a href='' src=s>3</a><img src=no><link href=no><a>4</a><a href='/x'>again</a>", BASE)
    assert page["links"] == ["https://h.id/x", "https://h.id/y", "https://h.id/a/b/z", "https://h.id/a/b/e", "https://h.id/a/b/o", "https://h.id/a/b/s"]


def test_references_to_characters_are_decoded():
    page = html.parse_page("<title>caf&eacute;</title><h1> </h1><h1>&#233;&#xE9; &amp;amp; a&nbsp; b<br>c</h1><p>&copy; x<script>var t='</p>'</script><style>p{}</style><!-- no -->&rarr;y", BASE)
    assert page["title"] == "éé &amp; a b c" and page["text"] == "café éé &amp; a b c © x →y"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<td>Status</td><td><b>Masih</b> berlaku</td>", {"portal_status": ["Masih berlaku"]}),
        ("<div>Nomor: <span> 12 </span><span>13</span></div>", {"number": ["12"]}),
        ("<div>Tahun<br><span> </span></div>  teks <div>20<i>24</i></div>", {"year": ["20 24"]}),
        ("<dl><dt>JUDUL :<dd>Satu<dt>Judul<dd>Dua<dt>Judul<dd>Satu</dl>", {"title": ["Satu", "Dua"]}),
        ("<label> tempat \n penetapan</label><input><span>x</span>", {}),
        ("<p>Nomor</p><p>12</p><b>Status</b><i>x</i>", {}),
        ("<div><!-- c -->Nomor<span>1</span></div>", {}),
        ("<div>Nomor lain <span>1</span></div><div>Bahasa</div>", {}),
        (f"<div>Lokasi<span>{'é' * 4096}</span></div><div>Lokasi<span>{'x' * 8191}</span></div>", {"location": ["x" * 8191]}),
    ],
)
def test_fields_are_values_of_elements(raw, want):
    assert {k: v for k, v in html.parse_page(raw, BASE)["fields"].items() if v} == want


def test_documents_details_and_next_pages():
    raw = """<a href="/f/Satu.PDF?x=1">s</a><a href="/unduh/2">d</a><a href="v?file=%2Ff%2Fdua.pdf">v</a><a href="/download/DownloadUjiMateri/1">r</a><a href="/id/details/7">t</a><a href="/produk_hukum/view/id/8">t</a>
    <iframe src="/details/9"></iframe><a rel="nofollow next" href="?page=2">2</a><a href="?page=3"> NEXT </a><a aria-label=next href="?page=2">></a><a href="https://other.id/?page=4">selanjutnya</a>"""
    page = html.parse_page(raw, BASE)
    assert page["documents"] == ["https://h.id/f/Satu.PDF?x=1", "https://h.id/unduh/2", "https://h.id/f/dua.pdf"] and page["related"] == ["https://h.id/download/DownloadUjiMateri/1"]
    assert page["details"] == ["https://h.id/id/details/7", "https://h.id/produk_hukum/view/id/8"] and page["next"] == [BASE + "?page=2", BASE + "?page=3"]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, BASE, "<a href=x"), (4, "not a url", "<a href=x>y</a></p></div><h1>t"), (5, BASE, "<td>a<table><tr><td>b</table></tr>c"), (5, BASE, "x")]
    got = {(r.page_id, r.title, r.text, tuple(r.links)) for r in html.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "", "", ()), (2, "", "", ()), (3, "", "", ()), (4, "t", "y t", ()), (5, "", "a b c", ()), (5, "", "x", ())}
    assert html.parse_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_long_pages_take_linear_time():
    start = time.perf_counter()
    page = html.parse_page("<div>" * 20_000 + "x" + "<a href=/p>" * 20_000, BASE)
    assert page["links"] == ["https://h.id/p"] and time.perf_counter() - start < 20


def walk(pages, seed, max_pages, max_documents):
    queue, seen, docs, out = [seed], [], [], []
    while queue and len(seen) < max_pages and len(docs) < max_documents:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        new = []
        for d in pages.get(url, ([], []))[1]:
            if d not in docs and len(docs) < max_documents:
                docs.append(d)
                new.append(d)
        out.append((seed, len(seen), url, url in pages, len(new)))
        queue += pages.get(url, ([], []))[0]
    return out, docs


@pytest.mark.parametrize(("max_pages", "max_documents"), [(1, 1), (5, 100), (100, 6), (9, 9), (100, 100)])
def test_listings_are_walked_in_order_within_both_limits(spark, max_pages, max_documents):
    import random

    from lontarix.operators import admission

    rng = random.Random(max_pages)
    pages = {f"p{i}": ([f"p{rng.randrange(16)}" for _ in range(rng.randrange(4))], [f"d{rng.randrange(12)}" for _ in range(rng.randrange(4))]) for i in range(14)}
    df = spark.createDataFrame([(u, n, d) for u, (n, d) in pages.items()], "url string, next array<string>, details array<string>")
    seeds = spark.createDataFrame([(f"p{i}",) for i in (0, 3, 15)], "url string")
    read, documents = admission.walk_listings(seeds, df, max_pages, max_documents)
    want = [walk(pages, f"p{i}", max_pages, max_documents) for i in (0, 3, 15)]
    assert sorted(map(tuple, read.collect())) == sorted(r for rows, _ in want for r in rows)
    assert sorted((r.seed, r.url) for r in documents.collect()) == sorted((f"p{i}", d) for i, (_, ds) in zip((0, 3, 15), want, strict=True) for d in ds)


def test_a_walk_goes_on_where_it_ended(spark, tmp_path):
    from lontarix.operators import admission

    pages = spark.createDataFrame([(f"p{i}", [f"p{i + 1}"], [f"d{i}"]) for i in range(6)], "url string, next array<string>, details array<string>")
    seeds, state = spark.createDataFrame([("p0",)], "url string"), f"file://{tmp_path}/walk"
    whole = sorted(map(tuple, admission.walk_listings(seeds, pages, 9, 9, state)[0].collect()))
    import shutil

    for step in (4, 5, 6):
        shutil.rmtree(tmp_path / f"walk/step={step}")
    assert sorted(map(tuple, admission.walk_listings(seeds, pages, 9, 9, state)[0].collect())) == whole and len(whole) == 7
    with pytest.raises(ValueError):
        admission.walk_listings(seeds, pages, 0, 9)


@pytest.mark.parametrize("name", ["html_parse", "html_text", "html_title"])
def test_references_without_semicolon_in_both_engines(spark, tmp_path, name):
    rows = [(1, "a &amp;&amp"), (2, "b&quot</b> &ampc&am"), (3, "&lt&gt; &copy, &copyx &quo"), (4, "&amp;lt &amp;amp"), (5, "&#39 &middot&eacute"), (6, "&a")]
    link = '<a href="/x">x</a>'
    spark.createDataFrame([(i, "http://h.example/d/p", f"<h1>{h}</h1><p>{h}</p>{link}") for i, h in rows if i != 3] + [(3, "http://h.example/d/p", f"<h1>&lt&gt; &copy, &quo</h1>{link}")], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    assert_same(got, con, queries.oracles()[name])
    if name == "html_title":
        assert {r["page_id"]: r["title"] for r in got.collect()} == {1: "a &&", 2: 'b" &c&am', 3: "<> \u00a9, &quo", 4: "&lt &amp", 5: "' \u00b7\u00e9", 6: "&a"}
