from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import LONG, ROWS, docs, empty, words
from conftest import SF
from oracle import assert_same, connect

from lontarix.llm import linededup, quality, queries
from lontarix.llm.cuckoo import CuckooFilter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def counts(text):
    text = text or ""
    w = words(text, lower=False)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts_of_odd_rows(spark):
    got = quality.judge(docs(spark)).collect()
    assert len(got) == len(ROWS)
    want = Counter((d, *counts(t)) for d, t, _ in ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert quality.judge(empty(spark)).count() == 0


def test_frequent_lines_deplete_and_copies_do_not(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    menu = " ".join(f"menu{j}" for j in range(300))
    rows = [(i, f"{menu}\n{body(i)}", "h") for i in range(40)]  # mostly menu
    rows += [(100 + i, body("same"), "h") for i in range(60)]  # exact copies of one page
    rows += [(300 + i, f"{menu}\n{body(i)}", "other") for i in range(10)]  # too few on that host
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows), min_docs=20).collect()}
    assert not any(got[i] for i in range(40))
    assert all(got[100 + i] for i in range(60)) and all(got[300 + i] for i in range(10))


def test_clean_removes_lines(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f" Menu \n{body(i)}\n\nMENU", "h") for i in range(40)] + [(99, "menu", "h"), (None, f"menu\n{body('n')}", "h"), (100, f"menu\n{body('o')}", None)]
    df = docs(spark, rows)
    got = quality.clean(df, min_docs=20)
    assert set(got.columns) == set(df.columns)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {**{i: f"{body(i)}\n" for i in range(40)}, None: body("n"), 100: f"menu\n{body('o')}"}
    assert quality.clean(empty(spark)).count() == 0


def plain_dedup(rows, least):
    strip = lambda x: x.strip(" \t\n\v\f\r")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: strip(x).translate(lower)
    seen = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("size", [2, 1 << 18])
def test_line_dedup_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(linededup, "PART_KEYS", size)
    df = docs(spark)
    out = linededup.LineDedup(spark, min_docs=3).insert(df).apply(df)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == plain_dedup(ROWS, 3)
    assert set(df.columns) <= set(out.columns)
    none = linededup.LineDedup(spark).insert(empty(spark))
    assert none.apply(empty(spark)).count() == 0


def test_line_dedup_is_reversible(spark):
    a = [(i, f"menu\nown {i}", "h") for i in range(4)]
    b = [(10 + i, f"MENU \nother\nown {10 + i}", "h") for i in range(3)]
    one = linededup.LineDedup(spark, min_docs=5).insert(docs(spark, a))
    before = {tuple(r) for r in one.refs.collect()}
    assert one.frequent().count() == 0
    one.insert(docs(spark, b))
    assert one.frequent().count() == 1
    got = one.apply(docs(spark, a + b))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == plain_dedup(a + b, 5)
    one.delete(docs(spark, b))
    assert {tuple(r) for r in one.refs.collect()} == before and one.frequent().count() == 0
    assert sum(r["n_dropped"] for r in one.apply(docs(spark, a)).collect()) == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = CuckooFilter.load(CuckooFilter.build(keys).dump())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.002
    assert all(f.delete(k) for k in keys[:2500]) and f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01
    assert not CuckooFilter.build(np.zeros(0, np.uint64)).contains(keys).any()
    # All at once or one by one: the same keys are in, and every one of them can be taken out again.
    whole = CuckooFilter(np.zeros((1 << 11, 4), np.uint16))
    assert whole.insert_all(keys) and whole.contains(keys).all() and (whole.table > 0).sum() == len(keys)
    assert all(whole.delete(k) for k in keys) and not whole.table.any()
    assert not CuckooFilter(np.zeros((1 << 8, 4), np.uint16)).insert_all(keys)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    monkeypatch.setattr(linededup, "PART_KEYS", 3)
    rows = [(i % 7 or None, "\n".join(f"line {(i * 5 + j) % 60}" for j in range(8)), "a") for i in range(60)]
    one = linededup.LineDedup(spark, min_docs=8).insert(docs(spark, rows[:30])).insert(docs(spark, rows[30:]))
    assert one.n_shards > 4
    got = one.apply(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == plain_dedup(rows, 8)


def test_long_text_is_whole(spark):
    got = quality.judge(docs(spark, [(1, LONG, "a")])).first()
    assert got["n_words"] == len(LONG.split()) and hashlib.sha256(LONG.encode()).hexdigest()
