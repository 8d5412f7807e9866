"""Spelling variants, the n-gram Jaccard join and the numeric band join against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import LOWER, docs, empty, words
from pyspark.sql import functions as F

from lontarix.llm import bandjoin, jaccard, spelling
from lontarix.llm.wavelet import WaveletMatrix

# Range reporting and spelling variants


def test_wavelet_matrix_reports_every_point_of_a_rectangle():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 200):
        seq = rng.permutation(n)
        a, c = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        b, d = np.minimum(n, a + rng.integers(0, 30, 300)), np.minimum(n, c + rng.integers(0, 30, 300))
        q, v = WaveletMatrix(seq).report(a, b, c, d)
        want = sorted((k, int(x)) for k in range(300) for x in seq[a[k] : b[k]] if c[k] <= x < d[k])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def runs(text):
    out, run = [], ""
    for ch in (text or "") + " ":
        if "a" <= ch <= "z" or "A" <= ch <= "Z" or "À" <= ch <= "ÿ":
            run += ch
        elif run:
            out.append(run.translate(LOWER))
            run = ""
    return out


def plain_vocabulary(rows, least=5, min_n=3, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= min_n}


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_near_words_like_brute_force_also_where_keys_are_split(spark, most):
    rng = random.Random(11)
    vocabulary = {"".join(rng.choice("abÿ") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 40) for _ in range(250)}
    vocabulary |= {"aaaaaa": 5, "aaaaa": 9, "aaaaaaa": 3, "×÷abc": 4}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, 5, most).collect()]
    want = {(a, b, vocabulary[b]) for a in vocabulary for b in vocabulary if one_edit(a, b)}
    assert len(got) == len(want) and set(got) == want


def test_variants_of_texts(spark):
    rng = random.Random(7)
    base = ["peraturan", "undang", "menteri", "ketentuan", "wilayah", "Große", "años"]
    rows = []
    for i in range(60):
        chosen = []
        for _ in range(80):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", w[k].upper(), w[k] * 2]) + w[k + 1 :]
            chosen.append(w)
        rows.append((i, ", ".join(chosen)))
    long = "q" * 30_000
    rows += [(None, None), (70, ""), (71, " \n"), (72, f"{long} {long}r {long}s {long} {long}r"), (72, f"{long} {long}r"), (73, "été×ÉTÉ été")]
    df = docs(spark, [(i, t, "a") for i, t in rows])
    got = {tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = plain_variants(plain_vocabulary(rows))
    assert got == want and any(x[3] for x in want)
    assert spelling.variants(empty(spark)).count() == 0


def test_chains_of_forms_end_at_their_last(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)] + [("x", "3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {str(i): "40" for i in range(40)} | {"x": "40"}


# Jaccard join


def shingles(text, k):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_groups(rows, k, pct):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return Counter((d, len(s), (min(ids[find(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(4))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_groups_like_all_pairs_by_listed_pairs_and_by_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(small)
    texts = []
    for size in (12, 40, 90):
        texts += near_copies(rng, 35, [f"w{rng.randrange(300)}" for _ in range(size)], size // 12)
    shared = [f"s{i}" for i in range(60)]
    texts += [" ".join(shared + [f"u{rng.random()}" for _ in range(60)]) for _ in range(15)]
    rows = list(enumerate(texts)) + [(0, texts[5]), (None, texts[50]), (None, "hanya di sini saja"), (900, None), (901, ""), (902, " \t\n"), (903, "A b"), (904, "a B"), (905, "kata " * 30_000), (906, "KATA kata kata kata kata")]
    rng.shuffle(rows)
    df = docs(spark, [(i, t, "a") for i, t in rows])
    for k, pct in ((4, 85), (5, 80)):
        got = Counter(tuple(r) for r in jaccard.linked_groups(df, k, pct).select("doc_id", "n_shingles", "component_id").collect())
        want = plain_groups(rows, k, pct)
        assert got == want and len({x[2] for x in want}) < len(want)
    assert jaccard.linked_groups(empty(spark)).count() == 0


def test_ids_that_are_not_numbers(spark):
    rows = [("b", "satu dua tiga empat lima"), ("a", "Satu dua tiga empat LIMA"), ("c", "lain sama sekali dari itu")]
    got = {tuple(r) for r in jaccard.linked_groups(spark.createDataFrame(rows, "doc_id string, text string"), 4, 85).collect()}
    assert got == {("b", 2, "a"), ("a", 2, "a"), ("c", 2, "c")}


def test_fragments_add_up_to_the_whole_overlap():
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 400, rng.integers(0, 120))) for _ in range(n)] for n in (9, 14)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]])
    for cuts in ([], [200], [50, 51, 300, 399]):
        assert (jaccard.overlaps(*sides, np.zeros(want.shape), np.array(cuts, np.int64)) == want).all()
    need = np.full(want.shape, 30.0)
    assert ((jaccard.overlaps(*sides, need, np.array([100, 200])) >= need) == (want >= need)).all()


# Band join


def cents(x):
    return None if x is None or math.isnan(x) or abs(x) >= (1 << 53) / 100 else math.floor(100 * x + 0.5)


def plain_band(lines, items, top=10, within=50, per_mille=5):
    usable = []
    for sale, no, item, q, amount in lines:
        a = cents(amount)
        if None not in (sale, item, q, a) and q >= 1:
            usable.append(((2 * a + q) // (2 * q), sale, no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    out = []
    for item, price in items:
        p = cents(price) if item is not None else None
        pairs = []
        for u, sale, no, other, crc in usable:
            if p is not None and other != item and (abs(u - p) <= within or 1000 * abs(u - p) <= per_mille * min(u, p)):
                pairs.append((abs(u - p), u, sale, no is None, no or 0, other, crc))
        pairs.sort()
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[6] for x in pairs))
        out += [(item, r, g, u, s, None if none else no, o, *sums) for r, (g, u, s, none, no, o, _) in enumerate(pairs[:top], 1)] or [(item, 0, None, None, None, None, None, 0, 0, 0)]
    return Counter(out)


def band(spark, lines, items, **more):
    left = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, quantity int, amount double").withColumn("u", F.lit("x")).withColumn("p", F.lit(1))
    right = spark.createDataFrame(items, "item_id long, price double").withColumn("salt", F.lit(2)).withColumn("near", F.lit("y"))
    return Counter(tuple(r) for r in bandjoin.near_prices(left, right, **more).collect())


def test_band_join_like_all_pairs(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([2.5, 3.0, 3.1, 9.99, 120.0, round(rng.uniform(1, 300), 2)])) for i in range(60)]
    items += [(60, None), (None, 3.0), (61, float("nan")), (62, float("inf")), (63, 1e300), (64, -2.0), (65, 0.0), (5, 3.0), (66, 77_777.77)]
    lines = []
    for sale in range(400):
        q = rng.randrange(1, 50)
        lines.append((sale // 3, sale % 3, rng.choice([7, 7, rng.randrange(60)]), q, round(rng.choice([3.0, 2.51, rng.uniform(0.5, 310)]) * q * rng.choice([1, 0.97]), 2)))
    lines += lines[:5] + [(None, 1, 2, 1, 3.0), (1, None, 2, 1, 3.0), (1, None, 3, 1, 3.0), (1, 2, None, 1, 3.0), (1, 2, 3, None, 3.0), (1, 2, 3, 1, None), (1, 2, 3, 0, 3.0), (1, 2, 3, -2, 3.0)]
    lines += [(2, 1, 3, 1, float("nan")), (2, 1, 3, 1, float("-inf")), (2, 1, 3, 1, 1e300), (3, 1, 9, 1, -2.2), (3, 1, 9, 7, 544_000.0), (3, 2, 9, 7, 545_000.0)]
    assert band(spark, lines, items) == plain_band(lines, items)
    assert band(spark, lines, items, top=3, within=0, per_mille=100) == plain_band(lines, items, 3, 0, 100)


def test_band_join_where_one_item_has_all_near_lines_and_prices_are_huge(spark):
    lines = [(s, 1, 7, 1, 5.0 + s % 20 / 100) for s in range(200)] + [(s, 2, s % 4, 2, 10.1) for s in range(30)]
    lines += [(900 + i, 1, 1, 1, 2.0e12 * (1 + i / 1000)) for i in range(12)] + [(950, 1, 2, 1, 9.0e13), (951, 1, 2, 1, 9.004e13)]
    items = [(7, 5.0), (8, 5.0), (1, 5.05), (2, 2.0e12), (3, 9.0e13), (4, 2.0e7)]
    assert band(spark, lines, items) == plain_band(lines, items)


def test_band_join_of_empty_tables(spark):
    assert band(spark, [(1, 1, 1, 1, 1.0)], []) == Counter()
    assert band(spark, [], [(1, 2.0), (2, None)]) == plain_band([], [(1, 2.0), (2, None)])
