from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, docs, empty
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lontarix.llm import binpack, packing, queries
from lontarix.llm.tokens import byte_bpe


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def pieces_of(ids, cap):
    first = len(ids) % cap or cap
    cuts = [0, *range(first, len(ids), cap), len(ids)] if len(ids) > cap else [0, len(ids)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def check_places(rows, cap):
    own = defaultdict(list)
    for r in rows:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(own)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_plan_uses_all_and_fills(histogram):
    left = dict(histogram)
    for pattern, times in packing.plan(histogram, 40):
        assert sum(pattern) <= 40 and times > 0
        for x in pattern:
            left[x] -= times
    assert not any(left.values())


def test_plan_finds_exact_fillings():
    assert sum(t for _, t in packing.plan({30: 3, 5: 3, 3: 3, 2: 3}, 40)) == 3
    assert packing.plan({20: 7}, 40) == [([20, 20], 3), ([20], 1)]
    assert packing.plan({}, 40) == []
    with pytest.raises(ValueError, match="does not fit"):
        packing.plan({41: 1}, 40)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizer_files(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert byte_bpe()(text) == t.encode(text, add_special_tokens=False).ids


def test_op1_against_brute_force(spark, tokenizer):
    got = queries.op1_best_fit_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, total = set(), 0
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want |= {(doc, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(pieces_of(ids, 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert check_places(got, 2048) <= -(-total // 2048) + 1


def test_odd_rows(spark, tokenizer):
    rows = packing.pack(docs(spark), capacity=64).collect()
    check_places(rows, 64)
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
    for doc, text, _ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(x[0] == doc for x in ROWS)
        assert sum(r["length"] for r in whole[doc]) == copies * len(ids)
        if copies == 1:
            joined = b"".join(bytes(r["ids"]) for r in sorted(whole[doc], key=lambda r: r["piece"]))
            assert np.frombuffer(joined, "<u4").tolist() == ids
    assert packing.pack(empty(spark)).count() == 0


def test_capacity_tree():
    t = binpack.CapacityTree(10)
    for row, left in enumerate((3, 7, 7, 10)):
        t.add(row, left)
    assert t.take(4) == (2, 7) and t.take(4) == (1, 7) and t.take(4) == (3, 10) and t.take(4) is None and t.take(1) == (0, 3) and t.take(1) is None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_decreasing_is_best_fit(sizes):
    rows = binpack.best_fit_decreasing(np.array(sizes, np.int64), 20)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    left: list[int] = []
    for n in sorted(sizes, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(20 - n)
    assert sorted(20 - sum(sizes[i] for i in r) for r in rows) == sorted(left)


def plain_packing(ids, capacity, window, end_id=50256):
    """The contents of all rows, by a plain packer: (row, start, ids) of each segment in order."""
    pool, out = [], []

    def close(last):
        nonlocal pool
        rows = []
        for item in sorted(pool, key=lambda p: -len(p[2])):
            fits = [(capacity - sum(len(p[2]) for p in r), i) for i, r in enumerate(rows)]
            best = min((x for x in fits if x[0] >= len(item[2])), default=None, key=lambda x: x[0])
            rows[best[1]].append(item) if best else rows.append([item])
        size = lambda r: sum(len(p[2]) for p in r)
        full, rest = [r for r in rows if last or size(r) == capacity], [r for r in rows if not last and size(r) < capacity]
        if sum(map(size, rest)) > window // 2:
            full, rest = full + rest, []
        out.extend(full)
        pool = [p for r in rest for p in r]

    for n, x in enumerate(ids):
        x = [*x, end_id]
        pool += [(n, a, x[a : a + capacity]) for a in range(0, len(x), capacity)]
        if sum(len(p[2]) for p in pool) >= window:
            close(False)
    if pool:
        close(True)
    return out


@pytest.mark.parametrize("window", [200, 3000, binpack.WINDOW])
def test_matrix_round_trip(spark, tmp_path, window):
    packed = binpack.pack_matrix(docs(spark).coalesce(1), "byte_bpe_50k", 128, window=window)
    binpack.write_matrix(packed, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    encode = byte_bpe()
    back = binpack.unpack(stored).collect()
    assert Counter((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tobytes()) for r in back) == Counter((d, np.array([*encode(t or ""), 50256], "<u4").tobytes()) for d, t, _ in ROWS)
    for r in stored.collect():
        ids, at = (np.frombuffer(bytes(r[c]), "<u4") for c in ("ids", "positions"))
        assert len(ids) == len(at) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        for a, z in zip(r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            assert at[a:z].tolist() == list(range(z - a))
        assert (ids[r["n_tokens"] :] == 50256).all() and not at[r["n_tokens"] :].any()
    assert binpack.pack_matrix(empty(spark)).count() == 0


@pytest.mark.parametrize("window", [3000, 40_000])
def test_matrix_against_a_plain_packer(spark, window):
    """Which lengths share a row, row by row, and what the rows hold."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).coalesce(1)
    texts = rows.collect()
    encode = byte_bpe()
    ids = [encode(r["text"] or "") for r in texts]
    at = {r["doc_id"]: n for n, r in enumerate(texts)}
    got = binpack.pack_matrix(rows, "byte_bpe_50k", 256, window=window).collect()
    want = plain_packing(ids, 256, window)
    assert Counter(tuple(sorted(np.diff(r["cu_seqlens"]).tolist())) for r in got) == Counter(tuple(sorted(len(p[2]) for p in r)) for r in want)
    segments = Counter()
    for r in got:
        own = np.frombuffer(bytes(r["ids"]), "<u4")
        for d, s, a, z in zip(r["docs"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            segments[at[d], s, own[a:z].tobytes()] += 1
    assert segments == Counter((n, s, np.array(x, "<u4").tobytes()) for r in want for n, s, x in r)


def test_op8_holds_every_document_once(spark):
    """The query against ids of the rank file's own library: every document's tokens, cut at 2,048, are in one place each."""
    import zlib

    from lontarix.llm.tokens import rank_bpe

    encode = rank_bpe("byte_bpe_multi_50k")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_packed_matrix(spark, SF).collect()
    ids = {d: [*encode(t or ""), 50256] for d, t in texts.items()}
    seen = Counter()
    for r in got:
        row = [x for d, s, a, z in zip(r["docs"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True) for x in ids[d][s : s + z - a]]
        seen.update((d, s, s + z - a) for d, s, a, z in zip(r["docs"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True))
        at = [x for a, z in zip(r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True) for x in range(z - a)]
        pad = 2048 - len(row)
        assert r["n_tokens"] == len(row) and r["ids_crc32"] == zlib.crc32(np.array(row + [50256] * pad, "<u4").tobytes())
        assert r["positions_crc32"] == zlib.crc32(np.array(at + [0] * pad, "<u4").tobytes())
    assert seen == Counter((d, a, min(a + 2048, len(x))) for d, x in ids.items() for a in range(0, len(x), 2048))
    assert sum(r["n_tokens"] for r in got) / (2048 * len(got)) > 0.9


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + " " * 300_000 + "b", "x\n" + "\n" * 50_000 + "  y" + "\u2003" * 20_000 + "z", "\t" * 12_000 + "'s", "a" * 200_000, "Wörter 日本語 " * 3000 + " " * 20_000 + "<|endoftext|>"])
def test_long_runs(tokenizer, text):
    assert byte_bpe()(text) == tokenizer.encode(text, add_special_tokens=False).ids
    from lontarix.llm.tokens import rank_bpe

    short = text[:150] + text[-150:]
    assert rank_bpe("byte_bpe_multi_50k")(short) and len(rank_bpe("byte_bpe_multi_50k")(text)) > 0
