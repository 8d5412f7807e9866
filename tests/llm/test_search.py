from __future__ import annotations

import gzip
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import public_tokenizers
from cases import ROWS, docs, empty, words
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lontarix.llm import lm, minhash, queries, sharding, spm, topk, warc


# --- sharding


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [(i, "x" * (i % 50), "a") for i in range(300)] + [(7, "y" * 40, "b")] * 100 + [(None, "z" * 30, None)] * 20 + [(999, "w" * 5000, "a")]
    out = sharding.assign(docs(spark, rows), limit=400).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in out:
        size[r["shard"]] += r["n_bytes"]
    big = {r["shard"] for r in out if r["doc_id"] == 999}
    assert all(n <= 400 for s, n in size.items() if s not in big) and size[big.pop()] == 5000
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards[:-1], shards[1:], strict=True))
    parents = defaultdict(int)
    for s, n in size.items():
        for k in range(len(s)):
            parents[s[:k]] += n
    assert all(n > 400 for n in parents.values())
    assert sharding.assign(empty(spark), limit=400).count() == 0


def test_small_table_is_one_shard(spark, tmp_path):
    assert {r["shard"] for r in sharding.assign(docs(spark, ROWS[:4]), limit=1 << 20).collect()} == {""}
    rows = [r for r in ROWS[:7]]
    sharding.write_shards(docs(spark, rows).select("doc_id", "text"), str(tmp_path / "s"), 2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


# --- exact top-k


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 200), st.integers(1, 8), st.sampled_from([3, 40, 5000, 1 << 24]), st.integers(1, 7))
def test_bit_slices_find_the_best(seed, n, dim, top, slices):
    rng = np.random.default_rng(seed)
    values, q = rng.integers(-top, top + 1, (n, dim)), rng.integers(-top, top + 1, dim)
    block = topk.SlicedBlock(values, slices)
    rows, score = block.top(q, 5, np.array([0]))
    exact = values @ q
    assert (score == exact[rows]).all() and 0 not in rows
    best = sorted((-exact[i], i) for i in range(1, n))[:5]
    assert sorted(zip((-score).tolist(), rows.tolist(), strict=True))[: len(best)] == [(int(s), int(i)) for s, i in best]


def test_vectors_that_take_no_part(spark):
    v = [(0, [0.5, -0.25]), (50, [0.1, 0.9]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [0.5, -0.25]), (7, [0.5, -0.25]), (None, [9.0, 9.0]), (100, [None, None])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("q", F.lit("x")).withColumn("id", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0] == [(0, 1, 6), (0, 2, 7), (0, 3, 50)]
    assert {r["query_id"] for r in got} == {0, 50}
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_any_size_and_repeated_queries(spark):
    big = 1.7e308
    v = [(0, [1e9, 2.0]), (0, [-3.5, 1e300]), (1, [big, big]), (2, [big, -big]), (3, [0.5, 0.25]), (4, [-big, -big]), (5, [1e9, 1e9]), (6, [2.0**40, 1.0]), (6, [2.0**40, 1.0]), (7, [0.0, 0.0]), (8, [131071.99, -131072.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.lit(True), k=4, row_block=4, query_block=3).collect()
    ints = [(i, [math.floor(Fraction(x) * 256) for x in c]) for i, c in v]
    want = Counter()
    for i, q in ints:
        best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ints if j != i)[:4]
        want.update((i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(best))
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("blocks", [(8, 3), (8192, 2048)])
def test_top_k_in_blocks(spark, blocks):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, row_block=blocks[0] * 8, query_block=blocks[1]).collect()
    rows = df.collect()
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)).astype(np.int64) for r in rows}
    want = set()
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


# --- archive


def test_archive_round_trip(spark, tmp_path):
    body = "<p>halaman yang sama, cukup panjang untuk dirujuk kembali oleh halaman lain di sini, bukan?</p>" * 2
    rows = [(3, "http://a/3", body), (1, "http://a/1", body), (2, None, body), (4, "http://a/4\r\nX: y", "kecil"), (5, "http://a/5", "kecil"), (6, "http://a/6", None), (7, "http://a/7", ""), (None, "http://a/8", body), (9, "http://é", "日本" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    path = str(tmp_path / "arc")
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    got = {r["page_id"]: (bytes(r["payload"]).decode(), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back.collect()}
    for i, _, html in rows:
        again = html == body and i != 1
        assert got[i] == (html or "", "revisit" if again else "response", 1 if again else None, len((html or "").encode()))
    assert spark.read.parquet(path + "/payloads").count() == 4
    records = {r["page_id"]: bytes(r["record"]) for r in warc.records(back).collect()}
    data = warc.to_warc(list(records.values()))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(rows)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(data)
    parsed = warc.parse_records(spark.read.format("binaryFile").load(str(tmp_path / "w"))).collect()
    assert {bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n" for r in parsed} == set(records.values())
    assert not any(b"\nX:" in r for r in records.values())


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "isi")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"lain"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    warc.write_archive(pages.where("false"), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


# --- SentencePiece


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdetheins  ▁\né日ing.,🙂\x00", max_size=120), max_size=8))
def test_pieces_are_the_library_s(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = spm.load("piece_bpe_32k.model")
    ids, off = spm.Encoder(pieces)(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == sp.encode(texts)
    assert spm.decode_batch(ids, off, pieces) == [sp.decode(x) for x in sp.encode(texts)]


def test_coding_of_odd_rows(spark, sp):
    df = docs(spark)
    back = spm.decode(spm.encode(df)).collect()
    want = Counter((d, tuple(sp.encode(t or "")), t or "") for d, t, _ in ROWS)
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), r["text"]) for r in back) == want
    assert spm.encode(empty(spark)).count() == 0


def test_encoder_forgets(sp):
    encode = spm.Encoder(spm.load("piece_bpe_32k.model"))
    encode.KNOWN = 3
    for text in ("satu dua tiga empat lima", "dua enam", "tujuh dua"):
        assert encode([text])[0].tolist() == sp.encode(text)


def test_unigram_path():
    class Model:
        chars = np.array([[98, 0], [99, 0], [98, 99]])
        length = np.array([1, 1, 2])
        score = np.array([-1.0, -1.0, -1.5])
        width = 2

    text = np.array([98, 99, 98, 0])
    lattice = spm.Lattice(text, Model)
    begin, end = lattice.path(np.array([0, 4]), -20.0)
    assert (begin.tolist(), end.tolist()) == ([0, 2], [2, 3])


def test_op6_against_the_library(spark, sp):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_suffix_sentencepiece(spark, SF).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


# --- language model


def plain_base(texts, held):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


@pytest.mark.parametrize("head", [50, 1 << 20])
def test_op7_base_and_held_out_gain(spark, head):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want = plain_base(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.score(df, head=head).collect()
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
    for held in (False, True):
        own = [r for r in got if r["held_out"] == held]
        assert own and sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    pairs = np.zeros((7, 6))
    for c in range(7):
        pairs[c] = rng.multinomial(5000, np.roll([0.7, 0.1, 0.1, 0.05, 0.03, 0.02], c))
    R, M, Q, b = lm.train(pairs, dim=8)
    model = lm.Model(np.zeros(1, np.uint64), 5, R, M, Q, b, None, None, None, 1, 1)
    model.set_groups(pairs.sum(0))
    p = 10 ** model.log10p(np.arange(7), np.zeros(7, np.int64))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    assert np.abs(p - pairs / pairs.sum(1, keepdims=True)).max() < 0.1


def test_scores_of_odd_rows(spark):
    got = lm.score(docs(spark)).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert all(r["n_tokens"] == len(words(t)) + 1 for r, t in ((r, dict((d, t) for d, t, _ in ROWS)[r["doc_id"]]) for r in got))
    assert lm.score(empty(spark)).count() == 0


# --- near duplicates


def plain_groups(rows, k, pct):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op9_finds_all_true_pairs(spark):
    """The whole table at sf0.01, all pairs compared: no pair above the threshold is left in two components."""
    sf = SF.replace("sf0.001", "sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_groups(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_minmax_near_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize(("small", "chunk"), [(32, 256), (1, 4)])
def test_groups_of_copies(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = [f"kata{x}" for x in rng.integers(0, 10_000, 220)]
    rows = []
    for i in range(60):  # near copies of one text, more and less changed
        w = list(base)
        for j in rng.integers(0, 220, i % 9):
            w[j] = f"lain{i}x{j}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:110]).upper()) for i in range(20)] + [(3000 + i, f"teks sendiri nomor {i} saja") for i in range(20)]
    df = docs(spark, [(i, t, "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == plain_groups(rows, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(docs(spark), 3, 85).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[9]["component_id"] == 8 and not by[9]["kept"] and by[8]["kept"]
    assert by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["kept"] and by[10]["n_shingles"] == 1
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_words_split_at_ascii_space_alone():
    from lontarix.llm.words import hashes
    from lontarix.llm.words import words as cut

    for text in ("", "a", " a  b c\td e ", "é" * 40 + " x"):
        raw = np.frombuffer(text.encode(), np.uint8)
        a, z, first = cut(raw, np.array([0, len(raw)]))
        assert [raw[i:j].tobytes().decode() for i, j in zip(a, z, strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", text)
        assert len(np.unique(hashes(raw, a, z))) == len(set(re.findall(r"[^\x20\x09-\x0D]+", text)))


@pytest.mark.parametrize("window", [300, 1000])
def test_long_segments_in_windows_are_those_of_the_library(monkeypatch, window):
    monkeypatch.setattr(spm, "WINDOW", window)
    pieces, sp = spm.load("piece_bpe_32k.model"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(window)
    solid = "".join(rng.choice("abcdehinorst") for _ in range(4000))
    texts = ["ab" * 2000, "a" * 3001, "abc" * 700 + "é日本" * 300, solid, " ".join(solid[i : i + 7] for i in range(0, 4000, 7)), "  " * 900 + "x", "halo dunia", "=" * 2001 + " y", None]
    ids, off = spm.Encoder(pieces)(texts)
    want = [sp.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    assert spm.decode_batch(ids, off, pieces) == [sp.decode(x) for x in want]


def test_long_unigram_segments_in_windows(monkeypatch):
    """A model of a few pieces with scores: the windowed path is the whole one."""

    class Model:
        bpe, byte_of, byte_id, unk, width, unknown = False, {}, np.zeros(256, np.int64), 9, 3, -20.0
        chars = np.array([[ord(c) + 1 for c in p] + [0] * (3 - len(p)) for p in ("a", "b", "ab", "bab", "ba")])
        length = np.array([1, 1, 2, 3, 2])
        score = np.array([-3.0, -3.5, -4.0, -5.0, -4.5])
        ids = np.arange(5)

    rng = random.Random(1)
    for n in (1, 50, 333):
        text = "".join(rng.choice("aab b?"[:5]) for _ in range(n)).replace(" ", "?")
        whole = spm._short([text], Model)[0].tolist()
        assert all(spm._long_path(text, Model, w).tolist() == whole for w in (3, 10, 64))
