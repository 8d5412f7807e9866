from __future__ import annotations

from collections import Counter

import numpy as np
from cases import ROWS, docs
from conftest import SF
from pyspark.sql import functions as F

from lontarix.llm import lm


def test_units_and_classes_grow_with_the_tokens():
    totals = [sum(lm.sizes(n)) + 1 for n in (0, 10**6, 10**8, 10**9, 10**10)]
    assert totals[0] == 1024 and sorted(set(totals))[-3:] == totals[2:]
    assert lm.sizes(10**10)[1] > lm.sizes(10**6)[1]


def test_sparse_blocks_train_as_the_dense_table(monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.poisson(0.4, (41, 40)).astype(float)
    at = np.nonzero(dense)
    sparse = lm.Pairs(np.searchsorted(at[0], np.arange(42)), at[1], dense[at].astype(np.float32), 40)
    assert (sparse[3:9] == dense[3:9]).all() and (sparse.sum(0) == dense.sum(0)).all() and (sparse.sum(1) == dense.sum(1)).all()
    whole = lm.train(dense, dim=4, steps=20)
    monkeypatch.setattr(lm, "BLOCK", 200)
    for a, b in zip(whole, lm.train(sparse, dim=4, steps=20), strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_pairs_of_all_rows_and_normalised_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 1 << 12)
    texts = docs(spark).select("text")
    model, _ = lm.fit(texts, n_top=2000, n_buckets=512)
    pairs = lm.pair_counts(texts, model)
    want: Counter[tuple[int, int]] = Counter()
    for _, text, _ in ROWS:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        h, b, begin = lm.tokens(buf, np.array([0, len(buf)]), 512)
        unit = model.unit(h, b)
        want.update(zip(lm.context(unit, begin, model.units).tolist(), unit.tolist(), strict=True))
    row = np.repeat(np.arange(model.units + 1), np.diff(pairs.first))
    assert dict(zip(zip(row.tolist(), pairs.unit.tolist(), strict=True), pairs.count.tolist(), strict=True)) == want
    c, u = np.arange(model.units + 1), np.arange(model.units + 1) % model.units
    k = c % lm.GROUPS
    p = model.log10p(c, k)
    assert np.allclose((10**p).sum(1), 1, atol=1e-3)
    assert np.allclose(model.log10p_of(model.parts(), c, k, u), p[c, u], atol=1e-4)
    spread = model.log_z
    model.normalise()
    assert np.allclose(model.log_z, spread, atol=1e-4)


def test_second_position_is_learnt():
    """Units that depend on the unit two before alone: without its matrix they are uniform."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, 40_000)
    unit = np.empty(40_000, np.int64)
    unit[:2] = 0, 1
    for i in range(2, len(unit)):
        unit[i] = unit[i - 2] if rng.random() < 0.9 else x[i]
    pairs = np.zeros((3, 2))
    np.add.at(pairs, (np.append(2, unit[:-1]), unit), 1)
    R, M, Q, b = lm.train(pairs, dim=4, prior=0.0)
    model = lm.Model(np.arange(1, dtype=np.uint64), 1, R, M, Q, b, None, None, None, 1, 1)
    model.set_groups(pairs.sum(0))
    begin = np.array([0, len(unit)])
    c, k = lm.contexts(model, unit, begin)
    model.normalise()
    before = model.log10p_of(model.parts(), c, k, unit).mean()
    fitted = lm._Positions(model, np.array([0.5, 0.5]), 1, samples=16, rate=0.05)
    for a in range(0, 40_000, 100):
        fitted.step(c[a : a + 100], k[a : a + 100], unit[a : a + 100])
    model.M, model.M2 = fitted.mean
    model.normalise()
    assert model.log10p_of(model.parts(), c, k, unit).mean() > before + 0.1


def test_head_is_a_bound(spark):
    """More words of one count than the table may hold: none travels, and the counts are the same."""
    texts = docs(spark, [(i, " ".join(f"w{j}" for j in range(40)), "a") for i in range(30)])
    model, _ = lm.fit(texts.select("text"), head=10)
    assert len(model.head) <= 10
    few, many = (lm.score(texts, head=n).orderBy("doc_id").collect() for n in (10, 1000))
    assert [r["n_known"] for r in few] == [r["n_known"] for r in many] and np.allclose([r["score"] for r in few], [r["score"] for r in many])


def test_scores_do_not_depend_on_the_splits(spark, monkeypatch):
    """One split or eight, in another order: the same fits of the same rows."""
    monkeypatch.setattr(lm, "FIT_TOKENS", 20_000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, eight = ({r.doc_id: (r.n_tokens, r.base_score, r.score) for r in lm.score(x).collect()} for x in (df.coalesce(1), df.orderBy(F.desc("doc_id")).repartition(8)))
    assert set(one) == set(eight)
    for k, (n, base, score) in one.items():
        assert n == eight[k][0] and abs(base - eight[k][1]) < 1e-6 * max(1, n) and abs(score - eight[k][2]) < 1e-5 * max(1, n)
