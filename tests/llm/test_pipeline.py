from __future__ import annotations

from collections import Counter

import pytest
from cases import LONG, docs
from conftest import SF
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lontarix.llm.tokens import byte_bpe  # noqa: E402
from test_cleaning import counts, plain_dedup  # noqa: E402
from test_search import plain_groups  # noqa: E402


def plain_lines(text):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = Counter()
    for x in (text or "").split("\n"):
        k = x.strip(" \t\n\v\f\r").translate(lower)
        if k:
            keys[k] += len([w for w in re.findall(r"[^\x20\x09-\x0D]+", x)])
    return keys


def plain_quality(rows):
    per = {}
    for i, t, h in rows:
        per.setdefault(h, set()).add(t or "")
    freq = {h: Counter(k for t in ts for k in plain_lines(t)) for h, ts in per.items()}
    hot = lambda k, h: freq[h][k] > 20 and freq[h][k] > 0.02 * len(per[h])
    out = []
    for i, t, h in rows:
        n, _, _, _, rep = counts(t)
        gone = sum(w for k, w in plain_lines(t).items() if hot(k, h))
        if n >= 50 and 100 * rep <= 50 * n and n - gone >= 0.2 * n:
            out.append((i, "\n".join(x for x in t.split("\n") if not hot(next(iter(plain_lines(x)), ""), h)), h))
    return out


def test_pipeline_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    kept = plain_quality(rows)
    lines = [(d, t) for d, _, _, t in plain_dedup(kept, 10)]
    groups = plain_groups(lines, 5, 80)
    final = {i: t for i, t in lines if groups[i][1] == i}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "best_fit_packing"]
    df = stages["quality_rules"](spark, table, SF)
    assert Counter((r["doc_id"], r["text"]) for r in df.collect()) == Counter((i, t) for i, t, _ in kept) and df.columns == corpus_pipeline.COLUMNS
    assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
    out = corpus_pipeline.run(spark, SF).collect()
    encode = byte_bpe()
    size = Counter()
    for r in out:
        size[r["doc_id"]] += r["length"]
    assert size == {i: len(encode(t)) + 1 for i, t in final.items()}


def test_stages_nest(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert Counter(map(tuple, d.select("doc_id", "length", "ids_crc32").collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "length", "ids_crc32").collect()))


def test_rows_without_or_with_one_id_are_judged_each(spark):
    good = lambda n: " ".join(f"w{n}x{j}" for j in range(60))
    rows = [(None, good(1), "a"), (None, "zu kurz", "a"), (5, good(2), "a"), (5, "auch kurz", "a"), (5, good(2), "a"), (5, good(3), "a"), (4, good(3), "b"), (None, good(1), "b"), (None, good(4), "b"), (None, good(2), "b")]
    df = docs(spark, rows).withColumn("lang", F.col("source")).withColumn("n_chars", F.col("doc_id"))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, df, SF)
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == Counter((i, t) for i, t, _ in rows if len(t) > 20)
    two = stages["near_dedup"](spark, one, SF)
    assert Counter((r["doc_id"], r["text"]) for r in two.collect()) == Counter([(None, good(1)), (5, good(2)), (4, good(3)), (None, good(4))])


def test_stages_on_odd_rows(spark, tmp_path):
    odd = docs(spark).withColumn("lang", F.col("source")).withColumn("n_chars", F.col("doc_id"))
    none = odd.where("false")
    for name, stage in corpus_pipeline.STAGES:
        for i, df in enumerate((odd, none)):
            stage(spark, df, SF).write.parquet(path := str(tmp_path / f"{name}{i}"))
            back = spark.read.parquet(path)
            if name == "line_dedup" and df is odd:
                assert back.count() == odd.count() and LONG in {r["text"] for r in back.collect()}
            assert back.count() == 0 or df is odd
