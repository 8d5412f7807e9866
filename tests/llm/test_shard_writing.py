from __future__ import annotations

from collections import Counter

from cases import docs

from lontarix.llm import sharding


def test_rows_of_one_key_are_written_once(spark, tmp_path):
    rows = [(7, f"{i:040d}", "a") for i in range(60)] + [(None, "n" * 30, "a")] * 5 + [(i, "x" * 20, "b") for i in range(20)]
    sharding.write_shards(docs(spark, rows).select("doc_id", "text"), str(tmp_path / "s"), 500)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t) for i, t, _ in rows)
    assert len({r["shard"] for r in back}) > 1
