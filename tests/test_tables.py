"""Table functions in SQL against the DataFrame forms."""

from __future__ import annotations

from conftest import SF

from lontarix.operators import structure, tables


def test_lateral_splitters_are_the_dataframe_s(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    tables.register(spark)
    got = spark.sql("SELECT d.doc_id, c.start, c.stop, c.tokens FROM {docs} d, LATERAL text_chunks(d.text) c", docs=docs)
    want = structure.chunks(docs).select("doc_id", "start", "stop", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    got = spark.sql("SELECT d.doc_id, w.start, w.stop FROM {docs} d, LATERAL text_windows(d.text) w", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, structure.windows(docs).collect()))


def test_a_splitter_of_the_caller_s(spark):
    tables.register(spark, {"letters": (lambda text: [(i, c) for i, c in enumerate(text)], "at: bigint, letter: string")})
    rows = spark.sql("SELECT x.id, l.* FROM VALUES (1, 'ab'), (2, null), (3, '') AS x(id, t), LATERAL letters(x.t) l").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a"), (1, 1, "b")]
