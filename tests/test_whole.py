"""Registered queries that once did a part of their job, on rows where the part and the whole differ."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import assert_same, connect

from lontarix import queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_cer_counts_whole_texts(spark, tmp_path):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [("user", "a" * 200 + "BCD" * 40), ("user", "Kurz"), ("assistant", "é" * 250 + "ÉXy"), ("assistant", "")]
    spark.createDataFrame(rows, "role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for role in ("user", "assistant"):
        texts = [t for r, t in rows if r == role]
        want[role] = sum(edits(t, t.translate(lower)) for t in texts) / sum(map(len, texts))
    got = {r["role"]: r["cer"] for r in queries.queries()["cer"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_evidence_query_answers_questions_without_document(spark):
    got = queries.queries()["evidence_query"](spark, SF)
    con = connect(SF)
    asked = {q for (q,) in con.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    assert {r["question_id"] for r in got.select("question_id").collect()} == asked
    assert_same(got, con, queries.oracles()["evidence_query"])


def test_cosine_leaves_out_vectors_without_direction(spark):
    from lontarix.operators import dense

    rows = [(i, [1.0, i / 10]) for i in range(10)] + [(20 + i, [0.0, 0.0]) for i in range(3)] + [(30, None), (31, [float("nan"), 1.0]), (32, [None, 1.0]), (33, [float("inf"), 0.0]), (34, [1.0]), (35, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id IN (0, 20, 30, 34)").withColumnRenamed("vec_id", "query_id")
    got = dense.cosine_top_k(df, asked, 5).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert found == {0: [0, 35, 1, 2, 3], 34: [34]}


def test_links_search_all_names(spark, tmp_path):
    spark.createDataFrame([(1, "Baut", "b1"), (2, " baut", "b2"), (3, "mur", "b2"), (9, "Mur ", "b2")], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["mention_id"]: (r["proposal"], r["canonical_id"]) for r in queries.queries()["link_proposals"](spark, str(tmp_path)).collect()}
    assert got == {1: ("LINK", 1), 2: ("LINK", 2), 3: ("DEFER", None), 9: ("DEFER", None)}


def test_page_end_markers_and_normalization_take_one_pass():
    """8,000 pages that end in a marker: each looks at the next page's first lines alone."""
    import time

    from lontarix.operators import structure

    text = "Pasal 1\n" + "a. isi ...\f\n- 3 -\nb. lain\n" * 8000 + "c. akhir ...\f\n7\nc. akhir\n"
    start = time.perf_counter()
    nodes = structure.parse_tree(text)
    assert time.perf_counter() - start < 10
    assert [n["label"] for n in nodes[-2:]] == ["b.", "c."] and len(nodes) == 2 + 16_000 + 1


def test_proposals_hold_no_pairs_of_a_block(spark, tmp_path):
    """20,000 parts of one name and one that stands alone: the pairs of the block would be 4 * 10^8."""
    from pyspark.sql import functions as F

    rows = spark.range(20_001).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < 20_000, "nut").otherwise("bolt").alias("p_name"), F.lit("b").alias("p_brand"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    start = spark.sparkContext._jvm.System.nanoTime()
    got = queries.queries()["link_proposals"](spark, str(tmp_path))
    assert {tuple(r) for r in got.where("proposal = 'LINK'").collect()} == {(20_000, "LINK", 20_000)} and got.count() == 20_001
    assert spark.sparkContext._jvm.System.nanoTime() - start < 20e9


def test_pairs_of_a_block_are_dealt_over_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.col("id").alias("p_partkey"), F.lit("nut").alias("p_name"), F.lit("b").alias("p_brand"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = queries.queries()["blocking_lookup"](spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 160_000 and max(sizes) < 80_000


def test_assertions_of_one_predicate_stay_dealt_over_tasks(spark):
    """Every row has an issue, so each task that held assertions gives rows."""
    from pyspark.sql import functions as F

    from lontarix.operators import graph
    from lontarix.queries.graph import ONTOLOGY
    from lontarix.sources import ontology

    known = ontology.parse(ONTOLOGY)
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS assertion_id", "'SHIPPED' AS predicate", "id AS subject", "-id AS object", "'nobody' AS subject_type", "'part' AS object_type", "'explicit' AS origin", "'items-v2' AS ontology_version", "CAST(array() AS array<struct<id:string,kind:string>>) AS qualifiers")
    got = graph.admit(rows, known.rules(spark), known.version).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in got) == [1000] * 4


def test_covers_of_a_text_are_those_of_its_tables(spark):
    """Ranges answered in the pass that makes the map: the same as by the join of tables, without a shuffle."""
    import random

    import numpy as np

    from lontarix.operators import structure

    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["a", "é", "\r\n", "\n", "  ", "\t", "\xad", "ﬃ", "ﬁ", " ", "字"]) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def some(text):
        return np.array([0, 1, 2, 5, 9]), np.array([1, 3, 2, 90, 12])

    maps, ranges = structure.byte_maps(docs), spark.createDataFrame([(i, a, z) for i, t in texts for a, z in zip(*(x.tolist() for x in some(t)), strict=True)], "doc_id long, start long, stop long")
    for one, join in ((structure.raw_cover_of(docs, some), structure.raw_cover(maps, ranges)), (structure.normalized_cover_of(docs, some), structure.normalized_cover(maps, ranges))):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, join.select(one.columns).collect()))
    for name in ("raw_line_cover", "normalized_text_cover", "byte_map"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_fitted_chunks_look_at_each_character_a_few_times():
    import time

    from lontarix.operators import structure

    text = "satu dua, tiga empat lima. " * 40_000
    start = time.perf_counter()
    got = structure.fitted_chunks(text, 16, lambda t: -(-len("".join(t.split())) // 4), overlap=0)
    assert time.perf_counter() - start < 4
    assert got[-1][1] == len(text) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_scores_of_a_block_are_held_a_tile_at_a_time():
    import tracemalloc

    import numpy as np

    from lontarix.operators import dense

    rng = np.random.default_rng(1)
    y, x, ids, q = rng.random((65_536, 4)), rng.random((300, 4)), rng.permutation(65_536), np.arange(300)
    tracemalloc.start()
    parts = list(dense._best(ids, y, q, x, 7, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    s = np.floor(x[299] @ y.T * 1000 + 0.5) / 1000
    want = np.lexsort((ids, -s))[:7]
    assert parts[-1][1][-7:].tolist() == ids[want].tolist() and sum(len(p[0]) for p in parts) == 300 * 7


def test_lines_are_made_a_few_megabytes_at_a_time():
    import pyarrow as pa

    from lontarix.operators import evidence

    texts = ["a\n" * 1_500_000] * 5 + [None, ""]
    pieces = list(evidence._pieces(pa.record_batch([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])))
    assert [i for p in pieces for i in p.column(0).to_pylist()] == list(range(7)) and max(p.num_rows for p in pieces) < 5


def test_batches_meet_in_one_aggregation(spark):
    """One table of both sides and no join; ids that are null match nothing, as in a join."""
    from lontarix.operators import admission

    mentions = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (2, None, 4), (3, 1, 4), (4, 1, 4), (4, 1, 4)], "batch_id long, mention_id long, revision int")
    lookups = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (2, None, 4), (3, 1, 3), (3, 9, 4), (4, 1, 4), (5, 1, None)], "batch_id long, mention_id long, revision int")
    got = admission.candidate_batches(mentions, lookups)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0, 0, 0, 0, "VALID"), (2, 1, 1, 1, 0, 0, "INVALID"), (3, 1, 0, 1, 0, 1, "INVALID"), (4, 1, 0, 0, 1, 0, "INVALID"), (5, 0, 0, 1, 0, 0, "INVALID")]
