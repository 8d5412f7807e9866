"""Stores, snapshots, inventories, ontology files, streams and the command line."""

from __future__ import annotations

import hashlib
import json
import os
import threading

import pytest
from conftest import SF

from lontarix.__main__ import main
from lontarix.operators import graph, registry
from lontarix.sources import inventory, ontology, store
from lontarix.streaming import windows


def test_content_store(spark, tmp_path):
    path = str(tmp_path / "blobs")
    a, b = (spark.createDataFrame([(x,) for x in rows], "body string") for rows in (["satu", "dua", "dua", None], ["dua", "tiga"]))
    assert store.put(a, path, "body") == 2 and store.put(b, path, "body") == 1 and store.put(b, path, "body") == 0
    got = {r["sha256"]: bytes(r["bytes"]).decode() for r in store.get(spark, path).collect()}
    assert got == {hashlib.sha256(x.encode()).hexdigest(): x for x in ("satu", "dua", "tiga")}
    bad = store.get(spark, path).selectExpr("sha256", "cast('lain' as binary) AS bytes", "size")
    bad.write.parquet(str(tmp_path / "bad/batch=0"))
    with pytest.raises(Exception, match="damaged blob"):
        store.get(spark, str(tmp_path / "bad")).collect()


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert store.active(spark, root) is None
    one = store.publish(spark, root, {"t": spark.range(3), "u": spark.range(1)})
    held = store.pinned(spark, root)
    two = store.publish(spark, root, {"t": spark.range(5)})
    assert (one, two) == (1, 2) and store.active(spark, root) == 2
    assert held["t"].count() == 3 and set(held) == {"t", "u"} and store.pinned(spark, root)["t"].count() == 5
    spark.range(9).write.parquet(root + "/data-other/t")  # written, never published
    assert store.active(spark, root) == 2
    with pytest.raises(LookupError):
        store.pinned(spark, root, 3)


def receipt(sha, **more):
    return {"kind": "document", "error": "", "sha256": sha, "path": f"blobs/{sha}.pdf", "bytes": 5} | more


def test_inventory(spark, tmp_path):
    a, b = "a" * 64, "b" * 64
    rows = [
        {"portal": "p2", "source_url": "u", "integrity_status": "valid", "portal_fields": {"year": ["2020"]}, "pdfs": [receipt(a), receipt(b, error="404")]},
        {"portal": "p1", "source_url": "u", "integrity_status": "valid", "portal_fields": {}, "pdfs": [receipt(a)]},
        {"portal": "p0", "source_url": "u", "integrity_status": "broken", "portal_fields": {}, "pdfs": [receipt(b)]},
    ]
    f = tmp_path / "r.jsonl"
    f.write_text("\n".join(map(json.dumps, rows)))
    got = inventory.candidates(inventory.read(spark, str(f))).collect()
    assert [(r["sha256"], r["portal"], r["year"]) for r in got] == [(a, "p1", "unknown")]
    f.write_text(json.dumps(rows[0] | {"pdfs": [receipt(a, path="elsewhere")]}))
    with pytest.raises(Exception, match="invalid file receipt"):
        inventory.candidates(inventory.read(spark, str(f))).collect()


ONTOLOGY = """// An ontology.

  // of laws
{"schema_version": 1, "ontology_version": "v1", "entity_types": ["law", "body"],
 "qualifiers": [{"id": "since", "value_kinds": ["date"]}, {"id": "by", "value_kinds": ["entity", "literal"]}],
 "predicates": [{"id": "AMENDS", "subject_types": ["law"], "object_types": ["law"], "qualifier_ids": ["since"], "origins": ["explicit"], "allow_self": false},
  {"id": "NAMES", "subject_types": ["law", "body"], "object_types": ["body"], "qualifier_ids": [], "origins": ["explicit", "inferred"], "allow_self": true}]}"""


def test_ontology(spark):
    known = ontology.parse(ONTOLOGY.encode())
    assert known.version == "v1" and known.sha256 == hashlib.sha256(ONTOLOGY.encode()).hexdigest()
    rows = [
        ("ok", "AMENDS", "a", "b", "law", "law", "explicit", "v1", [("since", "date")]), ("self ok", "NAMES", "a", "a", "body", "body", "inferred", "v1", []), ("none", "NAMES", "a", "b", "law", "body", "explicit", "v1", None),
        ("self", "AMENDS", "a", "a", "law", "law", "explicit", "v1", []), ("ends", "AMENDS", "a", "b", "body", None, "explicit", "v1", []), ("origin", "AMENDS", "a", "b", "law", "law", "inferred", "v1", []),
        ("version", "AMENDS", "a", "b", "law", "law", "explicit", "v2", []), ("unknown", "NONE", "a", "b", "law", "law", "explicit", "v1", [("x", "date")]), ("qualifier", "AMENDS", "a", "b", "law", "law", "explicit", "v1", [("by", "entity"), ("since", "number")]),
        ("odd", "AMENDS", "a", "b", "law", "law", None, None, [(None, "date"), ("since", None)]),
    ]
    a = spark.createDataFrame(rows, "assertion_id string, predicate string, subject string, object string, subject_type string, object_type string, origin string, ontology_version string, qualifiers array<struct<id:string,kind:string>>")
    got = {tuple(r) for r in graph.admit(a, known.rules(spark), known.version).collect()}
    assert got == {
        ("self", "self_edge"), ("ends", "subject_type"), ("ends", "object_type"), ("origin", "origin"), ("version", "ontology_version"), ("unknown", "unknown_predicate"), ("qualifier", "qualifier"), ("qualifier", "qualifier_kind"),
        ("odd", "ontology_version"), ("odd", "origin"), ("odd", "qualifier"), ("odd", "qualifier_kind"),
    }


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ('"allow_self": true', '"allow": true'), ('"allow_self": true', '"allow_self": 1'), ('"allow_self": true', '"allow_self": true, "allow_self": true'), ('"schema_version": 1', '"schema_version": 2'), ('"v1"', '"v 1"'),
        ('"NAMES"', '"AMENDS"'), ('["body"]', '["nobody"]'), ('["law", "body"],\n', '["law", "law"],\n'), ('["since"]', '["until"]'), ('["date"]', '["time"]'), ('["explicit"]', "[]"), ('"explicit", "inferred"', '"guessed"'), ("// An", "\ufeff// An"), ('"id": "by"', '"id": "since"'),
    ],
)
def test_an_ontology_is_read_strictly(old, new):
    assert old in ONTOLOGY
    with pytest.raises(ValueError):
        ontology.parse(ONTOLOGY.replace(old, new, 1).encode())
    with pytest.raises(ValueError):
        ontology.parse(b"")


def test_candidate_plans_are_whole_or_errors(spark):
    schema = "mention_id long, entity_type string, text string, sources array<string>"
    rows = [(2, "law", " Undang  DASAR ", ["r2", "r1"]), (1, "agency", "Badan", ["r9"])]
    policy = spark.createDataFrame([("law", "national"), ("law", "r1"), ("agency", "national")], "entity_type string, scope string")
    plan = lambda rows, per=3, total=9: sorted(map(tuple, registry.candidate_plan(spark.createDataFrame(rows, schema), policy, ["law"], per, total).collect()))
    assert plan(rows) == [(1, 0, "agency", "national", "badan"), (2, 0, "law", "national", "undang dasar"), (2, 1, "law", "r1", "undang dasar"), (2, 2, "law", "r2", "undang dasar")]
    assert plan([]) == [] and len(plan(rows, total=4)) == 4
    for bad, said, limits in (
        (rows + rows[:1], "repeated", {}), ([(None, *rows[0][1:])], "missing", {}), ([(1, "body", "x", ["r"])], "no scopes", {}), ([(1, "law", " \t", ["r"])], "without text", {}), ([(1, "law", "x", [])], "sources", {}), ([(1, "law", "x", None)], "sources", {}),
        (rows, "of a mention exceeded", {"per": 2}), (rows, "budget exceeded", {"total": 3}),
    ):
        with pytest.raises(Exception, match=said):
            plan(bad, **limits)


def test_stream_in_append_mode(spark):
    out = windows.run_available(spark, SF, "events", lambda df: df.selectExpr("event_id", "value * 2 AS twice"), "append")
    assert out.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_merged_stream_goes_on(spark, tmp_path):
    """A second call finds all input read and gives the same rows from the state that the first one left."""
    state = f"file://{tmp_path}/state"
    args = (spark, SF, "events", ["user_id"], ["ts", "event_id"], ["event_type"])
    first = sorted(map(tuple, windows.merge_latest(*args, state=state).collect()))
    assert sorted(map(tuple, windows.merge_latest(*args, state=state).collect())) == first
    assert len(first) == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_publication_needs_its_predecessor(spark, tmp_path):
    root = str(tmp_path / "cas")
    assert store.publish(spark, root, {"t": spark.range(1)}) == 1
    assert store.publish(spark, root, {"t": spark.range(2)}, expected=1) == 2
    with pytest.raises(RuntimeError, match="has become active"):
        store.publish(spark, root, {"t": spark.range(3)}, expected=1)
    assert store.active(spark, root) == 2 and store.pinned(spark, root)["t"].count() == 2


def at_once(n, work):
    """What ``work`` returns or raises in each of n threads that begin together."""
    gate, out = threading.Barrier(n), [None] * n

    def one(i):
        gate.wait()
        try:
            out[i] = work(i)
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=one, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_exactly_one_of_several_writers_follows_a_snapshot(spark, tmp_path):
    root = str(tmp_path / "race")
    store.publish(spark, root, {"t": spark.range(1)})
    for turn in range(1, 4):
        out = at_once(4, lambda i, turn=turn: store.publish(spark, root, {"t": spark.range(10 * turn + i)}, expected=turn))
        won = [i for i, x in enumerate(out) if x == turn + 1]
        assert len(won) == 1 and all(isinstance(x, RuntimeError) for i, x in enumerate(out) if i not in won)
        assert store.active(spark, root) == turn + 1 and store.pinned(spark, root)["t"].count() == 10 * turn + won[0]
    assert not [n for n in os.listdir(root) if n.startswith("aside-")] and len([n for n in os.listdir(root) if n.startswith("data-")]) == 4


def test_writers_without_a_predecessor_all_get_a_number(spark, tmp_path):
    root = str(tmp_path / "line")
    out = at_once(4, lambda i: store.publish(spark, root, {"t": spark.range(i + 1)}))
    assert sorted(out) == [1, 2, 3, 4]
    assert [store.pinned(spark, root, n)["t"].count() for n in out] == [1, 2, 3, 4]


def test_a_late_writer_finds_the_version_taken(spark, tmp_path, monkeypatch):
    """Both saw the same predecessor; the other's rename came first."""
    root = str(tmp_path / "late")
    store.publish(spark, root, {"t": spark.range(1)})
    seen = store.active
    monkeypatch.setattr(store, "active", lambda s, r: 1)
    assert store.publish(spark, root, {"t": spark.range(2)}, expected=1) == 2
    with pytest.raises(RuntimeError):
        store.publish(spark, root, {"t": spark.range(3)}, expected=1)
    monkeypatch.setattr(store, "active", seen)
    assert store.active(spark, root) == 2 and store.pinned(spark, root)["t"].count() == 2
    assert os.listdir(f"{root}/version-{2:012d}") == ["manifest.json"] or sorted(os.listdir(f"{root}/version-{2:012d}"))[-1] == "manifest.json"


def test_a_sweep_keeps_what_is_leased(spark, tmp_path):
    root = str(tmp_path / "sweep")
    for n in range(1, 5):
        store.publish(spark, root, {"t": spark.range(n)})
    with store.leased(spark, root, 600, snapshot=2) as held:
        assert store.sweep(spark, root) == [1, 3]
        assert held["t"].count() == 2 and store.pinned(spark, root)["t"].count() == 4
        with pytest.raises(LookupError):
            store.pinned(spark, root, 3)
        with pytest.raises(LookupError):
            store.renew(spark, root, 3, 600)
    assert store.sweep(spark, root, keep=2) == [] and store.sweep(spark, root) == [2]
    store.publish(spark, root, {"t": spark.range(5)})
    store.renew(spark, root, 4, -1)  # ran out
    spark.range(1).write.parquet(f"{root}/data-abandoned/t")
    assert store.sweep(spark, root) == [4] and os.path.exists(f"{root}/data-abandoned")
    store.sweep(spark, root, grace=-60)
    assert not os.path.exists(f"{root}/data-abandoned") and os.listdir(f"{root}/leases") == [] and store.pinned(spark, root)["t"].count() == 5


def test_a_lease_got_just_before_brings_a_snapshot_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "close")
    for n in (1, 2):
        store.publish(spark, root, {"t": spark.range(n)})
    answers = iter([set(), {1}])
    monkeypatch.setattr(store, "_leases", lambda *a: next(answers))
    assert store.sweep(spark, root) == [] and store.pinned(spark, root, 1)["t"].count() == 1


def test_blobs_that_no_live_snapshot_refers_to_go(spark, tmp_path):
    path = str(tmp_path / "blobs")
    for bodies in (["a", "b", "c"], ["d", "e"], ["f"]):
        store.put(spark.createDataFrame([(x,) for x in bodies], "body string"), path, "body")
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in "abcdef"}
    held = spark.createDataFrame([(1, sha["a"]), (1, sha["b"]), (2, sha["b"]), (2, sha["b"]), (3, sha["d"]), (3, sha["e"])], "snapshot long, sha256 string")
    refs = store.references(held, store.get(spark, path), [2, 3])
    assert {r.sha256: (r.n_refs, r.n_live) for r in refs.collect()} == {sha["a"]: (1, 0), sha["b"]: (2, 1), sha["c"]: (0, 0), sha["d"]: (1, 1), sha["e"]: (1, 1), sha["f"]: (0, 0)}
    wanted = spark.createDataFrame([(r.sha256,) for r in refs.where("n_live > 0").collect()], "sha256 string")
    assert store.collect_blobs(spark, path, wanted) == 3 and store.collect_blobs(spark, path, wanted) == 0
    assert {bytes(r.bytes).decode() for r in store.get(spark, path).collect()} == {"b", "d", "e"}


def test_payload_of_two_writers(spark, tmp_path):
    path = str(tmp_path / "both")
    row = spark.createDataFrame([("satu",)], "body string")
    assert store.put(row, path, "body") == 1
    spark.read.parquet(path).drop("batch").write.parquet(path + "/batch=other")
    assert store.get(spark, path).count() == 1


def test_command_line(capsys, spark, tmp_path):
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out
    main(["sql", "lex_df"])
    assert "WITH" in capsys.readouterr().out
    main(["run", "inventory_audit", "--data", SF, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    with pytest.raises(SystemExit):
        main(["run", "nothing"])
