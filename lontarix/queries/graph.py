"""Graph family: customers, orders and parts are nodes; orders and line items are the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_space, surface
from ..operators import graph, registry, traversal
from ..session import table
from ..sources import ontology
from ..sources.shared import cut


def _told(s: SparkSession, d: str, once: bool = False) -> DataFrame:
    o = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("assertion_id"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit("PLACED").alias("predicate"), F.concat(F.lit("o"), "o_orderkey").alias("object"))
    li = table(s, d, "lineitem").select(F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.concat(F.lit("o"), "l_orderkey").alias("subject"), F.lit("CONTAINS").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object"))
    return o.unionByName(li.distinct() if once else li)


def edges(s: SparkSession, d: str) -> DataFrame:
    """Orders and distinct line items as assertions."""
    return _told(s, d, once=True)


def neighbors(s, d):
    seeds = table(s, d, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.neighbours(edges(s, d), seeds)


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


def paths_2hop(s, d):
    return graph.paths(edges(s, d), _seeds(s, d), 2).select("seed", "hop", F.array_join("nodes", ">").alias("nodes"), F.array_join("assertions", ">").alias("assertions"))


def paths_3hop_simple(s, d):
    return graph.paths(edges(s, d), _seeds(s, d), 3).groupBy("seed", "hop").agg(F.count("*").alias("n"), F.min(F.array_join("nodes", ">")).alias("first_path"), F.max(F.array_join("nodes", ">")).alias("last_path"))


def paths_budget(s, d):
    found, ends = traversal.search(edges(s, d), _supports(s, d), _seeds(s, d), 2, max_paths=25)
    ends = ends.select("seed", F.array_contains("stop_reasons", "path_budget").alias("truncated"))
    return found.join(ends, "seed").select("seed", "rank", "truncated", F.array_join("assertions", ">").alias("assertions"))


def _supports(s: SparkSession, d: str) -> DataFrame:
    """Line items support their order's edge and their own, by supplier."""
    li = table(s, d, "lineitem")
    own = li.select(F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.concat(F.lit("s"), "l_suppkey").alias("support_id"))
    return own.unionByName(li.select(F.concat(F.lit("o"), "l_orderkey").alias("assertion_id"), F.concat(F.lit("t"), "l_suppkey").alias("support_id")))


def _searched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(s, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return traversal.search(edges(s, d), _supports(s, d), seeds, 3, max_paths=60, max_assertions=12)


def path_search(s, d):
    """Walks from customers over orders and parts to other orders, within budgets of paths and of a node's assertions."""
    found, _ = _searched(s, d)
    return found.select("seed", "rank", "hop", *(F.array_join(c, ">", "-").alias(c) for c in ("nodes", "assertions", "supports")))


def path_stops(s, d):
    _, ends = _searched(s, d)
    return ends.withColumn("stop_reasons", F.array_join("stop_reasons", ","))


def path_sources(s, d):
    found = cut(graph.paths(edges(s, d), _seeds(s, d), 2), "found")
    # The supports of a path's assertions are those of its orders' lines.
    lines = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("node"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.col("l_suppkey").alias("source"))
    return graph.path_sources(found, graph.of_nodes(lines, found.select(F.explode("nodes").alias("node")).where("node LIKE 'o%'")))


def path_usable(s, d):
    """Paths that go through parts of even number only."""
    found = cut(graph.paths(edges(s, d), _seeds(s, d), 2).where("hop = 2"), "found")
    selected = graph.directions(_told(s, d)).where("NOT (node LIKE 'p%' AND substr(node, 2) % 2 = 1)").select("node")
    return graph.usable_paths(found, selected).groupBy("seed", "usable").agg(F.count("*").alias("n"))


def ancestors(s, d):
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("label"))
    return graph.ancestor_paths(r.unionByName(n).unionByName(c))


def assertion_canonical_dedup(s, d):
    li = table(s, d, "lineitem").withColumn("assertion_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return graph.canonical(li, "l_partkey", "l_suppkey", "l_returnflag")


def support_fanin(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_supports"), F.count_distinct("l_orderkey").alias("n_groups"))


def orphan_edges(s, d):
    """Line items without their order, and those whose supplier number no supplier has."""
    li = table(s, d, "lineitem")
    no_order = li.join(table(s, d, "orders").where("o_orderkey % 97 <> 0"), li.l_orderkey == F.col("o_orderkey"), "left_anti").select("l_orderkey", F.lit("order").alias("missing"))
    no_supp = li.join(table(s, d, "supplier").where("s_suppkey % 41 <> 0"), li.l_suppkey == F.col("s_suppkey"), "left_anti").select("l_orderkey", F.lit("supplier").alias("missing"))
    return no_order.unionByName(no_supp).groupBy("l_orderkey", "missing").agg(F.count("*").alias("n"))


def edge_audit(s, d):
    e = edges(s, d)
    return e.groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("assertion_id").alias("n_ids"), F.count_distinct("subject").alias("n_subjects"), F.sum(F.when(F.col("subject") == F.col("object"), 1).otherwise(0)).alias("n_loops"))


def exception_ids(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("assertion_id"), F.concat_ws(":", "o_custkey", "o_orderstatus").alias("content"))
    refs = o.where("assertion_id % 10 = 0 AND assertion_id > 0").select("assertion_id", F.expr("assertion_id div 10").alias("exception_id"))
    return graph.exception_ids(o, refs).select("assertion_id", "canonical_id", F.col("level").cast("long").alias("level"))


def _plan_state(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("producer"), "lang")
    before = docs.where("item_id % 29 <> 1").drop("lang")
    after = docs.where("item_id % 31 <> 2").withColumn("content_hash", F.when(F.col("item_id") % 37 == 3, F.lit("changed")).otherwise(F.col("content_hash")))
    after = after.withColumn("producer", F.when((F.col("lang") == "es") & (F.col("item_id") % 5 == 0), "v2").otherwise("v1")).drop("lang")
    deps = docs.where("item_id > 0 AND item_id % 4 = 0").select("item_id", F.expr("item_id div 2").alias("dependency_id"))
    return before, after, deps


def update_plan(s, d):
    return graph.update_plan(*_plan_state(s, d))


def _scoped(s: SparkSession, d: str) -> DataFrame:
    """Customers as aliases of their segment in their nation, visible from one revision until another."""
    c, rev = table(s, d, "customer"), F.col("c_custkey") % 40
    return c.select(F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("scope"), rev.alias("from_rev"), F.when(F.col("c_custkey") % 3 > 0, rev + 1 + F.col("c_custkey") % 7).alias("to_rev"))


def scope_index(s, d):
    return graph.scope_index(_scoped(s, d), "scope")


def update_plan_lookups(s, d):
    """Documents looked up a scope each, some of them one that has no row; the plan goes from revision 20 to 23."""
    before, after, deps = _plan_state(s, d)
    index = cut(graph.scope_index(_scoped(s, d), "scope"), "scope-index")
    segment = F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "NOTHING", "FURNITURE"))), (F.col("item_id") % 4 + 1).cast("int"))
    asked = [df.select("item_id", F.concat_ws(":", F.col("item_id") % 25, segment).alias("scope")) for df in (before, after)]
    first = graph.looked_up(asked[0], index, "scope", 20)
    # A tenth of the documents has dropped its dependency.
    own = [deps.withColumn("hash", F.lit("h")), deps.where("item_id % 10 <> 8").withColumn("hash", F.lit("h"))]
    return graph.update_plan(before, after, deps, tuple(own), (first, graph.looked_up(asked[1], index, "scope", 23)))


def reverse_closure(s, d):
    _, _, deps = _plan_state(s, d)
    changed = table(s, d, "documents").where("doc_id % 37 = 3").select(F.col("doc_id").alias("item_id"))
    return graph.reverse_closure(changed, deps).select("item_id", F.col("hops").cast("long").alias("hops"))


#: An ontology of line items: what was returned and what was shipped, with quantities, flags and dates.
ONTOLOGY = b"""// Line items.
{"schema_version": 1, "ontology_version": "items-v2", "entity_types": ["order", "part", "supplier"],
 "qualifiers": [{"id": "quantity", "value_kinds": ["number"]}, {"id": "flag", "value_kinds": ["literal", "entity"]}, {"id": "day", "value_kinds": ["date"]}],
 "predicates": [
  {"id": "RETURNED", "subject_types": ["order"], "object_types": ["part"], "qualifier_ids": ["quantity", "flag"], "origins": ["explicit"], "allow_self": false},
  {"id": "SHIPPED", "subject_types": ["order", "supplier"], "object_types": ["part", "order"], "qualifier_ids": ["day"], "origins": ["explicit", "inferred"], "allow_self": true}]}"""


def ontology_admission(s, d):
    """Line items as assertions of two predicates and one that isn't known, with ends, origins and qualifiers of all kinds."""
    o, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    one = F.struct(pick(o, "quantity", "flag", "day", "other").alias("id"), pick(n, "number", "literal", "date", "entity").alias("kind"))
    rows = table(s, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_returnflag") == "A", "SHIPPED").otherwise("LOST").alias("predicate"),
        o.cast("string").alias("subject"), F.col("l_partkey").cast("string").alias("object"), pick(k, "order", "supplier", "nobody").alias("subject_type"), pick(n, "part", "order").alias("object_type"),
        pick(o, "explicit", "inferred").alias("origin"), F.when(o % 50 == 7, "items-v1").otherwise("items-v2").alias("ontology_version"), F.when(n % 3 == 0, F.array(one)).when(n % 3 == 1, F.array()).alias("qualifiers"),
    )
    known = ontology.parse(ONTOLOGY)
    return graph.admit(rows, known.rules(s), known.version).groupBy("assertion_id", "issue").agg(F.count("*").alias("n"))


def candidate_plan(s, d):
    """Parts are mentions of three types, two of which are looked up in the regulations that they were found in too."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("law", "agency", "article"))), (k % 3 + 1).cast("int"))
    mentions = table(s, d, "part").select(k.alias("mention_id"), kind.alias("entity_type"), F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" \t")).alias("text"), F.array(F.concat(F.lit("r"), k % 11), F.concat(F.lit("r"), k % 7)).alias("sources"))
    policy = s.createDataFrame([("law", "national"), ("law", "r3"), ("agency", "national"), ("article", "provision")], "entity_type string, scope string")
    return registry.candidate_plan(mentions, policy, ["law", "article"], 4, 1 << 40)


def endpoint_substitution(s, d):
    resolved = table(s, d, "customer").select(F.col("c_custkey").alias("mention_id"), F.col("c_nationkey").cast("long").alias("canonical_id"), F.lit("LINK").alias("proposal"))
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("assertion_id"), F.col("o_custkey").alias("subject"), F.lit("NEXT").alias("predicate"), F.expr("o_custkey div 2").alias("object"))
    return graph.substitute(a, resolved)


def graph_merge(s, d):
    h = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"))
    g = table(s, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"))
    return graph.merge_graph(h, g, table(s, d, "labels").select(F.col("doc_id").alias("key")).distinct())


def graph_delta_merge(s, d):
    """MERGE of new edges: what is there already is left alone, new rows carry the sequence they are visible from."""
    e = edges(s, d).where("predicate = 'PLACED'").withColumn("from_seq", F.lit(1).cast("long"))
    old = e.where("substr(assertion_id, 2) % 3 <> 0")
    new = registry.merge_new(old, e.withColumn("from_seq", F.lit(2).cast("long")), ["assertion_id"])
    return old.unionByName(new)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_brand").alias("scope"), F.concat(F.lit("  "), F.initcap("p_name")).alias("text"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("canonical_id"), F.col("p_brand").alias("scope"), surface("p_name").alias("surface"))


def blocking_lookup(s, d):
    return registry.block(_mentions(s, d), _names(s, d), "text", ["scope"]).select("mention_id", "canonical_id", "surface")


def link_proposals(s, d):
    return registry.propose_blocked(_mentions(s, d), _names(s, d), "text", ["scope"])


def ngram_alias_link(s, d):
    """Phrases of benchmark passages that start a document, as aliases of that document."""
    starts = F.array_join(F.slice(F.split(F.lower(collapse_space("text")), "[^a-z]+"), 1, 2), " ")
    aliases = table(s, d, "documents").select(F.col("doc_id").alias("canonical_id"), starts.alias("surface")).where("length(surface) > 3")
    found = registry.link_phrases(table(s, d, "benchmark"), aliases, 3, "item_id")
    return found.groupBy("item_id", "phrase").agg(F.count("*").alias("n_ids"), F.bool_or("ambiguous").alias("ambiguous"))


def identity_claims(s, d):
    o = table(s, d, "customer").select("c_nationkey", "c_mktsegment")
    known = o.where("c_nationkey < 10").distinct().withColumn("identity", F.concat_ws("/", "c_nationkey", "c_mktsegment"))
    return registry.claim_identities(known, o, ["c_nationkey", "c_mktsegment"])


def natural_keys(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type")
    return p.select("p_partkey", registry.natural_key("p_brand", "p_type").alias("natural_key"), registry.point_uuid(F.col("p_partkey").cast("string")).alias("point_id"))


def upsert_merge(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(c.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return registry.upsert(c, new, ["c_custkey"])


QUERIES = {f.__name__: f for f in (neighbors, paths_2hop, paths_3hop_simple, paths_budget, path_search, path_stops, scope_index, update_plan_lookups, path_sources, path_usable, ancestors, assertion_canonical_dedup, support_fanin, orphan_edges, edge_audit, exception_ids, update_plan, reverse_closure, ontology_admission, candidate_plan, endpoint_substitution, graph_merge, graph_delta_merge, blocking_lookup, link_proposals, ngram_alias_link, identity_claims, natural_keys, upsert_merge)}

EDGES = """
ed AS (SELECT 'o' || o_orderkey AS assertion_id, 'c' || o_custkey AS subject, 'PLACED' AS predicate, 'o' || o_orderkey AS object FROM orders UNION ALL
SELECT DISTINCT concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'o' || l_orderkey, 'CONTAINS', 'p' || l_partkey FROM lineitem),
di AS MATERIALIZED (SELECT subject AS node, assertion_id, object AS other FROM ed UNION ALL SELECT object, assertion_id, subject FROM ed WHERE subject <> object),
p1 AS MATERIALIZED (SELECT 'c' || c_custkey AS seed, 1 AS hop, ['c' || c_custkey, other] AS nodes, [assertion_id] AS a FROM customer JOIN di ON node = 'c' || c_custkey WHERE c_custkey % 100 = 0),
p2 AS MATERIALIZED (SELECT seed, 2 AS hop, list_append(nodes, other) AS nodes, list_append(a, assertion_id) AS a FROM p1 JOIN di ON node = nodes[-1] WHERE NOT list_contains(nodes, other)),
p3 AS (SELECT seed, 3 AS hop, list_append(nodes, other) AS nodes, list_append(a, assertion_id) AS a FROM p2 JOIN di ON node = nodes[-1] WHERE NOT list_contains(nodes, other)),
p12 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), p123 AS (SELECT * FROM p12 UNION ALL SELECT * FROM p3)"""
_LI = "concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_SEARCH = f"""sd AS (SELECT 'c' || c_custkey AS seed FROM customer WHERE c_custkey % 20 = 0),
deg AS (SELECT node, count(*) AS k FROM di GROUP BY 1), adj AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY assertion_id, other) AS pl FROM di) WHERE pl <= 12),
r1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY a, nodes) AS rank FROM (SELECT seed, [seed, other] AS nodes, [assertion_id] AS a FROM sd JOIN adj ON node = seed)),
f1 AS (SELECT * FROM r1 WHERE seed NOT IN (SELECT seed FROM r1 WHERE rank > 60)), u1 AS (SELECT seed, count(*) AS used FROM f1 GROUP BY 1),
r2 AS MATERIALIZED (SELECT seed, nodes, a, used + row_number() OVER (PARTITION BY seed ORDER BY a, nodes) AS rank FROM (
  SELECT seed, list_append(nodes, other) AS nodes, list_append(a, assertion_id) AS a FROM f1 JOIN adj ON node = nodes[-1] WHERE NOT list_contains(nodes, other)) JOIN u1 USING (seed)),
f2 AS (SELECT * FROM r2 WHERE seed NOT IN (SELECT seed FROM r2 WHERE rank > 60)), u2 AS (SELECT seed, max(rank) AS used FROM f2 GROUP BY 1),
r3 AS MATERIALIZED (SELECT seed, nodes, a, used + row_number() OVER (PARTITION BY seed ORDER BY a, nodes) AS rank FROM (
  SELECT seed, list_append(nodes, other) AS nodes, list_append(a, assertion_id) AS a FROM f2 JOIN adj ON node = nodes[-1] WHERE NOT list_contains(nodes, other)) JOIN u2 USING (seed)),
ranked AS (SELECT *, 1 AS hop FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3), kept AS (SELECT * FROM ranked WHERE rank <= 60),
walked AS (SELECT seed, [seed] AS nodes FROM sd UNION ALL SELECT seed, nodes FROM f1 UNION ALL SELECT seed, nodes FROM f2),
sup AS (SELECT assertion_id, min(x) AS sup FROM (SELECT {_LI} AS assertion_id, 's' || l_suppkey AS x FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 't' || l_suppkey FROM lineitem) GROUP BY 1)"""
_SCOPES = """al AS (SELECT c_nationkey || ':' || c_mktsegment AS scope, c_custkey % 40 AS f, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 + 1 + c_custkey % 7 END AS t FROM customer),
st AS (SELECT scope, revision, sum(d) AS d FROM (SELECT scope, f AS revision, 1 AS d FROM al UNION ALL SELECT scope, t, -1 FROM al WHERE t IS NOT NULL) GROUP BY 1, 2),
sx AS (SELECT scope, revision, sum(d) OVER (PARTITION BY scope ORDER BY revision)::BIGINT AS n FROM st)"""
_PLAN = """
docs AS (SELECT doc_id AS item_id, sha256(text) AS h, lang FROM documents),
b AS (SELECT item_id, h FROM docs WHERE item_id % 29 <> 1),
n AS (SELECT item_id, CASE WHEN item_id % 37 = 3 THEN 'changed' ELSE h END AS h, CASE WHEN lang = 'es' AND item_id % 5 = 0 THEN 'v2' ELSE 'v1' END AS p FROM docs WHERE item_id % 31 <> 2),
dep AS (SELECT item_id, item_id // 2 AS dependency_id FROM docs WHERE item_id > 0 AND item_id % 4 = 0),
dr AS (SELECT item_id, CASE WHEN b.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'REMOVED' WHEN b.h <> n.h THEN 'CONTENT' WHEN p <> 'v1' THEN 'PRODUCER' END AS direct FROM b FULL JOIN n USING (item_id))"""

ORACLES = {
    "neighbors": f"WITH {EDGES} SELECT DISTINCT node, other FROM di JOIN part ON node = 'p' || p_partkey WHERE p_partkey % 10 = 0",
    "paths_2hop": f"WITH {EDGES} SELECT seed, hop, array_to_string(nodes, '>') AS nodes, array_to_string(a, '>') AS assertions FROM p12",
    "paths_3hop_simple": f"WITH {EDGES} SELECT seed, hop, count(*)::BIGINT AS n, min(array_to_string(nodes, '>')) AS first_path, max(array_to_string(nodes, '>')) AS last_path FROM p123 GROUP BY 1, 2",
    "paths_budget": f"""WITH {EDGES}, r AS (SELECT seed, a, row_number() OVER (PARTITION BY seed ORDER BY hop, a, nodes)::INTEGER AS rank, count(*) OVER (PARTITION BY seed) AS k FROM p12)
SELECT seed, rank, k > 25 AS truncated, array_to_string(a, '>') AS assertions FROM r WHERE rank <= 25""",
    "path_search": f"""WITH {EDGES}, {_SEARCH}, e AS (SELECT seed, rank, unnest(a) AS assertion_id, generate_subscripts(a, 1) AS i FROM kept),
es AS (SELECT seed, rank, string_agg(coalesce(sup, '-'), '>' ORDER BY i) AS supports FROM e LEFT JOIN sup USING (assertion_id) GROUP BY 1, 2)
SELECT seed, rank::INTEGER AS rank, hop, array_to_string(nodes, '>') AS nodes, array_to_string(a, '>') AS assertions, supports FROM kept JOIN es USING (seed, rank)""",
    "path_stops": f"""WITH {EDGES}, {_SEARCH}, why AS (
SELECT seed, 'path_budget' AS reason FROM ranked WHERE rank > 60 UNION SELECT seed, 'assertion_budget' FROM walked JOIN deg ON node = nodes[-1] WHERE k > 12
UNION SELECT seed, 'hop_budget' FROM kept WHERE hop = 3 AND seed NOT IN (SELECT seed FROM ranked WHERE rank > 60)),
w AS (SELECT seed, string_agg(reason, ',' ORDER BY reason) AS r FROM why GROUP BY 1), k AS (SELECT seed, count(*) AS n FROM kept GROUP BY 1)
SELECT seed, coalesce(n, 0)::BIGINT AS n_paths, coalesce(r, '') AS stop_reasons, r IS NULL AS exhausted FROM sd LEFT JOIN w USING (seed) LEFT JOIN k USING (seed)""",
    "scope_index": f"WITH {_SCOPES} SELECT * FROM sx",
    "update_plan_lookups": f"""WITH RECURSIVE {_PLAN}, {_SCOPES},
q AS (SELECT item_id, (item_id % 25) || ':' || ['BUILDING', 'MACHINERY', 'NOTHING', 'FURNITURE'][item_id % 4 + 1] AS scope FROM dr),
at20 AS (SELECT scope, max(revision) AS r, arg_max(n, revision) = 0 AS e FROM sx WHERE revision <= 20 GROUP BY 1), at23 AS (SELECT scope, max(revision) AS r, arg_max(n, revision) = 0 AS e FROM sx WHERE revision <= 23 GROUP BY 1),
d2 AS (SELECT dr.item_id, coalesce(direct, CASE WHEN dr.item_id > 0 AND dr.item_id % 4 = 0 AND dr.item_id % 10 = 8 THEN 'DEPENDENCY'
  WHEN coalesce(a.r, 0) <> coalesce(b.r, 0) OR coalesce(a.e, true) <> coalesce(b.e, true) THEN 'LOOKUP' END) AS direct FROM dr JOIN q ON q.item_id = dr.item_id LEFT JOIN at20 a ON a.scope = q.scope LEFT JOIN at23 b ON b.scope = q.scope),
c AS (SELECT item_id FROM d2 WHERE direct IS NOT NULL UNION SELECT dep.item_id FROM c JOIN dep ON dependency_id = c.item_id),
orph AS (SELECT DISTINCT dep.item_id FROM dep JOIN d2 ON d2.item_id = dependency_id AND direct = 'REMOVED')
SELECT item_id, CASE WHEN direct = 'REMOVED' OR item_id IN (FROM orph) THEN 'REVIEW' WHEN item_id IN (FROM c) THEN 'RECOMPUTE' ELSE 'REUSE' END AS bucket,
coalesce(direct, CASE WHEN item_id IN (FROM c) THEN 'DEPENDENCY' ELSE 'UNCHANGED' END) AS reason FROM d2""",
    "path_sources": f"WITH {EDGES}, u AS (SELECT DISTINCT seed, unnest(a) AS assertion_id FROM p12) SELECT DISTINCT seed, l_suppkey AS source FROM u JOIN lineitem ON assertion_id = {_LI}",
    "path_usable": f"""WITH {EDGES}, x AS (SELECT seed, len(list_filter(nodes, lambda n: n[1] = 'p' AND substr(n, 2)::BIGINT % 2 = 1)) = 0 AS usable FROM p2)
SELECT seed, usable, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""",
    "ancestors": """SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL
SELECT 'n' || n_nationkey, 1, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
SELECT 'c' || c_custkey, 2, r_name || ' > ' || n_name || ' > ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "assertion_canonical_dedup": "SELECT sha256(concat_ws('|', l_partkey, l_suppkey, l_returnflag)) AS assertion_key, min(concat_ws('-', l_orderkey, l_linenumber)) AS representative, count(*)::BIGINT AS n FROM lineitem GROUP BY 1",
    "support_fanin": "SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n_supports, count(DISTINCT l_orderkey)::BIGINT AS n_groups FROM lineitem GROUP BY 1, 2",
    "orphan_edges": """SELECT l_orderkey, 'order' AS missing, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0) GROUP BY 1 UNION ALL
SELECT l_orderkey, 'supplier', count(*)::BIGINT FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 41 <> 0) GROUP BY 1""",
    "edge_audit": f"WITH {EDGES} SELECT predicate, count(*)::BIGINT AS n, count(DISTINCT assertion_id)::BIGINT AS n_ids, count(DISTINCT subject)::BIGINT AS n_subjects, count(*) FILTER (subject = object)::BIGINT AS n_loops FROM ed GROUP BY 1",
    "exception_ids": """WITH RECURSIVE o AS (SELECT o_orderkey AS k, concat_ws(':', o_custkey, o_orderstatus) AS c FROM orders),
r AS (SELECT k, sha256(c) AS canonical_id, 0 AS level FROM o WHERE NOT (k % 10 = 0 AND k > 0) UNION ALL
SELECT o.k, sha256(o.c || '|' || r.canonical_id), r.level + 1 FROM r JOIN o ON o.k = r.k * 10 AND o.k > 0)
SELECT k AS assertion_id, canonical_id, level::BIGINT AS level FROM r""",
    "update_plan": f"""WITH RECURSIVE {_PLAN}, c AS (SELECT item_id FROM dr WHERE direct IS NOT NULL UNION SELECT dep.item_id FROM c JOIN dep ON dependency_id = c.item_id),
orph AS (SELECT DISTINCT dep.item_id FROM dep JOIN dr ON dr.item_id = dependency_id AND direct = 'REMOVED')
SELECT item_id, CASE WHEN direct = 'REMOVED' OR item_id IN (FROM orph) THEN 'REVIEW' WHEN item_id IN (FROM c) THEN 'RECOMPUTE' ELSE 'REUSE' END AS bucket,
coalesce(direct, CASE WHEN item_id IN (FROM c) THEN 'DEPENDENCY' ELSE 'UNCHANGED' END) AS reason FROM dr""",
    "reverse_closure": f"""WITH RECURSIVE {_PLAN}, c AS (SELECT item_id, 0 AS hops FROM docs WHERE item_id % 37 = 3 UNION ALL SELECT dep.item_id, hops + 1 FROM c JOIN dep ON dependency_id = c.item_id)
SELECT item_id, min(hops)::BIGINT AS hops FROM c GROUP BY 1""",
    "ontology_admission": f"""WITH a AS (SELECT {_LI[:-1].replace("'l', ", "")}) AS assertion_id, l_returnflag AS f, l_orderkey AS o, l_linenumber AS n, l_suppkey AS k, l_orderkey = l_partkey AS loop FROM lineitem),
b AS (SELECT *, f IN ('R', 'A') AS known, ['quantity', 'flag', 'day', 'other'][o % 4 + 1] AS q, ['number', 'literal', 'date', 'entity'][n % 4 + 1] AS kind FROM a),
c AS (SELECT *, (f = 'R' AND q IN ('quantity', 'flag')) OR (f = 'A' AND q = 'day') AS has FROM b),
i AS (SELECT assertion_id, 'ontology_version' AS issue FROM c WHERE o % 50 = 7 UNION ALL SELECT assertion_id, 'unknown_predicate' FROM c WHERE NOT known
UNION ALL SELECT assertion_id, 'subject_type' FROM c WHERE (f = 'R' AND k % 3 <> 0) OR (f = 'A' AND k % 3 = 2) UNION ALL SELECT assertion_id, 'object_type' FROM c WHERE f = 'R' AND n % 2 = 1
UNION ALL SELECT assertion_id, 'self_edge' FROM c WHERE f = 'R' AND loop UNION ALL SELECT assertion_id, 'origin' FROM c WHERE f = 'R' AND o % 2 = 1
UNION ALL SELECT assertion_id, 'qualifier' FROM c WHERE known AND n % 3 = 0 AND NOT has
UNION ALL SELECT assertion_id, 'qualifier_kind' FROM c WHERE n % 3 = 0 AND has AND NOT ((q = 'quantity' AND kind = 'number') OR (q = 'flag' AND kind IN ('literal', 'entity')) OR (q = 'day' AND kind = 'date')))
SELECT assertion_id, issue, count(*)::BIGINT AS n FROM i GROUP BY 1, 2""",
    "candidate_plan": r"""WITH m AS (SELECT p_partkey AS mention_id, ['law', 'agency', 'article'][p_partkey % 3 + 1] AS entity_type, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS lookup,
list_sort(list_distinct(CASE p_partkey % 3 WHEN 0 THEN ['national', 'r3'] WHEN 1 THEN ['national'] ELSE ['provision'] END || CASE WHEN p_partkey % 3 <> 1 THEN ['r' || p_partkey % 11, 'r' || p_partkey % 7] ELSE [] END)) AS s FROM part)
SELECT mention_id, (generate_subscripts(s, 1) - 1)::INTEGER AS place, entity_type, unnest(s) AS scope, lookup FROM m""",
    "endpoint_substitution": "SELECT o_orderkey AS assertion_id, a.c_nationkey::BIGINT AS subject, 'NEXT' AS predicate, b.c_nationkey::BIGINT AS object FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_custkey // 2",
    "graph_merge": """WITH x AS (SELECT doc_id AS key, doc_id % 2 = 0 AS h, doc_id % 3 = 0 AS g, doc_id IN (SELECT doc_id FROM labels) AS c FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT key, CASE WHEN h AND g THEN 'BOTH' WHEN h THEN 'HYBRID' ELSE 'GRAPH' END AS origin, h OR c AS accepted, CASE WHEN NOT (h OR c) THEN 'outside_graph_support_spans' END AS reason FROM x""",
    "graph_delta_merge": "SELECT 'o' || o_orderkey AS assertion_id, 'c' || o_custkey AS subject, 'PLACED' AS predicate, 'o' || o_orderkey AS object, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END::BIGINT AS from_seq FROM orders",
    "blocking_lookup": "SELECT m.p_partkey AS mention_id, a.p_partkey AS canonical_id, lower(trim(a.p_name)) AS surface FROM part m JOIN part a ON m.p_brand = a.p_brand AND lower(trim(m.p_name)) = lower(trim(a.p_name))",
    "link_proposals": """WITH c AS (SELECT m.p_partkey AS mention_id, count(DISTINCT a.p_partkey) AS n, min(a.p_partkey) AS one FROM part m LEFT JOIN part a ON m.p_brand = a.p_brand AND lower(trim(m.p_name)) = lower(trim(a.p_name)) GROUP BY 1)
SELECT mention_id, CASE WHEN n = 1 THEN 'LINK' ELSE 'DEFER' END AS proposal, CASE WHEN n = 1 THEN one END AS canonical_id FROM c""",
    "ngram_alias_link": r"""WITH al AS (SELECT DISTINCT doc_id, array_to_string(regexp_split_to_array(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^a-z]+')[1:2], ' ') AS s FROM documents),
t AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:\p{L}+(?:-\p{L}+)*|[0-9]+(?:/[0-9]+)*)+', 0) AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM t, range(1, 4) x(n), range(1, 1000) y(i) WHERE i + n - 1 <= len(w))
SELECT item_id, phrase, count(*)::BIGINT AS n_ids, count(*) > 1 AS ambiguous FROM g JOIN al ON s = phrase WHERE length(s) > 3 GROUP BY 1, 2""",
    "identity_claims": """WITH k AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey < 10 THEN c_nationkey || '/' || c_mktsegment ELSE sha256('{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') END AS identity, c_nationkey >= 10 AS is_new FROM k""",
    "natural_keys": """WITH p AS (SELECT p_partkey, p_brand, p_type, sha256(p_partkey::VARCHAR) AS h FROM part)
SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}') AS natural_key,
concat_ws('-', h[1:8], h[9:12], '8' || h[14:16], substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20], h[21:32]) AS point_id FROM p""",
    "upsert_merge": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL
SELECT c_custkey + 10000000, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 10""",
}
