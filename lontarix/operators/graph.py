"""Evidence graph: neighbours, bounded simple paths, ancestors, canonical assertions, audits, incremental plans.

Iterations run as joins on tables in the shared folder; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, fewer

#: Limits of a traversal.
MAX_HOPS, MAX_DEPTH = 16, 64
#: Nodes of a frontier that are sent to tasks; more are met by a join, for which all edges are dealt out.
SENT = 1_000_000


def of_nodes(rows: DataFrame, frontier: DataFrame) -> DataFrame:
    """The rows of the frontier's nodes, by ``node``."""
    return rows.join(fewer(frontier.select("node").distinct(), SENT, "frontier"), "node", "left_semi")


def directions(assertions: DataFrame) -> DataFrame:
    """(node, assertion_id, other): each edge from both ends, a self-loop once. Two equi-joins instead of a join on OR."""
    one = assertions.select(F.col("subject").alias("node"), "assertion_id", F.col("object").alias("other"))
    two = assertions.where("subject <> object").select(F.col("object").alias("node"), "assertion_id", F.col("subject").alias("other"))
    return one.unionByName(two)


def neighbours(assertions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, other): distinct neighbours of the seed nodes."""
    return directions(assertions).join(seeds.select("node"), "node", "left_semi").select("node", "other").distinct()


def paths(assertions: DataFrame, seeds: DataFrame, hops: int, group: str = "seed") -> DataFrame:
    """All simple undirected paths of 1 .. ``hops`` edges from each seed: (seed, hop, nodes, assertions).

    No node repeats on a path; parallel edges give paths of their own. Their number can grow with the degree to the power of
    ``hops``: ``traversal.search`` is the bounded form.
    """
    if not 0 < hops <= MAX_HOPS:
        raise ValueError("hops")
    edges = directions(assertions)
    level = seeds.select(F.col("node").alias(group), F.array("node").alias("nodes"), F.array().cast(f"array<{dict(assertions.dtypes)['assertion_id']}>").alias("assertions"))
    found = None
    for hop in range(1, hops + 1):
        last = level.withColumn("node", F.element_at("nodes", -1))
        step = last.join(of_nodes(edges, last), "node").where(~F.array_contains("nodes", F.col("other")))
        level = step.select(group, F.lit(hop).alias("hop"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("assertions", F.array("assertion_id")).alias("assertions"))
        if hop < hops:
            level = cut(level, "paths")
        found = level if found is None else found.unionByName(level)
    return found


def path_sources(found: DataFrame, supports: DataFrame, group: str = "seed") -> DataFrame:
    """(seed, source): distinct sources that support any assertion on a seed's paths."""
    used = found.select(group, F.explode("assertions").alias("assertion_id")).distinct()
    return used.join(supports.select("assertion_id", "source"), "assertion_id").select(group, "source").distinct()


def ancestor_paths(nodes: DataFrame, separator: str = " > ") -> DataFrame:
    """(id, depth, path) of an adjacency list (id, parent_id, label), root first. A cycle or over 64 levels stops the job."""
    done = cut(nodes.where("parent_id IS NULL").select("id", F.lit(0).alias("depth"), F.col("label").alias("path")), "ancestors")
    level = done
    for depth in range(1, MAX_DEPTH + 2):
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = cut(nodes.join(up, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat_ws(separator, "above", "label").alias("path")), "ancestors")
        if not level.limit(1).count():
            return done
        done = done.unionByName(level)
    raise ValueError("hierarchy too deep")


def canonical(assertions: DataFrame, *content: str) -> DataFrame:
    """(assertion_key, representative, n): assertions of equal content, one row each; -0.0 counts as 0.0."""
    cols = [F.when(F.col(c) == 0, F.lit(0)).otherwise(F.col(c)).cast("string") if dict(assertions.dtypes)[c] == "double" else F.col(c).cast("string") for c in content]
    return assertions.groupBy(F.sha2(F.concat_ws("|", *cols), 256).alias("assertion_key")).agg(F.min("assertion_id").alias("representative"), F.count("*").alias("n"))


def exception_ids(assertions: DataFrame, refs: DataFrame) -> DataFrame:
    """(assertion_id, canonical_id, level) where an id covers the ids of the exceptions an assertion refers to.

    ``refs``: (assertion_id, exception_id). Those without exceptions come first, then each whose exceptions are done; a
    cycle stops the job. All assertions are dealt out once; a level meets only what waits and the ids that the level before made.
    """
    needs = refs.groupBy("assertion_id").agg(F.count("*").alias("n_refs"))
    named = refs.select(F.col("exception_id").alias("assertion_id"), F.lit(True).alias("named")).distinct()
    rows = assertions.select("assertion_id", "content").join(needs, "assertion_id", "left").join(named, "assertion_id", "left")
    rows = cut(rows.select("assertion_id", "content", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), "named"), "assertions")
    done = rows.where("n_refs = 0").select("assertion_id", F.sha2("content", 256).alias("canonical_id"), F.lit(0).alias("level"))
    front = rows.where("n_refs = 0 AND named").select("assertion_id", F.sha2("content", 256).alias("canonical_id"))
    waiting = rows.where("n_refs > 0").select("assertion_id", "content", "n_refs")
    left, level, partly = waiting.count(), 0, None
    while left:
        level += 1
        # An id counts when it is made, so what came before is kept of those alone that wait for more.
        known = refs.join(front.withColumnRenamed("assertion_id", "exception_id"), "exception_id").select("assertion_id", "canonical_id")
        known = known if partly is None else known.unionByName(partly)
        ready = known.groupBy("assertion_id").agg(F.count("*").alias("have"), F.array_sort(F.collect_list(F.struct("canonical_id")))["canonical_id"].alias("ids"))
        met = cut(waiting.join(ready, "assertion_id"), "canonical")
        new = met.where("have = n_refs")
        new = new.select("assertion_id", F.sha2(F.concat_ws("|", "content", F.array_join("ids", ",")), 256).alias("canonical_id"), F.lit(level).alias("level"))
        partly = met.where("have < n_refs").select("assertion_id", F.explode("ids").alias("canonical_id"))
        n = new.count()
        if not n:
            raise ValueError("exceptions form a cycle")
        done, front, left = done.unionByName(new), new.select("assertion_id", "canonical_id"), left - n
    return done


def reverse_closure(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(item_id, hops): items that are changed or depend on one, however far. ``dependencies``: (item_id, dependency_id)."""
    done = cut(changed.select("item_id", F.lit(0).alias("hops")).distinct(), "closure")
    front, hops = done, 0
    while front.limit(1).count():
        hops += 1
        near = front.select(F.col("item_id").alias("dependency_id")).join(dependencies, "dependency_id").select("item_id").distinct()
        front = cut(near.join(done, "item_id", "left_anti").select("item_id", F.lit(hops).alias("hops")), "closure")
        done = done.unionByName(front)
    return done


def scope_index(versions: DataFrame, *scope: str) -> DataFrame:
    """(scope, revision, n): every revision at which the number of a scope's visible rows is written anew, and that number.

    ``versions`` has the scope's columns, ``from_rev`` and ``to_rev`` (null: still visible). A scope that never had a row has no entry.
    """
    began = versions.select(*scope, F.col("from_rev").cast("long").alias("revision"), F.lit(1).alias("d"))
    ended = versions.where("to_rev IS NOT NULL").select(*scope, F.col("to_rev").cast("long").alias("revision"), F.lit(-1).alias("d"))
    steps = began.unionByName(ended).groupBy(*scope, "revision").agg(F.sum("d").alias("d"))
    return steps.select(*scope, "revision", F.expr(f"sum(d) OVER (PARTITION BY {', '.join(scope)} ORDER BY revision)").alias("n"))


def looked_up(asked: DataFrame, index: DataFrame, scope: str, at: int) -> DataFrame:
    """``asked`` (item_id, scope) with what a lookup at revision ``at`` relies on: the scope's last ``revision`` and whether it was ``empty``.

    A scope without a row up to then was empty at revision 0: an item that relied on finding nothing depends on it too.
    """
    last = index.where(F.col("revision") <= at).groupBy(scope).agg(F.max_by("n", "revision").alias("n"), F.max("revision").alias("revision"))
    out = asked.select("item_id", scope).distinct().join(last, scope, "left")
    return out.select("item_id", scope, F.coalesce("revision", F.lit(0)).alias("revision"), (F.coalesce("n", F.lit(0)) == 0).alias("empty"))


def _as_one(rows: DataFrame | None, name: str, *columns: str) -> DataFrame | None:
    """(item_id, name): what an item has of ``columns``, in order, as one text."""
    if rows is None:
        return None
    return rows.groupBy("item_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct(*columns)))).alias(name))


def _agreed(lookups: DataFrame, scope: str) -> DataFrame:
    """The lookups, or an error where two items saw one scope in different states."""
    states = lookups.groupBy(scope).agg(F.count_distinct("revision", "empty").alias("n"))
    said = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting lookup revisions of "), F.col(scope).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return lookups.join(states, scope).where(said).drop("n")


def update_plan(
    before: DataFrame, after: DataFrame, dependencies: DataFrame, fingerprints: tuple[DataFrame, DataFrame] | None = None, lookups: tuple[DataFrame, DataFrame] | None = None, scope: str = "scope"
) -> DataFrame:
    """(item_id, bucket, reason) from two states (item_id, content_hash, producer) and all dependencies (item_id, dependency_id).

    Reasons in this order: ADDED, REMOVED, CONTENT, PRODUCER, DEPENDENCY, LOOKUP. ``fingerprints`` are the dependencies of both states with a
    ``hash``, ``lookups`` the (item_id, scope, revision, empty) that both states relied on; an item whose own differ is changed by that.
    Items that are changed or depend on a change are RECOMPUTE, others REUSE, gone ones REVIEW; an item that depends directly on a
    gone one is REVIEW too. Items of the new state that saw one scope in different states stop the job.
    """
    old = before.select("item_id", F.col("content_hash").alias("c0"), F.col("producer").alias("p0"), F.lit(True).alias("was"))
    new = after.select("item_id", F.col("content_hash").alias("c1"), F.col("producer").alias("p1"), F.lit(True).alias("is"))
    both = old.join(new, "item_id", "full_outer")
    reason = F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "REMOVED").when(F.col("c0") != F.col("c1"), "CONTENT").when(F.col("p0") != F.col("p1"), "PRODUCER")
    for kind, pair, columns in (("DEPENDENCY", fingerprints, ("dependency_id", "hash")), ("LOOKUP", lookups, (scope, "revision", "empty"))):
        if pair is not None:
            first, second = pair if kind == "DEPENDENCY" else (pair[0], _agreed(pair[1], scope))
            both = both.join(_as_one(first, f"{kind}_0", *columns), "item_id", "left").join(_as_one(second, f"{kind}_1", *columns), "item_id", "left")
            reason = reason.when(~F.col(f"{kind}_0").eqNullSafe(F.col(f"{kind}_1")), kind)
    direct = cut(both.select("item_id", reason.alias("direct")), "plan")
    affected = reverse_closure(direct.where("direct IS NOT NULL"), dependencies)
    gone = direct.where("direct = 'REMOVED'").select(F.col("item_id").alias("dependency_id"))
    orphaned = dependencies.join(gone, "dependency_id", "left_semi").select("item_id", F.lit(True).alias("orphaned")).distinct()
    out = direct.join(affected.select("item_id", F.lit(True).alias("hit")), "item_id", "left").join(orphaned, "item_id", "left")
    bucket = F.when((F.col("direct") == "REMOVED") | F.col("orphaned"), "REVIEW").when(F.col("hit"), "RECOMPUTE").otherwise("REUSE")
    return out.select("item_id", bucket.alias("bucket"), F.coalesce("direct", F.when(F.col("hit"), "DEPENDENCY"), F.lit("UNCHANGED")).alias("reason"))


def admit(assertions: DataFrame, rules: DataFrame, version: str) -> DataFrame:
    """(assertion_id, issue): what an ontology forbids. ``rules`` has one row a predicate, of a file of a megabyte at most, and goes to every task:
    predicates are few, so dealing assertions out by them would make a task of each.

    ``assertions``: assertion_id, predicate, subject, object, subject_type, object_type, origin, ontology_version, qualifiers (array of id, kind).
    Issues: another version, a predicate that isn't known, an end of another type or of none, an edge to itself where that isn't allowed, an
    origin that the predicate doesn't take, a qualifier that it doesn't have, a value of another kind than the qualifier's.
    """
    j = assertions.join(F.broadcast(rules.withColumnRenamed("qualifiers", "allowed").withColumn("known", F.lit(True))), "predicate", "left")
    known, own = F.col("known").isNotNull(), F.coalesce("qualifiers", F.array().cast(assertions.schema["qualifiers"].dataType))
    has = lambda q: F.exists("allowed", lambda a: a.id == q.id)
    fits = lambda q: F.exists("allowed", lambda a: (a.id == q.id) & F.array_contains(a.kinds, q.kind))
    within = lambda of, c: F.coalesce(F.array_contains(of, F.col(c)), F.lit(False))
    issues = F.array(
        F.when(F.coalesce(F.col("ontology_version") != version, F.lit(True)), "ontology_version"),
        F.when(~known, "unknown_predicate"),
        F.when(known & ~within("subjects", "subject_type"), "subject_type"),
        F.when(known & ~within("objects", "object_type"), "object_type"),
        F.when(known & ~F.col("allow_self") & (F.col("subject") == F.col("object")), "self_edge"),
        F.when(known & ~within("origins", "origin"), "origin"),
        F.when(known & F.exists(own, lambda q: F.coalesce(~has(q), F.lit(True))), "qualifier"),
        F.when(known & F.exists(own, lambda q: has(q) & F.coalesce(~fits(q), F.lit(True))), "qualifier_kind"),
    )
    return j.select("assertion_id", F.explode(F.array_compact(issues)).alias("issue"))


def substitute(assertions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Assertions with mentions replaced by canonical ids; one with an unresolved end stops the job. Two equi-joins."""
    ids = resolved.where("proposal IN ('LINK', 'CREATE')").select("mention_id", "canonical_id")
    s = ids.select(F.col("mention_id").alias("subject"), F.col("canonical_id").alias("s_id"))
    o = ids.select(F.col("mention_id").alias("object"), F.col("canonical_id").alias("o_id"))
    j = assertions.join(s, "subject", "left").join(o, "object", "left")

    def sure(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit("unresolved mention")).cast(dict(ids.dtypes)["canonical_id"])).otherwise(F.col(c))

    return j.select("assertion_id", sure("s_id").alias("subject"), "predicate", sure("o_id").alias("object"))


def merge_graph(hybrid: DataFrame, graph: DataFrame, covered: DataFrame) -> DataFrame:
    """(key, origin, accepted, reason): other evidence stays; evidence from the graph alone needs covered support spans."""
    h, g = hybrid.select("key", F.lit(True).alias("h")), graph.select("key", F.lit(True).alias("g"))
    j = h.join(g, "key", "full_outer").join(covered.select("key", F.lit(True).alias("c")), "key", "left")
    origin = F.when(F.col("h") & F.col("g"), "BOTH").when(F.col("h"), "HYBRID").otherwise("GRAPH")
    ok = F.coalesce("h", F.lit(False)) | F.coalesce("c", F.lit(False))
    return j.select("key", origin.alias("origin"), ok.alias("accepted"), F.when(~ok, "outside_graph_support_spans").alias("reason"))


def usable_paths(found: DataFrame, selected: DataFrame, members: str = "nodes", key: str = "node") -> DataFrame:
    """Paths whose every member is selected: exploded and counted, so ``selected`` may be of any size."""
    numbered = found.withColumn("path_id", F.sha2(F.to_json(F.struct(members, "assertions")), 256))
    rows = numbered.select("path_id", F.explode(members).alias(key))
    hit = rows.join(selected.select(key, F.lit(1).alias("hit")).distinct(), key, "left").groupBy("path_id").agg((F.count("*") == F.count("hit")).alias("usable"))
    return numbered.join(hit, "path_id")
