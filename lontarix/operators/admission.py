"""Admission: what a batch, a dictionary, a sealed graph, a provision or an alias must fulfil before it is taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import surface, terms
from ..sources.shared import cut, scratch
from ..sources.store import exists
from .temporal import visible


def first_non_blank(*values: Column) -> Column:
    """The first value that is neither null nor blank, trimmed; null if there is none."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def in_order_distinct(values: Column) -> Column:
    """Distinct members of an array of (place, value) by first place."""
    return F.array_distinct(F.transform(F.array_sort(values), lambda x: x["value"]))


def bound_to(rows: DataFrame, corpus: str, generation: int) -> DataFrame:
    """Rows of exactly one corpus and index generation: equalities that reach the scan, and prune folders where these are partitions."""
    return rows.where((F.col("corpus") == corpus) & (F.col("generation") == generation))


def profile_as_of(identities: DataFrame, profiles: DataFrame, keys: list[str], revision: int) -> DataFrame:
    """Every identity, with the profile visible at ``revision`` or nulls. The range is a filter below the join."""
    seen = profiles.where(visible(F.col("from_rev"), F.col("to_rev"), revision)).drop("to_rev")
    return identities.join(seen, keys, "left")


def lineage_issue(indexes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(index_id, issue) for indexes whose dictionary is not what they say, or doesn't descend from their statistics' dictionary.

    ``lineage``: (dictionary, revision, fingerprint), a row for each revision that a dictionary descends from, its own too.
    ``indexes``: index_id, dictionary, revision, fingerprint, and the statistics' stats_revision, stats_fingerprint.
    """
    own = lineage.select("dictionary", "revision", F.col("fingerprint").alias("self_known"))
    old = lineage.select("dictionary", F.col("revision").alias("stats_revision"), F.col("fingerprint").alias("stats_known"))
    both = indexes.join(own, ["dictionary", "revision"], "left").join(old, ["dictionary", "stats_revision"], "left")
    issue = F.when(F.col("self_known").isNull(), "UNKNOWN_REVISION").when(F.col("self_known") != F.col("fingerprint"), "FINGERPRINT")
    issue = issue.when(F.col("stats_known").isNull(), "NO_ANCESTOR").when(F.col("stats_known") != F.col("stats_fingerprint"), "ANCESTOR_FINGERPRINT")
    return both.select("index_id", issue.alias("issue")).where("issue IS NOT NULL")


def index_batches(docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(batch, n_docs, n_empty, first_empty, status): a batch with one document without terms is REJECTED as a whole."""
    empty = F.coalesce(F.size(terms(text_col)), F.lit(0)) <= 0
    out = docs.select(batch, F.col(id_col).alias("id"), empty.alias("empty")).groupBy(batch)
    out = out.agg(F.count("*").alias("n_docs"), F.count_if("empty").alias("n_empty"), F.min(F.when(F.col("empty"), F.col("id"))).alias("first_empty"))
    return out.withColumn("status", F.when(F.col("n_empty") > 0, "REJECTED").otherwise("ACCEPTED"))


def seals(operations: DataFrame, manifests: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, n, fingerprint, status) of each manifest (graph, expected, state) against its operations (graph, operation_id, hash).

    READY if the state is SEALED and the counts agree. The fingerprint digests sorted operations by the first byte of their own
    digests, then those 256 results, so no task holds a graph.
    """
    d = F.sha2(F.concat_ws("\x1f", F.col("operation_id").cast("string"), "hash"), 256)
    one = operations.select(graph, d.alias("d"), F.substring(d, 1, 2).alias("p"))
    parts = one.groupBy(graph, "p").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d"), F.count("*").alias("n"))
    found = parts.groupBy(graph).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat("p", "d")))), 256).alias("fingerprint"), F.sum("n").alias("n"))
    out = manifests.join(found, graph, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    status = F.when(F.col("state") != "SEALED", "NOT_SEALED").when(F.col("n") != F.col("expected"), "COUNT").otherwise("READY")
    return out.select(graph, "n", "fingerprint", status.alias("status"))


def bind_provisions(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(doc_id, node_id, regulation_id, provision_key): each structure node under the regulation whose span holds the node's span.

    ``nodes``: doc_id, node_id, path (array of labels), start, stop. ``bindings``: doc_id, regulation_id, first, last. The key is
    a digest of the regulation and the path of surface forms, so it is the same wherever a document spells them otherwise. A node
    that no regulation holds keeps null in both: it is for review, never assigned silently.
    """
    inside = nodes.join(bindings, "doc_id").where((F.col("first") <= F.col("start")) & (F.col("stop") <= F.col("last")))
    path = F.transform("path", surface)
    key = F.sha2(F.to_json(F.struct(F.lit("provision-path-v1").alias("namespace"), "regulation_id", path.alias("path"))), 256)
    held = inside.select("doc_id", "node_id", "regulation_id", key.alias("provision_key"))
    return nodes.select("doc_id", "node_id").join(held, ["doc_id", "node_id"], "left")


def register_aliases(mentions: DataFrame, aliases: DataFrame, revision: int) -> DataFrame:
    """What registering sourced mentions would do, for review: (mention_id, alias, canonical_id, action, revision).

    ``mentions``: mention_id, scope, text, canonical_id (null: create a provisional identity). ``aliases``: scope, alias,
    canonical_id. ALIAS adds a row, KNOWN has one already, AMBIGUOUS would name a second identity, PROVISIONAL makes an identity
    whose id follows from scope and alias, so two mentions of it make one.
    """
    name = surface("text")
    old = aliases.groupBy("scope", "alias").agg(F.collect_set("canonical_id").alias("held"))
    made = F.concat(F.lit("provisional-"), F.sha2(F.concat_ws("\x1f", F.col("scope").cast("string"), "alias"), 256))
    rows = mentions.withColumn("alias", name).join(old, ["scope", "alias"], "left")
    action = F.when(F.col("canonical_id").isNull() & F.col("held").isNull(), "PROVISIONAL").when(F.col("held").isNull(), "ALIAS").when(F.array_contains("held", F.col("canonical_id")), "KNOWN").otherwise("AMBIGUOUS")
    identity = F.when(F.col("action") == "PROVISIONAL", made).otherwise(F.col("canonical_id").cast("string"))
    return rows.withColumn("action", action).select("mention_id", "alias", identity.alias("canonical_id"), "action", F.when(F.col("action").isin("ALIAS", "PROVISIONAL"), revision + 1).otherwise(revision).cast("long").alias("revision"))


def frontier(found: DataFrame, visited: DataFrame, most: int, url: str = "target") -> DataFrame:
    """At most ``most`` URLs to fetch next, in URL order: found once or often, not in the checkpoint of visited ones."""
    fresh = found.select(url).distinct().join(visited.select(url), url, "left_anti")
    return fresh.orderBy(url).limit(most)


def walk_listings(seeds: DataFrame, pages: DataFrame, max_pages: int, max_documents: int, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The listing pages that each seed's walk reads, and the documents that they lead to.

    ``seeds``: url, distinct. ``pages``: url, next and details (arrays of urls), as ``parse_pages`` makes them, a table, since each step reads it. A seed's walk goes breadth first,
    in the order of the links; it reads a page once, ``max_pages`` pages at most, and none any more once ``max_documents`` documents are
    found; a page's documents beyond these are left. A page that isn't there is read in vain.

    Pages: (seed, place, url, there, n_new), n_new the documents that the page added. Documents: (seed, url, place), the page that names
    each first. A step of all walks is one join and one table; with ``state``, a folder of the caller's, steps that an earlier call
    finished are read and the walk goes on from there (seeds, pages and limits must be the same).
    """
    if max_pages < 1 or max_documents < 1:
        raise ValueError("limits must be positive")
    spark = seeds.sparkSession
    root = state or scratch(spark, "listing")
    schema = "seed string, place long, url string, there boolean, next array<string>, new array<string>, documents long"
    front = seeds.select(F.col("url").alias("seed"), F.lit(1).cast("long").alias("place"), "url", F.lit(0).cast("long").alias("before"))
    levels: list[str] = []
    while True:
        path = f"{root}/step={len(levels)}"
        if not exists(spark, f"{path}/_SUCCESS"):
            read = front.join(pages.select("url", "next", "details", F.lit(True).alias("there")), "url", "left")
            named = read.select("seed", "place", F.posexplode("details").alias("at", "document")).groupBy("seed", "document").agg(F.min(F.struct("place", "at")).alias("p"))
            if levels:
                named = named.join(walked.select("seed", F.explode("new").alias("document")), ["seed", "document"], "left_anti")
            found = named.groupBy("seed", F.col("p.place").alias("place")).agg(F.sort_array(F.collect_list(F.struct("p.at", "document"))).alias("d"))
            read = read.join(found, ["seed", "place"], "left").withColumn("d", F.coalesce(F.col("d.document"), F.array().cast("array<string>")))
            # Documents before a page: those of earlier steps and of this step's pages before it.
            upto = F.expr("coalesce(sum(size(d)) OVER (PARTITION BY seed ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
            read = read.withColumn("had", F.col("before") + upto).where(F.col("had") < max_documents)
            new = F.slice("d", F.lit(1), F.least(F.size("d"), (F.lit(max_documents) - F.col("had")).cast("int")))
            read = read.withColumn("new", new).withColumn("documents", F.col("had") + F.size("new"))
            read.select("seed", "place", "url", F.coalesce("there", F.lit(False)).alias("there"), "next", "new", "documents").write.mode("overwrite").parquet(path)
        level = spark.read.schema(schema).parquet(path)
        levels.append(path)
        walked = spark.read.schema(schema).parquet(*levels)
        total = level.groupBy("seed").agg(F.max("documents").alias("before"), F.max("place").alias("last")).where(F.col("before") < max_documents)
        after = level.select("seed", "place", F.posexplode("next").alias("at", "url")).groupBy("seed", "url").agg(F.min(F.struct("place", "at")).alias("p"))
        after = after.join(walked.select("seed", "url"), ["seed", "url"], "left_anti")
        place = F.expr("row_number() OVER (PARTITION BY seed ORDER BY p)")
        front = after.withColumn("n", place).join(total, "seed").select("seed", (F.col("last") + F.col("n")).alias("place"), "url", "before").where(F.col("place") <= max_pages)
        if exists(spark, f"{root}/step={len(levels)}/_SUCCESS"):
            continue
        front = cut(front, "front")
        if not front.limit(1).count():
            break
    return walked.select("seed", "place", "url", "there", F.size("new").alias("n_new")), walked.select("seed", F.explode("new").alias("url"), "place")


def candidate_batches(mentions: DataFrame, lookups: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, n_mentions, n_missing, n_extra, n_repeated, n_stale, status): a batch is VALID if it has one lookup for each mention, none other, and
    all of them at its revision. ``mentions``: batch, mention_id, revision. ``lookups``: batch, mention_id, revision."""
    rows = mentions.select(batch, "mention_id", "revision", F.lit(True).alias("asked")).unionByName(lookups.select(batch, "mention_id", "revision", F.lit(False).alias("asked")))
    # Rows without a batch or an id match none of the other side.
    lone = F.when(F.col(batch).isNull() | F.col("mention_id").isNull(), F.col("asked"))
    asked, found = F.col("asked"), F.when(~F.col("asked"), F.col("revision"))
    # Dealt out before they are grouped: each row is nearly a group of its own, and a whole split's groups are too many for one task.
    both = rows.repartition(batch, "mention_id").groupBy(batch, "mention_id", lone.alias("lone")).agg(F.count_if(asked).alias("n_a"), F.count_if(~asked).alias("n_b"), F.max(F.when(asked, F.col("revision"))).alias("at"), F.min(found).alias("low"), F.max(found).alias("high"))
    stale = (F.col("n_a") > 0) & (F.col("n_b") > 0) & ((F.col("low") != F.col("at")) | (F.col("high") != F.col("at")))
    out = both.groupBy(batch).agg(
        F.count_if(F.col("n_a") > 0).alias("n_mentions"),
        F.count_if(F.col("n_b") == 0).alias("n_missing"),
        F.count_if(F.col("n_a") == 0).alias("n_extra"),
        F.count_if((F.col("n_b") > 1) | (F.col("n_a") > 1)).alias("n_repeated"),
        F.count_if(stale).alias("n_stale"),
    )
    bad = F.col("n_missing") + F.col("n_extra") + F.col("n_repeated") + F.col("n_stale")
    return out.withColumn("status", F.when(bad == 0, "VALID").otherwise("INVALID"))
