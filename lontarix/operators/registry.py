"""Registry lookups: aliases as of a revision, limits with overflow, latest rows, counts with empties, upserts, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import surface, terms
from .jobs import guard_total
from .temporal import visible


def alias_lookup(aliases: DataFrame, asked: DataFrame, keys: list[str], revision: int) -> DataFrame:
    """(keys, canonical_id) visible at ``revision``: an equi-join on the keys, the range as a filter below it."""
    seen = aliases.where(visible(F.col("from_rev"), F.col("to_rev"), revision))
    return asked.join(seen.select(*keys, "canonical_id"), keys)


def limited_lookup(aliases: DataFrame, asked: DataFrame, keys: list[str], revision: int, limit: int) -> DataFrame:
    """At most ``limit`` ids a key in id order, and ``overflow``: whether there were more; one over is looked at to know."""
    found = alias_lookup(aliases, asked, keys, revision)
    part = ", ".join(keys)
    ranked = found.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY canonical_id)")).where(F.col("n") <= limit + 1)
    ranked = ranked.withColumn("overflow", F.expr(f"max(n) OVER (PARTITION BY {part})") > limit)
    return ranked.where(F.col("n") <= limit).select(*keys, "canonical_id", "overflow")


def ambiguous(aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that name several ids, and how many."""
    return aliases.groupBy(*keys).agg(F.count_distinct("canonical_id").alias("n_ids")).where("n_ids > 1")


def latest_at(history: DataFrame, keys: list[str], revision: str, at: int, values: list[str]) -> DataFrame:
    """The newest row of each key with a revision not after ``at``: one aggregate, no window."""
    old = history.where(F.col(revision) <= at)
    return old.groupBy(*keys).agg(F.max(revision).alias(revision), *(F.max_by(v, revision).alias(v) for v in values))


def counts_with_empty(scopes: DataFrame, rows: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """(keys, n) for every scope, 0 included: an empty lookup is a fact of its own."""
    sums = rows.groupBy(*keys).agg(F.count(counted).alias("n"))
    return scopes.join(sums, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """``old`` with ``new`` rows: of equal keys the new one stays, or with ``update=False`` the old one.

    Rows of one side must have distinct keys. One shuffle by key.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    pick = F.max_by if update else F.min_by
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(pick(F.struct(*rest), "__new").alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def merge_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet (MERGE without update); appended, they leave what exists as it is."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def claim_identities(known: DataFrame, wanted: DataFrame, natural: list[str]) -> DataFrame:
    """(natural key, identity): the known identity, or a new one derived from the key; the same key never gets two."""
    key = F.sha2(F.to_json(F.struct(*natural)), 256)
    asked = wanted.select(*natural).distinct().withColumn("fresh", key)
    out = asked.join(known.select(*natural, F.col("identity").alias("have")), natural, "left")
    return out.select(*natural, F.coalesce("have", "fresh").alias("identity"), F.col("have").isNull().alias("is_new"))


def block(mentions: DataFrame, aliases: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Mentions joined with ids of equal surface key within the same type and scope.

    Mentions are dealt out first: the pairs of a block grow with the square of its names, so few splits of mentions would make them all.
    """
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = mentions.repartition(parts).withColumn("surface", surface(text_col))
    return left.join(aliases.select(*keys, "surface", "canonical_id"), [*keys, "surface"])


def candidate_plan(mentions: DataFrame, policy: DataFrame, with_sources: list[str], per_mention: int, total: int) -> DataFrame:
    """(mention_id, place, entity_type, scope, lookup): the scopes in which each mention is to be looked up, sorted, before any lookup.

    ``mentions``: mention_id, entity_type, text, sources (ids of the regulations it was found in). ``policy``: entity_type, scope, a small
    table; mentions of a type in ``with_sources`` are looked up in their sources too. A plan is whole or an error: a repeated or missing
    mention id, a type without scopes, an empty text, no sources, scopes of a type that repeat, more scopes than ``per_mention`` or ``total``.
    """
    scopes = policy.groupBy("entity_type").agg(F.collect_list("scope").alias("configured"))
    n = F.expr("count(*) OVER (PARTITION BY mention_id)")
    j = mentions.select("mention_id", "entity_type", surface("text").alias("lookup"), "sources", n.alias("n")).join(scopes, "entity_type", "left")
    also = F.when(F.col("entity_type").isin(with_sources), F.col("sources")).otherwise(F.array().cast("array<string>"))
    plan = j.withColumn("scopes", F.array_sort(F.array_union("configured", also)))
    faults = [
        (F.col("mention_id").isNull() | (F.col("n") > 1), "a mention id is missing or repeated"), (F.col("configured").isNull(), "no scopes for a mention's type"),
        (F.size("configured") != F.size(F.array_distinct("configured")), "a type's scopes repeat"), (F.coalesce(F.col("lookup") == "", F.lit(True)), "a mention without text"),
        (F.coalesce(F.size("sources") < 1, F.lit(True)) | F.exists("sources", lambda x: F.coalesce(x == "", F.lit(True))), "a mention without whole sources"), (F.size("scopes") > per_mention, "scope budget of a mention exceeded"),
    ]
    said = F.coalesce(*(F.when(bad, text) for bad, text in faults))
    sound = F.when(said.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    plan = guard_total(plan.where(sound), F.size("scopes"), total)
    return plan.select("mention_id", "entity_type", "lookup", F.posexplode("scopes").alias("place", "scope")).select("mention_id", "place", "entity_type", "scope", "lookup")


def propose(mentions: DataFrame, candidates: DataFrame, mention: str = "mention_id") -> DataFrame:
    """(mention, proposal, canonical_id): LINK where exactly one candidate exists, else DEFER."""
    found = candidates.groupBy(mention).agg(F.count_distinct("canonical_id").alias("n"), F.min("canonical_id").alias("one"))
    out = mentions.select(mention).join(found, mention, "left")
    link = F.col("n") == 1
    return out.select(mention, F.when(link, "LINK").otherwise("DEFER").alias("proposal"), F.when(link, F.col("one")).alias("canonical_id"))


def propose_blocked(mentions: DataFrame, aliases: DataFrame, text_col: str, keys: list[str], mention: str = "mention_id") -> DataFrame:
    """``propose`` over the candidates of ``block``, without its pairs: a block's smallest and largest id tell whether it has one, and are
    looked up by its mentions."""
    found = aliases.groupBy(*keys, "surface").agg(F.min("canonical_id").alias("one"), F.max("canonical_id").alias("last"))
    left = mentions.withColumn("surface", surface(text_col))
    hits = left.join(found, [*keys, "surface"]).groupBy(mention).agg(F.min("one").alias("one"), F.max("last").alias("last"))
    out = mentions.select(mention).join(hits, mention, "left")
    link = F.col("one") == F.col("last")
    return out.select(mention, F.when(link, "LINK").otherwise("DEFER").alias("proposal"), F.when(link, F.col("one")).alias("canonical_id"))


def ngrams(tokens: Column, most: int) -> Column:
    """All runs of 1 .. ``most`` neighbouring tokens as strings, distinct."""
    runs = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def link_phrases(questions: DataFrame, aliases: DataFrame, most: int = 4, question: str = "question_id", text_col: str = "text") -> DataFrame:
    """(question, phrase, canonical_id, ambiguous): phrases of a question that are aliases."""
    grams = questions.select(question, F.explode(ngrams(terms(text_col), most)).alias("phrase"))
    found = grams.join(aliases.select(F.col("surface").alias("phrase"), "canonical_id").distinct(), "phrase")
    return found.withColumn("ambiguous", F.expr(f"count(*) OVER (PARTITION BY {question}, phrase)") > 1)


def natural_key(*cols: str) -> Column:
    """SHA-256 of the JSON of the columns, in order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def point_uuid(key: Column) -> Column:
    """A UUID of version 8 from the SHA-256 of a key."""
    h = F.sha2(key, 256)
    variant = F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16)
    return F.lower(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def compare_and_set(current: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): a proposal is ACCEPTED if it expects the revision that is current, and is the first to; else STALE.

    ``current``: keys, revision; ``proposals``: keys, expected, proposal_id. A key without a row is at revision 0.
    """
    j = proposals.join(current.select(*keys, "revision"), keys, "left")
    hit = F.col("expected") == F.coalesce("revision", F.lit(0))
    part = ", ".join(keys)
    first = F.expr(f"min(CASE WHEN hit THEN proposal_id END) OVER (PARTITION BY {part})") == F.col("proposal_id")
    return j.withColumn("hit", hit).withColumn("outcome", F.when(F.coalesce(first, F.lit(False)) & F.col("hit"), "ACCEPTED").otherwise("STALE")).select("proposal_id", *keys, "outcome")


def used_identities(*columns: DataFrame) -> DataFrame:
    """Distinct ids of a batch over several one-column sources: its registry dependencies."""
    out = columns[0].toDF("canonical_id")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("canonical_id"))
    return out.where("canonical_id IS NOT NULL").distinct()
