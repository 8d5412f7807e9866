"""Record rules and inventories: field rules, paired filters, referential closure, samples, coverage, exact fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_ID = r"^[!-~]{1,256}$"
SHA256 = r"^[0-9a-f]{64}$"


def rule(kind: str, field: str) -> Column:
    """Whether a field breaks a rule: required, ascii_id, sha256, positive, finite, probability, unique, min_items:<n>."""
    c = F.col(field)
    broken = {
        "required": lambda: c.isNull() | (c.cast("string") == ""),
        "ascii_id": lambda: ~F.coalesce(c.cast("string").rlike(ASCII_ID), F.lit(False)),
        "sha256": lambda: ~F.coalesce(c.cast("string").rlike(SHA256), F.lit(False)),
        "positive": lambda: ~F.coalesce(c > 0, F.lit(False)),
        "finite": lambda: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")),
        "probability": lambda: ~F.coalesce((c >= 0) & (c <= 1), F.lit(False)),
        "unique": lambda: F.size(F.array_distinct(c)) < F.size(c),
        "min_items": lambda: F.coalesce(F.size(c), F.lit(0)) < int(kind.partition(":")[2] or 1),
    }
    return broken[kind.partition(":")[0]]()


def issues(rows: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, field, rule) of every broken rule, in one pass and without a shuffle."""
    found = F.array(*(F.when(rule(kind, field), F.struct(F.lit(field).alias("field"), F.lit(kind).alias("rule"))) for field, kind in rules))
    return rows.select(key, F.explode(F.array_compact(found)).alias("i")).select(key, "i.field", "i.rule")


def any_version(filters: Column, version: Column) -> Column:
    """Whether any of the paired filters has the version."""
    return F.exists(filters, lambda f: f["version"] == version)


def any_triple(filters: Column, blob: Column, version: Column, regulation: Column) -> Column:
    """Whether one and the same filter has blob, version and regulation."""
    return F.exists(filters, lambda f: (f["blob"] == blob) & (f["version"] == version) & (f["regulation"] == regulation))


def admitted(filters: Column, versions: Column) -> Column:
    """Whether every version has a filter and no (version, blob) repeats."""
    have = F.transform(filters, lambda f: f["version"])
    pairs = F.transform(filters, lambda f: F.struct(f["version"], f["blob"]))
    return (F.size(F.array_except(versions, have)) == 0) & (F.size(F.array_distinct(pairs)) == F.size(pairs))


def stratified(rows: DataFrame, strata: list[str], key: str, seed: str, limit: int) -> DataFrame:
    """A deterministic sample: strata take turns, each in order of sha256(seed, key)."""
    h = F.sha2(F.concat(F.lit(seed + "\x1f"), F.col(key).cast("string")), 256)
    part = ", ".join(strata)
    ranked = rows.withColumn("__h", h).withColumn("turn", F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY __h)")).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", *strata).limit(limit).drop("__h")


def exact_field(values: DataFrame, record: str, field: str, value: str) -> DataFrame:
    """(record, field, value, state): EXACT with the smallest original where all values agree once normalized, else CONFLICT."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(value), r"\s+", " ")))
    g = values.withColumn("__n", norm).where("__n <> ''").groupBy(record, field).agg(F.count_distinct("__n").alias("n"), F.min(value).alias("first"))
    one = F.col("n") == 1
    return g.select(record, field, F.when(one, F.col("first")).alias("value"), F.when(one, "EXACT").otherwise("CONFLICT").alias("state"))


def page_class(characters: Column, images: Column, text_min: int = 80, scan_max: int = 20) -> Column:
    return F.when(characters >= text_min, "text").when((characters <= scan_max) & (images > 0), "scan_candidate").otherwise("sparse")


def document_class(text_pages: Column, scan_pages: Column, sparse_pages: Column) -> Column:
    return F.when((text_pages > 0) & (scan_pages > 0), "mixed_candidate").when(scan_pages > 0, "scan_candidate").when(text_pages > 0, "text_candidate").when(sparse_pages > 0, "sparse_or_blank").otherwise("empty")


def state_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a read-back misses, has too many of, or has changed; empty if both sides agree."""
    cols = [c for c in expected.columns if c not in keys]
    e = expected.select(*keys, F.struct(*cols).alias("e"))
    a = actual.select(*keys, F.struct(*cols).alias("a"))
    j = e.join(a, keys, "full_outer")
    state = F.when(F.col("e").isNull(), "EXTRA").when(F.col("a").isNull(), "MISSING").when(~F.col("e").eqNullSafe(F.col("a")), "CHANGED")
    return j.select(*keys, state.alias("state")).where("state IS NOT NULL")


def by_phrase(rows: DataFrame, text: str, phrases: list[str], key: str, limit: int) -> DataFrame:
    """(key, priority): rows that hold a phrase, by the place of the first that they hold, then by digest; one row a text."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(phrases))):
        rank = F.when(F.lower(F.col(text)).contains(phrases[i]), F.lit(i)).otherwise(rank)
    found = rows.select(key, rank.alias("priority"), F.sha2(text, 256).alias("__sha")).where("priority IS NOT NULL")
    one = found.groupBy("__sha").agg(F.min(key).alias(key), F.first("priority").alias("priority"))
    return one.orderBy("priority", "__sha").limit(limit).select(key, "priority")


def reusable(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(by, reusable): whether a part has the same rows in both builds. Sides are counted together, in one shuffle."""
    cols = old.columns
    both = old.select(*cols, F.lit(1).alias("__n")).unionByName(new.select(*cols, F.lit(-1).alias("__n")))
    diff = both.groupBy(*cols).agg(F.sum("__n").alias("n"))
    return diff.groupBy(by).agg((F.max(F.abs("n")) == 0).alias("reusable"))
