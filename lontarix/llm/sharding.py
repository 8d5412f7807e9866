"""Extendible-hash sharding with DataFrame operations alone.

Rows are addressed by the bits of ``md5(key)``. The directory starts as one bucket; only a bucket above the byte limit is
split on its next bit, until every shard fits. Sizes come from one aggregate over fixed-width cells of the address, so the
rows themselves are read once for sizes and once for the assignment, however deep the directory gets.

Rows of one key share all bits. If they alone exceed the limit, further bits come from the row's own number, so a key with
a third of all rows splits as well. Only a single row larger than the limit stays above it, alone in its shard.

Defined cases: a null payload has 0 bytes; a null key is one key of its own; an empty table gives no rows. Repeated rows
are rows of their own. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of address taken from the key, and from the row's number where the key's bits are used up.
KEY_BITS, ROW_BITS = 60, 60


def _bits(text: Column) -> Column:
    """60 bits of md5 as a string of 0 and 1."""
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 2)
    return F.lpad(number, 60, "0")


def address(key: Column) -> Column:
    return _bits(F.coalesce(key.cast("string"), F.lit("\x00null")))


def directory(sized: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(cell, shard): which prefix of its address decides a row's shard.

    ``sized`` has (address, bytes). ``cell`` is the finest prefix that was needed; ``shard`` is the shortest prefix whose
    rows fit the limit. Each turn looks ``step`` bits further, only at addresses whose bucket is still too large.
    """
    total = KEY_BITS + ROW_BITS
    done: DataFrame | None = None
    depth, rest = 0, sized
    while True:
        upto = min(depth + step, total)
        cells = rest.groupBy(F.substring("address", 1, upto).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("address").alias("low"), F.max("address").alias("high"))
        cells = cut(cells, "shard-cells")
        prefixes = cells.select("cell", "bytes", "low", "high", F.explode(F.sequence(F.lit(depth), F.lit(upto))).alias("d"))
        prefixes = prefixes.withColumn("shard", F.substring("cell", F.lit(1), F.col("d")))
        # A bucket whose rows all have one address can't be split further: it is a single row.
        fit = prefixes.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        fit = fit.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("shard")
        found = prefixes.join(fit, "shard").groupBy("cell").agg(F.min_by("shard", "d").alias("shard"))
        found = cut(cells.select("cell").join(found, "cell", "left"), "shard-directory")
        settled = found.where(F.col("shard").isNotNull()).withColumn("depth", F.lit(upto))
        done = settled if done is None else done.unionByName(settled)
        still = found.where(F.col("shard").isNull()).select("cell")
        if upto == total or not still.limit(1).count():
            return done
        rest = rest.join(still, F.substring("address", 1, upto) == F.col("cell"), "left_semi")
        depth = upto


def assign(rows: DataFrame, limit: int, key_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """``rows`` with ``shard`` (its bits; "" while one shard holds all), ``depth`` (how many), ``n_bytes``.

    Columns of these names in the input are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "depth", "n_bytes")]
    size = F.coalesce(F.octet_length(F.col(payload_col)), F.lit(0)).cast("long")
    # The address is written once: a row keeps its number when a lost task is run again.
    narrow = cut(rows.select(F.col(key_col).alias("__key"), size.alias("bytes"), F.monotonically_increasing_id().alias("__row"), *(F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(kept) if c != payload_col)), "shard-rows")
    narrow = narrow.withColumn("address", F.concat(address(F.col("__key")), _bits(F.col("__row").cast("string"))))
    table = directory(narrow.select("address", "bytes"), limit)
    depths = sorted(r["depth"] for r in table.select("depth").distinct().collect())
    parts = [narrow.withColumn("cell", F.substring("address", 1, d)).join(table.where(F.col("depth") == d).drop("depth"), "cell") for d in depths]
    out = parts[0] if parts else narrow.withColumn("shard", F.lit(""))
    for p in parts[1:]:
        out = out.unionByName(p)
    names = [F.col(f"__in_{i}").alias(c) for i, c in enumerate(kept) if c != payload_col]
    return out.select(*names, "shard", F.length("shard").cast("long").alias("depth"), F.col("bytes").alias("n_bytes"))


def write_shards(rows: DataFrame, path: str, limit: int, key_col: str = "doc_id", payload_col: str = "text") -> None:
    """Write whole rows, one folder a shard. Rows are numbered once, written, and joined by number, so keys may repeat."""
    numbered = cut(rows.withColumn("__n", F.monotonically_increasing_id()), "shard-texts")
    placed = assign(numbered.select("__n", key_col, payload_col), limit, key_col, payload_col).select("__n", "shard")
    joined = numbered.join(placed, "__n").drop("__n")
    joined.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
