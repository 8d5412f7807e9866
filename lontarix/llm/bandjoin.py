"""Numeric band join of sale lines to items on near prices, over a grid of equal-width buckets.

Prices are whole cents. Lines are summed up by their price a unit before anything moves: an item's pairs depend on its own price
and the lines' prices alone, but for the lines of the item itself, which are taken off by a join on the item. So the join is one
of distinct prices. Every price of lines keeps one bucket of ``WIDTH`` cents, items' prices are dealt to every bucket that their
interval touches, both meet in an equi-join, and each pair is checked in exact integers. Buckets of more than ``HOT`` prices are
salted over several parts. An item whose interval would touch more than ``TOUCH`` buckets uses a grid 16, 256, ... times as
coarse; lines then keep one bucket in each grid that items use.

The first pairs need single lines: of the lines of one price the first ``2 * top`` are kept, ``top`` of one item at most. Whatever
one item is taken out, ``top`` are left, or all that there are. Prices next to an item's are opened until that many are found.

Defined cases: a line null in sale_id, item_id, quantity or amount, of a quantity under 1, or of an amount that is not finite or
beyond 2^53 cents never pairs, nor does an item without id or whose price is null, not finite or beyond 2^53 cents: it has one row
of rank 0, as every item without pairs. A null line_no comes after all numbers and counts as empty text. Repeated lines count and
rank each; repeated items are joined each by its own price. No items give no rows. Extra columns are left out. Sums that leave 64
bits are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, working

#: Cents of a bucket, distinct prices of lines in a part of a bucket, and buckets that an item touches in a grid.
WIDTH, HOT, TOUCH = 64, 32, 64
#: Parts that the items of one price are dealt over, so that a price that very many items share is no single task.
SALTS = 64
#: Beyond this many cents doubles don't hold every cent.
MOST = 1 << 53


def cents(x: Column) -> Column:
    """Whole cents, null where there are none."""
    c = F.floor(x * 100 + 0.5)
    return F.when(~F.isnan(x) & (F.abs(x) < MOST / 100), c.cast("long"))


def div(x: Column, y: Column | int) -> Column:
    """Floor of x / y in integers, y > 0."""
    y = y if isinstance(y, Column) else F.lit(y)
    return F.call_function("div", x - F.pmod(x, y), y)


def unit_prices(lines: DataFrame) -> DataFrame:
    """(u, sale_id, line_no, item_id, crc) of the lines that can pair; u is the price a unit in cents, rounded half up."""
    q = F.col("quantity").cast("long")
    rows = lines.select("sale_id", "line_no", "item_id", q.alias("q"), cents(F.col("amount").cast("double")).alias("a"))
    rows = rows.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND q >= 1 AND a IS NOT NULL")
    text = F.concat("sale_id", F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), "item_id")
    u = div(2 * F.col("a") + F.col("q"), 2 * F.col("q"))
    return rows.select(u.alias("u"), F.col("sale_id").cast("long"), F.col("line_no").cast("long"), F.col("item_id").cast("long"), F.crc32(text.cast("binary")).alias("crc"))


def band(p: Column, within: int, per_mille: int) -> tuple[Column, Column]:
    """Least and greatest u with |u - p| <= within, or 1000 * |u - p| <= per_mille * least(u, p)."""
    low = -div(-p * 1000, 1000 + per_mille)
    high = div(p * (1000 + per_mille), 1000)
    return F.least(p - within, low), F.greatest(p + within, high)


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join sorted and merged at every size: all tables here grow with the input, so none is broadcast."""
    return left.join(right.hint("merge"), on, how)


def _first(rows: DataFrame, keys: list[str], order: list[Column], most: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def _paired(units: DataFrame, prices: DataFrame) -> DataFrame:
    """(p, u, gap, n, crc, others): all pairs of distinct prices within the band."""
    # Grids that items use: a handful of numbers whatever the input.
    levels = sorted(r[0] for r in prices.select("level").distinct().collect())
    of = lambda x, level: div(x, WIDTH * F.pow(F.lit(16), level).cast("long"))
    grid = F.explode(F.array(*map(F.lit, levels))).alias("level") if levels else F.lit(0).alias("level")
    own = units.select("u", "n", "crc", "others", grid).withColumn("bucket", of(F.col("u"), F.col("level")))
    parts = own.groupBy("level", "bucket").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    dealt = _merged(own, parts, ["level", "bucket"]).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).drop("parts")
    touched = F.sequence(of(F.col("low"), F.col("level")), of(F.col("high"), F.col("level")))
    asked = _merged(prices.select("p", "low", "high", "level", F.explode(touched).alias("bucket")), parts, ["level", "bucket"])
    asked = asked.select("p", "low", "high", "level", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = _merged(asked, dealt, ["level", "bucket", "part"]).where("u BETWEEN low AND high")
    return both.select("p", "u", F.abs(F.col("u") - F.col("p")).alias("gap"), "n", "crc", "others")


def near_prices(lines: DataFrame, items: DataFrame, top: int = 10, within: int = 50, per_mille: int = 5) -> DataFrame:
    """Per item its first ``top`` pairs by (gap, u, sale_id, line_no, line_item_id), with n_pairs, gap_sum and lines_crc of all its pairs."""
    spark = lines.sparkSession
    order = [F.col("sale_id"), F.col("line_no").asc_nulls_last(), F.col("item_id")]
    price = cents(F.col("price").cast("double"))
    asked = items.select(F.col("item_id").cast("long"), F.when(F.col("item_id").isNotNull(), price).alias("p"), F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int").alias("salt"))
    with working(spark):
        rows = unit_prices(lines)
        by_item = cut(rows.groupBy("u", "item_id").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "unit-items")
        # Of one price and item the first `top` lines are enough, of one price twice as many.
        few = _first(rows.drop("crc"), ["u", "item_id"], order[:2], top, "k")
        few = _first(few, ["u"], order, 2 * top, "k")
        line = F.struct("sale_id", F.col("line_no").isNull().alias("none"), "line_no", "item_id")
        few = few.groupBy("u").agg(F.sort_array(F.collect_list(line)).alias("lines"))
        # Lines of this price that are left at least, whichever item is taken out.
        item = F.transform("lines", lambda x: x.item_id)
        most = F.array_max(F.transform(F.array_distinct("held"), lambda x: F.size(F.filter("held", lambda y: y == x))))
        few = cut(few.withColumn("held", item).select("u", "lines", (F.size("lines") - most).alias("others")), "unit-lines")
        units = _merged(by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")), few.select("u", "others"), ["u"])

        low, high = band(F.col("p"), within, per_mille)
        prices = asked.where("p IS NOT NULL").groupBy("p").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
        prices = prices.select("p", low.alias("low"), high.alias("high"), "salts")
        touched = (F.col("high") - F.col("low")) / (WIDTH * TOUCH)
        prices = cut(prices.withColumn("level", F.when(touched <= 1, 0).otherwise(F.ceil(F.log2(touched) / 4)).cast("int")), "prices")
        pairs = _paired(units, prices)
        before = F.sum("others").over(Window.partitionBy("p").orderBy("gap", "u").rowsBetween(Window.unboundedPreceding, -1))
        pairs = cut(pairs.withColumn("opened", F.coalesce(before, F.lit(0)) < top).drop("others"), "price-pairs")
        sums = pairs.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gap")).alias("gaps"), F.sum("crc").alias("crc"))
        near = _merged(pairs.where("opened").select("p", "u", "gap"), few.select("u", F.explode("lines").alias("x")), ["u"]).select("p", "gap", "u", "x.*")
        order = [F.col("gap"), F.col("u"), *order]
        near = _first(_first(near, ["p", "item_id"], order[:-1], top, "k"), ["p"], order, 2 * top, "k")
        near = near.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("gap", "u", "sale_id", "none", "line_no", "item_id"))).alias("near"))
        # One row for each part that items of the price are in.
        used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.bit_get("salts", i) == 1)
        known = cut(_merged(_merged(prices, sums, ["p"]), near, ["p"]).select("p", F.explode(used).alias("salt"), "n", "gaps", "crc", "near"), "price-sums", keep=True)
        alone = asked.where("p IS NOT NULL").select("item_id", "p").distinct().withColumns({"low": low, "high": high})
        inside = _merged(by_item, alone, ["item_id"]).where("u BETWEEN low AND high")
        gap = F.abs(F.col("u") - F.col("p"))
        taken = inside.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * gap).alias("own_gaps"), F.sum("crc").alias("own_crc"))
        taken = cut(taken, "own-sums", keep=True)

    rest = lambda x, own: F.coalesce(F.col(x), F.lit(0)) - F.coalesce(F.col(own), F.lit(0))
    out = _merged(_merged(asked, known, ["p", "salt"], "left"), taken, ["item_id", "p"], "left")
    out = out.select(
        "item_id", rest("n", "own_n").alias("n_pairs"), rest("gaps", "own_gaps").alias("gap_sum"), rest("crc", "own_crc").alias("lines_crc"),
        F.slice(F.filter("near", lambda x: x.item_id != F.col("item_id")), 1, top).alias("near"),
    ).select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("near").alias("at", "x"))
    return out.select(
        "item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), F.col("x.gap").alias("gap"), F.col("x.u").alias("u"), F.col("x.sale_id").alias("sale_id"),
        F.col("x.line_no").alias("line_no"), F.col("x.item_id").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc",
    )
