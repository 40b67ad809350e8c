"""Exact order statistics of a whole column, without sorting it.

Histograms are refined: by size to a sixteenth of a power of two, then in 4096 equal parts of the
bucket that holds the wanted rank, then the distinct values of that part. Each pass shuffles a row
for each bucket and task only, and no window holds more than the buckets or that part's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096


def _size_bucket(x: Column) -> Column:
    """A number that grows with x: at most some 35,000 different ones for all doubles."""
    own = lambda v: F.floor(F.log2(v) * 16).cast("int") + 20_000
    return F.when(x > 0, own(x)).when(x < 0, -own(-x)).otherwise(0)


def _holding(counts: DataFrame, by: str, wanted: Column, *keys: str) -> DataFrame:
    """Of counts (keys, by, c, …) the rows that hold the wanted rank, with `rest`, the rank within them."""
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    till = F.sum("c").over(over.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"till": till, "n": F.sum("c").over(over)}).withColumn("rank", wanted)
    return counts.filter("rank >= till - c and rank < till").withColumn("rest", F.col("rank") - F.col("till") + F.col("c"))


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(name, value): for each name the value at its rank, counted from 0 in ascending order.

    ranks: a function of the number of values for each name; a rank outside them has no row. Null
    and NaN values don't count. rows are read three times, so they should be a table or cheap.
    """
    x = F.col(value).cast("double")
    rows = rows.select(x.alias("x")).filter("x is not null and not isnan(x)").withColumn("bucket", _size_bucket(F.col("x")))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    over = Window.partitionBy(F.lit(0))
    till = F.sum("c").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    at = sizes.withColumns({"till": till, "n": F.sum("c").over(over)}).select("*", named.alias("w")).filter("w.rank >= till - c and w.rank < till")
    # a row for each name
    at = at.select("w.name", "bucket", "lo", "hi", (F.col("w.rank") - F.col("till") + F.col("c")).alias("rest"))
    inside = rows.join(F.broadcast(at), "bucket")
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    parts = inside.withColumn("part", part).groupBy("name", "part", "bucket", "rest").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = _holding(parts.withColumnRenamed("rest", "asked"), "part", F.col("asked"), "name").select("name", "bucket", "lo", "hi", "rest")
    values = rows.join(F.broadcast(at), "bucket").filter("x between lo and hi").groupBy("name", "x", F.col("rest").alias("asked")).agg(F.count("*").alias("c"))
    return _holding(values, "x", F.col("asked"), "name").select("name", F.col("x").alias("value"))


def at_share(p: float) -> Callable[[Column], Column]:
    """The rank at a share p of the way from the first to the last value, rounded down."""
    return lambda n: F.floor((n - 1) * F.lit(p))
