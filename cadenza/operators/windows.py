"""Ordered carry-over without a window over the whole sequence.

Positions are cut into buckets, and buckets into buckets of buckets until few are left; a window inside each and one row
per bucket above give the same as one window over everything, but run in parallel at every level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def _before(totals: DataFrame, over: Callable[[Window], Column], merged: Column, both: Callable[[Column, Column], Column], wide: int = 4096, few: int = 100_000) -> DataFrame:
    """totals (_b, _s) with _start: what over makes of all _s of smaller _b.

    merged makes one _s of a bucket of totals; both joins what is before the bucket and what is before in it.
    """
    last = totals.agg(F.max("_b")).first()[0] or 0
    earlier = lambda w: w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if last < few:
        return totals.withColumn("_start", over(earlier(Window)))
    upper = totals.groupBy(F.expr(f"_b div {wide}").alias("_b")).agg(merged.alias("_s"))
    upper = _before(upper, over, merged, both, wide, few).select(F.col("_b").alias("_u"), F.col("_start").alias("_above"))
    rows = totals.withColumn("_u", F.expr(f"_b div {wide}"))
    return rows.withColumn("_in", over(earlier(Window.partitionBy("_u")))).join(upper, "_u").withColumn("_start", both(F.col("_above"), F.col("_in"))).drop("_u", "_in", "_above")


def _carried(df: DataFrame, summary, bucket: int) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn("_b", F.expr(f"position div {bucket}"))
    return rows, rows.groupBy("_b").agg(summary.alias("_s"))


def running_sum(df: DataFrame, column: str, name: str, before: bool = False, bucket: int = BUCKET, few: int = 100_000) -> DataFrame:
    """Adds the sum of column over all positions up to each row's; before: without its own."""
    rows, totals = _carried(df, F.sum(column), bucket)
    zero = lambda x: F.coalesce(x, F.lit(0))
    start = _before(totals, lambda w: zero(F.sum("_s").over(w)), F.sum("_s"), lambda a, b: zero(a) + zero(b), few=few).select("_b", "_start")
    inside = F.sum(column).over(Window.partitionBy("_b").orderBy("position").rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(start, "_b").withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def last_seen(df: DataFrame, column: str, name: str, bucket: int = BUCKET, few: int = 100_000) -> DataFrame:
    """Adds the latest non-null value of column at or before each position; null before the first."""
    rows, ends = _carried(df, F.max_by(column, F.when(F.col(column).isNotNull(), F.col("position"))), bucket)
    latest = F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_b")))
    start = _before(ends, lambda w: F.last("_s", True).over(w), latest, lambda a, b: F.coalesce(b, a), few=few).select("_b", "_start")
    inside = F.last(column, True).over(Window.partitionBy("_b").orderBy("position"))
    return rows.withColumn("_in", inside).join(start, "_b").withColumn(name, F.coalesce("_in", "_start")).drop("_b", "_in", "_start")


def previous(df: DataFrame, name: str, bucket: int = BUCKET, few: int = 100_000, carry: str | None = None) -> DataFrame:
    """Adds the position next before each row's (null at the first), wherever it lies; carry: that row's value of a column under name too, and then the position as start. Positions occur once."""
    value = F.struct(F.col("position").alias("p"), *([F.col(carry).alias("v")] if carry else []))
    rows, ends = _carried(df, F.max(value), bucket)
    start = _before(ends, lambda w: F.max("_s").over(w), F.max("_s"), lambda a, b: F.coalesce(b, a), few=few).select("_b", "_start")
    inside = F.lag(value).over(Window.partitionBy("_b").orderBy("position"))
    found = rows.withColumn("_in", inside).join(start, "_b").withColumn("_s", F.coalesce("_in", "_start"))
    return found.select(*df.columns, *([F.col("_s.p").alias("start"), F.col("_s.v").alias(name)] if carry else [F.col("_s.p").alias(name)]))


def lagged(df: DataFrame, column: str, name: str, by: int = 1, key: str = "position") -> DataFrame:
    """Adds the value of column by positions earlier (negative: later), by an equi-join; null at the ends."""
    other = df.select((F.col(key) + by).alias("_k"), F.col(column).alias(name))
    return df.join(other, F.col(key) == F.col("_k"), "left").drop("_k")
