"""Order statistics with the exact index rules that reports quote, and small aggregates.

placed() gives every distinct value of a group its place among the group's rows, so a statistic is a plain aggregate over
it. Values are counted, then sorted by range partitions; no task holds a group, however few groups there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .recovery import cut


def placed(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, value (nulls left out), n (rows that have it), below (rows of the group with a lesser one) and size (of the group)."""
    counts = rows.select(*keys, value.alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(n, *keys, "value").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("_n"))
    group, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "size": F.sum("_n").over(group)}).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), "_before", "size")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("part") == F.col("_part"))
    within = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("_before") + F.sum("n").over(within) - F.col("n")
    return ranged.join(parts, same).select(*keys, "value", "n", below.alias("below"), "size")


def at_index(i: Column) -> Column:
    """Of placed rows, the value at an index (from 0) of the sorted values. An aggregate."""
    return F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col("value")))


def index_quantile(p: float) -> Column:
    """The value at index min(n - 1, floor(p * n)) of the sorted values. An aggregate over placed rows, as the next ones."""
    return at_index(F.least(F.col("size") - 1, F.floor(p * F.col("size"))))


def upper_median() -> Column:
    return index_quantile(0.5)


def lower_quantile(p: float) -> Column:
    """The value at index floor(p * (n - 1))."""
    return at_index(F.floor(p * (F.col("size") - 1)))


def middle_mean() -> Column:
    """Mean of the sorted values from index floor(n / 4) up to floor(3n / 4); of all, when that is empty."""
    lo, hi = F.floor(F.col("size") / 4), F.floor(3 * F.col("size") / 4)
    lo, hi = F.when(hi > lo, lo).otherwise(0), F.when(hi > lo, hi).otherwise(F.col("size"))
    own = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), hi) - F.greatest(F.col("below"), lo))
    return F.sum(F.col("value") * own) / F.sum(own)


def quantile(p: float) -> Column:
    """Exact, interpolated between neighbours."""
    at = p * (F.col("size") - 1)
    lo = F.floor(at)
    low, high = at_index(lo), at_index(F.ceil(at))
    return low + F.max(at - lo) * (high - low)


def mean() -> Column:
    return F.sum(F.col("value") * F.col("n")) / F.sum("n")


def share_below(limit: float) -> Column:
    return F.sum(F.when(F.col("value") < limit, F.col("n")).otherwise(0)) / F.sum("n")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)
