"""Volumes against their baseline, the three-level quantile lookup and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.recovery import cut

LAGS = (7, 14, 21, 28, 35, 42)
LEVELS = ("site_relation", "closure_type", "work_window", "time_band", "road_class")
ANY = "any"
LARGE_DROP = -0.15


def road_class(volume: Column) -> Column:
    """A missing volume counts as high."""
    return F.when(volume < 20000, "low (<20k/day)").when(volume < 40000, "medium (20-40k/day)").otherwise("high (>40k/day)")


def _middle(xs: Column) -> Column:
    """Median of a short list without nulls; null of none."""
    s = F.sort_array(xs)
    return F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def against_baseline(days: DataFrame, keys: list[str], day: str, volume: str, least_days: int = 3, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """days with the median volume of the same weekday in the weeks before (baseline), its number of days, and the relative change.

    Each day is sent forward to the days it is a baseline of, so the lags are one equi-join.
    """
    ahead = days.select(*keys, F.explode(F.transform(F.array(*[F.lit(k) for k in lags]), lambda k: F.date_add(F.col(day), k))).alias(day), F.col(volume).alias("_prior"))
    base = days.join(ahead, [*keys, day]).groupBy(*keys, day, volume).agg(_middle(F.collect_list("_prior")).alias("baseline"), F.count("*").alias("baseline_days"))
    return base.where((F.col("baseline_days") >= least_days) & (F.col("baseline") > 0)).withColumn("change", F.col(volume) / F.col("baseline") - 1)


def _summary(n: str) -> list[Column]:
    """Aggregates over placed changes."""
    return [F.max("size").alias(n), stats.quantile(0.1).alias("p10"), stats.quantile(0.5).alias("p50"), stats.quantile(0.9).alias("p90"), stats.mean().alias("mean_change"), stats.share_below(LARGE_DROP).alias("share_over_15pct_drop")]


def quantile_summary(changes: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    return stats.placed(changes, keys, F.col("change")).groupBy(*keys).agg(*_summary("n")).where(F.col("n") >= least)


def per_closure(impacts: DataFrame, keys: list[str]) -> DataFrame:
    """Median change and daily volume of each closure's site-days, with how many days and sites they are. Days without a change are left out."""
    known = impacts.where(F.col("change").isNotNull() & F.col("daily_volume").isNotNull())
    days = known.groupBy(*keys).agg(F.collect_list(F.struct("change", "daily_volume", "date_local", "site_no")).alias("_days"))
    n = lambda c: F.size(F.array_distinct(F.col(f"_days.{c}"))).cast("long")
    return days.select(*keys, _middle(F.col("_days.change")).alias("change"), _middle(F.col("_days.daily_volume")).alias("site_daily_volume"), n("date_local").alias("n_days"), n("site_no").alias("n_sites"))


def build(changes: DataFrame, least: int = 20) -> DataFrame:
    """Level 1 by all keys, level 2 without road class, level 3 by site relation and time band, from one pass over the changes."""
    free = {1: (), 2: ("road_class",), 3: ("closure_type", "work_window", "road_class")}
    sets = [F.struct(F.lit(level).alias("level"), *[(F.lit(ANY) if c in out else F.col(c)).alias(c) for c in LEVELS]) for level, out in free.items()]
    rows = changes.select("change", F.inline(F.array(*sets)))
    keys = ["level", *LEVELS]
    return stats.placed(rows, keys, F.col("change")).groupBy(*keys).agg(*_summary("n_closures")).where(F.col("n_closures") >= least)


def find(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows with the most specific lookup row there is: three equi-joins on the small lookup; rows without any go."""
    facts = ("level", "n_closures", "p10", "p50", "p90", "mean_change", "share_over_15pct_drop")
    out = rows
    for n, keys in ((1, LEVELS), (2, LEVELS[:4]), (3, ("site_relation", "time_band"))):
        own = lookup.where(F.col("level") == n).select(*keys, F.struct(*facts).alias(f"_l{n}"))
        out = out.join(own, list(keys), "left")
    hit = F.coalesce("_l1", "_l2", "_l3")
    return out.withColumn("_hit", hit).where("_hit is not null").select(*rows.columns, *[F.col(f"_hit.{c}").alias(c) for c in facts])


def find_ranked(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """As find(), by one join on the keys of level 3 and a rank over what matches; `key` names rows' own key."""
    w = Window.partitionBy(key).orderBy("level")
    a, b = rows.alias("a"), lookup.alias("b")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    fits = (F.col("b.level") == 3) | (same("closure_type") & same("work_window") & ((F.col("b.level") == 2) | same("road_class")))
    met = a.join(b, same("site_relation") & same("time_band")).where(fits)
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return met.select(*kept, "level", "n_closures", "p10", "p50", "p90", "mean_change", "share_over_15pct_drop").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split(closures: DataFrame, day: str = "2026-01-01") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by their first day."""
    before = F.col("d_from") < F.lit(day).cast("date")
    return closures.where(before), closures.where(~before)


def validation(tested: DataFrame) -> DataFrame:
    """Per site relation: absolute errors of the lookup's median and of no change, coverage, share of level 1."""
    miss, none = F.abs(F.col("change") - F.col("p50")), F.abs(F.col("change"))
    key, tested = ["site_relation"], cut(tested)
    out = tested.groupBy(*key).agg(F.count("*").alias("n_test"), F.avg(miss).alias("mean_abs_err_model"), F.avg(none).alias("mean_abs_err_no_change"), stats.share(F.col("change").between(F.col("p10"), F.col("p90"))).alias("p10_p90_coverage"), stats.share(F.col("level") == 1).alias("share_level1"))
    for name, error in (("mae_model", miss), ("mae_no_change", none)):
        out = out.join(stats.placed(tested, key, error).groupBy(*key).agg(stats.quantile(0.5).alias(name)), key)
    return out


def risk_band(share: Column) -> Column:
    return F.when(share < 0.1, "<10%").when(share < 0.2, "10-20%").when(share < 0.3, "20-30%").otherwise(">30%")


def calibration(tested: DataFrame) -> DataFrame:
    """Predicted and actual share of large drops by predicted risk."""
    band = risk_band(F.col("share_over_15pct_drop")).alias("predicted_risk_band")
    return tested.groupBy("site_relation", band).agg(F.count("*").alias("n_test"), F.avg("share_over_15pct_drop").alias("predicted_share_over_15pct_drop"), stats.share(F.col("change") < LARGE_DROP).alias("actual_share_over_15pct_drop"))


def sql_function(lookup: DataFrame, name: str = "closure_effect") -> None:
    """Registers a SQL table function over the lookup: name(closure_type, work_window, time_band, road_class [, site_relation]).

    It gives the most specific row as find() does; the relation is 'same street' unless named. Nothing that fits is an error.
    """
    spark = lookup.sparkSession
    lookup.createOrReplaceTempView(f"{name}_rows")
    facts = "level, n_closures, p10, p50, p90, mean_change, share_over_15pct_drop"
    kind = ", ".join(f"{c} {lookup.schema[c].dataType.simpleString()}" for c in facts.split(", "))
    fits = "r.level = 3 OR (r.closure_type = of_type AND r.work_window = of_window AND (r.level = 2 OR r.road_class = of_road))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_type STRING, of_window STRING, of_band STRING, of_road STRING, of_relation STRING DEFAULT 'same street')
    RETURNS TABLE ({kind}) RETURN SELECT hit.* FROM (SELECT CASE WHEN count(*) = 0 THEN raise_error('no lookup row fits') ELSE min_by(struct({facts}), level) END AS hit
    FROM {name}_rows r WHERE r.site_relation = of_relation AND r.time_band = of_band AND ({fits}))""")
