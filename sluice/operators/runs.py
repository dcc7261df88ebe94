"""Paired simulation runs: trips and edges of a base and a closure case, over hours and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, stats

RUN_DIR = r"(base|closure)_h(\d+)(?:_s[\d.]+)?_seed(\d+)"


def run_keys(path: Column) -> list[Column]:
    """scenario, hour and seed from a run folder's name."""
    part = lambda n: F.regexp_extract(path, RUN_DIR, n)
    return [part(1).alias("scenario"), part(2).try_cast("int").alias("hour"), part(3).try_cast("int").alias("seed")]


def paired(base: DataFrame, closure: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Trips of both runs, with the difference of their values."""
    b, c = base.select(*keys, F.col(value).alias("base")), closure.select(*keys, F.col(value).alias("closure"))
    return b.join(c, keys).withColumn("difference", F.col("closure") - F.col("base"))


def delay_hours(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg((F.sum("difference") / 3600).alias("delay_veh_h"), F.count("*").alias("n_trips"))


def seed_spread(totals: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, median and greatest over seeds, rounded."""
    whole = lambda x: F.bround(x)
    return totals.groupBy(*by).agg(whole(F.min(value)).alias("low"), whole(F.median(value)).alias("typical"), whole(F.max(value)).alias("high"))


def seed_noise(base: DataFrame, seed: str, keys: list[str], value: str) -> DataFrame:
    """Differences between each base run and the next seed's, summed: what varies without any closure."""
    order = base.select(seed).distinct()
    nxt = order.select(F.col(seed), F.lead(seed).over(Window.orderBy(seed)).alias("next_seed"))
    a = base.join(F.broadcast(nxt.where("next_seed is not null")), seed)
    b = base.select(F.col(seed).alias("next_seed"), *keys, F.col(value).alias("_other"))
    return a.join(b, ["next_seed", *keys]).groupBy(seed, "next_seed").agg(F.sum(F.col("_other") - F.col(value)).alias("noise"), F.count("*").alias("n"))


def users_of(routes: DataFrame, closed: list[str], edges: str = "edges") -> DataFrame:
    """Whether each route touches a closed edge."""
    return routes.withColumn("uses_closed", F.arrays_overlap(F.col(edges), F.array(*[F.lit(c) for c in closed])))


def against_counts(simulated: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with the simulated volume (0 where none) and GEH."""
    joined = counts.join(simulated, keys, "left").withColumn("simulated", F.coalesce("simulated", F.lit(0.0)))
    return joined.withColumn("geh", geo.geh(F.col("simulated"), F.col("counted")))


def geh_report(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), stats.share(F.col("geh") < 5).alias("share_under_5"), stats.share(F.col("geh") < 10).alias("share_under_10"), F.avg("geh").alias("mean_geh"), F.sum("counted").alias("counted"), F.sum("simulated").alias("simulated"))


def worst(rows: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The n keys of the largest summed absolute error (a top-k report)."""
    return rows.groupBy(key).agg(F.sum(F.abs(F.col("simulated") - F.col("counted"))).alias("abs_error")).orderBy(F.desc("abs_error"), key).limit(n)


def allocated(parts: DataFrame, group: list[str], total: str, weight: str) -> DataFrame:
    """A group's total shared out by weight."""
    return parts.withColumn("allocated", F.col(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy(*group)))


def street_changes(users: DataFrame, least: float = 0.05) -> DataFrame:
    """users (case, street, n, n_seeds): per street the mean users per seed of both cases and whether it gained or was relieved by 5 % of the base."""
    mean = lambda case: F.coalesce(F.sum(F.when(F.col("case") == case, F.col("n") / F.col("n_seeds"))), F.lit(0.0))
    out = users.groupBy("street").agg(mean("base").alias("base"), mean("closure").alias("closure")).withColumn("change", F.col("closure") - F.col("base"))
    return out.withColumn("verdict", F.when(F.col("change") > least * F.col("base"), "gained").when(F.col("change") < -least * F.col("base"), "relieved").otherwise("same"))


def half_hours(counts: DataFrame, by: list[str], hour: str, value: str) -> DataFrame:
    """Value at each half hour, between an hour's and the next one's (its own where there is none)."""
    ahead = F.lead(value).over(Window.partitionBy(*by).orderBy(hour))
    return counts.withColumn("half_hour_value", 0.5 * F.col(value) + 0.5 * F.coalesce(ahead, F.col(value)))


def trailing_mean(samples: DataFrame, by: list[str], second: str, value: str, seconds: int = 120) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(second).rangeBetween(-(seconds - 1), 0)
    return samples.withColumn("trailing_mean", F.avg(value).over(w))


def dense_seconds(samples: DataFrame, by: list[str], second: str, value: str) -> DataFrame:
    """A row for every second between a group's first and last, without a sample its value is 0."""
    span = samples.groupBy(*by).agg(F.sequence(F.min(second), F.max(second)).alias("_s")).select(*by, F.explode("_s").alias(second))
    return span.join(samples, [*by, second], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def running_distinct(events: DataFrame, by: list[str], time: str, item: str) -> DataFrame:
    """How many distinct items a group has seen by each time at which a new one appears."""
    first = events.groupBy(*by, item).agg(F.min(time).alias(time)).groupBy(*by, time).agg(F.count("*").alias("new"))
    return first.withColumn("seen", F.sum("new").over(Window.partitionBy(*by).orderBy(time)))


def level_bands(extra: Column, normal: Column) -> Column:
    """0 to 3 by how far a block's queue exceeds its normal average; fewer than 2 extra cars never count."""
    r = extra / F.greatest(normal, F.lit(1.0))
    return F.when(extra < 2, 0).when(r < 0.2, 0).when(r < 0.5, 1).when(r < 1.0, 2).otherwise(3)


def gap_tolerant_runs(bins: DataFrame, by: list[str], at: str, gap: int = 1) -> DataFrame:
    """Runs of occupied bins in which at most `gap` bins in a row are missing: first, last, and the length in bins."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = bins.withColumn("_new", (F.col(at) - F.lag(at).over(w) > gap + 1).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    return marked.groupBy(*by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).withColumn("length", F.col("last") - F.col("first") + 1).drop("_run")


def longest_run(bins: DataFrame, by: list[str], at: str, gap: int = 1) -> DataFrame:
    runs = gap_tolerant_runs(bins, by, at, gap)
    return runs.groupBy(*by).agg(F.max_by(F.struct("first", "last", "length"), F.struct("length", -F.col("first"))).alias("r")).select(*by, "r.*")


def pinch(slices: DataFrame, by: list[str], at: str, width: str) -> DataFrame:
    """Of each two neighbouring slices the wider, and of those the narrowest: one slice's noise is no pinch."""
    w = Window.partitionBy(*by).orderBy(at)
    pairs = slices.withColumn("_w", F.when(F.lead(at).over(w) == F.col(at) + 1, F.greatest(F.col(width), F.lead(width).over(w))))
    return pairs.where("_w is not null").groupBy(*by).agg(F.min("_w").alias("pinch"), F.min_by(at, F.struct("_w", at)).alias("at"))


def until_first_bad(bins: DataFrame, by: list[str], at: str, bad: Column) -> DataFrame:
    """The first bin that is bad; without one, the bin after the last."""
    return bins.groupBy(*by).agg(F.coalesce(F.min(F.when(bad, F.col(at))), F.max(at) + 1).alias("until"))
