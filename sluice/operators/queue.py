"""The hour-by-hour queue: a left fold over the day's hours, from 05:00."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

# The standard work windows.
WINDOWS = {"night": (20, 21, 22, 23, 0, 1, 2, 3, 4), "day": (9, 10, 11, 12, 13, 14), "24 hours": tuple(range(24))}
DEFAULTS = {"direction_split": 0.5, "capacity_per_lane": 800.0, "work_zone_factor": 0.85, "veh_length_m": 7.0, "max_queue_m_per_lane": 500.0}
SCENARIOS = {"low": "p10", "typical": "p50", "worst": "p90"}


def hour_order(hour: Column) -> Column:
    """0 for 05:00 up to 23 for 04:00."""
    return F.pmod(hour - 5, F.lit(24))


def window_hours(window: Column) -> Column:
    out = None
    for name, hours in WINDOWS.items():
        value = F.array(*[F.lit(h) for h in hours])
        out = F.when(window == name, value) if out is None else out.when(window == name, value)
    return out


def fold(hours: DataFrame, keys: list[str], python_rounding: bool = True) -> DataFrame:
    """Summary of each key's hours (hour, works, demand, change, cap, qmax, lanes_open): delay, longest queue, hours with a queue, forced diversions.

    A group has 24 rows. Either rounding is offered: half to even, with queue hours counted on rounded queues, or
    half up, counted on raw queues.
    """
    rounded = F.bround if python_rounding else text.round_up_half
    rows = F.array_sort(F.collect_list(F.struct(hour_order(F.col("hour")).alias("i"), "works", "demand", "change", "cap", "qmax")))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("delay"), F.lit(0.0).alias("longest"), F.lit(0).alias("queued"), F.lit(0.0).alias("forced"))

    def step(s: Column, x: Column) -> Column:
        raw = F.greatest(F.lit(0.0), s["q"] + x["demand"] * (1 + F.when(x["works"], x["change"]).otherwise(0.0)) - x["cap"])
        forced = F.greatest(F.lit(0.0), raw - x["qmax"])
        q = raw - forced
        whole = rounded(q).cast("double")
        return F.struct(q.alias("q"), (s["delay"] + (s["q"] + q) / 2).alias("delay"), F.greatest(s["longest"], whole).alias("longest"), (s["queued"] + ((whole if python_rounding else q) > 0).cast("int")).alias("queued"), (s["forced"] + rounded(forced).cast("double")).alias("forced"))

    out = hours.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("s"), F.first("lanes_open").alias("lanes_open"), F.first("veh_length_m").alias("veh_length_m"))
    return out.select(*keys, F.col("s.delay").alias("delay_veh_h"), rounded(F.col("s.longest") * F.col("veh_length_m") / F.greatest("lanes_open", F.lit(1))).cast("long").alias("max_queue_m"), F.col("s.queued").cast("long").alias("queue_hours"), F.col("s.forced").cast("long").alias("forced_diversions_veh"))


def hourly(requests: DataFrame, profile: DataFrame, settings: dict | None = None) -> DataFrame:
    """requests (aadt, lanes_per_direction, lanes_open, active: hours) x profile (hour, share): demand, capacity and works of each hour."""
    p = DEFAULTS | (settings or {})
    works = F.array_contains("active", F.col("hour"))
    cap = F.when(works, F.col("lanes_open") * p["capacity_per_lane"] * p["work_zone_factor"]).otherwise(F.col("lanes_per_direction") * p["capacity_per_lane"])
    return requests.crossJoin(F.broadcast(profile)).withColumns({"works": works, "demand": F.col("aadt") * p["direction_split"] * F.col("share"), "cap": cap.cast("double"), "qmax": p["max_queue_m_per_lane"] / p["veh_length_m"] * F.greatest("lanes_open", F.lit(1)), "veh_length_m": F.lit(p["veh_length_m"])})


def scenarios(hours: DataFrame, which: tuple[str, ...] = ("typical", "worst")) -> DataFrame:
    """A row per scenario, its change being the lookup's quantile."""
    pairs = F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(SCENARIOS[s]).alias("change")) for s in which])
    return hours.select("*", F.inline(pairs))


def delay_cost(delay: Column, value_of_time: float) -> Column:
    return F.bround(delay * value_of_time)


def best_window(summaries: DataFrame, key: str, measure: str = "delay_veh_h") -> DataFrame:
    """Windows of each key ranked by the measure, the plan's own first among equals; the first is recommended."""
    w = Window.partitionBy(key).orderBy(measure, F.when(F.col("work_window") == "plan", 0).otherwise(1), F.when(F.col("work_window") == "night", 0).when(F.col("work_window") == "day", 1).otherwise(2))
    return summaries.withColumn("rank", F.row_number().over(w)).withColumn("recommended", F.col("rank") == 1)


def nearest_window(hours: Column) -> Column:
    """The standard window of the largest Jaccard similarity with the hours; the first listed among equals."""
    scored = []
    for k, (name, own) in enumerate(WINDOWS.items()):
        w = F.array(*[F.lit(h) for h in own])
        both = F.size(F.array_intersect(hours, w)) / F.size(F.array_union(hours, w))
        scored.append(F.struct(both.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    return F.greatest(*scored)["name"]


def lanes(requests: DataFrame) -> DataFrame:
    """Lanes to model: closed roads and directions keep none, footpath works all, partial closures at least one."""
    road, foot = F.col("closure_type") == "road closed", F.col("closure_type") == "footpath only"
    direction = ~road & ~foot & F.col("direction_closed")
    partial = ~road & ~foot & ~F.col("direction_closed")
    unknown = F.col("lanes_per_direction") < 1
    per = F.when(unknown, F.when(partial, 2).otherwise(1)).otherwise(F.col("lanes_per_direction"))
    still = F.when(road | direction, 0).when(foot, per).otherwise(F.least("lanes_open", per))
    still = F.when(partial & (still < 1), F.greatest(F.lit(1), per - 1)).otherwise(still)
    return requests.withColumns({"lanes_per_direction": per, "lanes_open": still})


def modelled_aadt(daily: Column) -> Column:
    """Half of a site's daily count uses the closed street; without a site, 20,000."""
    return F.when(daily.isNotNull() & (daily != 0), daily * 0.5).otherwise(F.lit(20000.0))


def spread(low: Column, typical: Column, worst: Column) -> Column:
    """struct(low, typical, high) of three rounded values, low and high taken over all three."""
    a, b, c = (text.round_up_half(x) for x in (low, typical, worst))
    return F.struct(F.least(a, b, c).alias("low"), b.alias("typical"), F.greatest(a, b, c).alias("high"))


def confidence(level: Column, lanes_open: Column) -> Column:
    return F.when((level == 1) & (lanes_open > 0), "medium").otherwise("low")
