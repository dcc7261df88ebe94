"""Severity rules over modes, the site check on measured widths, crowding grades, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Limits (high, moderate) by metric, metrics by mode in order, ranks, grades by people a minute and metre.
LIMITS = {"forced_diversions": (1000.0, 100.0), "max_queue": (250.0, 50.0), "delay": (200.0, 20.0), "detour": (100.0, 30.0)}
MODE_METRICS = {"cars": ("forced_diversions", "max_queue", "delay"), "trucks": ("forced_diversions", "max_queue", "delay"), "public_transport": ("delay",), "pedestrians": ("detour",)}
MODES = ("cars", "pedestrians", "public_transport", "trucks")
RANK = {"Not modelled": 0, "Low": 1, "Moderate": 2, "Review required": 2, "High": 3}
GRADES = ((3, "A+"), (6, "A"), (9, "A-"), (12, "B+"), (15, "B"), (18, "B-"), (21, "C+"), (24, "C"), (27, "C-"), (36, "D"))
ORDER = ("High", "Moderate", "Review required", "Low", "Not modelled")
FOOTPATH_MIN, FOOTPATH_ABS_MIN = 1.5, 1.2


def limits(spark: SparkSession) -> DataFrame:
    """mode, metric, its order among the mode's, and both limits."""
    rows = [(mode, m, k, *LIMITS[m]) for mode, ms in MODE_METRICS.items() for k, m in enumerate(ms)]
    return spark.createDataFrame(rows, "mode string, metric string, metric_order int, high double, moderate double")


def rank(severity: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.element_at(pairs, severity)


def rate_metrics(values: DataFrame) -> DataFrame:
    """request, mode, severity and metric of modelled modes (request, mode, metric, value: the range's high end).

    Every mode that has a row is modelled. The first of its metrics, in order, that reaches the best level gives the
    reason; below all limits, or with none of its metrics, it is Low. Any diverted service makes public transport High.
    """
    met = values.join(F.broadcast(limits(values.sparkSession)), ["mode", "metric"], "left")
    level = F.when(F.col("value") >= F.col("high"), 3).when(F.col("value") >= F.col("moderate"), 2).otherwise(1)
    best = F.max_by(F.struct(level.alias("level"), "metric"), F.struct(level.alias("l"), (-F.coalesce("metric_order", F.lit(99))).alias("o")))
    diverted = F.max((F.col("mode") == "public_transport") & (F.col("metric") == "forced_diversions") & (F.col("value") > 0))
    out = met.groupBy("request", "mode").agg(best.alias("b"), F.coalesce(diverted, F.lit(False)).alias("d"))
    severity = F.element_at(F.array(F.lit("Low"), F.lit("Moderate"), F.lit("High")), F.col("b.level"))
    reason = F.when(F.col("b.level") > 1, F.col("b.metric"))
    return out.select("request", "mode", F.when(F.col("d"), "High").otherwise(severity).alias("severity"), F.when(F.col("d"), "forced_diversions").otherwise(reason).alias("metric"))


def touched(mode: Column, tram: Column, moves_people: Column, closure_type: Column) -> Column:
    """Whether a plan touches a mode that its model does not cover."""
    return ((mode == "public_transport") & tram) | ((mode == "pedestrians") & moves_people) | ((mode == "trucks") & (closure_type == "road closed"))


def all_modes(requests: DataFrame, rated: DataFrame) -> DataFrame:
    """A row per request (tram, moves_people, closure_type) and mode: rated, else for review, else not modelled."""
    every = requests.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    other = F.when(touched(F.col("mode"), F.col("tram"), F.col("moves_people"), F.col("closure_type")), "Review required").otherwise("Not modelled")
    return every.join(rated, ["request", "mode"], "left").select("request", "mode", F.coalesce("severity", other).alias("severity"), "metric")


def overall(modes: DataFrame) -> DataFrame:
    """The highest rank over a request's modes, the first mode among equals; a review counts as Moderate."""
    at = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode"))
    top = modes.groupBy("request").agg(F.max_by(F.struct("mode", "severity"), F.struct(rank(F.col("severity")), -at)).alias("t"))
    return top.select("request", F.col("t.mode").alias("mode"), F.when(F.col("t.severity") == "Review required", "Moderate").otherwise(F.col("t.severity")).alias("overall"))


def footpath_check(scans: DataFrame) -> DataFrame:
    """Per site (min_clear_m per scan, null where unmeasured): conflicts and severity. Nothing measured is Moderate, not a pass."""
    worst = F.min("min_clear_m")
    n = F.count(F.when(F.col("min_clear_m") < FOOTPATH_MIN, 1))
    severity = F.when(worst.isNull(), "Moderate").when(worst < FOOTPATH_ABS_MIN, "High").when(n > 0, "Moderate").otherwise("Low")
    return scans.groupBy("site").agg(worst.alias("narrowest_m"), n.alias("n_conflicts"), severity.alias("severity"))


def first_obstacle(scans: DataFrame, obstacles: DataFrame, near: float = 1.5) -> DataFrame:
    """Of each scan the obstacle first along it that lies within `near` of its narrowest place."""
    met = scans.join(obstacles, "scan").where(F.abs(F.col("along_m") - F.col("narrowest_at_m")) <= near)
    return met.groupBy("scan").agg(F.min("along_m").alias("along_m"))


def crowding_grade(people_per_minute: Column, clear_m: Column) -> Column:
    """Grade of people a minute and metre of clear width, 0.4 m of the measured width being buffers; rounded before grading."""
    flow = F.floor(people_per_minute / (clear_m - 0.4) + 0.5)
    out = None
    for under, grade in GRADES:
        out = F.when(flow < under, grade) if out is None else out.when(flow < under, grade)
    return F.when(clear_m > 0.4, out.otherwise("E"))


def required_width(people_per_minute: Column) -> Column:
    """Width that keeps grade B+."""
    return people_per_minute / 11 + 0.4


def capacity_verdict(flow: Column, lanes: Column, lane_capacity: float = 700.0) -> Column:
    used = flow / (lanes * lane_capacity)
    return F.when(used < 0.6, "spare").when(used < 0.85, "busy").otherwise("full")


def recommendations(actions: DataFrame, most: int = 5) -> DataFrame:
    """actions (site, category, severity, position): each category's first, then the rest, by severity and position; at most `most`."""
    level = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("severity"))
    order = [level, F.col("position")]
    w = Window.partitionBy("site", "category").orderBy(*order)
    ranked = actions.withColumn("_first", (F.row_number().over(w) == 1).cast("int"))
    overall_order = Window.partitionBy("site").orderBy(F.desc("_first"), *order)
    return ranked.withColumn("id", F.row_number().over(overall_order)).where(F.col("id") <= most).drop("_first")


def beyond_noise(effect: Column, noise: Column) -> Column:
    """The effect, null unless it exceeds the variation from run to run."""
    return F.when(F.abs(effect) > noise, effect)
