"""Model choice, report assembly and findings as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import rating

Estimate = Callable[[DataFrame], DataFrame]


class Models:
    """Estimators by name: each takes requests (request, ...) and gives one result row per request it covers."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Estimate, Callable[[], Column]]] = {}

    def register(self, name: str, estimate: Estimate, covers: Callable[[], Column] = lambda: F.lit(True)) -> None:
        self.known[name] = (estimate, covers)

    def estimate(self, requests: DataFrame, preferred: list[str], default: str) -> DataFrame:
        """Each request by the first preferred model that covers it, else by the default; a result without the cars' part, or whose model names no method, falls back to the default with a note."""
        choice = F.lit(default)
        for name in reversed(preferred):
            choice = F.when(self.known[name][1](), name).otherwise(choice)
        chosen = requests.withColumn("model", choice)
        out = None
        for name in dict.fromkeys([*preferred, default]):
            part = self.known[name][0](chosen.where(F.col("model") == name)).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        whole = F.col("cars").isNotNull() & (F.col("method").isNotNull() if "method" in out.columns else F.lit(True))
        bad = out.where(~whole).select("request")
        again = self.known[default][0](chosen.join(bad, "request", "left_semi")).withColumns({"model": F.lit(default), "note": F.lit("the chosen model gave no result")})
        return out.where(whole).withColumn("note", F.lit(None).cast("string")).unionByName(again, allowMissingColumns=True)


#: Which point of a report a mode belongs to.
POINT = {"cars": "traffic", "trucks": "traffic", "pedestrians": "pedestrians", "public_transport": "transport"}


def points(modes: DataFrame) -> DataFrame:
    """Per request and report point the worst severity of its modes."""
    at = F.create_map(*[F.lit(x) for kv in POINT.items() for x in kv])
    order = F.array_position(F.array(*[F.lit(m) for m in rating.MODES]), F.col("mode"))
    p = modes.withColumn("point", F.element_at(at, F.col("mode")))
    return p.groupBy("request", "point").agg(F.max_by(F.struct("severity", "mode"), F.struct(rating.rank(F.col("severity")), -order)).alias("w")).select("request", "point", "w.severity", "w.mode")


def assembled(overall: DataFrame, pts: DataFrame, actions: DataFrame) -> DataFrame:
    """One record per request: overall severity, its points and its recommendations, in order, as arrays of structs."""
    p = pts.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("point", "severity", "mode"))).alias("points"))
    a = rating.recommendations(actions.withColumnRenamed("request", "site")).groupBy(F.col("site").alias("request")).agg(F.array_sort(F.collect_list(F.struct("id", "category", "title"))).alias("recommendations"))
    return overall.join(p, "request", "left").join(a, "request", "left")


def slots(base: DataFrame, overlay: DataFrame, fields: list[str]) -> DataFrame:
    """Time slots of a report: a slot's own values where it has any, else the whole report's."""
    joined = overlay.join(base.select("request", *[F.col(f).alias(f"_{f}") for f in fields]), "request")
    return joined.select("request", "slot", *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def latest_of(snapshots: list[DataFrame], key: str, order: str) -> DataFrame:
    """Over several snapshots of one feed each key's row with the greatest order."""
    out = snapshots[0]
    for s in snapshots[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key,)]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def plan_gaps(cut_off: DataFrame, bus_routes: DataFrame) -> DataFrame:
    """Findings: each node that loses its access, and each bus route on a closed way."""
    a = cut_off.select(F.lit("dead end").alias("kind"), F.col("node").cast("string").alias("what"), F.lit("no way in or out while the street is closed").alias("finding"))
    b = bus_routes.select(F.lit("bus route").alias("kind"), F.col("ref").alias("what"), F.concat(F.lit("route "), F.col("ref"), F.lit(" runs on the closed street")).alias("finding")).distinct()
    return a.unionByName(b)


def replace_source(stored: DataFrame, fresh: DataFrame, source: str = "source") -> DataFrame:
    """Delete and insert by source: the stored rows of other sources with the fresh ones."""
    return stored.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh)


def valid_enum(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def parsed_records(rows: DataFrame, json: str, schema: str, required: list[str], enums: dict[str, list[str]]) -> DataFrame:
    """rows with the columns `parsed` (fields as the schema says) and `fault`: what is missing or not allowed, null for a sound record."""
    out = rows.withColumn("parsed", F.from_json(json, f"{schema}, _unread string", {"columnNameOfCorruptRecord": "_unread"}))
    fault = F.when(F.col("parsed").isNull() | F.col("parsed._unread").isNotNull(), "not a record")
    for f in required:
        fault = fault.when(F.col(f"parsed.{f}").isNull(), f"{f} is missing")
    for f, allowed in enums.items():
        fault = fault.when(F.col(f"parsed.{f}").isNotNull() & ~valid_enum(F.col(f"parsed.{f}"), allowed), f"{f} is not allowed")
    return out.withColumn("fault", fault)


def span(low: Column, typical: Column, high: Column, unit: str) -> Column:
    """A range in words; one number when both ends are the same."""
    whole = F.format_string(f"%s to %s {unit}, typically %s", text.thousands(low), text.thousands(high), text.thousands(typical))
    return F.when(low == high, F.format_string(f"%s {unit}", text.thousands(typical))).otherwise(whole)


def car_sentence(lanes_open: Column, diversions: str, queue: str, delay: str) -> Column:
    """What drivers meet; diversions, queue and delay name structs of low, typical and high. The texts are fixed values."""
    n = lambda c, k: text.about(F.col(f"{c}.{k}"))
    closed = F.format_string("About %s vehicles must take the detour during the works (%s to %s).", *[n(diversions, k) for k in ("typical", "low", "high")])
    forced = F.format_string("About %s vehicles are forced onto other routes (%s to %s). Queues can reach %s m.", *[n(diversions, k) for k in ("typical", "low", "high")], n(queue, "high"))
    queued = F.format_string("Queues can reach %s m. Delay totals %s to %s vehicle-hours.", n(queue, "high"), n(delay, "low"), n(delay, "high"))
    none = F.lit("No queue is expected with the lanes left open.")
    return F.when(lanes_open == 0, closed).when(F.col(f"{diversions}.typical") > 0, forced).when(F.col(f"{queue}.high") > 0, queued).otherwise(none)
