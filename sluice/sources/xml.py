"""A simulator's XML files as tables, by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import run_keys

# Elements, their attributes and types.
TRIPS = "`_id` string, `_depart` double, `_duration` double, `_routeLength` double"
ROUTES = "`_id` string, `_depart` double, route struct<`_edges`: string>"
INTERVAL_EDGES = "`_begin` double, `_end` double, edge array<struct<`_id`: string, `_entered`: double, `_departed`: double, `_traveltime`: double>>"
QUEUES = "`_id` string, `_begin` double, `_maxJamLengthInMeters` double"
STEPS = "`_time` double, `_loaded` long, `_teleports` long, `_discarded` long, `_meanSpeed` double, `_meanSpeedRelative` double"
FRAMES = "`_time` double, vehicle array<struct<`_id`: string, `_x`: double, `_y`: double, `_speed`: double, `_lane`: string>>"
NODES = "`_id` long, `_lat` double, `_lon` double"
WAYS = "`_id` long, nd array<struct<`_ref`: long>>, tag array<struct<`_k`: string, `_v`: string>>"
RELATIONS = "`_id` long, member array<struct<`_type`: string, `_ref`: long, `_role`: string>>, tag array<struct<`_k`: string, `_v`: string>>"

DEMAND = "`_id` string, `_type` string, `_depart` double, `_from` string, `_to` string"
CONNECTIONS = "`_from` string, `_to` string, `_fromLane` int, `_toLane` int"
#: The passenger car of the runs, and how a vehicle enters the network.
CAR = {"id": "car", "vClass": "passenger", "length": "4.8", "minGap": "2.0", "accel": "2.6", "decel": "4.5", "sigma": "0.5", "tau": "1.0", "speedFactor": "normc(1,0.1,0.8,1.2)"}
ENTRY = {"departLane": "best", "departSpeed": "max", "departPos": "random_free"}


def elements(spark: SparkSession, path: str, tag: str, schema: str, keyed: bool = False) -> DataFrame:
    """A row per element, attributes without their mark; keyed adds scenario, hour and seed of the run's folder."""
    df = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    plain = [F.col(f"`{c}`").alias(c.lstrip("_")) for c in df.columns]
    return df.select(*plain, *(run_keys(F.col("_metadata.file_path")) if keyed else []))


def trips(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    return elements(spark, path, "tripinfo", TRIPS, keyed)


def routes(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    return elements(spark, path, "vehicle", ROUTES, keyed).withColumn("edges", F.split("route._edges", " ")).drop("route")


def edge_intervals(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """A row per edge and interval."""
    e = elements(spark, path, "interval", INTERVAL_EDGES, keyed)
    rest = [c for c in e.columns if c != "edge"]
    flat = e.select(*rest, F.explode("edge").alias("e"))
    return flat.select(*rest, *[F.col(f"e._{c}").alias(c) for c in ("id", "entered", "departed", "traveltime")])


def queues(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """Longest jam of each edge (lanes taken together) in each interval."""
    q = elements(spark, path, "interval", QUEUES, keyed).withColumn("edge", F.regexp_extract("id", r"^q_(.*)_\d+$", 1))
    keys = [c for c in ("scenario", "hour", "seed") if c in q.columns]
    return q.groupBy(*keys, "edge", "begin").agg(F.max("maxJamLengthInMeters").alias("jam_m"))


def last_step(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """Of each run the last step's counters."""
    s = elements(spark, path, "step", STEPS, keyed)
    keys = [c for c in ("scenario", "hour", "seed") if c in s.columns]
    return s.groupBy(*keys).agg(F.max_by(F.struct("time", "loaded", "teleports", "discarded"), "time").alias("s")).select(*keys, "s.*")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """A row per vehicle and second."""
    f = elements(spark, path, "timestep", FRAMES)
    return f.select("time", F.explode("vehicle").alias("v")).select("time", *[F.col(f"v._{c}").alias(c) for c in ("id", "x", "y", "speed", "lane")])


def street_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways (node refs, tags as a map) and relations (members, tags as a map)."""
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")
    ways = elements(spark, path, "way", WAYS).select("id", F.transform("nd", lambda n: n["_ref"]).alias("nodes"), tags)
    relations = elements(spark, path, "relation", RELATIONS).select("id", F.col("member").alias("members"), tags)
    return elements(spark, path, "node", NODES), ways, relations


def bus_routes_on(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Bus routes with a member among the ways."""
    m = relations.where(F.try_element_at("tags", F.lit("route")) == "bus").select(F.col("id").alias("route"), F.try_element_at("tags", F.lit("ref")).alias("ref"), F.explode("members").alias("m"))
    return m.where("m._type = 'way'").join(ways.select(F.col("id").alias("way")), F.col("m._ref") == F.col("way")).select("route", "ref", "way").distinct()


def write_counts(counts: DataFrame, path: str) -> None:
    """Edge counts as a counts file: edges inside their interval."""
    e = counts.groupBy("begin", "end").agg(F.sort_array(F.collect_list(F.struct(F.col("edge").alias("_id"), F.col("entered").alias("_entered")))).alias("edge"))
    e.select(F.col("begin").alias("_begin"), F.col("end").alias("_end"), "edge").coalesce(1).write.mode("overwrite").format("xml").option("rootTag", "data").option("rowTag", "interval").option("attributePrefix", "_").save(path)


def _write(rows: DataFrame, path: str, root: str, tag: str) -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", tag).option("attributePrefix", "_").option("declaration", "").save(path)


def _by_departure(rows: DataFrame, files: int) -> DataFrame:
    """In order of departure, then id, within the files and from file to file."""
    return rows.repartitionByRange(files, "depart", "id").sortWithinPartitions("depart", "id")


def _vehicle(kind: str) -> list:
    given = {"type": kind, **ENTRY}
    return [F.col("id").cast("string").alias("_id"), F.format_string("%.1f", F.col("depart").cast("double")).alias("_depart"), *[F.lit(v).alias(f"_{k}") for k, v in given.items()]]


def write_routes(vehicles: DataFrame, path: str, kind: str = "car", files: int = 8) -> None:
    """Vehicles (id, depart, edges) with their route inside, in up to `files` files; a simulator needs them in order of departure."""
    route = F.struct(F.array_join(F.col("edges").cast("array<string>"), " ").alias("_edges")).alias("route")
    _write(_by_departure(vehicles, files).select(*_vehicle(kind), route), path, "routes", "vehicle")


def write_trips(vehicles: DataFrame, path: str, kind: str = "car", files: int = 8) -> None:
    """Vehicles (id, depart, edges) as trips from their first to their last edge. Those without edges have no trip."""
    ends = [F.element_at(F.col("edges").cast("array<string>"), i).alias(name) for i, name in ((1, "_from"), (-1, "_to"))]
    _write(_by_departure(vehicles.where(F.size("edges") > 0), files).select(*_vehicle(kind), *ends), path, "routes", "trip")


def write_vehicle_type(spark: SparkSession, path: str, attributes: dict[str, str] | None = None) -> None:
    """The vehicles' type as a file of its own, which routes and trips in many files share."""
    row = spark.range(1).select(*[F.lit(v).alias(f"_{k}") for k, v in (attributes or CAR).items()])
    _write(row.coalesce(1), path, "additional", "vType")


def write_connections(turns: DataFrame, path: str) -> None:
    """Turn rules (kind, from_edge, to_edge, from_lane, to_lane) as changes of the network, in the folders `delete` and `connection`.

    A ban deletes all connections of its two edges, once; a hook turn moves its connection to the kerb lane (0), unless it starts
    there. Rows without edges change nothing.
    """
    known = turns.where("from_edge is not null and to_edge is not null")
    ends = [F.col("from_edge").alias("_from"), F.col("to_edge").alias("_to")]
    bans = known.where("kind = 'ban'").select(*ends, F.lit(None).cast("int").alias("_fromLane"), F.lit(None).cast("int").alias("_toLane"))
    hooks = known.where("kind = 'hook' and from_lane <> 0").select(*ends, F.col("from_lane").cast("int").alias("_fromLane"), F.col("to_lane").cast("int").alias("_toLane")).distinct()
    order = ["_from", "_to", "_fromLane", "_toLane"]
    _write(bans.unionByName(hooks).distinct().orderBy(*order), f"{path}/delete", "connections", "delete")
    _write(hooks.withColumn("_fromLane", F.lit(0)).distinct().orderBy(*order), f"{path}/connection", "connections", "connection")


def demand_trips(spark: SparkSession, path: str) -> DataFrame:
    return elements(spark, path, "trip", DEMAND)


def connections(spark: SparkSession, path: str) -> DataFrame:
    """change (delete or connection), from, to, fromLane and toLane of written connections."""
    each = [elements(spark, f"{path}/{tag}", tag, CONNECTIONS).withColumn("change", F.lit(tag)) for tag in ("delete", "connection")]
    return each[0].unionByName(each[1])
