"""The star schema's tables in the roles of road-closure entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closures of 0 to 8 days."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("radar_id"), F.col("o_custkey").alias("cust"), day.alias("d_from"), F.date_add(day, F.pmod("o_orderkey", F.lit(9)).cast("int")).alias("d_to"), F.col("o_orderpriority").alias("closure_type"), F.col("o_orderstatus").alias("work_window"), (F.pmod("o_custkey", F.lit(7)) + 1).cast("int").alias("site_no"), "o_totalprice")


CLOSURES = "closures AS (SELECT o_orderkey AS radar_id, o_custkey AS cust, CAST(o_orderdate AS DATE) AS d_from, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS d_to, o_orderpriority AS closure_type, o_orderstatus AS work_window, CAST(o_custkey % 7 + 1 AS INTEGER) AS site_no, o_totalprice FROM orders)"


def site_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly volumes of a site (their type), with how many detectors (users) counted."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("site"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("volume"), F.countDistinct("user_id").alias("n_detectors"), F.count("*").alias("n_rows"))


SITE_HOURS = "site_hours AS (SELECT event_type AS site, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS volume, count(DISTINCT user_id) AS n_detectors, count(*) AS n_rows FROM events GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as daily volumes of a site (their line number)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("site_no"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("volume"))


DAILY = "daily AS (SELECT CAST(l_linenumber AS INTEGER) AS site_no, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings' first components as a cloud of points within some metres, their label the scan."""
    v = lambda k: F.round(F.col("embedding")[k].cast("double") * 10, 4)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("scan"), F.col("vec_id").alias("pid"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))


POINTS = "points AS (SELECT CAST(label AS INTEGER) AS scan, vec_id AS pid, round(CAST(embedding[1] AS DOUBLE) * 10, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 4) AS y, round(CAST(embedding[3] AS DOUBLE) * 10, 4) AS z FROM embeddings)"
