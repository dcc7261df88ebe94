"""Text feeds: CSV snapshots, GeoJSON, zipped detector days, JSON tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 96
DETECTOR_DAY = "site_no long, detector long, date_local date, region string, alarm double, slots array<int>"
#: A detector-day file's columns.
SITE, DAY, DETECTOR, REGION, ALARM = "NB_SCATS_SITE", "QT_INTERVAL_COUNT", "NB_DETECTOR", "NM_REGION", "CT_ALARM_24HOUR"


def latest_snapshot(spark: SparkSession, folder: str) -> str:
    """The sub-folder of the greatest name, by whatever store the path is in."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().toString() for s in found if s.isDirectory()]
    if not names:
        raise FileNotFoundError(f"no snapshot in {folder}")
    return max(names)


def snapshot_files(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """path and content of a feed's files in every snapshot; names that only begin with the pattern (unfinished ones) stay out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with all columns as text; a byte-order mark before the first header goes."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*columns) if columns else df


def number(column: str) -> Column:
    """Double of a text, null where it is none."""
    return F.nullif(F.trim(F.col(f"`{column}`")), F.lit("")).try_cast("double")


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The signal sites: numeric key and coordinates, rows without either dropped; first known name, type and status, mean place."""
    from ..functions.geo import conic_inverse
    from ..operators.exposure import PLAUSIBLE, first_known, within

    raw = text_csv(spark, path).withColumns({"site_no": number("SITE_NO").cast("long"), "x": number("X"), "y": number("Y"), "row": F.monotonically_increasing_id()})
    raw = raw.where("site_no is not null and x is not null and y is not null")
    lat, lon = conic_inverse(F.col("x"), F.col("y"))
    placed = raw.withColumns({"site_lat": lat, "site_lon": lon}).where(within(F.col("site_lat"), F.col("site_lon"), PLAUSIBLE))
    named = placed.withColumnsRenamed({"SITE_NAME": "site_name", "SITE_TYPE": "site_type", "STATUS": "site_status"})
    return first_known(named, ["site_no"], "row", ["site_name", "site_type", "site_status"], ["site_lat", "site_lon"])


NOTICE = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("state", "updated_category", "street_name", "side_street", "end_side_street", "direction", "description")], T.StructField("from_date", T.LongType()), T.StructField("to_date", T.LongType())])


def _features(spark: SparkSession, path: str, properties: T.StructType, coordinates: T.DataType) -> DataFrame:
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", coordinates)])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", properties)])
    doc = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", "true").json(path)
    return doc.select(F.explode("features").alias("f")).select("f.*")


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Closure notices of a point GeoJSON, those without a geometry dropped."""
    f = _features(spark, path, NOTICE, T.ArrayType(T.DoubleType())).where("geometry.coordinates is not null")
    p = F.col("properties")
    return f.select(p["id"].alias("radar_id"), p["state"].alias("state"), p["updated_category"].alias("category_clean"), p["street_name"].alias("street_name"), p["side_street"].alias("side_street"), p["end_side_street"].alias("end_side_street"), p["direction"].alias("direction"), p["description"].alias("description"), p["from_date"].alias("from_ms"), p["to_date"].alias("to_ms"), F.col("geometry.coordinates")[0].alias("closure_lon"), F.col("geometry.coordinates")[1].alias("closure_lat"))


VOLUME = T.StructType([T.StructField("Road Segment ID", T.LongType()), T.StructField("Travel Direction", T.StringType()), T.StructField("Calendar Year", T.IntegerType()), T.StructField("Road Name", T.StringType()), T.StructField("Road Section Description", T.StringType()), T.StructField("Average Annual Daily Traffic Volume", T.DoubleType()), T.StructField("Average Annual Daily Heavy Vehicle Volume", T.DoubleType())])


def road_volumes(spark: SparkSession, path: str, box: tuple[float, float, float, float] = (144.5, -38.2, 145.5, -37.5)) -> DataFrame:
    """Volume segments of line and multi-line features that touch the box; lines: array of lines of [lon, lat]. Newest year first wins later."""
    from ..functions.geo import boxes_overlap

    # coordinates of either geometry type are read as text and parsed by type
    f = _features(spark, path, VOLUME, T.StringType())
    line, lines = T.ArrayType(T.ArrayType(T.DoubleType())), T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    c = F.col("geometry.coordinates")
    parsed = F.when(F.col("geometry.type") == "LineString", F.array(F.from_json(c, line))).when(F.col("geometry.type") == "MultiLineString", F.from_json(c, lines))
    p = lambda n: F.col("properties")[n]
    out = f.select(p("Road Segment ID").alias("segment_id"), p("Travel Direction").alias("direction"), p("Calendar Year").alias("year"), p("Road Name").alias("road_name"), p("Road Section Description").alias("section"), p("Average Annual Daily Traffic Volume").alias("aadt"), p("Average Annual Daily Heavy Vehicle Volume").alias("aadt_heavy"), parsed.alias("lines"))
    flat = F.flatten("lines")
    near = boxes_overlap(F.transform(flat, lambda q: q[0]), F.transform(flat, lambda q: q[1]), box)
    return out.where(F.col("segment_id").isNotNull() & F.col("lines").isNotNull()).where(near)


def _csv_rows(name: str, text: Iterator[str], wanted: set[int] | None, weekdays: bool) -> Iterator[tuple]:
    import datetime

    stamp = re.search(r"VSDATA_(\d{8})", name)
    named = datetime.datetime.strptime(stamp[1], "%Y%m%d").date() if stamp else None
    for r in csv.DictReader(text):
        try:
            site, detector = int(r[SITE]), int(r[DETECTOR])
        except (KeyError, TypeError, ValueError):
            continue
        day = named
        if day is None:
            try:
                day = datetime.date.fromisoformat((r.get(DAY) or "")[:10])
            except ValueError:
                continue
        if (wanted is not None and site not in wanted) or (weekdays and day.weekday() >= 5):
            continue
        slots = []
        for k in range(SLOTS):
            v = (r.get(f"V{k:02d}") or "").strip()
            slots.append(int(float(v)) if re.fullmatch(r"-?\d+(\.\d*)?", v) else None)
        alarm = (r.get(ALARM) or "").strip()
        yield site, detector, day, r.get(REGION), float(alarm) if re.fullmatch(r"-?\d+(\.\d*)?", alarm) else 0.0, slots


def _zip_members(name: str, content: bytes, months: set[str] | None) -> Iterator[tuple[str, bytes]]:
    """CSV members of a zip, and of zips inside it; months: labels of the month zips to read, as in january_2024."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in sorted(z.namelist()):
            low = m.lower()
            if low.endswith(".zip"):
                if months is None or any(x in low for x in months):
                    yield from _zip_members(m, z.read(m), None)
            elif low.endswith(".csv"):
                yield m, z.read(m)


def detector_days(files: DataFrame, wanted: set[int] | None = None, months: set[str] | None = None, weekdays: bool = False) -> DataFrame:
    """Detector days of zipped daily CSVs (files: path, content), filtered while reading: by site, by month zip, to weekdays.

    The same site, detector and day in a monthly and in an annual file counts once. wanted is the small set of matched sites.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.date32(), pa.string(), pa.float64(), pa.list_(pa.int32()))
        names = ["site_no", "detector", "date_local", "region", "alarm", "slots"]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if months is not None and path.lower().endswith(".zip") and not any(x in path.lower() for x in months) and re.search(r"(january|february|march|april|may|june|july|august|september|october|november|december)_\d{4}", path.lower()):
                    continue
                for name, data in _zip_members(path, content, months):
                    rows = list(_csv_rows(name, io.TextIOWrapper(io.BytesIO(data), "utf-8-sig"), wanted, weekdays))
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, DETECTOR_DAY).dropDuplicates(["site_no", "detector", "date_local"])


def valid_detector_days(days: DataFrame, strict: bool = False) -> DataFrame:
    """Without alarmed days; strict also drops days with any negative slot."""
    ok = F.coalesce("alarm", F.lit(0.0)) == 0
    return days.where(ok & ~F.exists("slots", lambda v: F.coalesce(v, F.lit(0)) < 0)) if strict else days.where(ok)


def json_table(df: DataFrame, rounding: dict[str, int] | None = None) -> DataFrame:
    """One JSON record per row as text, columns rounded as told and NaN as null; write with .write.text()."""
    out = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            clean = F.when(~F.isnan(name), F.col(name))
            out = out.withColumn(name, F.round(clean, (rounding or {}).get(name, 12)))
    return out.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_sorted_csv(df: DataFrame, path: str, *order) -> None:
    """A small report as one sorted CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_exposure(df: DataFrame, path: str) -> None:
    """The wide table, partitioned by the closure's month, zstd, row groups of about a million short rows.

    Ranges of month and closure rather than a task a month: a busy month is written by several tasks, a file each.
    """
    order = ["month", "radar_id", "site_no", "date_local"]
    ranged = df.withColumn("month", F.date_format("d_from", "yyyy-MM")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(128 << 20)).partitionBy("month").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON, one to a line, fields without a value as null."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
