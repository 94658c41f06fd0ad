"""Scans of the domain's files and the sinks that write them back.

Paths are read by Spark alone, so that any store it knows will do. Text formats with blocks of lines keep the order of
lines through Spark's metadata column of file name and block start plus an increasing id, never through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DETECTIONS = "date_time TIMESTAMP_NTZ, mac_address STRING, kind STRING, station_name STRING"


def detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Device detections, ``;`` separated; the old header's mac-address is mac_address."""
    raw = spark.read.options(sep=";", header=True).csv(path)
    if "mac-address" in raw.columns:
        raw = raw.withColumnRenamed("mac-address", "mac_address")
    kind = F.col("kind") if "kind" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.col("date_time").cast("timestamp_ntz"), "mac_address", kind.alias("kind"), "station_name")


def router_csv(spark: SparkSession, path: str) -> DataFrame:
    """Router events without repeated rows."""
    return spark.read.options(sep=";", header=True).csv(path).withColumn("occurredAt", F.col("occurredAt").cast("timestamp_ntz")).distinct()


def range_predicates(column: str, start: str, stop: str, hours: int) -> list[str]:
    """Half-open predicates, one for each chunk of hours, for a partitioned JDBC read."""
    from datetime import datetime, timedelta

    at, end, out = datetime.fromisoformat(start), datetime.fromisoformat(stop), []
    while at < end:
        to = min(at + timedelta(hours=hours), end)
        out.append(f"{column} >= '{at.isoformat(' ')}' AND {column} < '{to.isoformat(' ')}'")
        at = to
    return out


def jdbc_range(spark: SparkSession, url: str, table: str, column: str, start: str, stop: str, hours: int = 2, **options: str) -> DataFrame:
    """A time range of a database table, read in chunks side by side; credentials come with the options."""
    return spark.read.jdbc(url, table, predicates=range_predicates(column, start, stop, hours), properties=options)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, or the second where the first is empty."""
    return second if first.isEmpty() else first


def landed_pages(spark: SparkSession, path: str, schema: str, stop: str, time: str = "date_time", lines: bool = False) -> DataFrame:
    """Pages of a service's answers landed as JSON: no repeats, before ``stop``, in order.

    A page is a file, or with ``lines`` a line, so that any number of pages can lie in a file and files can be split.
    """
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).dropDuplicates()
    return rows.filter(F.col(time) < stop).orderBy(time)


def road_table(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a road file: a header line, then columns by place, separated by blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 11)
    names = ("lid", "nf", "nt", "length", "level", "type", None, None, "speed", "oneway")
    kinds = ("bigint", "bigint", "bigint", "double", "double", "int", None, None, "double", "int")
    columns = [F.get("p", F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if n]
    name = F.array_join(F.slice("p", F.lit(11), F.size("p") - 10), " ").alias("name")
    return rows.select(*columns, name).filter(F.col("lid").isNotNull())


def road_points(spark: SparkSession, path: str) -> DataFrame:
    """lid, seq, ilat, ilon of a points file: a line ``cid skip count`` heads each block of ``ilat ilon`` lines.

    Lines are numbered within their split of the file. What a split begins with belongs to the last block of the splits
    before, which a table of one row a split tells, so no task holds more than a split. Points before any head are dropped.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("p"),
    )
    split = Window.partitionBy("file", "block").orderBy("line")
    head = F.when((F.size("p") == 3) & F.col("p")[0].try_cast("bigint").isNotNull(), F.struct(F.col("p")[0].cast("bigint").alias("lid"), F.col("n")))
    lines = raw.withColumn("n", F.row_number().over(split)).withColumn("head", F.last(head, ignorenulls=True).over(split))
    # One row a split: the last block that begins in it, and its lines after that or all of them.
    ends = lines.groupBy("file", "block").agg(F.max("n").alias("lines"), F.max_by("head", F.col("head.n")).alias("head"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("total", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    placed = F.when(F.col("head").isNotNull(), F.struct(F.col("head.lid"), (F.col("total") + F.col("head.n")).alias("n")))
    ends = ends.select("file", "block", "total", F.last(placed, ignorenulls=True).over(before).alias("carried"))
    points = lines.filter(F.size("p") == 2).join(ends, ["file", "block"])
    at = F.col("total") + F.col("n")
    own = F.when(F.col("head").isNotNull(), F.struct(F.col("head.lid"), (F.col("total") + F.col("head.n")).alias("n")))
    placed = points.select("p", at.alias("at"), F.coalesce(own, F.col("carried")).alias("of")).filter(F.col("of").isNotNull())
    return placed.select(
        F.col("of.lid").alias("lid"), (F.col("at") - F.col("of.n") - 1).alias("seq"), F.col("p")[0].cast("int").alias("ilat"), F.col("p")[1].cast("int").alias("ilon")
    )


def edge_counts(spark: SparkSession, path: str) -> DataFrame:
    """lid, cid and counts both ways; 0 counts as 1."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(p.alias("p")).filter(F.size("p") >= 4)
    one = lambda i: F.when(F.col("p")[i].cast("bigint") == 0, 1).otherwise(F.col("p")[i].cast("bigint"))
    return rows.select(F.col("p")[0].cast("bigint").alias("lid"), F.col("p")[1].cast("bigint").alias("cid"), one(2).alias("cnt_ft"), one(3).alias("cnt_tf"))


def forbidden_turns(spark: SparkSession, path: str) -> DataFrame:
    """lid and the edges that may not follow it."""
    rows = spark.read.options(sep=";").schema("lid BIGINT, after BIGINT").csv(path)
    return rows.filter("lid IS NOT NULL").groupBy("lid").agg(F.array_sort(F.collect_set("after")).alias("after"))


def patched_oneway(edges: DataFrame, patch: DataFrame) -> DataFrame:
    """edges with the oneway of patch (lid, oneway) where it has one."""
    return edges.join(patch.withColumnRenamed("oneway", "_new"), "lid", "left").withColumn("oneway", F.coalesce("_new", "oneway")).drop("_new")


def barriers(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """tag, lat, lon; one of each tag up to its last underscore; only allowed tags, if given (tag)."""
    rows = spark.read.options(sep=";").schema("tag STRING, lat DOUBLE, lon DOUBLE").csv(path).filter("lat IS NOT NULL")
    rows = rows.withColumn("base", F.regexp_replace("tag", "_[^_]*$", ""))
    once = rows.groupBy("base").agg(F.min(F.struct("tag", "lat", "lon")).alias("first")).select("first.*", "base")
    return once if allowed is None else once.join(allowed.select("tag"), "tag", "left_semi")


def polygons(spark: SparkSession, path: str, bbox: Sequence[float] | None = None, lines: bool = False) -> DataFrame:
    """uid, ring (array of x, y) of GeoJSON polygons; of several rings or parts the first is the outline.

    A file is one collection, read whole, or with ``lines`` a feature a line, as ``features`` writes them, read in splits.
    """
    raw = spark.read.text(path, wholetext=not lines)
    shape = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    if lines:
        parsed = raw.select(F.from_json("value", shape).alias("f"))
    else:
        parsed = raw.select(F.explode(F.from_json("value", f"features array<{shape}>")["features"]).alias("f"))
    coords = F.when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")[0][0]
    ).otherwise(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0])
    uid = F.coalesce(F.try_element_at("f.properties", F.lit("uid")), F.try_element_at("f.properties", F.lit("PK_UID"))).cast("bigint")
    rows = parsed.select(uid.alias("uid"), F.transform(coords, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"))
    if bbox is None:
        return rows
    n = F.size("ring")
    cx, cy = (F.aggregate(F.col("ring")[k], F.lit(0.0), lambda a, v: a + v) / n for k in ("x", "y"))
    return rows.filter(cx.between(bbox[0], bbox[2]) & cy.between(bbox[1], bbox[3]))


def transit_legs(spark: SparkSession, path: str) -> DataFrame:
    """trip, route and each leg's stops and times, from rows of ``;`` separated pairs of any number."""
    p = F.split("value", ";")
    rows = spark.read.text(path).select(p[1].alias("trip"), p[2].alias("route"), F.slice(p, F.lit(4), F.size(p)).alias("rest"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("rest") / 2).cast("int") - 1),
        lambda i: F.struct(F.get("rest", i * 2).alias("stop"), F.get("rest", i * 2 + 1).cast("bigint").alias("at")),
    )
    stops = rows.filter(F.size("rest") >= 2).select("trip", "route", F.posexplode(pairs).alias("seq", "s"))
    ahead = F.lead("s").over(Window.partitionBy("trip", "route").orderBy("seq"))
    legs = stops.withColumn("next", ahead).filter(F.col("next").isNotNull())
    return legs.select("trip", "route", "seq", F.col("s.stop").alias("from"), F.col("next.stop").alias("to"), F.col("s.at").alias("leaves"), F.col("next.at").alias("arrives"))


def placemarks(spark: SparkSession, path: str, roles: dict[str, str], lines: bool = False) -> DataFrame:
    """name, lon, lat, role of KML placemarks; the role by the first pattern that the description matches.

    A file is one document, streamed through one task, or with ``lines`` a placemark a line, read in splits.
    """
    rows = spark.read.format("xml").options(rowTag="Placemark", multiLine=not lines).schema("name STRING, description STRING, Point STRUCT<coordinates: STRING>").load(path)
    role = F.lit(None).cast("string")
    for pattern, name in reversed(list(roles.items())):
        role = F.when(F.col("description").rlike(pattern), name).otherwise(role)
    c = F.split(F.trim("Point.coordinates"), ",")
    return rows.select("name", c[0].cast("double").alias("lon"), c[1].cast("double").alias("lat"), role.alias("role"))


def line_protocol(spark: SparkSession, path: str) -> DataFrame:
    """id, cnt, t (seconds) of measurement lines; zero counts are dropped."""
    get = lambda pattern, i=1: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).select(
        get(r"id=([^ ,]+)").cast("bigint").alias("id"), get(r"cnt=(\d+)").cast("bigint").alias("cnt"),
        F.floor(get(r" (\d+)\s*$").cast("bigint") / 1_000_000_000).alias("t"),
    )
    return rows.filter("cnt <> 0")


def cell_answers(rows: DataFrame, column: str = "value") -> DataFrame:
    """t, cell, cnt of nested maps ``{t: {cell: cnt}}``."""
    outer = rows.select(F.explode(F.from_json(column, "map<string,map<string,int>>")).alias("t", "cells"))
    return outer.select(F.col("t").cast("bigint").alias("t"), F.explode("cells").alias("cell", "cnt"))


#: Columns of a road usage table, by place. Fixed values.
USAGE_COLUMNS = "cid BIGINT, lid BIGINT, nf_cid BIGINT, nt_cid BIGINT, cnt_ft BIGINT, cnt_tf BIGINT, cnt BIGINT, length DOUBLE"


def edge_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage of each edge; the header is skipped, whatever it says, and blanks around numbers don't count."""
    options = {"sep": ";", "header": True, "enforceSchema": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    return spark.read.options(**options).schema(USAGE_COLUMNS).csv(path)


def with_usage(edges: DataFrame, usage: DataFrame) -> DataFrame:
    """edges with their total count as ``used``, 1 where the table has none; of repeated rows the largest counts."""
    totals = usage.groupBy("lid").agg(F.max("cnt").alias("used"))
    return edges.join(totals, "lid", "left").na.fill(1, ["used"])


def randomised_counts(rows: DataFrame, hours: int = 1) -> DataFrame:
    """Counts stamped in unix seconds, shifted by a fixed number of hours."""
    return rows.withColumn("date_time", F.timestamp_seconds(F.col("t") + hours * 3600))


def documents_pipeline(rows: DataFrame) -> DataFrame:
    """Documents with an array of key and value pairs turned to one map each: match, unwind, project, group."""
    pairs = F.map_from_entries(F.transform("tags", lambda t: F.struct(t["k"], t["v"])))
    return rows.filter(F.size("tags") > 0).select("id", pairs.alias("tags"), F.explode(F.transform("tags", lambda t: t["k"])).alias("key"))


#: Times keep their microseconds in text files; Spark's own default keeps milliseconds.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep=";", header=True, timestampNTZFormat=_MICROS, timestampFormat=_MICROS + "[XXX]").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(timestampNTZFormat=_MICROS, timestampFormat=_MICROS + "[XXX]").json(path)


def features(df: DataFrame, geometry: str, coordinates: Column, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    shape = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(shape).alias("value"))


def edge_features(points: DataFrame) -> DataFrame:
    """Lines of polylines (lid, seq, x, y)."""
    lines = points.groupBy("lid").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))
    return features(lines, "LineString", F.transform("points", lambda p: F.array(p["x"], p["y"])), ["lid"])


def cell_features(cells: DataFrame, low_x: float, low_y: float, side: float) -> DataFrame:
    """Squares of grid cells (row, col, cnt)."""
    x, y = low_x + F.col("col") * side, low_y + F.col("row") * side
    ring = F.array(*(F.array(a, b) for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))))
    return features(cells, "Polygon", F.array(ring), ["row", "col", "cnt"])
