"""Round trips of the domain's files: rows of the tables are written in a file's layout and come back through its reader.

Files go to a new folder below spark.checkpoint.dir, written and read by Spark's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.scratch import shared_folder
from footfall.sources import files
from footfall.sources.tables import detections, table
from footfall.streaming import ingest, progress

#: The month of the events, in chunks of a day.
_START, _STOP = "2024-01-01", "2024-02-01"


def _lines(df: DataFrame, *lines: Column) -> str:
    """The folder of text files to which each row's lines went."""
    path = shared_folder(df.sparkSession, "files")
    df.select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    return path


def _joined(sep: str, *columns: str | Column) -> Column:
    return F.concat_ws(sep, *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def detections_scan(spark, d):
    """Detections through the CSV sink, under the old name of the address column, and back."""
    path = shared_folder(spark, "files")
    rows = detections(spark, d).select("date_time", F.col("mac_address").alias("mac-address"), F.lit("wifi").alias("kind"), "station_name")
    files.write_csv(rows, path)
    return files.detections_csv(spark, path)


def router_scan(spark, d):
    """Router events, each written twice, come back once."""
    path = shared_folder(spark, "files")
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("occurredAt"), F.col("event_type").alias("router"))
    files.write_csv(e.unionByName(e), path)
    return files.router_csv(spark, path).withColumn("event_id", F.col("event_id").cast("bigint"))


def range_chunks(spark, d):
    """Events by the chunk of a partitioned range read that fetches them: each in one chunk, bounds included once."""
    chunk = F.coalesce(*(F.when(F.expr(p), i) for i, p in enumerate(files.range_predicates("ts", _START, _STOP, 24))))
    return table(spark, d, "events").groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("cnt")).filter("chunk IS NOT NULL")


def fallback_scan(spark, d):
    """The detections of a station by its number in parentheses, or, as no name has one, those by its plain name."""
    rows = detections(spark, d)
    out = files.with_fallback(rows.filter(F.col("station_name").like("%(1)")), rows.filter("station_name = 'view'"))
    return out.select("event_id", "station_name")


def found_stations(spark, d):
    """A document store's find and distinct: JSON documents filtered by range and list, projected, each station once."""
    path = shared_folder(spark, "files")
    files.write_json(detections(spark, d).select("event_id", "date_time", "station_name", "value"), path)
    rows = spark.read.schema("date_time TIMESTAMP_NTZ, station_name STRING, value DOUBLE").json(path)
    return rows.filter((F.col("value") >= 10) & (F.col("value") < 60) & (F.col("date_time") >= _START)).select("station_name").distinct()


def tagged_documents(spark, d):
    """Documents with tags as pairs: matched, made maps, unwound and projected."""
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), F.col(v).alias("v"))
    tags = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<struct<k:string,v:string>>")).otherwise(
        F.array(pair("status", "o_orderstatus"), pair("priority", "o_orderpriority"))
    )
    out = files.documents_pipeline(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tags.alias("tags")))
    return out.select("id", "key", F.try_element_at("tags", F.col("key")).alias("value"))


def page_scan(spark, d):
    """Answers of a service in pages of one day, one a line and all landed twice: no repeats, none past the stop."""
    row = F.struct(F.col("event_id"), F.col("ts").cast("string").alias("date_time"), F.col("event_type").alias("station_name"))
    # A page holds some thousandth of a day at most, so that a busy day is many pages.
    pages = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), (F.col("event_id") % 1000).alias("page")).agg(F.collect_list(row).alias("rows"))
    path = _lines(pages, F.to_json("rows"), F.to_json("rows"))
    return files.landed_pages(spark, path, "event_id BIGINT, date_time STRING, station_name STRING", "2024-01-20", lines=True)


def hour_shift(spark, d):
    """Counts by unix second come back an hour later."""
    rows = table(spark, d, "events").groupBy(F.unix_seconds(F.date_trunc("hour", F.col("ts")).cast("timestamp")).alias("t")).agg(F.count(F.lit(1)).alias("cnt"))
    return files.randomised_counts(rows).select("t", F.unix_seconds("date_time").alias("shifted"), "cnt")


def road_scan(spark, d):
    """Orders as edges of a road file, with a heading and names of one to three words."""
    o = table(spark, d, "orders").select(
        _joined(" ", "o_orderkey", "o_custkey", F.col("o_custkey") + 1, F.col("o_totalprice").cast("decimal(20,2)"), F.lit("0.0"), F.lit(1), F.lit(0), F.lit("x"), F.lit(50), F.lit(0), "o_orderpriority").alias("line")
    )
    out = files.road_table(spark, _lines(o.unionByName(spark.createDataFrame([("cid nF nT length lvl type a b speed ow name",)], "line string")), F.col("line")))
    return out.select("lid", "nf", "nt", F.round("length", 2).alias("length"), "type", "speed", "oneway", "name")


def road_points(spark, d):
    """Each order's lines as the points of an edge, in blocks of a heading and its points."""
    # Dealt by order once, for both steps.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    p = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"))
    blocks = p.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y"))).alias("p"))
    points = F.array_join(F.transform("p", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), "\n")
    return files.road_points(spark, _lines(blocks, _joined(" ", "l_orderkey", F.lit(0), F.size("p")), points))


def counter_scan(spark, d):
    """Edge counters, 0 counting as 1."""
    o = table(spark, d, "orders")
    line = _joined(" ", "o_orderkey", "o_custkey", F.col("o_orderkey") % 5, F.col("o_custkey") % 3)
    return files.edge_counts(spark, _lines(o, F.lit("# lid cid FT TF"), line))


def usage_scan(spark, d):
    """Orders with the usage that a table of their lines gives them, 1 where it has none."""
    back, items = F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1))
    u = table(spark, d, "lineitem").groupBy("l_orderkey").agg(back.alias("r"), items.alias("n"), F.sum("l_quantity").alias("q"))
    path = shared_folder(spark, "files")
    key = F.col("l_orderkey")
    files.write_csv(u.select(key.alias("cid"), key.alias("lid"), key.alias("nf"), (key + 1).alias("nt"), "r", (F.col("n") - F.col("r")).alias("o"), "n", "q"), path)
    return files.with_usage(table(spark, d, "orders").select(F.col("o_orderkey").alias("lid")), files.edge_usage(spark, path))


def turn_scan(spark, d):
    """For each order the parts that follow it, as a file of forbidden turns lists them."""
    out = files.forbidden_turns(spark, _lines(table(spark, d, "lineitem"), _joined(";", "l_orderkey", "l_partkey")))
    return out.select("lid", F.array_join(F.transform("after", lambda a: a.cast("string")), ",").alias("after"))


def oneway_patch(spark, d):
    """Orders as edges, those that are done closed one way by a patch file."""
    o = table(spark, d, "orders")
    path = _lines(o.filter("o_orderstatus = 'F'"), _joined(";", "o_orderkey", F.lit(1)))
    patch = spark.read.options(sep=";").schema("lid BIGINT, oneway INT").csv(path)
    edges = o.select(F.col("o_orderkey").alias("lid"), (F.col("o_custkey") % 2 * 2).cast("int").alias("oneway"))
    return files.patched_oneway(edges, patch)


def barrier_scan(spark, d):
    """Barriers by segment and customer: one of each segment and nation, if it is on the list of those with a balance."""
    c = table(spark, d, "customer").withColumn("tag", _joined("_", "c_mktsegment", "c_nationkey", F.lpad(F.col("c_custkey").cast("string"), 12, "0")))
    path = _lines(c, _joined(";", "tag", F.col("c_nationkey") + 0.5, F.col("c_nationkey") + 0.25))
    return files.barriers(spark, path, c.filter("c_acctbal > 0").select("tag"))


def polygon_scan(spark, d):
    """Squares of the parts as GeoJSON features, a line each; those around a place within the box."""
    x, y, side = F.col("p_partkey").cast("double"), F.col("p_size").cast("double"), F.lit(2.0)
    ring = F.array(*(F.array(a, b) for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side))))
    shapes = files.features(table(spark, d, "part").withColumn("uid", F.col("p_partkey")), "Polygon", F.array(ring), ["uid"])
    out = files.polygons(spark, _lines(shapes, F.col("value")), (0.0, 5.0, 1e12, 30.0), lines=True)
    return out.select("uid", F.size("ring").alias("corners"), F.col("ring")[2]["x"].alias("x2"), F.col("ring")[2]["y"].alias("y2"))


def leg_scan(spark, d):
    """Each order's lines as the stops of a trip, in one row of any number of pairs, and the legs between them."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("stop"))
    trips = s.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "stop"))).alias("p"))
    pairs = F.array_join(F.transform("p", lambda q: F.concat_ws(";", q["stop"].cast("string"), (q["l_linenumber"] * 60).cast("string"))), ";")
    out = files.transit_legs(spark, _lines(trips, _joined(";", F.lit("x"), "l_orderkey", F.lit("r"), pairs)))
    return out.withColumn("trip", F.col("trip").cast("bigint"))


def placemark_scan(spark, d):
    """Customers as placemarks, with the role that the first matching pattern gives them."""
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    place = tag("Point", tag("coordinates", _joined(",", F.col("c_custkey") + 0.5, "c_nationkey", F.lit(0))))
    mark = tag("Placemark", tag("name", F.col("c_name")), tag("description", F.col("c_mktsegment")), place)
    path = _lines(table(spark, d, "customer"), mark)
    return files.placemarks(spark, path, {"^BUILD": "home", "E$": "work", "^MACH": "work"}, lines=True)


def protocol_scan(spark, d):
    """Errors by user and hour as lines of measurements; hours without any are written, and dropped on reading."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts")).cast("timestamp")).alias("t")
    c = table(spark, d, "events").groupBy("user_id", hour).agg(F.count_if(F.col("event_type") == "error").alias("cnt"))
    line = F.concat(F.lit("gridstate,id="), F.col("user_id").cast("string"), F.lit(" cnt="), F.col("cnt").cast("string"), F.lit(" "), (F.col("t") * 1_000_000_000).cast("string"))
    return files.line_protocol(spark, _lines(c, line))


def cell_shapes(spark, d):
    """Events by hour and user cell as squares of GeoJSON, read back by their corners."""
    c = table(spark, d, "events").groupBy(F.hour("ts").alias("row"), (F.col("user_id") % 16).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("cnt"))
    shapes = spark.read.text(_lines(files.cell_features(c, 10.0, 40.0, 0.5), F.col("value")))
    get = lambda p, kind: F.get_json_object("value", f"$.{p}").cast(kind)
    return shapes.select(
        get("properties.row", "int").alias("row"), get("properties.col", "int").alias("col"), get("properties.cnt", "bigint").alias("cnt"),
        get("geometry.coordinates[0][2][0]", "double").alias("x"), get("geometry.coordinates[0][2][1]", "double").alias("y"),
    )


def barrier_files(spark, d):
    """A camera's nested counters, one document an hour, unfolded and given the ids of their barriers and ways."""
    way = F.when(F.col("value") > 50, "out").otherwise("in")
    c = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("barrier"), way.alias("way")).agg(F.count(F.lit(1)).cast("int").alias("cnt"))
    ways = c.groupBy("h", "barrier").agg(F.map_from_entries(F.collect_list(F.struct("way", "cnt"))).alias("ways"))
    docs = ways.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("barrier", "ways"))).alias("counter"))
    path = shared_folder(spark, "files")
    files.write_json(docs.select(F.lit("cam").alias("cam_name"), F.unix_seconds(F.col("h").cast("timestamp")).alias("timestamp"), F.col("h").cast("string").alias("datetime"), "counter"), path)
    meta = c.select(F.lit("cam").alias("cam_name"), "barrier", F.col("way").alias("direction")).distinct().withColumn("uid", F.concat_ws(":", "barrier", "direction"))
    return ingest.barrier_rows(spark.read.schema(ingest.BARRIER_FILE).json(path), meta)


def stream_fan_out(spark, d):
    """The stream of events dealt to two stores by their value, each read back and counted."""
    at = shared_folder(spark, "stream")
    stores = {f"{at}/low": "value < 50", f"{at}/high": "value >= 50"}
    schema = table(spark, d, "events").schema
    ingest.fan_out(ingest.table_stream(spark, d, "events"), stores, f"{at}/state").awaitTermination()
    low, high = (spark.read.schema(schema).parquet(p).withColumn("store", F.lit(p.rsplit("/", 1)[1])) for p in stores)
    return low.unionByName(high).groupBy("store", "event_type").agg(F.count(F.lit(1)).alias("cnt"))


#: Steps of an hour, runs that end after six quiet ones, ten minutes for late rows.
_STEP, _IDLE, _LATE = 3_600_000, 6, 600_000


def progress_snapshots(spark, d):
    """Hourly progress of each type's events as the stream tells it by timers, up to its last watermark."""
    at = shared_folder(spark, "stream")
    stream = ingest.table_stream(spark, d, "events")
    progress.progress_stream(stream, "event_type", "ts", _STEP, _IDLE, f"{_LATE} milliseconds", f"{at}/told", f"{at}/state").awaitTermination()
    return spark.read.schema("key STRING, step BIGINT, cnt BIGINT, fresh BIGINT").parquet(f"{at}/told")


_ITEMS = "p AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS x, min(l_suppkey) AS y FROM lineitem GROUP BY ALL)"

SQL = {
    "detections_scan": "SELECT ts AS date_time, CAST(user_id AS VARCHAR) AS mac_address, 'wifi' AS kind, event_type AS station_name FROM events",
    "router_scan": "SELECT DISTINCT event_id, ts AS \"occurredAt\", event_type AS router FROM events",
    "range_chunks": f"SELECT CAST(date_diff('day', TIMESTAMP '{_START}', ts) AS INTEGER) AS chunk, count(*) AS cnt FROM events WHERE ts >= '{_START}' AND ts < '{_STOP}' GROUP BY 1",
    "fallback_scan": "SELECT event_id, event_type AS station_name FROM events WHERE event_type = 'view'",
    "found_stations": f"SELECT DISTINCT event_type AS station_name FROM events WHERE value >= 10 AND value < 60 AND ts >= '{_START}'",
    "tagged_documents": "SELECT o_orderkey AS id, 'status' AS key, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders WHERE o_orderstatus <> 'F'",
    "page_scan": "SELECT event_id, CAST(ts AS VARCHAR) AS date_time, event_type AS station_name FROM events WHERE ts < '2024-01-20'",
    "hour_shift": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 3600 AS shifted, count(*) AS cnt FROM events GROUP BY 1, 2",
    "road_scan": "SELECT o_orderkey AS lid, o_custkey AS nf, o_custkey + 1 AS nt, round(o_totalprice, 2) AS length, CAST(1 AS INTEGER) AS type, CAST(50 AS DOUBLE) AS speed, CAST(0 AS INTEGER) AS oneway, o_orderpriority AS name FROM orders",
    "road_points": f"WITH {_ITEMS} SELECT l_orderkey AS lid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq, CAST(x AS INTEGER) AS ilat, CAST(y AS INTEGER) AS ilon FROM p",
    "counter_scan": "SELECT o_orderkey AS lid, o_custkey AS cid, greatest(o_orderkey % 5, 1) AS cnt_ft, greatest(o_custkey % 3, 1) AS cnt_tf FROM orders",
    "usage_scan": "SELECT o_orderkey AS lid, coalesce(n, 1) AS used FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "turn_scan": "SELECT l_orderkey AS lid, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS after FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "oneway_patch": "SELECT o_orderkey AS lid, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE o_custkey % 2 * 2 END AS INTEGER) AS oneway FROM orders",
    "barrier_scan": """WITH t AS (SELECT c_mktsegment || '_' || c_nationkey AS base, c_nationkey AS n, c_acctbal AS a, c_mktsegment || '_' || c_nationkey || '_' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS tag FROM customer),
f AS (SELECT base, min(tag) AS tag, arg_min(n, tag) AS n, arg_min(a, tag) AS a FROM t GROUP BY 1) SELECT tag, CAST(n AS DOUBLE) + 0.5 AS lat, CAST(n AS DOUBLE) + 0.25 AS lon, base FROM f WHERE a > 0""",
    "polygon_scan": "SELECT p_partkey AS uid, CAST(4 AS INTEGER) AS corners, CAST(p_partkey AS DOUBLE) + 2 AS x2, CAST(p_size AS DOUBLE) + 2 AS y2 FROM part WHERE p_size + 1 BETWEEN 5 AND 30",
    "leg_scan": f"""WITH {_ITEMS}, s AS (SELECT l_orderkey AS trip, x, l_linenumber * 60 AS m, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, lead(x) OVER w AS nx, lead(l_linenumber * 60) OVER w AS nat FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT trip, 'r' AS route, seq, CAST(x AS VARCHAR) AS "from", CAST(nx AS VARCHAR) AS "to", CAST(m AS BIGINT) AS leaves, CAST(nat AS BIGINT) AS arrives FROM s WHERE nx IS NOT NULL""",
    "placemark_scan": "SELECT c_name AS name, CAST(c_custkey AS DOUBLE) + 0.5 AS lon, CAST(c_nationkey AS DOUBLE) AS lat, CASE WHEN c_mktsegment LIKE 'BUILD%' THEN 'home' WHEN c_mktsegment LIKE '%E' OR c_mktsegment LIKE 'MACH%' THEN 'work' END AS role FROM customer",
    "protocol_scan": "SELECT user_id AS id, count(*) AS cnt, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error' GROUP BY 1, 3",
    "cell_shapes": "SELECT CAST(hour(ts) AS INTEGER) AS \"row\", CAST(user_id % 16 AS INTEGER) AS col, count(*) AS cnt, 10.5 + CAST(user_id % 16 AS INTEGER) * 0.5::DOUBLE AS x, 40.5 + CAST(hour(ts) AS INTEGER) * 0.5::DOUBLE AS y FROM events GROUP BY ALL",
    "barrier_files": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS timestamp, event_type || ':' || CASE WHEN value > 50 THEN 'out' ELSE 'in' END AS uid, CAST(count(*) AS INTEGER) AS counter FROM events GROUP BY 1, 2",
    "stream_fan_out": "SELECT CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS store, event_type, count(*) AS cnt FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
    "progress_snapshots": f"""WITH s AS (SELECT event_type AS key, epoch_ms(ts) // {_STEP} AS step, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
b AS (SELECT *, CASE WHEN step - lag(step) OVER w <= {_IDLE} THEN 0 ELSE 1 END AS begins, lead(step) OVER w AS nx FROM s WINDOW w AS (PARTITION BY key ORDER BY step)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY step) AS run FROM b), c AS (SELECT *, sum(n) OVER (PARTITION BY key, run ORDER BY step) AS cnt FROM r),
t AS (SELECT key, unnest(range(step, least(step + {_IDLE}, coalesce(nx - 1, step + {_IDLE})) + 1)) AS told, step, CAST(cnt AS BIGINT) AS cnt, n FROM c)
SELECT key, told AS step, cnt, CASE WHEN told = step THEN n ELSE 0 END AS fresh FROM t WHERE (told + 1) * {_STEP} <= (SELECT epoch_ms(max(ts)) - {_LATE} FROM events)""",
}

QUERIES = {name: globals()[name] for name in SQL}
