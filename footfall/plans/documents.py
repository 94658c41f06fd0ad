"""Queries over nested documents, features, streams and fitted series."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import clusters, documents, forecast, learning, patches, series
from footfall.scratch import shared_folder
from footfall.sources import files
from footfall.sources.tables import table
from footfall.streaming import ingest


def _talks(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    return turns.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("t").alias("turns"))).alias("doc"))


def json_paths(spark, d):
    """Child, index, negative index, wildcard, slice, filter and length over a nested array."""
    t = _talks(spark, d).withColumn("turns", F.from_json(F.get_json_object("doc", "$.turns"), "array<struct<turn:bigint,role:string,n:int>>"))
    return t.select(
        "conv_id", F.get_json_object("doc", "$.id").cast("bigint").alias("id"), F.get_json_object("doc", "$.turns[0].role").alias("first"),
        F.element_at("turns", -1)["role"].alias("last"), F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("roles"),
        F.array_join(F.transform(F.slice("turns", 2, 2), lambda x: x["turn"].cast("string")), ",").alias("slice"),
        F.size(F.filter("turns", lambda x: (x["role"] == "user") & (x["n"] > 200))).alias("long_users"),
        F.array_max(F.transform("turns", lambda x: x["n"])).alias("longest"),
        documents.at_pointer("doc", "/turns/0/turn").cast("bigint").alias("pointer"), documents.has_pointer("doc", "/turns/3").alias("has4"),
        F.get_json_object("doc", "$.turns[*].turn").alias("wild"),
    )


def json_slices(spark, d):
    """Slices with a step, backwards and from the end, and a union of places."""
    turns = F.transform(F.from_json(F.get_json_object("doc", "$.turns"), "array<struct<turn:bigint>>"), lambda x: x["turn"].cast("string"))
    t = _talks(spark, d).select("conv_id", turns.alias("t"))
    cuts = {"even": documents.sliced("t", step=2), "back": documents.sliced("t", step=-1), "tail": documents.sliced("t", -2), "mid": documents.sliced("t", 1, -1), "ends": documents.picked("t", 0, -1)}
    return t.select("conv_id", *(F.array_join(c, ",").alias(n) for n, c in cuts.items()))


def json_descendants(spark, d):
    """All members named n, at any depth of the talk."""
    out = documents.descendants(_talks(spark, d), "doc", "n")
    return out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col("value").cast("bigint")).alias("total"))


def json_map_explode(spark, d):
    inner = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).alias("cell")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    maps = inner.groupBy(F.length("event_type").cast("string").alias("t"), "cell").agg(F.sum("n").cast("int").alias("n"))
    nested = maps.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("string"), "n"))).alias("cells"))
    text = nested.select(F.to_json(F.map_from_arrays(F.array("t"), F.array("cells"))).alias("value"))
    return files.cell_answers(text)


def json_patch(spark, d):
    """Three kinds of patches on flat documents; a failing test leaves null."""
    ops = F.when(F.col("n_nationkey") % 3 == 0, F.expr("array(named_struct('op','add','path','/x','from',null,'value','1'), named_struct('op','move','path','/y','from','/x','value',null))")).when(
        F.col("n_nationkey") % 3 == 1, F.expr("array(named_struct('op','remove','path','/region','from',null,'value',null), named_struct('op','copy','path','/z','from','/name','value',null))")
    ).otherwise(F.expr("array(named_struct('op','test','path','/region','from',null,'value','1'), named_struct('op','replace','path','/name','from',null,'value','q'))"))
    types = "array<struct<op:string,path:string,from:string,value:string>>"
    doc = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    rows = table(spark, d, "nation").select("n_nationkey", doc.alias("doc"), ops.cast(types).alias("ops"))
    out = rows.withColumn("new", documents.patched(F.col("doc"), F.col("ops")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("new")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("n_nationkey", text.alias("patched"), F.size(documents.differences(F.col("doc"), F.col("new"))).alias("changes"))


def json_edits(spark, d):
    """Each talk with a turn put first, its last one removed, its id replaced and a value copied; a failing test leaves null.

    back: whether the differences to the old talk, applied to the new one, give it back.
    """
    last = F.size(F.from_json(F.get_json_object("doc", "$.turns"), "array<string>")).cast("string")
    ops = F.concat(
        F.lit('[{"op":"add","path":"/turns/0","value":{"turn":-1,"role":"system","n":0}},{"op":"remove","path":"/turns/'), last,
        F.lit('"},{"op":"replace","path":"/id","value":"c'), F.col("conv_id").cast("string"), F.lit('"},{"op":"copy","from":"/turns/0/role","path":"/first"}'),
        F.when(F.col("conv_id") % 3 == 0, ',{"op":"test","path":"/turns/0/role","value":"user"}').otherwise(""), F.lit("]"),
    )
    new = _talks(spark, d).withColumn("patched", patches.patched(F.col("doc"), ops))
    back = patches.patched(F.col("patched"), patches.differences(F.col("patched"), F.col("doc")))
    return new.select("conv_id", "patched", (back == F.col("doc")).alias("back"))


def replaced_member(spark, d):
    """Every turn's length replaced, wherever it is."""
    return _talks(spark, d).select("conv_id", patches.replaced_at(F.col("doc"), ("turns", None, "n"), F.lit("0")).alias("doc"))


def renamed_member(spark, d):
    """Every turn's role under another name."""
    return _talks(spark, d).select("conv_id", patches.renamed_at(F.col("doc"), ("turns", None, "role"), "who").alias("doc"))


def csv_roundtrip(spark, d):
    rows = table(spark, d, "nation").select(F.to_csv(F.struct("n_nationkey", "n_name", "n_regionkey"), {"sep": ";"}).alias("line"))
    return rows.select(F.from_csv("line", "k INT, name STRING, region INT", {"sep": ";"}).alias("r")).select("r.*")


def line_features(spark, d):
    points = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("lid"), F.col("l_linenumber").alias("seq")).agg(
        F.min("l_quantity").alias("x"), F.min("l_tax").alias("y")
    )
    out = files.edge_features(points)
    return out.select(F.get_json_object("value", "$.properties.lid").cast("bigint").alias("lid"), F.get_json_object("value", "$.geometry.coordinates[0][0]").cast("double").alias("x0"))


def cosine_nn(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("feature"))
    out = learning.nearest_features(rows, rows.filter("id % 100 = 0"))
    return out.select("id", F.round("likeness", 5).alias("likeness"))


def pair_distance(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("i")).agg(F.count(F.lit(1)).alias("value"))
    out = learning.pair_distances(s)
    return out.select("a", "b", F.round("l2", 6).alias("l2"), F.round("corr", 6).alias("corr"))


def session_windows(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = ingest.sessions(rows, "t", ["user_id"], "2 hours")
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "cnt")


def sliding_counts(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy("event_type", F.window("ts", "2 hours", "1 hour")["start"].alias("start")).agg(F.count(F.lit(1)).alias("cnt"))


def two_clock(spark, d):
    return ingest.two_clock(table(spark, d, "events"), "ts", ["event_type"], "user_id", "10 minutes", "1 hour")


def stream_unique_devices(spark, d):
    """The file stream of events through the idempotent store equals the batch count."""
    at = shared_folder(spark, "stream")
    return ingest.unique_devices_stream(ingest.table_stream(spark, d, "events"), "15 minutes", f"{at}/store", f"{at}/state")


def _hourly(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def savgol_smooth(spark, d):
    """Each type's events by the hour, smoothed by cubics over nine hours with events."""
    return series.savitzky_golay(_hourly(spark, d), ["event_type"], "t", "value").select("event_type", "t", F.round("smooth", 5).alias("smooth"))


def spline_timetable(spark, d):
    return learning.per_series(_hourly(spark, d), "event_type", "event_type string, place double, value double", learning.cubic_spline)


def seasonal_orders(spark, d):
    """The seasonal models of every order for each type's events by the hour."""
    out = forecast.fitted(_hourly(spark, d), "event_type", 24)
    return out.select("event_type", F.array_join(F.transform("order", lambda o: o.cast("string")), ",").alias("order"), F.round("aic", 4).alias("aic"), "n")


def seasonal_forecast(spark, d):
    """The next day of each type's events by the hour, by the seasonal model of least AIC."""
    return forecast.forecast(_hourly(spark, d), "event_type", 24, 24)


def nearest_days(spark, d):
    """For each type and day the other one whose counts by the hour are nearest by warping of up to two hours."""
    hours = _hourly(spark, d).groupBy("event_type", F.to_date("t").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct(F.hour("t"), "value"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    rows = hours.select(F.concat_ws(" ", "event_type", F.col("day").cast("string")).alias("id"), x.alias("x"))
    return learning.nearest_warped(rows, 2).select("id", "best", F.round("dist", 6).alias("dist"))


def ward_clusters(spark, d):
    """Three clusters of all embeddings by Ward's linkage, each named by its least id."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("feature"))
    return clusters.ward_labels(rows, 3)


_T = "t AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, n := length(text)) ORDER BY turn) AS t FROM conversations GROUP BY 1)"

SQL = {
    "json_paths": f"""WITH {_T} SELECT conv_id, conv_id AS id, t[1].role AS first, t[-1].role AS last, list_aggregate(list_transform(t, lambda x: x.role), 'string_agg', ',') AS roles,
  coalesce(list_aggregate(list_transform(t[2:3], lambda x: CAST(x.turn AS VARCHAR)), 'string_agg', ','), '') AS slice, CAST(len(list_filter(t, lambda x: x.role = 'user' AND x.n > 200)) AS INTEGER) AS long_users,
  CAST(list_max(list_transform(t, lambda x: x.n)) AS INTEGER) AS longest, t[1].turn AS pointer, len(t) >= 4 AS has4,
  CASE WHEN len(t) = 1 THEN CAST(t[1].turn AS VARCHAR) ELSE '[' || list_aggregate(list_transform(t, lambda x: CAST(x.turn AS VARCHAR)), 'string_agg', ',') || ']' END AS wild FROM t""",
    "json_slices": f"""WITH {_T}, s AS (SELECT conv_id, list_transform(t, lambda x: CAST(x.turn AS VARCHAR)) AS t FROM t)
SELECT conv_id, array_to_string(t[1:-1:2], ',') AS even, array_to_string(list_reverse(t), ',') AS back, array_to_string(t[-2:], ',') AS tail, array_to_string(t[2:len(t) - 1], ',') AS mid, t[1] || ',' || t[-1] AS ends FROM s""",
    "json_descendants": "SELECT conv_id, count(text) AS cnt, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY 1 HAVING count(text) > 0",
    "json_map_explode": "SELECT CAST(length(event_type) AS BIGINT) AS t, CAST(user_id % 20 AS VARCHAR) AS cell, CAST(count(*) AS INTEGER) AS cnt FROM events GROUP BY 1, 2",
    "json_patch": """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'name=' || n_name || ',region=' || n_regionkey || ',y=1' WHEN 1 THEN 'name=' || n_name || ',z=' || n_name
  ELSE CASE WHEN n_regionkey = 1 THEN 'name=q,region=1' END END AS patched, CAST(CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN n_regionkey = 1 THEN 1 END END AS INTEGER) AS changes FROM nation""",
    "json_edits": f"""WITH {_T} SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN CAST(to_json(struct_pack(id := 'c' || conv_id, turns := list_prepend(struct_pack(turn := -1, role := 'system', n := 0), t[1:len(t) - 1]), first := 'system')) AS VARCHAR) END AS patched,
  CASE WHEN conv_id % 3 <> 0 THEN true END AS back FROM t""",
    "replaced_member": f"WITH {_T} SELECT conv_id, CAST(to_json(struct_pack(id := conv_id, turns := list_transform(t, lambda x: struct_pack(turn := x.turn, role := x.role, n := 0)))) AS VARCHAR) AS doc FROM t",
    "renamed_member": f"WITH {_T} SELECT conv_id, CAST(to_json(struct_pack(id := conv_id, turns := list_transform(t, lambda x: struct_pack(turn := x.turn, who := x.role, n := x.n)))) AS VARCHAR) AS doc FROM t",
    "csv_roundtrip": "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation",
    "line_features": "SELECT l_orderkey AS lid, arg_min(q, l_linenumber) AS x0 FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY 1",
    "cosine_nn": "SELECT q.vec_id AS id, round(max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 5) AS likeness FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1",
    "pair_distance": "WITH s AS (SELECT event_type AS key, CAST(ts AS DATE) AS i, count(*) AS v FROM events GROUP BY ALL) SELECT a.key AS a, b.key AS b, round(sqrt(sum(pow(a.v - b.v, 2))), 6) AS l2, round(corr(a.v, b.v), 6) AS corr FROM s a JOIN s b ON a.i = b.i AND a.key < b.key GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS cnt FROM s GROUP BY user_id, n""",
    "sliding_counts": "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(k AS BIGINT)) AS start, count(*) AS cnt FROM events, range(2) t(k) GROUP BY ALL",
    "two_clock": "WITH f AS (SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS tick, arg_max(user_id, ts) AS v FROM events GROUP BY ALL) SELECT event_type, time_bucket(INTERVAL '1 hour', tick) AS bin, CAST(sum(v) AS BIGINT) AS total FROM f GROUP BY ALL",
    # The cubic fit over nine places as a sum over orthogonal polynomials.
    "savgol_smooth": """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, count(*) AS v FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h),
p AS (SELECT [-4, -3, -2, -1, 0, 1, 2, 3, 4] AS a, [28, 7, -8, -17, -20, -17, -8, 7, 28] AS b, [-14, 7, 13, 9, 0, -9, -13, -7, 14] AS c),
l AS (SELECT event_type, t, i, least(greatest(i - 4, 0), n - 9) AS low FROM r)
SELECT l.event_type, l.t, round(sum(v * (1 / 9.0::DOUBLE + a[l.i - low + 1] * a[r.i - low + 1] / 60.0::DOUBLE + b[l.i - low + 1] * b[r.i - low + 1] / 2772.0::DOUBLE + c[l.i - low + 1] * c[r.i - low + 1] / 990.0::DOUBLE)), 5) AS smooth
FROM l, p, r WHERE l.event_type = r.event_type AND r.i BETWEEN low AND low + 8 GROUP BY l.event_type, l.t""",
    "stream_unique_devices": "SELECT event_type AS station_name, time_bucket(INTERVAL '15 minutes', ts) AS bin, count(DISTINCT user_id) AS devices FROM events GROUP BY 1, 2",
}

QUERIES = {name: globals()[name] for name in (*SQL, "spline_timetable", "seasonal_orders", "seasonal_forecast", "nearest_days", "ward_clusters")}
