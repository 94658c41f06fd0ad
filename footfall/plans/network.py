"""Queries over polylines, routes and agents. ``roads`` has those over the road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import agents, graph
from footfall.sources.tables import table

def polyline_arcs(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("lid"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")
    )
    once = rows.groupBy("lid", "seq").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return graph.arcs(once).select("lid", "seq", F.round("length", 6).alias("length"), F.round("s0", 6).alias("s0"))


def route_enumeration(spark, d):
    places = table(spark, d, "region").select(F.col("r_name").alias("place"))
    a, b = places.toDF("a"), places.toDF("b")
    dist = a.join(b, F.col("a") != F.col("b")).select("a", "b", (F.abs(F.length("a") - F.length("b")) + 1).cast("double").alias("dist"))
    found = graph.routes(places, dist, 3)
    weights = places.select("place", (F.length("place") / 10).alias("w"))
    out = graph.route_weights(found, weights, 2.0)
    return out.select(F.concat_ws(">", "route").alias("route"), "length", "bin", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


def trip_stats(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("id"), F.col("ts").alias("t"), F.col("event_type").alias("kind"),
        (F.col("event_id") % 900).alias("triptime"), (F.col("event_id") % 900 + F.col("user_id") % 300).alias("lifetime"),
    )
    return agents.trip_stats(rows)


def population_by_type(spark, d):
    rows = table(spark, d, "events").select(
        F.to_date("ts").alias("t"), F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "locals").otherwise("tourist").alias("tag"),
        F.when(F.col("event_type") == "error", "dead").otherwise("moving").alias("state"),
    )
    return agents.population(rows, ["locals", "tourist"])


def fifo_admission(spark, d):
    q = table(spark, d, "events").select(F.col("event_type").alias("place"), F.date_trunc("hour", "ts").alias("hour"), F.col("event_id").alias("id"), F.col("ts").alias("t"))
    cap = q.select("place", "hour").distinct().withColumn("capacity", F.hour("hour") % 3 + 1)
    return agents.admitted(q, cap).select("place", "hour", "id", "turn")


def barrier_counts(spark, d):
    moves = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 10).alias("lid"), F.col("l_quantity").alias("s"), (F.col("l_tax") * 100).alias("ds"), (F.col("l_returnflag") == "N").alias("forward")
    )
    bars = spark.createDataFrame([(f"bar{i}", i, 10.0 + 3 * i) for i in range(10)], "tag string, lid bigint, at double")
    return agents.barrier_crossings(moves, bars)


def unique_on_edges(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 20).alias("lid"), (F.col("value") > 50).alias("forward"), F.col("user_id").alias("id"), F.col("ts").alias("t"))
    return agents.unique_on_edges(rows, "6 hours")


SQL = {
    "polyline_arcs": """WITH p AS (SELECT l_orderkey AS lid, l_linenumber AS seq, min(l_quantity) AS x, min(l_discount * 100) AS y FROM lineitem GROUP BY ALL), a AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY lid ORDER BY seq)),
l AS (SELECT lid, seq, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS length FROM a WHERE x2 IS NOT NULL)
SELECT lid, seq, round(length, 6) AS length, round(coalesce(sum(length) OVER (PARTITION BY lid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS s0 FROM l""",
    "route_enumeration": """WITH p AS (SELECT r_name AS place, CAST(length(r_name) AS DOUBLE) AS n FROM region),
r AS (SELECT place AS route, 0.0::DOUBLE AS length, n / 10 AS weight, [place] AS k FROM p UNION ALL SELECT a.place || '>' || b.place, abs(a.n - b.n) + 1, a.n * b.n / 100, [a.place, b.place] FROM p a JOIN p b ON a.place <> b.place
  UNION ALL SELECT a.place || '>' || b.place || '>' || c.place, abs(a.n - b.n) + abs(b.n - c.n) + 2, a.n * b.n * c.n / 1000, [a.place, b.place, c.place] FROM p a JOIN p b ON a.place <> b.place JOIN p c ON c.place <> a.place AND c.place <> b.place)
SELECT route, length, CAST(floor(length / 2) AS BIGINT) AS bin, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY floor(length / 2) ORDER BY round(weight, 9) DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(weight) OVER (PARTITION BY floor(length / 2)), 6) AS share FROM r""",
    "trip_stats": """SELECT user_id AS id, event_type AS kind, event_id % 900 AS triptime, event_id % 900 + user_id % 300 AS lifetime, user_id % 300 AS idle FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "population_by_type": "SELECT CAST(ts AS DATE) AS t, count(*) FILTER (WHERE user_id % 2 = 0) AS locals, count(*) FILTER (WHERE user_id % 2 <> 0) AS tourist FROM events WHERE event_type <> 'error' GROUP BY 1",
    "fifo_admission": """WITH q AS (SELECT event_type AS place, date_trunc('hour', ts) AS hour, event_id AS id, CAST(row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS INTEGER) AS turn FROM events) SELECT * FROM q WHERE turn <= hour(hour) % 3 + 1""",
    "barrier_counts": """WITH m AS (SELECT l_partkey % 10 AS lid, l_quantity AS s, l_tax * 100 AS ds, l_returnflag = 'N' AS f FROM lineitem), b AS (SELECT 'bar' || i AS tag, i AS lid, CAST(10.0 + 3 * i AS DOUBLE) AS pos FROM range(10) t(i))
SELECT tag, count(*) FILTER (WHERE f AND ((s < pos AND s + ds > pos) OR (s > pos AND s - ds < 0))) AS ins, count(*) FILTER (WHERE NOT f AND ((s > pos AND s - ds < pos) OR (s < pos AND s - ds < 0))) AS outs FROM m JOIN b USING (lid) GROUP BY tag""",
    "unique_on_edges": "SELECT event_id % 20 AS lid, value > 50 AS forward, time_bucket(INTERVAL '6 hours', ts) AS bin, count(DISTINCT user_id) AS ids FROM events GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in SQL}
