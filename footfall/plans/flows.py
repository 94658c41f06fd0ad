"""Queries over flows, statistics, joins and demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import flows, joins, stats
from footfall.sources.tables import detections, table


def od_matrix(spark, d):
    return flows.od_matrix(detections(spark, d))


def path_shares(spark, d):
    return flows.path_shares(detections(spark, d))


def days_seen_hist(spark, d):
    return flows.days_seen(detections(spark, d), 15)


def transition_steps(spark, d):
    return flows.transition_steps(detections(spark, d), "view", 6)


def group_transitions(spark, d):
    names = ["click", "error", "signup", "purchase", "view"]
    groups = spark.createDataFrame([(x, "act" if x in ("click", "purchase") else "other") for x in names], "station_name string, group string")
    return flows.group_transitions(detections(spark, d), groups)


def dwell_time(spark, d):
    return flows.dwell_time(detections(spark, d), "6 hours")


def id_stats(spark, d):
    return flows.id_statistics(detections(spark, d))


def topk_devices(spark, d):
    return flows.top_ids(detections(spark, d), 10)


def visitors_running(spark, d):
    rows = detections(spark, d).select(
        F.col("station_name").alias("place"), "date_time", F.when(F.col("event_id") % 3 == 0, "OUT").otherwise("IN").alias("kind")
    )
    return flows.visitors(rows, "1 hour").select("place", "bin", "visitors")


def quantile_bins(spark, d):
    out = stats.quantile_bins(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "level")


def hist_numpy(spark, d):
    out = stats.histogram(table(spark, d, "customer"), "c_acctbal", -1000.0, 10000.0, 22)
    return out.select("bin", "cnt", F.round("density", 10).alias("density"))


def hist_cdf(spark, d):
    out = stats.tagged_histogram(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", 1000.0, 20000.0, 12)
    return out.select("o_orderstatus", "bin", "cnt", F.round("cdf", 6).alias("cdf"))


def cov_matrix(spark, d):
    out = stats.covariances(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_returnflag", "a", "b", F.round("cov", 3).alias("cov"))


def coverage_bitmap(spark, d):
    return stats.coverage(detections(spark, d), ["station_name"], "date_time", "30 minutes")


def coverage_minmax(spark, d):
    return detections(spark, d).groupBy("station_name", (F.col("mac_address") % 4).alias("kind")).agg(
        F.min("date_time").alias("first"), F.max("date_time").alias("last"), F.count(F.lit(1)).alias("n")
    )


def rescale_series(spark, d):
    daily = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))
    out = stats.scaled(daily, ["o_orderpriority"], "cnt", 1000.0)
    return out.select("o_orderpriority", "day", *(F.round(c, 6).alias(c) for c in ("by_max", "by_range", "by_total")))


def source_weighting(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 5 == 0).alias("measured"))
    out = stats.source_weights(rows, "s_acctbal", "measured")
    return out.select("s_suppkey", "measured", F.round("share", 9).alias("share"))


def rate_carry(spark, d):
    rates = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("rate"))
    return stats.carried_counts(rates, ["event_type"], "hour", "rate", 12)


def insert_ignore(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    old, new = rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0")
    first = joins.insert_ignore(old.limit(0), old, ["hour", "event_type"], "event_id")
    return joins.insert_ignore(first, new, ["hour", "event_type"], "event_id")


def meta_join_group(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"),
        F.round(F.avg("l_quantity"), 6).alias("mean"), F.any_value("n_regionkey").alias("region"),
    )


def natural_join(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    common = [c for c in names.columns if c in people.columns]
    return names.join(people, common)


def full_outer_status(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "outer")


def semi_customers(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_customers(spark, d):
    any_ = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(any_, "c_custkey", "left_anti").select("c_custkey", "c_name")


def asof_next(spark, d):
    rows = detections(spark, d)
    clicks = rows.filter("station_name = 'click'").select("event_id", "mac_address", "date_time")
    buys = rows.filter("station_name = 'purchase'").select("mac_address", "date_time")
    return joins.next_after(clicks, buys, ["mac_address"], "date_time", "next_time")


def _points(spark, d):
    x, y = F.col("p_retailprice") % 97, (F.col("p_partkey") * 37) % 101
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def radius_join(spark, d):
    p = _points(spark, d)
    right = p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return joins.within_radius(p, right, 2.0).filter("id < other").select("id", "other", F.round("dist", 6).alias("dist"))


def nearest_cell(spark, d):
    p = _points(spark, d)
    right = p.filter("id % 5 = 0").select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return joins.nearest_in_cells(p.filter("id % 5 <> 0"), right, 10.0).select("id", "other", F.round("dist", 6).alias("dist"))


def period_compare(spark, d):
    """Hourly counts of two weeks side by side, by place in order."""
    rows = detections(spark, d).groupBy("station_name", F.date_trunc("hour", "date_time").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    a = rows.filter("bin >= '2024-01-01' AND bin < '2024-01-08'")
    b = rows.filter("bin >= '2024-01-08' AND bin < '2024-01-15'")
    return joins.positional(a, b, "bin").withColumn("change", F.col("other") - F.col("cnt"))


def grouping_totals(spark, d):
    """Row counts by each column alone, in one pass."""
    rows = detections(spark, d).select("station_name", F.to_date("date_time").alias("date"), (F.col("mac_address") % 7).alias("ssid"))
    out = rows.groupingSets([["station_name"], ["date"], ["ssid"]], "station_name", "date", "ssid").agg(F.count(F.lit(1)).alias("cnt"))
    return out


def set_operations(spark, d):
    """Closed edges: those of one list that are not in the other, and those in both."""
    rows = table(spark, d, "lineitem")
    a, b = rows.filter("l_quantity > 45").select("l_partkey"), rows.filter("l_discount > 0.08").select("l_partkey")
    return a.subtract(b).withColumn("kind", F.lit("only")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


_E = "e AS (SELECT event_id, ts AS date_time, user_id AS mac_address, event_type AS station_name FROM events)"
_COLLAPSED = f"""{_E}, o AS (SELECT *, CAST(date_time AS DATE) AS date, lag(station_name) OVER w AS before, count(*) OVER (PARTITION BY CAST(date_time AS DATE), mac_address) AS n_rows
  FROM e WINDOW w AS (PARTITION BY CAST(date_time AS DATE), mac_address ORDER BY date_time, event_id)),
c AS (SELECT * FROM o WHERE before IS NULL OR before <> station_name)"""


def _steps(source: str, start: str, steps: int) -> str:
    return f"""r AS (SELECT *, lead(station_name) OVER w AS next_station, first_value(station_name) OVER w AS first,
  min(station_name) OVER (PARTITION BY mac_address) <> max(station_name) OVER (PARTITION BY mac_address) AS many
  FROM {source} WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY mac_address ORDER BY date_time, event_id) - 1 AS step FROM r WHERE many AND next_station <> station_name {start}),
k AS (SELECT station_name, next_station, CAST(step AS INTEGER) AS step, count(*) AS n FROM n WHERE step < {steps} GROUP BY ALL)
SELECT station_name, next_station, step, n, round(n / CAST(sum(n) OVER (PARTITION BY step) AS DOUBLE), 4) AS norm FROM k"""


_POINTS = "p AS (SELECT p_partkey AS id, p_retailprice % 97 AS x, CAST((p_partkey * 37) % 101 AS DOUBLE) AS y FROM part)"

SQL = {
    "od_matrix": f"WITH {_COLLAPSED} SELECT before AS origin, station_name AS destination, count(*) AS trips, CAST(floor(count(*) / (SELECT count(DISTINCT CAST(date_time AS DATE)) FROM e)) AS BIGINT) AS per_day FROM c WHERE before IS NOT NULL GROUP BY ALL",
    "path_shares": f"""WITH {_COLLAPSED}, g AS (SELECT date, mac_address, max(n_rows) AS n, count(*) AS stops FROM c GROUP BY ALL)
SELECT count(*) AS activity, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS multi, count(*) FILTER (WHERE n > 1 AND stops > 1) AS path, count(*) FILTER (WHERE n > 1 AND stops = 1) AS rest FROM g""",
    "days_seen_hist": f"WITH {_E}, a AS (SELECT mac_address, CAST(date_time AS DATE) AS date FROM e GROUP BY ALL HAVING count(*) > 1), p AS (SELECT mac_address, count(*) AS days_seen FROM a GROUP BY 1) SELECT days_seen, count(*) AS ids FROM p WHERE days_seen < 15 GROUP BY 1",
    "transition_steps": f"WITH {_E}, {_steps('e', 'AND first = ' + chr(39) + 'view' + chr(39), 6)}",
    "group_transitions": f"WITH {_E}, g AS (SELECT event_id, date_time, mac_address, CASE WHEN station_name IN ('click', 'purchase') THEN 'act' ELSE 'other' END AS station_name FROM e WHERE station_name IN ('click', 'error', 'signup', 'purchase', 'view')), {_steps('g', '', 1)}",
    "dwell_time": f"""WITH {_E}, s AS (SELECT station_name, time_bucket(INTERVAL '6 hours', date_time) AS bin, mac_address, CAST(epoch(date_trunc('second', max(date_time))) - epoch(date_trunc('second', min(date_time))) AS BIGINT) AS stay FROM e GROUP BY ALL)
SELECT station_name, bin, count(*) FILTER (WHERE stay >= 10) AS ids, round_even(avg(stay) FILTER (WHERE stay >= 10) / 60, 0) AS minutes FROM s GROUP BY ALL""",
    "id_stats": f"WITH {_E} SELECT mac_address, count(*) AS n, count(DISTINCT CAST(date_time AS DATE)) AS days, count(DISTINCT station_name) AS stations FROM e GROUP BY 1",
    "topk_devices": f"WITH {_E}, s AS (SELECT mac_address, count(*) AS n, count(DISTINCT CAST(date_time AS DATE)) AS days, count(DISTINCT station_name) AS stations FROM e GROUP BY 1) SELECT * FROM s WHERE stations > 1 ORDER BY n DESC, mac_address LIMIT 10",
    "visitors_running": """WITH p AS (SELECT event_type AS place, time_bucket(INTERVAL '1 hour', ts) AS bin, count(*) FILTER (WHERE event_id % 3 <> 0) - count(*) FILTER (WHERE event_id % 3 = 0) AS n FROM events GROUP BY 1, 2)
SELECT place, bin, CAST(sum(n) OVER (PARTITION BY place ORDER BY bin) AS BIGINT) AS visitors FROM p""",
    "quantile_bins": """WITH c AS (SELECT l_returnflag, quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l.l_returnflag, CASE WHEN l_quantity > q[1] AND l_quantity <= q[5] THEN CAST(len(list_filter(q, lambda x: x < l_quantity)) - 1 AS INTEGER) END AS level FROM lineitem l JOIN c USING (l_returnflag)""",
    "hist_numpy": """WITH b AS (SELECT CAST(least(floor((c_acctbal + 1000) / 500), 21) AS INTEGER) AS bin FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000), g AS (SELECT bin, count(*) AS cnt FROM b GROUP BY 1)
SELECT bin, cnt, round(cnt / (sum(cnt) OVER () * 500.0::DOUBLE), 10) AS density FROM g""",
    "hist_cdf": """WITH b AS (SELECT o_orderstatus, CAST(least(floor((o_totalprice - 1000) / 20000), 11) AS INTEGER) AS bin, count(*) AS cnt FROM orders WHERE o_totalprice >= 1000 GROUP BY ALL)
SELECT o_orderstatus, bin, cnt, round(sum(cnt) OVER (PARTITION BY o_orderstatus ORDER BY bin) / CAST(sum(cnt) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 6) AS cdf FROM b""",
    "cov_matrix": " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 3) AS cov FROM lineitem GROUP BY 1"
        for a, b in (
            ("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
            ("l_extendedprice", "l_extendedprice"), ("l_extendedprice", "l_discount"), ("l_discount", "l_discount"),
        )
    ),
    "coverage_bitmap": "SELECT event_type AS station_name, time_bucket(INTERVAL '30 minutes', ts) AS bin, CAST(1 AS INTEGER) AS seen FROM events GROUP BY 1, 2",
    "coverage_minmax": "SELECT event_type AS station_name, user_id % 4 AS kind, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY 1, 2",
    "rescale_series": """WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS cnt FROM orders GROUP BY ALL),
w AS (SELECT *, min(cnt) OVER p AS lo, max(cnt) OVER p AS hi, sum(cnt) OVER p AS s FROM d WINDOW p AS (PARTITION BY o_orderpriority))
SELECT o_orderpriority, day, round(cnt / CAST(hi AS DOUBLE), 6) AS by_max, round((cnt - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 6) AS by_range, round(cnt * 1000.0::DOUBLE / s, 6) AS by_total FROM w""",
    "source_weighting": "SELECT s_suppkey, s_nationkey % 5 = 0 AS measured, round(CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE s_acctbal / sum(s_acctbal) FILTER (WHERE s_nationkey % 5 <> 0) OVER () END, 9) AS share FROM supplier",
    "rate_carry": """WITH RECURSIVE r AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS rate FROM events GROUP BY ALL),
s AS (SELECT event_type, hour, CAST(k AS INTEGER) AS part, rate // 12 AS whole, rate % 12 AS rest, row_number() OVER (PARTITION BY event_type ORDER BY hour, k) AS i FROM r, range(12) t(k)),
c AS (SELECT event_type, hour, part, whole, rest AS carry, i, whole AS created FROM s WHERE i = 1
  UNION ALL SELECT s.event_type, s.hour, s.part, s.whole, CASE WHEN c.carry + s.rest > 12 THEN c.carry + s.rest - 12 ELSE c.carry + s.rest END, s.i, s.whole + CASE WHEN c.carry + s.rest > 12 THEN 1 ELSE 0 END
  FROM c JOIN s ON s.event_type = c.event_type AND s.i = c.i + 1)
SELECT event_type, hour, part, CAST(created AS BIGINT) AS created FROM c""",
    "insert_ignore": """WITH r AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_id) AS i FROM events)
SELECT event_id, user_id, event_type, hour FROM r WHERE i = 1""",
    "meta_join_group": "SELECT n_name, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, any_value(n_regionkey) AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "natural_join": "SELECT * FROM (SELECT n_nationkey AS nation, n_name FROM nation) NATURAL JOIN (SELECT c_nationkey AS nation, c_custkey FROM customer)",
    "full_outer_status": "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (nation)",
    "semi_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "asof_next": f"WITH {_E} SELECT c.event_id, c.mac_address, c.date_time, (SELECT min(b.date_time) FROM e b WHERE b.station_name = 'purchase' AND b.mac_address = c.mac_address AND b.date_time > c.date_time) AS next_time FROM e c WHERE c.station_name = 'click'",
    "radius_join": f"WITH {_POINTS} SELECT a.id, b.id AS other, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS dist FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2",
    "nearest_cell": f"""WITH {_POINTS}, j AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON b.id % 5 = 0
  AND abs(floor(a.x / 10) - floor(b.x / 10)) <= 1 AND abs(floor(a.y / 10) - floor(b.y / 10)) <= 1 WHERE a.id % 5 <> 0),
m AS (SELECT id, min(struct_pack(dist := dist, other := other)) AS best FROM j GROUP BY 1)
SELECT p.id, m.best.other AS other, round(m.best.dist, 6) AS dist FROM p LEFT JOIN m USING (id) WHERE p.id % 5 <> 0""",
    "period_compare": """WITH h AS (SELECT event_type AS station_name, date_trunc('hour', ts) AS bin, count(*) AS cnt FROM events GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY bin) AS i FROM h WHERE bin >= '2024-01-01' AND bin < '2024-01-08'),
b AS (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY bin) AS i FROM h WHERE bin >= '2024-01-08' AND bin < '2024-01-15')
SELECT a.station_name, a.bin, a.cnt, b.cnt AS other, b.cnt - a.cnt AS change FROM a JOIN b USING (station_name, i)""",
    "grouping_totals": "WITH r AS (SELECT event_type AS station_name, CAST(ts AS DATE) AS date, user_id % 7 AS ssid FROM events) SELECT station_name, date, ssid, count(*) AS cnt FROM r GROUP BY GROUPING SETS ((station_name), (date), (ssid))",
    "set_operations": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08)
SELECT l_partkey, 'only' AS kind FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM b) UNION ALL SELECT l_partkey, 'both' FROM a WHERE l_partkey IN (SELECT l_partkey FROM b)""",
}

QUERIES = {name: globals()[name] for name in SQL}
