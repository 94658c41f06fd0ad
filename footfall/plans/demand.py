"""Queries over sensor clean-up, demand curves, camera reports and small text and time columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import demand, series
from footfall.sources.tables import table


def _events(spark, d):
    return table(spark, d, "events")


def _hour(spark, d):
    return _events(spark, d).withColumn("bin", F.date_trunc("hour", "ts"))


def hours_between(spark, d):
    return _events(spark, d).filter(F.hour("ts").between(8, 18)).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


def sparse_series(spark, d):
    way = F.when(F.col("event_id") % 5 == 0, "OUT").otherwise("IN")
    counts = _events(spark, d).groupBy("event_type", way.alias("way"), F.to_date("ts").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return demand.without_sparse(counts, "event_type", "way", 30, 0.2)


def positive_coordinate(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_acctbal")


def decoded_ways(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", demand.decoded_way(F.col("l_returnflag"), {"R": "(E)", "N": "(U)"}).alias("way"))
    return rows


def series_by_time(spark, d):
    rows = _hour(spark, d)
    one = lambda kind: rows.filter(F.col("event_type") == kind).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    return demand.by_time({k: one(k) for k in ("click", "purchase", "error")})


def all_place_pairs(spark, d):
    return demand.ordered_pairs(table(spark, d, "nation").select(F.col("n_name").alias("place")))


def unique_of_each(spark, d):
    return demand.unique_of_each(_events(spark, d), F.window("ts", "6 hours")["start"], ["user_id", "event_type"])


def device_first_seen(spark, d):
    return _events(spark, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first"))


def cluster_first_mean(spark, d):
    out = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_mktsegment", "c_custkey").alias("colour"), F.avg("c_acctbal").alias("lat"))
    return out.select("c_nationkey", "colour", F.round("lat", 6).alias("lat"))


def barrier_totals(spark, d):
    rows = _events(spark, d)
    inward = F.count_if(F.col("event_id") % 3 != 0)
    return rows.groupBy("event_type").agg((inward * 2.0).alias("ins"), ((F.count(F.lit(1)) - inward) * 2.0).alias("outs"))


def frame_stats(spark, d):
    rows = _events(spark, d).groupBy("event_type", F.floor(F.col("event_id") / 20).alias("batch"))
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"))


LEVELS = [(0, 0.1), (6, 0.4), (9, 1.0), (13, 0.7), (20, 0.3)]


def hour_levels(spark, d):
    return _events(spark, d).select("event_id", demand.level_of_hour(F.hour("ts"), LEVELS).alias("level"))


def population_curve(spark, d):
    counts = _events(spark, d).groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    smooth = series.box_smooth(counts, ["event_type"], "hour", "cnt", 3, trailing=True)
    return demand.scaled(smooth, ["event_type"], "smooth", 100.0, 1000.0).select("event_type", "hour", F.round("smooth", 6).alias("population"))


def mixed_profiles(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 11 / 10).alias("mix"))
    return demand.mixed_profile(names, 24, "profile-1").select("name", "hour", F.round("value", 9).alias("value"))


def sum_of_file_means(spark, d):
    rows = _events(spark, d).select("event_type", F.weekday("ts").alias("wday"), F.hour("ts").alias("hour"), "value")
    return demand.sum_of_means(rows, "event_type", ["wday", "hour"], "value").select("wday", "hour", F.round("total", 6).alias("total"))


def prior_month_weekday(spark, d):
    daily = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cam"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))
    return demand.beside_prior_month(daily).select("month", "wday", F.round("now", 6).alias("now"), F.round("prior", 6).alias("prior"))


def second_best(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return demand.nth_best(rows, ["l_returnflag", "l_linestatus"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 2)


def attraction_cap(spark, d):
    """The 25 largest attractions: the cap is what is asked for."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


def merged_columns(spark, d):
    long = _hour(spark, d).groupBy("bin", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("cnt"))
    groups = spark.createDataFrame([("click", "site"), ("view", "site"), ("purchase", "shop"), ("signup", "shop")], "name string, group string")
    return demand.merged_columns(long, groups)


def split_counter(spark, d):
    counts = _hour(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    return demand.split_counter(counts, ["a", "b", "c"])


def tag_lengths(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.length("s_name") - 2).alias("stops"))


def name_parts(spark, d):
    path = F.concat(F.lit("/data/run_"), F.col("s_suppkey"), F.lit("_240101_240131.csv"))
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.]csv$", ""), "_")
    return table(spark, d, "supplier").select("s_suppkey", parts[1].cast("bigint").alias("run"), F.to_date(parts[2], "yyMMdd").alias("start"), F.to_date(parts[3], "yyMMdd").alias("stop"))


def unix_dates(spark, d):
    stamp = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _events(spark, d).select("event_id", F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd HH:mm:ss").alias("label"))


def zone_clocks(spark, d):
    utc = F.convert_timezone(F.lit("Europe/Rome"), F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
    back = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Rome"), F.col("ts").cast("timestamp_ntz"))
    return _events(spark, d).select("event_id", utc.alias("utc"), back.alias("local"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss").alias("label"))


def list_products(spark, d):
    one = table(spark, d, "region").select("r_name").withColumn("b", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("c", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    return one.select(F.concat_ws(",", "r_name", "b", "c").alias("combo"))


def month_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM").alias("name"), F.month("o_orderdate").alias("month"))


def destination_choice(spark, d):
    places = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("place"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("score"))
    out = demand.cumulative_choice(places, ["s_nationkey"], "score")
    return out.select("s_nationkey", "place", F.round("share", 9).alias("share"), F.round("upto", 9).alias("upto"))


def snapshots(spark, d):
    return _events(spark, d).filter(F.unix_timestamp(F.col("ts").cast("timestamp")) % 300 == 0).select("event_id", "ts")


def simulated_beside_real(spark, d):
    rows = _hour(spark, d)
    real = rows.filter("event_type IN ('click', 'view')").groupBy("bin", "event_type").agg(F.count(F.lit(1)).alias("real"))
    simulated = rows.filter("event_type IN ('click', 'view')").groupBy("bin", "event_type").agg(F.round(F.sum("value") / 50).cast("bigint").alias("simulated"))
    return real.join(simulated, ["bin", "event_type"], "full").select("bin", "event_type", "real", "simulated", (F.col("simulated") - F.col("real")).alias("difference"))


def route_report(spark, d):
    """Of the orders of each length (lines), how many were created, and how many used (shipped in full)."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"), F.bool_and(F.col("l_linestatus") == "F").alias("done"))
    return lines.groupBy("length").agg(F.count(F.lit(1)).alias("created"), F.count_if("done").alias("used"), F.round(F.avg(F.col("done").cast("int")), 9).alias("share"))


_H = "date_trunc('hour', ts)"

SQL = {
    "hours_between": "SELECT event_type, count(*) AS cnt FROM events WHERE hour(ts) BETWEEN 8 AND 18 GROUP BY 1",
    "sparse_series": """WITH c AS (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'OUT' ELSE 'IN' END AS way, CAST(ts AS DATE) AS bin, count(*) AS cnt FROM events GROUP BY ALL)
SELECT * FROM c WHERE event_type NOT IN (SELECT event_type FROM c GROUP BY event_type, way HAVING 1 - count(DISTINCT bin) / 30 > 0.2)""",
    "positive_coordinate": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
    "decoded_ways": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'E' WHEN 'N' THEN 'U' ELSE 'A' END AS way FROM lineitem",
    "series_by_time": f"SELECT {_H} AS bin, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "purchase", "error")) + " FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1",
    "all_place_pairs": "SELECT a.n_name AS origin, b.n_name AS destination, 0 AS cnt FROM nation a JOIN nation b ON a.n_name <> b.n_name",
    "unique_of_each": "SELECT time_bucket(INTERVAL '6 hours', ts) AS bin, count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type FROM events GROUP BY 1",
    "device_first_seen": "SELECT event_type, user_id, count(*) AS cnt, min(ts) AS first FROM events GROUP BY ALL",
    "cluster_first_mean": "SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS colour, round(avg(c_acctbal), 6) AS lat FROM customer GROUP BY 1",
    "barrier_totals": "SELECT event_type, 2.0::DOUBLE * count(*) FILTER (WHERE event_id % 3 <> 0) AS ins, 2.0::DOUBLE * count(*) FILTER (WHERE event_id % 3 = 0) AS outs FROM events GROUP BY 1",
    "frame_stats": "SELECT event_type, event_id // 20 AS batch, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least FROM events GROUP BY ALL",
    "hour_levels": "SELECT event_id, CAST(CASE WHEN hour(ts) >= 20 THEN 0.3 WHEN hour(ts) >= 13 THEN 0.7 WHEN hour(ts) >= 9 THEN 1.0 WHEN hour(ts) >= 6 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS level FROM events",
    "population_curve": """WITH c AS (SELECT event_type, hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS cnt FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM c),
s AS (SELECT a.event_type, a.hour, sum(b.cnt) / 3 AS v FROM n a JOIN n b ON a.event_type = b.event_type AND (a.i - b.i + a.n) % a.n < 3 GROUP BY ALL)
SELECT event_type, CAST(hour AS INTEGER) AS hour, round(100 + 900 * coalesce((v - min(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0), 0), 6) AS population FROM s WINDOW p AS (PARTITION BY event_type)""",
    "mixed_profiles": """WITH g AS (SELECT n_name AS name, n_nationkey % 11 / 10.0::DOUBLE AS mix, h AS hour, CAST('0x' || substr(md5('profile-1:' || n_name || ':' || h), 1, 12) AS BIGINT) / 140737488355328.0::DOUBLE - 1 AS z FROM nation, range(24) t(h))
SELECT name, CAST(hour AS INTEGER) AS hour, round((mix * (1 - cos(hour * (2 * pi() / 24))) + (1 - mix) * (1 - cos(2 * (hour * (2 * pi() / 24))))) * (1 + 0.1::DOUBLE * z), 9) AS value FROM g""",
    "sum_of_file_means": "SELECT wday, hour, round(sum(m), 6) AS total FROM (SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS wday, CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS m FROM events GROUP BY ALL) GROUP BY ALL",
    "prior_month_weekday": """WITH c AS (SELECT o_orderpriority AS cam, CAST(o_orderdate AS DATE) AS day, count(*) AS cnt FROM orders GROUP BY ALL), m AS (SELECT cam, CAST(date_trunc('month', day) AS DATE) AS month, CAST(isodow(day) - 1 AS INTEGER) AS wday, avg(cnt) AS mean FROM c GROUP BY ALL),
w AS (SELECT month, wday, sum(mean) AS now FROM m GROUP BY ALL) SELECT a.month, a.wday, round(a.now, 6) AS now, round(b.now, 6) AS prior FROM w a LEFT JOIN w b ON b.wday = a.wday AND CAST(b.month + INTERVAL 1 MONTH AS DATE) = a.month""",
    "second_best": "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 2",
    "attraction_cap": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "merged_columns": f"""SELECT {_H} AS bin, CASE WHEN event_type IN ('click', 'view') THEN 'site' ELSE 'shop' END AS "group", count(*) AS cnt FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup') GROUP BY ALL""",
    "split_counter": f"SELECT bin, source, cnt // 3 AS cnt FROM (SELECT {_H} AS bin, count(*) AS cnt FROM events GROUP BY 1), (VALUES ('a'), ('b'), ('c')) t(source)",
    "tag_lengths": "SELECT s_suppkey, CAST(length(s_name) - 2 AS INTEGER) AS stops FROM supplier",
    "name_parts": "SELECT s_suppkey, s_suppkey AS run, DATE '2024-01-01' AS start, DATE '2024-01-31' AS stop FROM supplier",
    "unix_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label FROM events",
    "zone_clocks": """SELECT event_id, ts - INTERVAL 1 HOUR AS utc, ts + INTERVAL 1 HOUR AS local, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS label FROM events WHERE ts < TIMESTAMP '2024-03-31 00:00:00'
UNION ALL SELECT event_id, timezone('UTC', timezone('Europe/Rome', ts)), timezone('Europe/Rome', timezone('UTC', ts)), strftime(timezone('UTC', timezone('Europe/Rome', ts)), '%Y-%m-%dT%H:%M:%S') FROM events WHERE ts >= TIMESTAMP '2024-03-31 00:00:00'""",
    "list_products": "SELECT r_name || ',' || b || ',' || c AS combo FROM region, (VALUES ('x'), ('y')) t(b), (VALUES ('1'), ('2'), ('3')) u(c)",
    "month_names": "SELECT o_orderkey, monthname(o_orderdate) AS name, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders",
    "destination_choice": """WITH p AS (SELECT s_nationkey, s_suppkey AS place, greatest(s_acctbal, 0) AS score FROM supplier)
SELECT s_nationkey, place, round(score / nullif(sum(score) OVER (PARTITION BY s_nationkey), 0), 9) AS share, round(sum(score) OVER (PARTITION BY s_nationkey ORDER BY score DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(score) OVER (PARTITION BY s_nationkey), 0), 9) AS upto FROM p""",
    "snapshots": "SELECT event_id, ts FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) % 300 = 0",
    "simulated_beside_real": f"SELECT {_H} AS bin, event_type, count(*) AS real, CAST(round(sum(value) / 50) AS BIGINT) AS simulated, CAST(round(sum(value) / 50) AS BIGINT) - count(*) AS difference FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL",
    "route_report": "WITH l AS (SELECT l_orderkey, count(*) AS length, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) SELECT length, count(*) AS created, count(*) FILTER (WHERE done) AS used, round(avg(CAST(done AS INTEGER)), 9) AS share FROM l GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
