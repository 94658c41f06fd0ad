"""Single steps of the domain's scripts over whole tables: ranges, keys, fills, draws, maps and notations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.functions import geo, text
from footfall.operators import agents, flows, series, stats
from footfall.sources.tables import detections, table

_FROM, _TO = series.aligned_bounds("2024-01-03 07:13:20", "2024-01-25 21:48:00", 15)


def aligned_sums(spark, d):
    """Values by quarter hour and place within a closed range of whole bins, then summed and averaged by place; sums of 0 are null."""
    rows = detections(spark, d).filter(F.col("date_time").between(F.lit(_FROM).cast("timestamp_ntz"), F.lit(_TO).cast("timestamp_ntz")))
    place = F.concat_ws("_", "station_name", (F.col("mac_address") % 10).cast("string"))
    bins = rows.groupBy(place.alias("place"), series.bin_start("date_time", "15 minutes").alias("bin")).agg(F.sum(F.floor("value").cast("bigint")).alias("total"))
    return bins.groupBy("place").agg(F.nullif(F.sum("total"), F.lit(0)).alias("total"), F.round(F.avg("total"), 6).alias("mean"))


def next_station(spark, d):
    """Each detection's next station of the device; the last one's is its own."""
    ahead = F.lead("station_name").over(Window.partitionBy("mac_address").orderBy("date_time", "event_id"))
    return detections(spark, d).select("event_id", F.coalesce(ahead, "station_name").alias("next"))


def device_chunks(spark, d):
    """How often a device is seen at a station in each chunk of six hours, and when first."""
    chunk = series.bin_start("date_time", "6 hours").alias("chunk")
    return detections(spark, d).groupBy(chunk, "mac_address", "station_name").agg(F.count(F.lit(1)).alias("cnt"), F.min("date_time").alias("first"))


def first_times(spark, d):
    """Times written in two forms, or in none, read by the first that fits."""
    k = F.col("o_orderkey") % 3
    form = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy_HH:mm")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy_HH:mm:ss")).otherwise("none")
    at = text.first_time(form, ["dd/MM/yyyy_HH:mm:ss", "dd/MM/yyyy_HH:mm"])
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(at.cast("timestamp")).alias("at"))


def nation_regions(spark, d):
    """Regions with their lists of nations turned around, and the region of each supplier's nation, if it has one."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = n.groupBy("r_name").agg(F.map_from_arrays(F.array("r_name"), F.array(F.collect_list("n_nationkey"))).alias("m"))
    owner = lists.select(F.explode(text.inverted("m")).alias("s_nationkey", "region"))
    return table(spark, d, "supplier").join(owner, "s_nationkey", "left").select("s_suppkey", "region").na.fill("NONE", ["region"])


def unit_sums(spark, d):
    """Each day's share of its station's detections."""
    days = detections(spark, d).groupBy("station_name", F.to_date("date_time").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))
    return days.select("station_name", "day", F.round(stats.unit_sum("cnt", ["station_name"]), 9).alias("share"))


def extreme_ids(spark, d):
    """The ten devices with most and the ten with fewest detections; ties go to the least device."""
    return flows.extremes(detections(spark, d).groupBy("mac_address").agg(F.count(F.lit(1)).alias("n")), "n", "mac_address", 10)


def iso_places(spark, d):
    """Places in the notation of ISO 6709 and back."""
    c = F.col("c_custkey")
    there = geo.to_iso6709((c % 361 - 180) / 2, (c * 7 % 1441 - 720) / 4)
    return table(spark, d, "customer").select("c_custkey", there.alias("iso"), geo.from_iso6709(there).alias("p")).select("c_custkey", "iso", "p.lat", "p.lon")


def letter_orders(spark, d):
    """All orders of one to three of the first letters of each segment."""
    s = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    letters = F.array_distinct(F.split(F.substring("seg", 1, 3), ""))
    return s.select("seg", F.explode(text.permutations(letters, 3)).alias("letters"))


def _drawn(salt: str):
    """A number in [0, 1) for each customer, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("c_custkey").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def created_agents(spark, d):
    """Customers as agents: a length bin drawn by its parts' value and the chance of such a way, then a brand by value within it."""
    p = table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 10).alias("bin"), F.col("p_brand").alias("brand")).agg(F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("w"))
    far = text.stop_probability(F.col("bin") + 0.5, "exp", 1.0)
    bins = p.groupBy("bin").agg(F.sum("w").alias("all")).select(F.lit(0).cast("bigint").alias("one"), "bin", (F.col("all") * far).alias("w"))
    lengths = agents.running_shares(bins, ["one"], "bin", "w").select(F.col("one").alias("bin"), "share", F.array(F.col("bin").cast("string")).alias("route"))
    brands = agents.running_shares(p, ["bin"], "brand", "w").select("bin", "share", F.array("brand").alias("route"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _drawn("a").alias("u"), _drawn("b").alias("v"))
    first = agents.created_from_weights(c.select("id", F.lit(0).cast("bigint").alias("bin"), "u"), lengths).select("id", F.col("route")[0].cast("bigint").alias("bin"))
    out = agents.created_from_weights(first.join(c.select("id", F.col("v").alias("u")), "id"), brands)
    return out.select("id", "bin", F.col("route")[0].alias("brand"))


_U = "CAST('0x' || substr(md5('{}' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"

SQL = {
    "aligned_sums": f"""WITH b AS (SELECT event_type || '_' || user_id % 10 AS place, time_bucket(INTERVAL '15 minutes', ts) AS bin, sum(CAST(floor(value) AS BIGINT)) AS total FROM events WHERE ts BETWEEN '{_FROM}' AND '{_TO}' GROUP BY ALL)
SELECT place, CAST(nullif(sum(total), 0) AS BIGINT) AS total, round(avg(total), 6) AS mean FROM b GROUP BY 1""",
    "next_station": "SELECT event_id, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type) AS next FROM events",
    "device_chunks": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS chunk, user_id AS mac_address, event_type AS station_name, count(*) AS cnt, min(ts) AS first FROM events GROUP BY ALL",
    "first_times": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(epoch(date_trunc('minute', o_orderdate)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) END AS at FROM orders",
    "nation_regions": "SELECT s_suppkey, coalesce(r_name, 'NONE') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "unit_sums": "SELECT event_type AS station_name, CAST(ts AS DATE) AS day, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY event_type) AS DOUBLE), 9) AS share FROM events GROUP BY 1, 2",
    "extreme_ids": """WITH n AS (SELECT user_id AS mac_address, count(*) AS n FROM events GROUP BY 1)
(SELECT 'top' AS side, * FROM n ORDER BY n DESC, mac_address LIMIT 10) UNION ALL (SELECT 'bottom', * FROM n ORDER BY n, mac_address LIMIT 10)""",
    "iso_places": "WITH p AS (SELECT c_custkey, (c_custkey % 361 - 180) / 2.0::DOUBLE AS lat, (c_custkey * 7 % 1441 - 720) / 4.0::DOUBLE AS lon FROM customer) SELECT c_custkey, printf('%+010.6f%+011.6f/', lat, lon) AS iso, lat, lon FROM p",
    "letter_orders": """WITH l AS (SELECT DISTINCT c_mktsegment AS seg, unnest(string_split(substr(c_mktsegment, 1, 3), '')) AS x FROM customer)
SELECT seg, x AS letters FROM l UNION ALL SELECT a.seg, a.x || ' ' || b.x FROM l a JOIN l b ON a.seg = b.seg AND a.x <> b.x
UNION ALL SELECT a.seg, a.x || ' ' || b.x || ' ' || c.x FROM l a JOIN l b ON a.seg = b.seg AND a.x <> b.x JOIN l c ON c.seg = a.seg AND c.x <> a.x AND c.x <> b.x""",
    "created_agents": f"""WITH p AS (SELECT p_size // 10 AS bin, p_brand AS brand, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) AS w FROM part GROUP BY ALL),
b AS (SELECT bin, sum(w) * exp(-(bin + 0.5::DOUBLE)) AS w FROM p GROUP BY bin),
bs AS (SELECT bin, (sum(w) OVER o - w) / sum(w) OVER () AS low, sum(w) OVER o / sum(w) OVER () AS upto FROM b WINDOW o AS (ORDER BY w DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ps AS (SELECT bin, brand, (sum(w) OVER o - w) / sum(w) OVER (PARTITION BY bin) AS low, sum(w) OVER o / sum(w) OVER (PARTITION BY bin) AS upto FROM p WINDOW o AS (PARTITION BY bin ORDER BY w DESC, brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT c_custkey AS id, {_U.format('a')} AS u, {_U.format('b')} AS v FROM customer)
SELECT id, CAST(bs.bin AS BIGINT) AS bin, brand FROM u JOIN bs ON u > bs.low AND u <= bs.upto JOIN ps ON ps.bin = bs.bin AND v > ps.low AND v <= ps.upto""",
}

QUERIES = {name: globals()[name] for name in SQL}
