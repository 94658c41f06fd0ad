"""Queries over time series of detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import anomaly, series
from footfall.sources.tables import detections, table

R = 6


def unique_devices_15min(spark, d):
    out = series.unique_per_bin(detections(spark, d), ["station_name"], "date_time", "mac_address", "15 minutes")
    return out.withColumnRenamed("cnt", "devices")


def records_per_bin(spark, d):
    return series.records_per_bin(detections(spark, d), ["station_name"], "date_time", "10 minutes")


def _hourly(spark, d, fill=0):
    rows = detections(spark, d)
    counts = series.unique_per_bin(rows, ["station_name"], "date_time", "mac_address", "1 hour")
    return series.dense(counts, ["station_name"], *series.day_bounds(rows, "date_time"), "1 hour", fill)


def dense_counts(spark, d):
    return _hourly(spark, d)


def interpolated_counts(spark, d):
    full = _hourly(spark, d, None).withColumn("date", F.to_date("bin"))
    out = series.interpolate(full, ["station_name", "date"], "bin", "cnt")
    return out.select("station_name", "bin", F.round("cnt", R).alias("cnt"))


def cumulative_unique(spark, d):
    return series.cumulative_unique(detections(spark, d), "station_name", "date_time", "mac_address", 30)


def weekday_profile(spark, d):
    out = series.weekday_profile(_hourly(spark, d), ["station_name"], "bin", "cnt")
    return out.select("station_name", "wday", "tod", F.round("mean", R).alias("mean"))


def weekday_class_profile(spark, d):
    profile = series.weekday_profile(_hourly(spark, d), ["station_name"], "bin", "cnt")
    return series.class_profile(profile, ["station_name"])


WDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def profile_pivot(spark, d):
    profile = weekday_profile(spark, d)
    return profile.groupBy("station_name", "tod").pivot("wday", WDAYS).agg(F.first("mean"))


def counts_unpivot(spark, d):
    return profile_pivot(spark, d).unpivot(["station_name", "tod"], WDAYS, "wday", "mean")


def box_smooth(spark, d):
    out = series.box_smooth(_hourly(spark, d), ["station_name"], "bin", "cnt", 8)
    out = series.box_smooth(out, ["station_name"], "bin", "cnt", 4, "trail", trailing=True)
    return out.select("station_name", "bin", F.round("smooth", R).alias("smooth"), F.round("trail", R).alias("trail"))


def day_comparison(spark, d):
    """Each day's smoothed quarter hours less those of the day before and of a week before, smoothed again."""
    rows = detections(spark, d).select("station_name", F.to_date("date_time").alias("day"), (F.hour("date_time") * 4 + F.floor(F.minute("date_time") / 15)).cast("int").alias("slot"))
    out = series.compared_days(rows.groupBy("station_name", "day", "slot").agg(F.count(F.lit(1)).alias("cnt")), ["station_name"], 96, (1, 7), 5)
    return out.select("station_name", "day", "slot", *(F.round(c, R).alias(c) for c in ("smooth", "less_1", "less_7")))


def rolling_mean3(spark, d):
    out = series.rolling_mean3(_hourly(spark, d), ["station_name"], "bin", "cnt")
    return out.select("station_name", "bin", F.round("mean", R).alias("mean"))


def local_anomaly_kpi(spark, d):
    out = anomaly.local_anomaly(anomaly.observed(detections(spark, d), "1 hour"))
    # The operator compares differences rounded to nine places; these are only shown shorter.
    return out.select(
        "station_name", "bin", F.round("base", 4).alias("base"), F.round("diff", 4).alias("diff"),
        F.round("l2_cut", 4).alias("l2_cut"), "kpi",
    )


def daily_l2_anomaly(spark, d):
    out = anomaly.daily_distance(anomaly.observed(detections(spark, d), "1 hour"))
    return out.select("station_name", "date", F.round("l2_norm", 4).alias("l2_norm"), F.round("l2_norm_d", 4).alias("l2_norm_d"))


def _daily(spark, d):
    return detections(spark, d).groupBy("station_name", F.to_date("date_time").alias("date")).agg(F.count(F.lit(1)).alias("cnt"))


def wday_pct_change(spark, d):
    out = anomaly.weekday_change(_daily(spark, d), ["station_name"], "date", "cnt")
    return out.select("station_name", "date", "cnt", F.round("pct", 4).alias("pct"))


def trend_increment(spark, d):
    out = anomaly.trend_increment(_daily(spark, d), ["station_name"], "date", "cnt")
    return out.select("station_name", "date", F.round("pct", 4).alias("pct"))


def daily_trend_regression(spark, d):
    out = anomaly.trend_regression(_daily(spark, d), ["station_name"], "date", "cnt")
    return out.select(
        "station_name", "n", F.round("slope", 4).alias("slope"), F.round("r", 4).alias("r"), F.round("stderr", 4).alias("stderr"), F.round("p", 6).alias("p")
    )


def upsample_preserve_total(spark, d):
    out = series.upsample_total(_hourly(spark, d), ["station_name"], "cnt", 3600, 900)
    return out.select("station_name", "bin", F.round("cnt", R).alias("cnt"))


def monthly_rescale(spark, d):
    """Each order day's share of its month's total per calendar day."""
    orders = table(spark, d, "orders")
    month = F.date_trunc("month", "o_orderdate")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))
    total = orders.groupBy(F.to_date(month).alias("month")).agg(F.count(F.lit(1)).alias("total"))
    joined = daily.withColumn("month", F.to_date(F.date_trunc("month", "day"))).join(total, "month")
    per_day = F.col("total") / F.dayofmonth(F.last_day("month"))
    return joined.select("day", "cnt", F.round(per_day, R).alias("per_day"), F.round(F.col("cnt") / per_day, R).alias("ratio"))


def week_deviation(spark, d):
    """Each hour against the mean curve of its ISO week, in percent of that curve's mean."""
    rows = _hourly(spark, d).withColumn("week", F.weekofyear("bin")).withColumn("tod", series.second_of_day("bin"))
    curve = rows.groupBy("station_name", "week", "tod").agg(F.avg("cnt").alias("curve"))
    level = curve.groupBy("station_name", "week").agg(F.avg("curve").alias("level"))
    joined = rows.join(curve, ["station_name", "week", "tod"]).join(level, ["station_name", "week"])
    pct = F.try_divide((F.col("cnt") - F.col("curve")) * 100, F.col("level"))
    return joined.select("station_name", "bin", F.round(pct, 4).alias("pct"))


_DAYS = "(SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) + 1 AS b FROM events)"
_GRID = f"""grid AS (
  SELECT s.event_type AS station_name, unnest(generate_series(CAST(b.a AS TIMESTAMP), CAST(b.b AS TIMESTAMP) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bin
  FROM (SELECT DISTINCT event_type FROM events) s, {_DAYS} b
), counts AS (
  SELECT event_type AS station_name, time_bucket(INTERVAL '1 hour', ts) AS bin, count(DISTINCT user_id) AS cnt FROM events GROUP BY 1, 2
), raw AS (SELECT g.station_name, g.bin, c.cnt FROM grid g LEFT JOIN counts c USING (station_name, bin)),
dense AS (SELECT station_name, bin, coalesce(cnt, 0) AS cnt FROM raw)"""
_INTERPOLATED = """num AS (
  SELECT *, CAST(bin AS DATE) AS date, row_number() OVER (PARTITION BY station_name, CAST(bin AS DATE) ORDER BY bin) AS i FROM raw
), known AS (
  SELECT *, last_value(cnt IGNORE NULLS) OVER p AS l, last_value(CASE WHEN cnt IS NOT NULL THEN i END IGNORE NULLS) OVER p AS li,
    first_value(cnt IGNORE NULLS) OVER f AS r, first_value(CASE WHEN cnt IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ri
  FROM num WINDOW p AS (PARTITION BY station_name, date ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY station_name, date ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT station_name, bin, date, CAST(CASE WHEN ri > li THEN l + (r - l) * (i - li) / CAST(ri - li AS DOUBLE) ELSE coalesce(l, r) END AS DOUBLE) AS cnt
  FROM known
)"""
_WD = "strftime({0}, '%a')"
_TOD = "CAST(hour({0}) * 3600 + minute({0}) * 60 + second({0}) AS INTEGER)"


def _smooth(name: str, source: str, keys: str, order: str, value: str, box: int, low: int, out: str) -> str:
    """CTE text: circular box mean over offsets low to low + box - 1."""
    same = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    return f"""{name}_n AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i_, count(*) OVER (PARTITION BY {keys}) AS n_ FROM {source}
), {name} AS (
  SELECT a.* EXCLUDE (i_, n_), s.v / {box} AS {out} FROM {name}_n a JOIN (
    SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.i_, sum(b.{value}) AS v FROM {name}_n a
    JOIN range({low}, {low + box}) o(d) ON true JOIN {name}_n b ON {same} AND b.i_ = (a.i_ + o.d + a.n_) % a.n_ GROUP BY ALL
  ) s ON {same.replace("b.", "s.")} AND a.i_ = s.i_
)"""


_PROFILE = f"profile AS (SELECT station_name, {_WD.format('bin')} AS wday, {_TOD.format('bin')} AS tod, avg(cnt) AS mean FROM dense GROUP BY ALL)"
_ROUNDED = "SELECT station_name, wday, tod, round(mean, 6) AS mean FROM profile"
_PIVOTED = (
    "SELECT station_name, tod, "
    + ", ".join(f"max(CASE WHEN wday = '{w}' THEN round(mean, 6) END) AS {w}" for w in WDAYS)
    + " FROM profile GROUP BY ALL"
)
_FILLED_PROFILE = (
    f"profile AS (SELECT station_name, {_WD.format('bin')} AS wday, {_TOD.format('bin')} AS tod, avg(cnt) AS mean FROM filled GROUP BY ALL)"
)
_DAILY = "daily AS (SELECT event_type AS station_name, CAST(ts AS DATE) AS date, count(*) AS cnt FROM events GROUP BY ALL)"

SQL = {
    "unique_devices_15min": "SELECT event_type AS station_name, time_bucket(INTERVAL '15 minutes', ts) AS bin, count(DISTINCT user_id) AS devices FROM events GROUP BY 1, 2",
    "records_per_bin": "SELECT event_type AS station_name, time_bucket(INTERVAL '10 minutes', ts) AS bin, count(*) AS cnt FROM events GROUP BY 1, 2",
    "dense_counts": f"WITH {_GRID} SELECT station_name, bin, cnt FROM dense",
    "interpolated_counts": f"WITH {_GRID}, {_INTERPOLATED} SELECT station_name, bin, round(cnt, 6) AS cnt FROM filled",
    "cumulative_unique": """WITH seen AS (
  SELECT event_type AS station_name, CAST(ts AS DATE) AS date, user_id, min(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS first
  FROM events GROUP BY ALL
), labels AS (SELECT DISTINCT station_name, date FROM seen)
SELECT l.station_name, l.date, CAST(m.minute AS INTEGER) AS minute, (SELECT count(*) FROM seen s WHERE s.station_name = l.station_name AND s.date = l.date AND s.first < m.minute * 60) AS cnt
FROM labels l, range(0, 1440, 30) m(minute)""",
    "weekday_profile": f"WITH {_GRID}, {_PROFILE} {_ROUNDED}",
    "weekday_class_profile": f"""WITH {_GRID}, {_PROFILE} SELECT station_name, tod,
  CAST(trunc(avg(mean) FILTER (WHERE wday NOT IN ('Sat', 'Sun'))) AS INTEGER) AS feriali,
  CAST(trunc(avg(mean) FILTER (WHERE wday IN ('Sat', 'Sun'))) AS INTEGER) AS festivi FROM profile GROUP BY ALL""",
    "profile_pivot": f"WITH {_GRID}, {_PROFILE} {_PIVOTED}",
    "counts_unpivot": f"WITH {_GRID}, {_PROFILE}, p AS ({_PIVOTED}) "
    + " UNION ALL ".join(f"SELECT station_name, tod, '{w}' AS wday, {w} AS mean FROM p" for w in WDAYS),
    "box_smooth": f"WITH {_GRID}, {_smooth('a1', 'dense', 'station_name', 'bin', 'cnt', 8, -3, 'smooth')}, {_smooth('a2', 'a1', 'station_name', 'bin', 'cnt', 4, -3, 'trail')} "
    "SELECT station_name, bin, round(smooth, 6) AS smooth, round(trail, 6) AS trail FROM a2",
    "rolling_mean3": f"WITH {_GRID} SELECT station_name, bin, round(avg(cnt) OVER (PARTITION BY station_name ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mean FROM dense",
    "local_anomaly_kpi": f"""WITH {_GRID}, {_INTERPOLATED}, {_FILLED_PROFILE},
whole AS (SELECT station_name, wday, tod, CAST(trunc(mean) AS INTEGER) AS mean FROM profile),
{_smooth('b', 'whole', 'station_name, wday', 'tod', 'mean', 5, -1, 'base')},
tiled AS (SELECT f.station_name, f.bin, f.cnt, b.base FROM filled f JOIN b ON b.station_name = f.station_name AND b.wday = {_WD.format('f.bin')} AND b.tod = {_TOD.format('f.bin')}),
{_smooth('s1', 'tiled', 'station_name', 'bin', 'cnt', 5, -1, 'cnt_smooth')},
l2 AS (SELECT *, pow(cnt - base, 2) AS l2, round(cnt_smooth - base, 9) AS diff FROM s1),
{_smooth('s2', 'l2', 'station_name', 'bin', 'l2', 5, -1, 'l2_smooth')},
lim AS (SELECT station_name, avg(l2_smooth) + stddev_pop(l2_smooth) AS t, round(quantile_cont(diff, 0.2), 9) AS lo, round(quantile_cont(diff, 0.8), 9) AS hi FROM s2 GROUP BY 1)
SELECT s.station_name, s.bin, round(s.base, 4) AS base, round(s.diff, 4) AS diff, round(CASE WHEN s.l2_smooth >= lim.t THEN s.l2_smooth ELSE 0 END, 4) AS l2_cut,
  CASE WHEN s.diff > lim.hi THEN 3 WHEN s.diff > lim.lo THEN 2 ELSE 1 END AS kpi FROM s2 s JOIN lim USING (station_name)""",
    "daily_l2_anomaly": f"""WITH {_GRID}, {_INTERPOLATED}, {_FILLED_PROFILE},
cls AS (SELECT station_name, tod, CAST(trunc(avg(mean) FILTER (WHERE wday NOT IN ('Sat', 'Sun'))) AS INTEGER) AS feriali, CAST(trunc(avg(mean) FILTER (WHERE wday IN ('Sat', 'Sun'))) AS INTEGER) AS festivi FROM profile GROUP BY ALL),
r AS (SELECT f.*, CASE WHEN p.wday IN ('Sat', 'Sun') THEN festivi ELSE feriali END AS base, CAST(trunc(p.mean) AS INTEGER) AS day_base FROM filled f
  JOIN profile p ON p.station_name = f.station_name AND p.wday = {_WD.format('f.bin')} AND p.tod = {_TOD.format('f.bin')} JOIN cls c ON c.station_name = f.station_name AND c.tod = p.tod)
SELECT station_name, date, round(sqrt(sum(pow(cnt - base, 2))) / nullif(sqrt(sum(pow(base, 2))), 0), 4) AS l2_norm,
  round(sqrt(sum(pow(cnt - day_base, 2))) / nullif(sqrt(sum(pow(day_base, 2))), 0), 4) AS l2_norm_d FROM r GROUP BY ALL""",
    "wday_pct_change": f"WITH {_DAILY}, m AS (SELECT *, avg(cnt) OVER (PARTITION BY station_name, isodow(date)) AS mean FROM daily) SELECT station_name, date, cnt, round((cnt - mean) * 100 / nullif(mean, 0), 4) AS pct FROM m",
    "trend_increment": f"WITH {_DAILY}, m AS (SELECT *, first_value(cnt) OVER (PARTITION BY station_name ORDER BY date) AS f FROM daily) SELECT station_name, date, round((cnt - f) * 100.0::DOUBLE / nullif(f, 0), 4) AS pct FROM m",
    "daily_trend_regression": f"""WITH {_DAILY}, x AS (SELECT station_name, CAST(cnt AS DOUBLE) AS y, CAST(date_diff('day', DATE '0001-01-01', date) + 1 AS DOUBLE) AS x FROM daily),
f AS (SELECT station_name, count(*) AS n, regr_slope(y, x) AS slope, corr(y, x) AS r, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM x GROUP BY 1),
e AS (SELECT *, sqrt(greatest(0, syy - slope * slope * sxx) / (n - 2) / sxx) AS stderr FROM f), a AS (SELECT *, atan(abs(slope / stderr) / sqrt(n - 2)) AS w FROM e),
k AS (SELECT station_name, sum(CASE WHEN n % 2 = 0 THEN exp(lgamma(i + 0.5) - lgamma(i + 1) - lgamma(0.5)) * pow(cos(w), 2 * i) ELSE exp(lgamma(i + 1) - lgamma(i + 1.5) + lgamma(1.5)) * pow(cos(w), 2 * i + 1) END) AS total
  FROM a, range(1000) t(i) WHERE i < (n - 2) // 2 GROUP BY 1)
SELECT station_name, n, round(slope, 4) AS slope, round(r, 4) AS r, round(stderr, 4) AS stderr, round(1 - CASE WHEN n % 2 = 0 THEN sin(w) * coalesce(total, 0) ELSE (w + sin(w) * coalesce(total, 0)) * 2 / pi() END, 6) AS p FROM a LEFT JOIN k USING (station_name)""",
    "upsample_preserve_total": f"""WITH {_GRID}, fine AS (
  SELECT station_name, bin + to_minutes(CAST(15 * k AS BIGINT)) AS bin, CASE WHEN k = 0 THEN cnt END AS cnt, bin AS b0 FROM dense, range(0, 4) r(k)
), cut AS (SELECT f.station_name, f.bin, f.cnt FROM fine f JOIN (SELECT max(bin) AS last FROM dense) m ON f.bin <= m.last),
num AS (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY bin) AS i FROM cut),
known AS (
  SELECT *, last_value(cnt IGNORE NULLS) OVER p AS l, last_value(CASE WHEN cnt IS NOT NULL THEN i END IGNORE NULLS) OVER p AS li,
    first_value(cnt IGNORE NULLS) OVER f AS r, first_value(CASE WHEN cnt IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ri
  FROM num WINDOW p AS (PARTITION BY station_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY station_name ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), v AS (SELECT station_name, bin, CASE WHEN ri > li THEN l + (r - l) * (i - li) / CAST(ri - li AS DOUBLE) ELSE coalesce(l, r) END AS x FROM known),
t AS (SELECT station_name, sum(cnt) AS total FROM dense GROUP BY 1)
SELECT v.station_name, v.bin, round(v.x * t.total / sum(v.x) OVER (PARTITION BY v.station_name), 6) AS cnt FROM v JOIN t USING (station_name)""",
    "monthly_rescale": """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS cnt FROM orders GROUP BY 1),
m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS total FROM orders GROUP BY 1)
SELECT day, cnt, round(total / CAST(day(last_day(month)) AS DOUBLE), 6) AS per_day, round(cnt / (total / CAST(day(last_day(month)) AS DOUBLE)), 6) AS ratio
FROM d JOIN m ON CAST(date_trunc('month', d.day) AS DATE) = m.month""",
    "week_deviation": f"""WITH {_GRID}, r AS (SELECT *, weekofyear(bin) AS week, {_TOD.format('bin')} AS tod FROM dense),
c AS (SELECT station_name, week, tod, avg(cnt) AS curve FROM r GROUP BY ALL), l AS (SELECT station_name, week, avg(curve) AS level FROM c GROUP BY ALL)
SELECT r.station_name, r.bin, round((r.cnt - c.curve) * 100 / nullif(l.level, 0), 4) AS pct FROM r JOIN c USING (station_name, week, tod) JOIN l USING (station_name, week)""",
    "day_comparison": """WITH c AS (SELECT event_type AS station_name, CAST(ts AS DATE) AS day, hour(ts) * 4 + minute(ts) // 15 AS slot, count(*) AS cnt FROM events GROUP BY ALL),
g AS (SELECT k.station_name, k.day, s AS slot, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT station_name, day, s FROM c, range(96) r(s)) k LEFT JOIN c ON c.station_name = k.station_name AND c.day = k.day AND c.slot = k.s),
m AS (SELECT station_name, day, (slot - o + 96) % 96 AS slot, sum(cnt) / 5.0::DOUBLE AS v FROM g, range(-1, 4) r(o) GROUP BY ALL),
f AS (SELECT m.station_name, m.day, m.slot, m.v, m.v - a.v AS a, m.v - b.v AS b FROM m LEFT JOIN m a ON a.station_name = m.station_name AND a.slot = m.slot AND a.day = m.day - 1 LEFT JOIN m b ON b.station_name = m.station_name AND b.slot = m.slot AND b.day = m.day - 7),
t AS (SELECT station_name, day, (slot - o + 96) % 96 AS slot, sum(a) / 5.0::DOUBLE AS a, sum(b) / 5.0::DOUBLE AS b FROM f, range(-1, 4) r(o) GROUP BY ALL)
SELECT f.station_name, f.day, CAST(f.slot AS INTEGER) AS slot, round(f.v, 6) AS smooth, round(t.a, 6) AS less_1, round(t.b, 6) AS less_7 FROM f JOIN t USING (station_name, day, slot)""",
}

QUERIES = {name: globals()[name] for name in SQL}
