"""Anomalies of counters against their weekday profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import stats
from footfall.operators import series
from footfall.operators.graph import _cut


def observed(detections: DataFrame, freq: str) -> DataFrame:
    """station_name, bin, cnt on full days: distinct devices, empty bins interpolated within each day."""
    start, stop = series.day_bounds(detections, "date_time")
    counts = series.unique_per_bin(detections, ["station_name"], "date_time", "mac_address", freq)
    full = series.dense(counts, ["station_name"], start, stop, freq, fill=None).withColumn("date", F.to_date("bin"))
    return series.interpolate(full, ["station_name", "date"], "bin", "cnt")


def smooth_profile(counts: DataFrame, box: int) -> DataFrame:
    """station_name, wday, tod, base: weekday means cut to whole numbers and smoothed around the day."""
    profile = series.weekday_profile(counts, ["station_name"], "bin", "cnt").withColumn("mean", F.col("mean").cast("int"))
    return series.box_smooth(profile, ["station_name", "wday"], "tod", "mean", box, "base").drop("mean")


def local_anomaly(counts: DataFrame, box: int = 5, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Each bin with its squared and plain difference to the profile, both smoothed, and a level 1 (low) to 3 (high).

    Thresholds are taken per station over the whole range: mean plus population deviation for the squared difference,
    interpolated quantiles for the plain one. Differences are compared to nine places, so that the order in which means are
    summed decides no tie. The counts, a row for each station and bin, are written once, as both the profile and the
    differences are made of them.
    """
    counts = _cut(counts)
    base = smooth_profile(counts, box)
    tiled = counts.withColumn("wday", series.weekday_name("bin")).withColumn("tod", series.second_of_day("bin"))
    joined = tiled.join(base, ["station_name", "wday", "tod"])
    smooth = series.box_smooth(joined, ["station_name"], "bin", "cnt", box, "cnt_smooth")
    squared = smooth.withColumn("l2", F.pow(F.col("cnt") - F.col("base"), 2))
    squared = series.box_smooth(squared, ["station_name"], "bin", "l2", box, "l2_smooth")
    diff = squared.withColumn("diff", F.round(F.col("cnt_smooth") - F.col("base"), 9))
    per = Window.partitionBy("station_name")
    judged = (
        diff.withColumn("l2_limit", F.avg("l2_smooth").over(per) + F.stddev_pop("l2_smooth").over(per))
        .withColumn("low", F.round(F.percentile("diff", F.lit(low)).over(per), 9))
        .withColumn("high", F.round(F.percentile("diff", F.lit(high)).over(per), 9))
    )
    level = F.when(F.col("diff") > F.col("high"), 3).when(F.col("diff") > F.col("low"), 2).otherwise(1)
    return judged.select(
        "station_name",
        "bin",
        "cnt",
        "base",
        "diff",
        F.when(F.col("l2_smooth") >= F.col("l2_limit"), F.col("l2_smooth")).otherwise(F.lit(0.0)).alias("l2_cut"),
        level.alias("kpi"),
    )


def daily_distance(counts: DataFrame) -> DataFrame:
    """Per station and date: distance to the day class's profile and to the weekday's, over the profile's norm."""
    profile = series.weekday_profile(counts, ["station_name"], "bin", "cnt")
    classes = series.class_profile(profile, ["station_name"])
    weekday = profile.select("station_name", "wday", "tod", F.col("mean").cast("int").alias("day_base"))
    rows = (
        counts.withColumn("wday", series.weekday_name("bin"))
        .withColumn("tod", series.second_of_day("bin"))
        .join(classes, ["station_name", "tod"])
        .join(weekday, ["station_name", "wday", "tod"])
        .withColumn("base", F.when(F.col("wday").isin("Sat", "Sun"), F.col("festivi")).otherwise(F.col("feriali")))
    )

    def norm(x):
        return F.sqrt(F.sum(F.pow(x, 2)))

    return rows.groupBy("station_name", F.to_date("bin").alias("date")).agg(
        F.try_divide(norm(F.col("cnt") - F.col("base")), norm(F.col("base"))).alias("l2_norm"),
        F.try_divide(norm(F.col("cnt") - F.col("day_base")), norm(F.col("day_base"))).alias("l2_norm_d"),
    )


def weekday_change(daily: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Percent difference to the mean of the same weekday; null where that is 0."""
    mean = F.avg(value).over(Window.partitionBy(*keys, F.weekday(day)))
    return daily.withColumn("pct", F.try_divide((F.col(value) - mean) * 100, mean))


def trend_increment(daily: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Percent difference to the first day of the key."""
    first = F.first_value(value).over(
        Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return daily.withColumn("pct", F.try_divide((F.col(value) - first) * 100, first))


def trend_regression(daily: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Slope, intercept, correlation, the slope's standard error over ordinal days, and the p-value of no trend.

    p is null for fewer than three days; a perfect line has p 0, and days without any variation 1.
    """
    x = F.datediff(F.to_date(day), F.lit("0001-01-01").cast("date")) + 1
    rows = daily.withColumn("_x", x.cast("double")).withColumn("_y", F.col(value).cast("double"))
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.corr("_y", "_x").alias("r"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
    )
    left = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"))
    error = F.sqrt(F.try_divide(left, (F.col("n") - 2).cast("double")) / F.col("_sxx"))
    p = F.when(F.col("stderr") > 0, stats.t_two_sided(F.col("slope") / F.col("stderr"), F.col("n") - 2)).when(
        F.col("n") > 2, F.when(F.col("slope") == 0, 1.0).otherwise(0.0)
    )
    return fit.withColumn("stderr", error).withColumn("p", p).drop("_sxx", "_syy")
