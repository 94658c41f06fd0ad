"""Paths of devices between stations: origin and destination, transitions, dwell times, identity statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapsed_paths(df: DataFrame) -> DataFrame:
    """Rows of each device's day in time order whose station differs from the one before, with the day's row count."""
    day = F.to_date("date_time")
    by = Window.partitionBy("date", "mac_address")
    ordered = by.orderBy("date_time", "event_id")
    rows = df.withColumn("date", day).withColumn("n_rows", F.count(F.lit(1)).over(by))
    before = F.lag("station_name").over(ordered)
    return rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("station_name")))


def od_matrix(df: DataFrame) -> DataFrame:
    """origin, destination, trips and trips per day (whole), over the station changes within each device's day."""
    days = df.agg(F.countDistinct(F.to_date("date_time")).alias("days"))
    moves = collapsed_paths(df).filter(F.col("before").isNotNull())
    pairs = moves.groupBy(F.col("before").alias("origin"), F.col("station_name").alias("destination")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    return pairs.join(F.broadcast(days)).select(
        "origin", "destination", "trips", F.floor(F.col("trips") / F.col("days")).alias("per_day")
    )


def path_shares(df: DataFrame) -> DataFrame:
    """Device days: all, with one row, with several, with a station change, without one."""
    days = collapsed_paths(df).groupBy("date", "mac_address").agg(
        F.max("n_rows").alias("n"), F.count(F.lit(1)).alias("stops")
    )
    return days.agg(
        F.count(F.lit(1)).alias("activity"),
        F.count_if(F.col("n") == 1).alias("single"),
        F.count_if(F.col("n") > 1).alias("multi"),
        F.count_if((F.col("n") > 1) & (F.col("stops") > 1)).alias("path"),
        F.count_if((F.col("n") > 1) & (F.col("stops") == 1)).alias("rest"),
    )


def days_seen(df: DataFrame, below: int) -> DataFrame:
    """How many devices were seen, with several rows, on how many days."""
    active = (
        df.groupBy("mac_address", F.to_date("date_time").alias("date")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    per = active.groupBy("mac_address").agg(F.count(F.lit(1)).alias("days_seen"))
    return per.filter(F.col("days_seen") < below).groupBy("days_seen").agg(F.count(F.lit(1)).alias("ids"))


def transition_steps(df: DataFrame, start: str | None, steps: int) -> DataFrame:
    """Station changes by step, of devices that visit two stations or more (and begin at ``start``, if given)."""
    by = Window.partitionBy("mac_address")
    ordered = by.orderBy("date_time", "event_id")
    rows = (
        df.withColumn("next_station", F.lead("station_name").over(ordered))
        .withColumn("first", F.first_value("station_name").over(ordered))
        .withColumn("many", F.min("station_name").over(by) != F.max("station_name").over(by))
        .filter("many")
    )
    if start is not None:
        rows = rows.filter(F.col("first") == start)
    changes = rows.filter(F.col("next_station") != F.col("station_name"))
    numbered = changes.withColumn("step", F.row_number().over(ordered) - 1).filter(F.col("step") < steps)
    counted = numbered.groupBy("station_name", "next_station", "step").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("step"))
    return counted.withColumn("norm", F.round(share, 4))


def group_transitions(df: DataFrame, groups: DataFrame, steps: int = 1) -> DataFrame:
    """The same between groups of stations; groups: station_name, group. Stations without a group are left out."""
    mapped = df.join(groups, "station_name").drop("station_name").withColumnRenamed("group", "station_name")
    return transition_steps(mapped, None, steps)


def dwell_time(df: DataFrame, window: str, least_seconds: int = 10) -> DataFrame:
    """station_name, bin, ids that stayed, and their mean stay in minutes, rounded half to even."""
    stays = df.groupBy("station_name", F.window("date_time", window)["start"].alias("bin"), "mac_address").agg(
        (F.unix_timestamp(F.max("date_time")) - F.unix_timestamp(F.min("date_time"))).alias("stay")
    )
    kept = F.when(F.col("stay") >= least_seconds, F.col("stay"))
    return stays.groupBy("station_name", "bin").agg(
        F.count(kept).alias("ids"), F.bround(F.avg(kept) / 60, 0).alias("minutes")
    )


def id_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("mac_address").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.to_date("date_time")).alias("days"),
        F.countDistinct("station_name").alias("stations"),
    )


def top_ids(df: DataFrame, k: int) -> DataFrame:
    """The k devices with most rows among those of several stations: a report of the k first."""
    return id_statistics(df).filter("stations > 1").orderBy(F.desc("n"), "mac_address").limit(k)


def extremes(totals: DataFrame, value: str, ident: str, k: int) -> DataFrame:
    """The k rows of most and the k of least value, a report: side (top or bottom) first; ties go to the least ident."""
    top = totals.orderBy(F.desc(value), ident).limit(k).select(F.lit("top").alias("side"), "*")
    return top.unionByName(totals.orderBy(value, ident).limit(k).select(F.lit("bottom").alias("side"), "*"))


def visitors(df: DataFrame, freq: str) -> DataFrame:
    """Running arrivals less running departures; df: place, date_time, kind (IN or OUT)."""
    per = df.groupBy("place", F.window("date_time", freq)["start"].alias("bin")).agg(
        F.count_if(F.col("kind") == "IN").alias("ins"), F.count_if(F.col("kind") == "OUT").alias("outs")
    )
    so_far = Window.partitionBy("place").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per.withColumn("total_in", F.sum("ins").over(so_far))
        .withColumn("total_out", F.sum("outs").over(so_far))
        .withColumn("visitors", F.col("total_in") - F.col("total_out"))
    )
