"""Counts per time bin, dense series, interpolation, profiles and smoothing.

Series are long tables: key columns, a time, a value. Windows are always partitioned by the keys of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_start(time: str | Column, freq: str) -> Column:
    return F.window(time, freq)["start"]


def unique_per_bin(df: DataFrame, keys: Sequence[str], time: str, ident: str, freq: str) -> DataFrame:
    """Distinct idents per key and bin; bins without rows are absent."""
    return df.groupBy(*keys, bin_start(time, freq).alias("bin")).agg(F.countDistinct(ident).alias("cnt"))


def records_per_bin(df: DataFrame, keys: Sequence[str], time: str, freq: str) -> DataFrame:
    return df.groupBy(*keys, bin_start(time, freq).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def day_bounds(df: DataFrame, time: str) -> tuple[str, str]:
    """The first day and the day after the last one, as ISO dates; one small aggregate."""
    row = df.agg(F.min(F.to_date(time)).alias("a"), F.max(F.date_add(F.to_date(time), 1)).alias("b")).first()
    return str(row["a"] or "1970-01-01"), str(row["b"] or "1970-01-01")


def spine(keyed: DataFrame, start: str, stop: str, freq: str) -> DataFrame:
    """Each row of keyed with every bin start in [start, stop)."""
    grid = F.sequence(
        F.expr(f"timestamp_ntz'{start} 00:00:00'"),
        F.expr(f"timestamp_ntz'{stop} 00:00:00'") - F.expr(f"interval {freq}"),
        F.expr(f"interval {freq}"),
    )
    return keyed.withColumn("bin", F.explode(grid))


def dense(counts: DataFrame, keys: Sequence[str], start: str, stop: str, freq: str, fill: int | None = 0) -> DataFrame:
    """counts (keys, bin, cnt) on the full grid of each key, empty bins filled."""
    full = spine(counts.select(*keys).distinct(), start, stop, freq).join(counts, [*keys, "bin"], "left")
    return full if fill is None else full.withColumn("cnt", F.coalesce("cnt", F.lit(fill)))


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Linear by position inside, flat at both ends, within each key; a key without a value stays null."""
    by = Window.partitionBy(*keys).orderBy(order)
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, so that this frame grows row by row as well.
    future = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_i", F.row_number().over(by))
    place = F.when(F.col(value).isNotNull(), F.col("_i"))
    known = (
        numbered.withColumn("_l", F.last(value, ignorenulls=True).over(past))
        .withColumn("_li", F.last(place, ignorenulls=True).over(past))
        .withColumn("_r", F.last(value, ignorenulls=True).over(future))
        .withColumn("_ri", F.last(place, ignorenulls=True).over(future))
    )
    between = F.col("_l") + (F.col("_r") - F.col("_l")) * (F.col("_i") - F.col("_li")) / (F.col("_ri") - F.col("_li"))
    filled = F.when(F.col("_ri") > F.col("_li"), between).otherwise(F.coalesce("_l", "_r"))
    return known.withColumn(value, filled.cast("double")).drop("_i", "_l", "_li", "_r", "_ri")


def cumulative_unique(df: DataFrame, station: str, time: str, ident: str, minutes: int) -> DataFrame:
    """station, date, label minute T and how many idents were seen that day before T."""
    seen = df.groupBy(station, F.to_date(time).alias("date"), ident).agg(
        F.min(F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)).alias("first")
    )
    step = minutes * 60
    per = seen.groupBy(station, "date", (F.floor(F.col("first") / step) + 1).cast("int").alias("slot")).agg(
        F.count(F.lit(1)).alias("new")
    )
    labels = (
        per.select(station, "date")
        .distinct()
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24 * 60 // minutes - 1))))
    )
    running = Window.partitionBy(station, "date").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    joined = labels.join(per, [station, "date", "slot"], "left")
    return joined.select(
        station,
        "date",
        (F.col("slot") * minutes).alias("minute"),
        F.coalesce(F.sum("new").over(running), F.lit(0)).alias("cnt"),
    )


def aligned_bounds(start: str, stop: str, minutes: int) -> tuple[str, str]:
    """A closed range of whole bins: the start of start's bin, and a second before that of stop's; bins count from midnight."""
    from datetime import datetime, timedelta

    def floor(at: str) -> datetime:
        t = datetime.fromisoformat(at)
        midnight = t.replace(hour=0, minute=0, second=0, microsecond=0)
        return midnight + (t - midnight) // timedelta(minutes=minutes) * timedelta(minutes=minutes)

    return floor(start).isoformat(" "), (floor(stop) - timedelta(seconds=1)).isoformat(" ")


def weekday_name(time: str | Column) -> Column:
    return F.date_format(time, "E")


def second_of_day(time: str | Column) -> Column:
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def weekday_profile(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Mean per key, weekday (Mon to Sun) and second of the day."""
    return df.groupBy(*keys, weekday_name(time).alias("wday"), second_of_day(time).alias("tod")).agg(
        F.avg(value).alias("mean")
    )


def class_profile(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of weekday means for working days and weekends, cut to whole numbers."""
    weekend = F.col("wday").isin("Sat", "Sun")
    return profile.groupBy(*keys, "tod").agg(
        F.avg(F.when(~weekend, F.col("mean"))).cast("int").alias("feriali"),
        F.avg(F.when(weekend, F.col("mean"))).cast("int").alias("festivi"),
    )


def box_smooth(
    df: DataFrame, keys: Sequence[str], order: str, value: str, box: int, out: str = "smooth", trailing: bool = False
) -> DataFrame:
    """Circular box mean over each ordered series, which must be at least ``box`` long.

    Centred, the mean of x[(i + d) mod n] for d from h - box + 1 to h, h = ceil(n / 2) - floor((n - box) / 2), the
    offsets of a centred kernel applied by a discrete Fourier transform; trailing, d from 1 - box to 0. The series'
    ends are put before its start and after its end, so one window per series does it.
    """
    by = Window.partitionBy(*keys)
    placed = df.withColumn("_i", F.row_number().over(by.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    highs = (0, 0) if trailing else ((box + 1) // 2, (box + 1) // 2 if box % 2 else box // 2 + 1)
    reach = max(box, highs[1] + 1)
    turns = F.filter(
        F.array(
            F.struct(F.lit(0).alias("turn"), F.col("_i").alias("at")),
            F.struct(F.lit(1).alias("turn"), (F.col("_i") + F.col("_n")).alias("at")),
            F.struct(F.lit(-1).alias("turn"), (F.col("_i") - F.col("_n")).alias("at")),
        ),
        lambda t: (t["at"] >= -reach) & (t["at"] < F.col("_n") + reach),
    )
    long = placed.withColumn("_t", F.explode(turns)).withColumn("_at", F.col("_t.at"))
    frame = Window.partitionBy(*keys).orderBy("_at")

    def mean(high: int) -> Column:
        return F.sum(value).over(frame.rowsBetween(high - box + 1, high)) / box

    even, odd = highs
    smooth = mean(even) if even == odd else F.when(F.col("_n") % 2 == 0, mean(even)).otherwise(mean(odd))
    return long.withColumn(out, smooth).filter(F.col("_t.turn") == 0).drop("_i", "_n", "_t", "_at")


def compared_days(counts: DataFrame, keys: Sequence[str], slots: int, back: Sequence[int], box: int) -> DataFrame:
    """keys, day, slot, smooth and for each number of days back the smoothed difference to that day's smoothed counts.

    counts: keys, day, slot (0 to slots - 1), cnt; slots without a row count 0 on days that have any. Both smoothings go
    round the day. ``less_n`` is null where the day n days back has no row.
    """
    days = counts.select(*keys, "day").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    full = days.join(counts.select(*keys, "day", "slot", "cnt"), [*keys, "day", "slot"], "left").na.fill(0, ["cnt"])
    out = box_smooth(full, [*keys, "day"], "slot", "cnt", box)
    # One shifted copy a number of days: all differences from one aggregate, without a join for each.
    copies = F.array(*(F.struct(F.lit(n).alias("n"), F.date_add("day", n).alias("day")) for n in (0, *back)))
    moved = out.withColumn("c", F.explode(copies)).select(*keys, "c.day", "slot", "c.n", "smooth")
    wide = moved.groupBy(*keys, "day", "slot").agg(*(F.max(F.when(F.col("n") == n, F.col("smooth"))).alias(f"s{n}") for n in (0, *back))).filter("s0 IS NOT NULL")
    wide = wide.withColumnRenamed("s0", "smooth")
    for n in back:
        wide = box_smooth(wide.withColumn(f"s{n}", F.col("smooth") - F.col(f"s{n}")), [*keys, "day"], "slot", f"s{n}", box, f"less_{n}").drop(f"s{n}")
    return wide


def _fit_weights(window: int, order: int) -> list[list[float]]:
    """For each place of a window the weights that give its value of the polynomial fitted to the window."""
    import numpy as np

    basis = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return (basis @ np.linalg.pinv(basis)).tolist()


def savitzky_golay(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 9, degree: int = 3, out: str = "smooth") -> DataFrame:
    """Polynomial smoothing of each ordered series; the ends by the polynomial of the first and last window.

    A series shorter than ``window`` (odd) takes the greatest odd window that it has room for, and is left as it is where
    that can't fit the polynomial. Each value is a weighted sum over at most 2 * window - 1 neighbours. A null within the
    window makes its values null; order should have no ties.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    cell = F.collect_list(F.struct(F.col(value).cast("double").alias("v")))
    near = df.withColumn("_before", cell.over(by.rowsBetween(1 - window, -1))).withColumn("_after", cell.over(by.rowsBetween(0, window - 1)))
    before, after = F.size("_before"), F.size("_after") - 1
    whole = (before < window - 1) & (after < window - 1) & (before + after + 1 < window)
    room = before + after + 1
    size = F.when(whole, room - (room + 1) % 2).otherwise(window)
    half = F.floor(size / 2).cast("int")
    place = F.when(before < half, before).when(after < half, size - 1 - after).otherwise(half)
    smooth = F.col(value).cast("double")
    for w in range(window - (window + 1) % 2, degree, -2):
        rows = F.array(*(F.array(*map(F.lit, row)) for row in _fit_weights(w, degree)))
        seen = F.slice("_all", before - F.col("_place") + 1, F.lit(w))
        fitted = F.aggregate(F.zip_with(seen, F.element_at(rows, F.col("_place") + 1), lambda x, c: x["v"] * c), F.lit(0.0), lambda a, x: a + x)
        smooth = F.when(F.col("_size") == w, fitted).otherwise(smooth)
    placed = near.withColumn("_size", size).withColumn("_place", place).withColumn("_all", F.concat("_before", "_after"))
    return placed.withColumn(out, smooth).drop("_before", "_after", "_all", "_size", "_place")


def rolling_mean3(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Centred mean of three closed at both ends: two rows before to one after, over what is there."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-2, 1)
    return df.withColumn("mean", F.avg(value).over(frame))


def upsample_total(
    df: DataFrame, keys: Sequence[str], value: str, coarse_seconds: int, fine_seconds: int
) -> DataFrame:
    """Each key's series (bin, value) on a finer grid, interpolated, then scaled so that its total stays."""
    parts = coarse_seconds // fine_seconds
    last = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    marked = df.withColumn("_last", F.row_number().over(last) == 1)
    fine = marked.withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.when(F.col("_last"), F.lit(0)).otherwise(F.lit(parts - 1))))
    ).select(
        *keys,
        (F.col("bin") + F.expr(f"make_dt_interval(0, 0, 0, _k * {fine_seconds})")).alias("bin"),
        F.when(F.col("_k") == 0, F.col(value)).cast("double").alias(value),
    )
    filled = interpolate(fine, keys, "bin", value)
    whole = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    per_key = Window.partitionBy(*keys)
    summed = filled.withColumn("_sum", F.sum(value).over(per_key)).join(whole, [*keys])
    return summed.withColumn(
        value, F.when(F.col("_sum") != 0, F.col(value) * F.col("_total") / F.col("_sum")).otherwise(F.col(value))
    ).drop("_sum", "_total")
