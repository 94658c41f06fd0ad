"""Sensor clean-up, demand curves and source splits over long tables of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.joins import within_radius


def without_sparse(counts: DataFrame, key: str, way: str, bins: int, most: float) -> DataFrame:
    """counts (key, way, bin, ...) without the keys of which a way lacks more than a share ``most`` of all ``bins``.

    Both ways of a key go together: what comes in without what goes out is of no use.
    """
    seen = counts.groupBy(key, way).agg(F.countDistinct("bin").alias("_n"))
    sparse = seen.filter(1 - F.col("_n") / bins > most).select(key).distinct()
    return counts.join(sparse, key, "left_anti")


def unique_of_each(df: DataFrame, bin_: Column, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column by bin."""
    return df.groupBy(bin_.alias("bin")).agg(*(F.countDistinct(c).alias(c) for c in columns))


def by_time(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Series (bin, cnt) side by side, one column each, 0 where one has no row."""
    long = None
    for name, df in tables.items():
        part = df.select("bin", F.lit(name).alias("name"), "cnt")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("bin").pivot("name", list(tables)).agg(F.sum("cnt")).na.fill(0)


def ordered_pairs(places: DataFrame, blocks: int = 16) -> DataFrame:
    """origin, destination, cnt 0 for all ordered pairs of different places: the empty form of an origin-destination matrix.

    Its size is the square of the number of places, which is the number of stations and not of detections. Places are
    dealt to blocks, and each pair of blocks is a task's work of its own.
    """
    block = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = places.select("place").filter("place IS NOT NULL").distinct().withColumn("own", block)
    rows = each.select(F.col("place").alias("origin"), F.col("own").alias("i"), every.alias("j"))
    columns = each.select(F.col("place").alias("destination"), every.alias("i"), F.col("own").alias("j"))
    return rows.join(columns, ["i", "j"]).filter("origin <> destination").select("origin", "destination", F.lit(0).alias("cnt"))


def merged_columns(long: DataFrame, groups: DataFrame) -> DataFrame:
    """bin, group, cnt: series (bin, name, cnt) added up by the group that each name is mapped to (name, group)."""
    return long.join(groups, "name").groupBy("bin", "group").agg(F.sum("cnt").alias("cnt"))


def split_counter(counts: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One counter dealt evenly to sources, cut to whole numbers."""
    each = F.explode(F.array(*(F.lit(s) for s in sources)))
    return counts.select("bin", each.alias("source"), F.floor(F.col("cnt") / len(sources)).alias("cnt"))


def level_of_hour(hour: Column, levels: Sequence[tuple[int, float]]) -> Column:
    """The level of the last (from hour, level) that has begun; levels ascend by hour and begin with 0."""
    out = F.lit(levels[0][1])
    for start, level in levels[1:]:
        out = F.when(hour >= start, F.lit(level)).otherwise(out)
    return out


def scaled(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Each key's values stretched to [low, high]; a series of one value is at low."""
    per = Window.partitionBy(*keys)
    least, most = F.min(value).over(per), F.max(value).over(per)
    share = F.coalesce(F.try_divide(F.col(value) - least, most - least), F.lit(0.0))
    return df.withColumn(value, low + share * (high - low))


def noise(name: Column, step: Column, seed: str) -> Column:
    """A number in [-1, 1) from a hash of seed, name and step: reruns and retried tasks agree."""
    key = F.concat(F.lit(f"{seed}:"), name, F.lit(":"), step.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 47)) - 1


def mixed_profile(names: DataFrame, hours: int, seed: str, share: float = 0.1) -> DataFrame:
    """name, hour, value: each name's own mix of a one-peak and a two-peak day, with ``share`` of noise; names: name, mix."""
    grid = names.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    turn = F.col("hour") * (2 * 3.141592653589793 / hours)
    one, two = 1 - F.cos(turn), 1 - F.cos(2 * turn)
    value = (F.col("mix") * one + (1 - F.col("mix")) * two) * (1 + share * noise(F.col("name"), F.col("hour"), seed))
    return grid.select("name", "hour", value.alias("value"))


def sum_of_means(df: DataFrame, part: str, keys: Sequence[str], value: str) -> DataFrame:
    """The mean of each part (a file, a camera) by keys, summed over the parts."""
    return df.groupBy(part, *keys).agg(F.avg(value).alias("_mean")).groupBy(*keys).agg(F.sum("_mean").alias("total"))


def beside_prior_month(daily: DataFrame) -> DataFrame:
    """month, wday, now, prior: sums over cameras of weekday means beside those of the month before; daily: cam, day, cnt."""
    means = daily.groupBy("cam", F.trunc("day", "month").alias("month"), F.weekday("day").alias("wday")).agg(F.avg("cnt").alias("mean"))
    whole = means.groupBy("month", "wday").agg(F.sum("mean").alias("now"))
    before = whole.select(F.add_months("month", 1).alias("month"), "wday", F.col("now").alias("prior"))
    return whole.join(before, ["month", "wday"], "left")


def nth_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The row that is n-th in order within each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", at).filter(F.col("_r") == n).drop("_r")


def cumulative_choice(places: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Each place's share of its key's scores and the running share, best first: the table a destination is drawn from."""
    per = Window.partitionBy(*keys)
    run = per.orderBy(F.desc(score), "place").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(score).over(per)
    return places.withColumn("share", F.try_divide(F.col(score), whole)).withColumn("upto", F.try_divide(F.sum(score).over(run), whole))


def choice_in_radius(places: DataFrame, radius: float) -> DataFrame:
    """For each place (place, x, y, component, score) the others within the radius that its network reaches, drawn by score.

    place, other, share of the scores in reach, and the running share from the least score on (ties by place). Where
    all scores in reach are 0 the shares are null.
    """
    left = places.select(F.col("place").alias("id"), "x", "y")
    right = places.select(F.col("place").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = within_radius(left, right, radius).filter("id <> other").select(F.col("id").alias("place"), "other")
    own = places.select("place", "component")
    to = places.select(F.col("place").alias("other"), F.col("component").alias("_there"), "score")
    reached = near.join(own, "place").join(to, "other").filter("component = _there")
    per = Window.partitionBy("place")
    run = per.orderBy("score", "other").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("score").over(per)
    return reached.select("place", "other", F.try_divide("score", whole).alias("share"), F.try_divide(F.sum("score").over(run), whole).alias("upto"))


def decoded_way(code: Column, names: Mapping[str, str]) -> Column:
    """The letter of a direction code in its name (second character), A for a code without a name."""
    mapped = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.substring(F.try_element_at(mapped, code), 2, 1), F.lit("A"))
