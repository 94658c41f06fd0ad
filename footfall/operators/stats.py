"""Histograms, quantile bins, covariances, coverage, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.graph import _cut


def quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """keys and cuts, the interpolated quantiles of the values that aren't null; keys without any have no row.

    Different values are counted, dealt to ranges of (keys, value) and numbered by running sums within a range and over
    the ranges, so that no task holds a key's values; a quantile is read off the values that hold its two ranks.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = _cut(counted.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    upto = [Window.unboundedPreceding, -1]
    # One row a range.
    firsts = dealt.groupBy("_range").agg(F.sum("_n").alias("_all")).select(
        "_range", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(*upto)), F.lit(0)).alias("_first")
    )
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(*keys, "_v").rowsBetween(*upto)), F.lit(0))
    placed = dealt.withColumn("_within", within).join(firsts, "_range").withColumn("_at", F.col("_first") + F.col("_within"))
    size = placed.groupBy(*keys).agg(F.min("_at").alias("_start"), F.sum("_n").alias("_size"))
    ranks = F.transform(F.array(*map(F.lit, quantiles)), lambda q: F.col("_start") + q * (F.col("_size") - 1))
    wanted = size.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), ranks.alias("_ranks"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # The ranks' lower and upper neighbours that lie in a value's run.
    ends = F.flatten(F.transform("_ranks", lambda r, i: F.array(F.struct(i.alias("i"), F.floor(r).alias("rank"), (1 - r + F.floor(r)).alias("w")), F.struct(i.alias("i"), (F.floor(r) + 1).alias("rank"), (r - F.floor(r)).alias("w")))))
    here = F.filter(ends, lambda e: (e["w"] > 0) & (e["rank"] >= F.col("_at")) & (e["rank"] < F.col("_at") + F.col("_n")))
    found = placed.join(wanted, same).withColumn("_here", here).filter(F.size("_here") > 0)
    parts = found.select(*keys, "_v", F.explode("_here").alias("e")).groupBy(*keys, F.col("e.i").alias("i")).agg(F.sum(F.col("_v") * F.col("e.w")).alias("cut"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda c: c["cut"]).alias("cuts"))


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, quantiles_: Sequence[float]) -> DataFrame:
    """The right-closed bin of each value between the keys' interpolated quantiles: 0 for the first; null below it."""
    cuts = quantiles(df, keys, value, quantiles_).withColumnRenamed("cuts", "_cuts")
    level = F.size(F.filter("_cuts", lambda c: c < F.col(value))) - 1
    return df.join(cuts, list(keys), "left").withColumn(
        "level", F.when((level >= 0) & (F.col(value) <= F.element_at("_cuts", -1)), level)
    ).drop("_cuts")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins over [low, high], the last closed; values outside are left out; with density."""
    width = (high - low) / bins
    inside = df.filter(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    return counted.withColumn("density", F.col("cnt") / (total * width))


def tagged_histogram(df: DataFrame, tag: str, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Per tag: counts of bins, values below dropped, those above in the last bin, and the running share."""
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(value) >= low).groupBy(tag, at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    per = Window.partitionBy(tag)
    run = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("cdf", F.sum("cnt").over(run) / F.sum("cnt").over(per))


def covariances(df: DataFrame, tag: str, values: Sequence[str]) -> DataFrame:
    """Population covariance of each pair of columns, per tag, in one pass."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    wide = df.groupBy(tag).agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(
        *(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs)
    )
    return wide.select(tag, F.inline(rows))


def coverage(df: DataFrame, keys: Sequence[str], time: str, freq: str) -> DataFrame:
    """1 for each key and bin with rows."""
    return df.groupBy(*keys, F.window(time, freq)["start"].alias("bin")).agg(F.lit(1).alias("seen"))


def scaled(df: DataFrame, keys: Sequence[str], value: str, total: float) -> DataFrame:
    """A series as shares of its maximum, between 0 and 1, and summing to ``total``."""
    per = Window.partitionBy(*keys)
    x, low, high, whole = F.col(value), F.min(value).over(per), F.max(value).over(per), F.sum(value).over(per)
    return (
        df.withColumn("by_max", F.try_divide(x, high))
        .withColumn("by_range", F.try_divide(x - low, high - low))
        .withColumn("by_total", F.when(whole != 0, x * total / whole).otherwise(x.cast("double")))
    )


def source_weights(df: DataFrame, weight: str, measured: str) -> DataFrame:
    """Weights normalised over the sources that are not measured; measured ones keep weight 1."""
    rest = df.agg(F.sum(F.when(~F.col(measured), F.col(weight))).alias("_rest"))
    # One row on the side that is broadcast.
    joined = df.join(F.broadcast(rest))
    return joined.withColumn("share", F.when(F.col(measured), F.lit(1.0)).otherwise(F.try_divide(F.col(weight), F.col("_rest")))).drop("_rest")


def carried_counts(rates: DataFrame, keys: Sequence[str], order: str, rate: str, parts: int) -> DataFrame:
    """Each rate over ``parts`` steps as whole counts, the fraction carried over; an exact 1 waits for the next step.

    The running sum of fractions after i steps has let out ceil(sum) - 1 extra ones, or none yet; rounding to 1e-9 keeps
    sums such as 1/3 + 1/3 + 1/3 exact.
    """
    steps = rates.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    each = F.col(rate) / parts
    run = Window.partitionBy(*keys).orderBy(order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("_carry", F.round(F.sum(each - F.floor(each)).over(run), 9))
    out = summed.withColumn("_out", F.greatest(F.ceil("_carry") - 1, F.lit(0)))
    before = F.coalesce(F.lag("_out").over(Window.partitionBy(*keys).orderBy(order, "_k")), F.lit(0))
    return out.select(
        *keys, order, F.col("_k").alias("part"), (F.floor(each) + F.col("_out") - before).cast("bigint").alias("created")
    )


def unit_sum(value: str | Column, keys: Sequence[str]) -> Column:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.when(total != 0, F.col(value) / total).otherwise(F.col(value))
