"""Reports over agents: what a simulation's event and state tables say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trip_stats(events: DataFrame) -> DataFrame:
    """One row per agent from its last event: kind, trip time, life time and idle time; events: id, t, kind, triptime, lifetime."""
    last = events.groupBy("id").agg(F.max_by(F.struct("kind", "triptime", "lifetime"), F.struct("t", "event_id")).alias("e"))
    return last.select("id", "e.kind", "e.triptime", "e.lifetime", (F.col("e.lifetime") - F.col("e.triptime")).alias("idle"))


def population(states: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Living agents by time and tag, one column for each tag; states: t, id, tag, state."""
    alive = states.filter("state <> 'dead'")
    return alive.groupBy("t").pivot("tag", list(tags)).agg(F.count(F.lit(1))).na.fill(0)


def occupancy(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Agents on each edge, 0 where there are none."""
    counted = states.groupBy("lid").agg(F.count(F.lit(1)).alias("cnt"))
    return edges.select("lid", "length", "speed").join(counted, "lid", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def congested_speed(count: Column, length: Column, speed: Column, critical: float = 4.0, lowest: float = 0.15) -> Column:
    """Speed falls in a line with density and is never below ``lowest``."""
    return F.greatest(F.lit(lowest), (1 - count / length / critical) * speed)


def admitted(queue: DataFrame, capacity: DataFrame) -> DataFrame:
    """First come, first in: those of each place and hour whose turn is within its capacity; queue: place, hour, id, t."""
    turn = F.row_number().over(Window.partitionBy("place", "hour").orderBy("t", "id"))
    return queue.withColumn("turn", turn).join(capacity, ["place", "hour"]).filter("turn <= capacity")


def barrier_crossings(moves: DataFrame, barriers: DataFrame) -> DataFrame:
    """Counts of barriers passed along edges: moves: lid, s, ds, forward; barriers: tag, lid, at."""
    joined = moves.join(barriers, "lid")
    s, ds, at = F.col("s"), F.col("ds"), F.col("at")
    forward = F.col("forward") & (((s < at) & (s + ds > at)) | ((s > at) & (s - ds < 0)))
    back = ~F.col("forward") & (((s > at) & (s - ds < at)) | ((s < at) & (s - ds < 0)))
    return joined.groupBy("tag").agg(F.count_if(forward).alias("ins"), F.count_if(back).alias("outs"))


def unique_on_edges(states: DataFrame, freq: str) -> DataFrame:
    """Distinct agents by edge, direction and time bin; states: lid, forward, id, t."""
    return states.groupBy("lid", "forward", F.window("t", freq)["start"].alias("bin")).agg(F.countDistinct("id").alias("ids"))


#: Slices of [0, 1) that draws and running shares are dealt to.
SLICES = 64


def running_shares(weights: DataFrame, keys: Sequence[str], item: str, weight: str) -> DataFrame:
    """keys, item, low and share: each item's part of [0, 1) within its key, heaviest first, ties by item; weights of 0 or less have none."""
    some = weights.filter(F.col(weight) > 0)
    run = Window.partitionBy(*keys).orderBy(F.desc(weight), item).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(weight).over(run)
    whole = some.groupBy(*keys).agg(F.sum(weight).alias("_whole"))
    shares = some.withColumn("_upto", upto).join(whole, list(keys)) if keys else some.withColumn("_upto", upto).join(F.broadcast(whole))
    return shares.select(*keys, item, ((F.col("_upto") - F.col(weight)) / F.col("_whole")).alias("low"), (F.col("_upto") / F.col("_whole")).alias("share"))


def created_from_weights(draws: DataFrame, shares: DataFrame) -> DataFrame:
    """The route of each draw u in [0, 1): the first whose running share is u or more; shares: bin, share, route.

    A route stands in the slices of [0, 1) that its part of its bin touches, and a draw meets the routes of its own bin and
    slice alone, so draws of one bin don't meet in one task. Draws of bins without routes have a null one.
    """
    below = F.lag("share", 1, -1.0).over(Window.partitionBy("bin").orderBy("share", "route"))
    place = lambda x: F.least(F.floor(x * SLICES), F.lit(SLICES - 1)).cast("int")
    parts = shares.select("bin", "route", "share", below.alias("low")).filter("share > low")
    parts = parts.withColumn("slice", F.explode(F.sequence(F.greatest(place(F.col("low")), F.lit(0)), place(F.col("share")))))
    inside = (F.col("u") <= F.col("share")) & (F.col("u") > F.col("low"))
    d = draws.withColumn("slice", place(F.col("u"))).alias("d")
    met = d.join(parts.alias("p"), (F.col("d.bin") == F.col("p.bin")) & (F.col("d.slice") == F.col("p.slice")) & inside, "left")
    return met.select("id", "d.bin", "route")
