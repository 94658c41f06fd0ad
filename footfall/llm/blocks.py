"""Large groups whose members have to be compared, in blocks that one task can hold.

A group is dealt to blocks, and each block is compared alone by whoever uses this module. ``meet_heads`` and
``left_over`` then say what else has to meet, so that all that is connected inside a group is found: ids are group, node,
blocks (how many the group has) and block; links are a, b.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import join_groups, written
from footfall.llm.components import components


def whole_buckets(batches):
    """Tables of whole buckets, of batches that are sorted by bucket."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        bucket = table.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1], side="left")) if len(bucket) else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def runs(bucket: np.ndarray):
    """(first, end) of each run of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    return zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def joined_known(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids with ``known``, the least node that the links reach."""
    now = components(links).withColumnRenamed("component", "known")
    return ids.join(now, "node", "left").withColumn("known", F.coalesce("known", "node"))


def meet_heads(ids: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """links and those between the connected parts of each group: one member of each part stands for it.

    Parts of two or more members send one; ``verify`` (bucket, id) compares blocks of these. This goes on until they fit
    in a block, or are no longer half as many as the time before.
    """
    before = None
    while True:
        parts = joined_known(ids, links).groupBy("group", "known").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
        heads = written(parts.filter("n > 1").select("group", "node"), "heads")
        count = heads.groupBy("group").agg(F.count(F.lit(1)).alias("heads"))
        found = count.agg(F.sum("heads").alias("all"), F.max("heads").alias("most")).first()
        if not found["all"] or found["most"] < 2 or (before is not None and 2 * found["all"] > before):
            return links
        before = found["all"]
        meet = join_groups(heads, count, ["group"], F.col("node")).filter("heads > 1")
        part = F.pmod(F.xxhash64("node", F.lit(before)), F.ceil(F.col("heads") / block))
        links = links.unionByName(written(verify(meet.select(F.xxhash64("group", part).alias("bucket"), F.col("node").alias("id"))), "head-links"))
        if found["most"] <= block:
            return links


def left_over(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids of the groups that the links don't connect in full, with known, left (not in the group's main part) and rest."""
    known = written(joined_known(ids, links), "known")
    parts = known.groupBy("group", "known").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("group").agg(F.max_by("known", F.struct("n", -F.col("known"))).alias("main"))
    known = join_groups(known, main, ["group"], F.col("node")).withColumn("left", F.col("known") != F.col("main"))
    rest = known.filter("left").groupBy("group").agg(F.count(F.lit(1)).alias("rest"))
    return written(join_groups(known, rest, ["group"], F.col("node")).filter("rest IS NOT NULL").drop("main"), "left-over")


def cells(known: DataFrame, block: int, wide: int) -> DataFrame:
    """bucket, group, id, block, known, left of what ``left_over`` gave: each left member meets all of its group.

    A cell holds a share of the left members and the members of ``wide`` blocks, each about ``block * wide`` members.
    """
    placed = (
        known.withColumn("rows", F.ceil(F.col("rest") / (block * wide)))
        .withColumn("columns", F.ceil(F.col("blocks") / wide))
        .withColumn("own", F.floor(F.col("block") / wide))
    )
    as_left = F.transform(
        F.sequence(F.lit(0), F.col("columns") - 1),
        lambda m: F.struct(F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")).alias("r"), m.alias("m")),
    )
    as_any = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("own").alias("m")))
    cell = F.explode(F.when(F.col("left"), F.array_distinct(F.concat(as_left, as_any))).otherwise(as_any))
    return placed.withColumn("cell", cell).select(
        F.xxhash64("group", "cell.r", "cell.m").alias("bucket"), "group", F.col("node").alias("id"), "block", "known", "left"
    )
