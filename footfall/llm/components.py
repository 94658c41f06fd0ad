"""Connected components of a table of links, by union-find in partitions and star contraction between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import discard, join_groups, tidy, written


def local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's links replaced by links to the least node of their local components: a node appears once."""
    import numpy as np
    import pyarrow as pa

    def unite(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    low, high = (ra, rb) if ra < rb else (rb, ra)
                    parent[high] = low
                    parent.setdefault(low, low)
        nodes = [x for x in parent if find(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(part, np.int64)), pa.array(np.array([find(x) for x in part], np.int64))],
                names=["a", "b"],
            )

    return edges.select("a", "b").mapInArrow(tidy(unite), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of the links (a, b bigint, any order, repeats allowed).

    Large-star and small-star rounds run until each node hangs on its component's least node; every round is written to
    the shared folder. Grouped minima combine before they are shuffled, so a node with very many links costs no task
    more than its share.
    """
    tree = local_forest(edges.filter(F.col("a") != F.col("b")))
    tree = written(tree.distinct(), "links")
    while True:
        both = tree.select("a", "b").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's larger neighbours link to the least of its neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # A hub's neighbours are dealt to several parts.
        upward = join_groups(both.filter(F.col("b") > F.col("a")), least, ["a"], F.col("b"), parts=8)
        large = upward.select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node's smaller neighbours and itself link to the least of them.
        large = large.filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        before, tree = tree, written(small, "links")
        discard(before)
        # A forest of depth one: no node is both a child and a parent, and each child has one parent.
        stats = tree.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
        if not stats["n"] or (stats["n"] == 1 and tree.join(tree.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()):
            break
    roots = tree.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
