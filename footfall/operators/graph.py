"""Road graphs: nodes, weights, components, cleaning and shortest paths as joins and grouped minima.

An edge table has lid, nf, nt (its end nodes), length, and where needed speed, cnt_ft, cnt_tf, oneway and level.
Iterative operators cut their lineage with tables in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.scratch import shared_folder

#: A weight that closes an edge. Fixed value.
CLOSED = 1e8


#: Row groups of tables of long rows. A reader holds up to 4,096 rows of a row group at once, and a writer looks at the size
#: of what it holds after 100 rows if it isn't told to do so after each. Compressed, a row group could hold any number.
_LONG = {"compression": "uncompressed", "parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def _cut(df: DataFrame, long: bool = False) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read back. long: rows may have megabytes.

    Unlike a checkpoint's, the size of the table that is read is its real one, so that joins of later rounds are planned
    by it, and estimates don't grow with the number of rounds.
    """
    path = shared_folder(df.sparkSession, "graph")
    df.write.options(**(_LONG if long else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _drop(*tables: DataFrame) -> None:
    """Delete tables of ``_cut`` that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge from either end: node, other, forward and the kept columns."""
    there = edges.select(F.col("nf").alias("node"), F.col("nt").alias("other"), F.lit(True).alias("forward"), *keep)
    back = edges.select(F.col("nt").alias("node"), F.col("nf").alias("other"), F.lit(False).alias("forward"), *keep)
    return there.unionByName(back)


def nodes(edges: DataFrame) -> DataFrame:
    """node and its degree."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def numbered(rows: DataFrame, keys: Sequence[str], out: str = "number") -> DataFrame:
    """rows with dense numbers from 0 in the order of their keys, which should be unique. A written table.

    Rows are dealt to ranges of the keys and counted there; a range's first number is the sum of the counts before it, a
    sum over one row for each range. No task sees all rows.
    """
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    # The low bits count the rows of a partition.
    placed = _cut(placed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_range", before.alias("_first"))
    done = _cut(placed.join(first, "_range").withColumn(out, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first"))
    _drop(placed)
    return done


def placed_nodes(points: DataFrame) -> DataFrame:
    """number, node, x, y of the nodes of polyline ends (node, lid, x, y) in the order of node; the greatest lid's place wins."""
    last = points.groupBy("node").agg(F.max(F.struct("lid", "x", "y")).alias("p")).select("node", "p.x", "p.y")
    return numbered(last, ["node"]).select("number", "node", "x", "y")


def directed_weights(edges: DataFrame, alpha: float = 1.0, alpha_speed: float = 0.0, vmin: float = 1.0, lowest: float = 1, highest: float = 2) -> DataFrame:
    """lid, nf, nt, w_ft, w_tf: length weighed with speed and use; one-way edges are closed the other way.

    oneway: 0 both ways, 1 from nf to nt only, 2 from nt to nf only, 3 closed.
    """

    def weight(count: str) -> Column:
        used = (1 / F.col(count) - 1 / F.lit(highest)) / (1 / F.lit(lowest) - 1 / F.lit(highest))
        return F.col("length") * (alpha + alpha_speed * (vmin / F.col("speed")) + (1 - alpha - alpha_speed) * used)

    return edges.select(
        "lid",
        "nf",
        "nt",
        F.when(F.col("oneway").isin(0, 1), weight("cnt_ft")).otherwise(F.lit(CLOSED)).alias("w_ft"),
        F.when(F.col("oneway").isin(0, 2), weight("cnt_tf")).otherwise(F.lit(CLOSED)).alias("w_tf"),
    )


def flooded(weights: DataFrame, levels: DataFrame, height: float, water: float) -> DataFrame:
    """Weights with edges closed whose level less ``height`` is not over the water; level 0 means unknown, and open."""
    joined = weights.join(levels.select("lid", "level"), "lid")
    is_open = (F.col("level") - height > water) | (F.col("level") == 0)
    return joined.select("lid", "nf", "nt", *(F.when(is_open, F.col(c)).otherwise(F.lit(CLOSED)).alias(c) for c in ("w_ft", "w_tf")))


def transition_classes(edges: DataFrame) -> DataFrame:
    """node, lid, cnt, total, others: what leaves each node by each edge, and what all edges there sum to.

    The share of traffic that turns from edge x into edge y at a node is y's cnt / (x's total - x's cnt), or 1 / others
    where that is less than 1; so these rows, two for each edge, say all that ``transitions`` lists in pairs.
    """
    ends = both_ways(edges, "lid", "cnt_ft", "cnt_tf")
    cnt = F.when(F.col("forward"), F.col("cnt_ft")).otherwise(F.col("cnt_tf"))
    rows = ends.select("node", "lid", cnt.alias("cnt"))
    sums = rows.groupBy("node").agg(F.sum("cnt").alias("total"), (F.count(F.lit(1)) - 1).alias("others"))
    return rows.join(sums, "node").select("node", "lid", "cnt", "total", "others")


def transitions(edges: DataFrame) -> DataFrame:
    """lid, next_lid, share: how traffic leaving an edge at either end spreads over the other edges there, all pairs.

    Shares follow the counts in the direction of travel; all alike where they sum to less than 1. For few nodes;
    ``transition_classes`` is linear in the edges.
    """
    ends = both_ways(edges, "lid", "cnt_ft", "cnt_tf")
    after = ends.select(
        "node", F.col("lid").alias("next_lid"), F.when(F.col("forward"), F.col("cnt_ft")).otherwise(F.col("cnt_tf")).alias("cnt")
    )
    pairs = ends.select("node", "lid").join(after, "node").filter(F.col("lid") != F.col("next_lid"))
    per = Window.partitionBy("node", "lid")
    total, n = F.sum("cnt").over(per), F.count(F.lit(1)).over(per)
    return pairs.withColumn("share", F.when(total < 1, 1 / n).otherwise(F.col("cnt") / total)).select("node", "lid", "next_lid", "share")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): labels spread and jump to their label's label until nothing changes."""
    pairs = _cut(both_ways(edges).select("node", "other").distinct())
    labels = _cut(pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        spread = (
            pairs.join(labels.select(F.col("node").alias("other"), "component"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("m"))
        )
        near = labels.join(spread, "node").select("node", F.least("component", "m").alias("c"))
        # Only nodes that are labels are looked up: few once components have grown, and then Spark broadcasts them.
        labelled = near.select(F.col("c").alias("node")).distinct()
        jump = near.join(labelled, "node", "left_semi").select(F.col("node").alias("c"), F.col("c").alias("root"))
        moved = _cut(near.join(jump, "c").select("node", F.least("c", "root").alias("component")))
        changed = moved.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").isEmpty()
        labels = moved
        if changed:
            return labels


def drop_small(edges: DataFrame, least: float = 0.05) -> DataFrame:
    """edges without those of components that hold less than a share of all nodes."""
    labels = components(edges)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = labels.agg(F.count(F.lit(1)).alias("total"))
    # One row on the side that is broadcast.
    keep = sizes.join(F.broadcast(total)).filter(F.col("n") >= least * F.col("total")).select("component")
    kept = labels.join(keep, "component", "left_semi").select(F.col("node").alias("nf"))
    return edges.join(kept, "nf", "left_semi")


def without_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each pair of end nodes, the shortest, then the least lid."""
    pair = Window.partitionBy(F.least("nf", "nt"), F.greatest("nf", "nt")).orderBy("length", "lid")
    return edges.withColumn("_r", F.row_number().over(pair)).filter("_r = 1").drop("_r")


def checked(edges: DataFrame) -> DataFrame:
    """lid and what is wrong with it: null loop, loop, or a double or multiple of another edge."""
    pair = Window.partitionBy(F.least("nf", "nt"), F.greatest("nf", "nt"))
    n = F.count(F.lit(1)).over(pair)
    kind = (
        F.when((F.col("nf") == F.col("nt")) & (F.col("length") == 0), "null_loop")
        .when(F.col("nf") == F.col("nt"), "loop")
        .when(n == 2, "double")
        .when(n > 2, "multi")
    )
    return edges.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("lid", "kind")


def without_stubs(edges: DataFrame, shorter: float) -> DataFrame:
    """edges without short dead ends."""
    ends = nodes(edges).filter("degree = 1").select("node")
    short = edges.filter(F.col("length") < shorter)
    stubs = both_ways(short, "lid").join(ends, "node", "left_semi").select("lid")
    return edges.join(stubs, "lid", "left_anti")


def chains(edges: DataFrame) -> DataFrame:
    """lid, chain: edges that meet in nodes of degree 2 are one chain, named by its least lid."""
    inner = nodes(edges).filter("degree = 2").select("node")
    links = (
        both_ways(edges, "lid").join(inner, "node", "left_semi").groupBy("node").agg(F.min("lid").alias("nf"), F.max("lid").alias("nt"))
    )
    found = components(links.filter("nf <> nt").select("nf", "nt"))
    joined = edges.join(found.select(F.col("node").alias("lid"), F.col("component").alias("chain")), "lid", "left")
    return joined.select("lid", F.coalesce("chain", "lid").alias("chain"), "length")


def chain_places(edges: DataFrame) -> DataFrame:
    """lid, chain, place, forward, nf, nt: where each edge stands in its chain, and the chain's two end nodes.

    A chain runs from its lesser end node; forward says whether the edge does so too. It is named by the lesser lid of its
    two end edges. Each edge is walked both ways, and each walk learns the end it leads to by looking up the walk that it
    has reached, so a chain of n edges takes log2(n) rounds. Rings without an end have no rows.
    """
    ways = both_ways(edges, "lid")
    inner = ways.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("a"), F.max("lid").alias("b"))
    inner = _cut(inner.filter("n = 2 AND a <> b").select("node"))
    walks = _cut(ways.select((F.col("lid") * 2 + F.col("forward").cast("int")).alias("walk"), "lid", F.col("node").alias("tail"), F.col("other").alias("head")))
    there = walks.join(inner.select(F.col("node").alias("head")), "head", "left_semi")
    after = walks.join(inner.select(F.col("node").alias("tail")), "tail", "left_semi")
    after = after.select(F.col("tail").alias("head"), F.col("walk").alias("at"), F.col("lid").alias("_next"), F.col("head").alias("end"))
    going = there.join(after, "head").filter("lid <> _next").select("walk", "at", "end", F.lit(1).cast("bigint").alias("hops"))
    done = _cut(
        walks.join(inner.select(F.col("node").alias("head")), "head", "left_anti").select("walk", F.col("walk").alias("at"), F.col("head").alias("end"), F.lit(0).cast("bigint").alias("hops"))
    )
    going = _cut(going)
    while True:
        # No two walks that still go on have reached the same walk, so no key of this join is hot.
        ahead = lambda df: df.select(F.col("walk").alias("at"), F.col("at").alias("_at"), F.col("end").alias("_end"), F.col("hops").alias("_hops"))
        moved = lambda df: going.join(ahead(df), "at").select("walk", F.col("_at").alias("at"), F.col("_end").alias("end"), (F.col("hops") + F.col("_hops")).alias("hops"))  # noqa: E731, B023
        ended = _cut(moved(done))
        if ended.isEmpty():
            break
        done, going = done.unionByName(ended), _cut(moved(going))
    both = done.withColumn("lid", F.shiftright("walk", 1)).withColumn("ft", F.col("walk") % 2 == 1)
    one = both.filter("ft").select("lid", F.struct("end", "at").alias("f"), F.col("hops").alias("hops_f"))
    two = both.filter("NOT ft").select("lid", F.struct("end", "at").alias("b"), F.col("hops").alias("hops_b"))
    forward = F.col("b") < F.col("f")
    return one.join(two, "lid").select(
        "lid",
        F.least(F.shiftright("f.at", 1), F.shiftright("b.at", 1)).alias("chain"),
        F.when(forward, F.col("hops_b")).otherwise(F.col("hops_f")).alias("place"),
        forward.alias("forward"),
        F.least("f.end", "b.end").alias("nf"),
        F.greatest("f.end", "b.end").alias("nt"),
    )


def contracted(edges: DataFrame) -> DataFrame:
    """lid, nf, nt, length, edges: chains of edges that meet in nodes of degree 2 as one edge each, of the chain's name.

    A chain stays as it is where it would become a loop, or a second edge between two nodes: an edge, then the chain of
    least name, comes first. Rings without an end stay too.
    """
    # Read several times here: not to be made from its tables each time.
    edges = _cut(edges.select("lid", "nf", "nt", "length"))
    places = _cut(chain_places(edges))
    sums = places.join(edges.select("lid", "length"), "lid").groupBy("chain", "nf", "nt").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("length"))
    first = Window.partitionBy("nf", "nt").orderBy(F.col("edges") > 1, "chain")
    kept = _cut(sums.withColumn("_r", F.row_number().over(first)).filter("_r = 1 AND edges > 1 AND nf <> nt").drop("_r"))
    gone = places.join(kept.select("chain"), "chain", "left_semi").select("lid")
    rest = edges.join(gone, "lid", "left_anti").select("lid", "nf", "nt", "length", F.lit(1).cast("bigint").alias("edges"))
    return rest.unionByName(kept.select(F.col("chain").alias("lid"), "nf", "nt", "length", "edges"))


def chain_points(places: DataFrame, points: DataFrame) -> DataFrame:
    """lid (the chain), seq, x, y: the polylines (lid, seq, x, y) of a chain's edges as one; points where two meet are there once.

    places is what ``chain_places`` gave; a polyline runs from its edge's nf to its nt.
    """
    along = places.select("lid", "chain", "place", "forward").join(points, "lid")
    order = F.when(F.col("forward"), F.col("seq")).otherwise(-F.col("seq"))
    own = Window.partitionBy("chain", "place").orderBy(order)
    inner = along.withColumn("_o", order).withColumn("_r", F.row_number().over(own)).filter("place = 0 OR _r > 1")
    whole = F.row_number().over(Window.partitionBy("chain").orderBy("place", "_o")) - 1
    return inner.select(F.col("chain").alias("lid"), whole.alias("seq"), "x", "y")


def directed_arcs(weights: DataFrame, most: float = CLOSED) -> DataFrame:
    """a, b, w, lid: the cheapest open arc between two nodes in each direction, of equals that of the least lid."""
    there = weights.select(F.col("nf").alias("a"), F.col("nt").alias("b"), F.col("w_ft").alias("w"), "lid")
    back = weights.select(F.col("nt").alias("a"), F.col("nf").alias("b"), F.col("w_tf").alias("w"), "lid")
    return there.unionByName(back).filter(F.col("w") < most).groupBy("a", "b").agg(F.min(F.struct("w", "lid")).alias("s")).select("a", "b", "s.w", "s.lid")


def shortest(weights: DataFrame, sources: DataFrame, most: float = CLOSED) -> DataFrame:
    """source, node, dist, before: least cost from each source (node) to every node it reaches, and the node before.

    Rounds of joins with the edges, of the nodes whose cost fell, until none falls. Ties go to the least node before.
    ``hubs`` answers pairs of nodes without a round for each hop.
    """
    arcs = _cut(directed_arcs(weights, most).drop("lid"))
    best = _cut(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("before")))
    out = _spread(arcs, best)
    _drop(arcs)
    return out


#: Rounds after which the costs found are gathered to one row for each source and node.
GATHER = 6


def _gathered(parts: list[DataFrame]) -> DataFrame:
    """The least cost, then the least node before, of each source and node."""
    rows = functools.reduce(DataFrame.unionByName, [p.select("source", "node", "dist", "before") for p in parts])
    best = F.min(F.struct(F.round("dist", 9).alias("r"), "before", "dist")).alias("s")
    return rows.groupBy("source", "node").agg(best).select("source", "node", "s.dist", "s.before")


def _spread(arcs: DataFrame, best: DataFrame) -> DataFrame:
    """The least costs from best (source, node, dist, before) on over arcs (a, b, w). A written table; best is deleted.

    A round writes only what is new: the nodes whose cost fell, and equal costs by a lesser node before.
    """
    parts, front = [best], best
    while True:
        step = (
            front.join(arcs, F.col("node") == F.col("a"))
            .select("source", F.col("b").alias("n"), F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("a").alias("before")).alias("s"))
            .groupBy("source", "n")
            .agg(F.min("s").alias("s"))
        )
        old = _gathered(parts).select("source", F.col("node").alias("n"), F.col("dist").alias("old"), F.col("before").alias("old_before"))
        joined = step.join(old, ["source", "n"], "left")
        fell = F.col("old").isNull() | (F.col("s.dist") < F.col("old") - 1e-9)
        tied = (F.abs(F.col("s.dist") - F.col("old")) <= 1e-9) & (F.col("s.before") < F.col("old_before"))
        new = _cut(
            joined.withColumn("fell", fell).filter(F.col("fell") | tied).select(
                "source", F.col("n").alias("node"), F.col("s.dist").alias("dist"), F.col("s.before").alias("before"), "fell"
            )
        )
        front = new.filter("fell").drop("fell")
        parts.append(new)
        ended = front.isEmpty()
        if ended or len(parts) > GATHER:
            whole = _cut(_gathered(parts))
            if not ended:
                # The front lives on in a table of its own.
                front = _cut(front)
            _drop(*parts)
            if ended:
                return whole
            parts = [whole, front]


def path_edges(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, target, step, a, b: the arcs of the best path of each wanted (source, target), step 0 at the target.

    found is what ``shortest`` gave. Pointers to the node 1, 2, 4, ... arcs back are doubled until none is left; then each
    pointer, from the longest down, doubles the places known of every path. A target out of reach has no rows.
    """
    sources = wanted.select("source").distinct()
    one = found.filter(F.col("before").isNotNull()).select("source", "node", F.col("before").alias("to")).join(sources, "source", "left_semi")
    jumps = [_cut(one)]
    while True:
        last = jumps[-1]
        twice = _cut(last.join(last.select("source", F.col("node").alias("to"), F.col("to").alias("far")), ["source", "to"]).select("source", "node", F.col("far").alias("to")))
        if twice.isEmpty():
            _drop(twice)
            break
        jumps.append(twice)
    at = _cut(wanted.select("source", "target", F.lit(0).alias("step"), F.col("target").alias("node")))
    for k in range(len(jumps) - 1, -1, -1):
        ahead = at.join(jumps[k], ["source", "node"]).select("source", "target", (F.col("step") + (1 << k)).alias("step"), F.col("to").alias("node"))
        before, at = at, _cut(at.unionByName(ahead))
        _drop(before)
    out = _cut(at.join(jumps[0], ["source", "node"]).select("source", "target", "step", F.col("to").alias("a"), F.col("node").alias("b")))
    _drop(at, *jumps)
    return out


def shortest_with_turns(weights: DataFrame, forbidden: DataFrame, sources: DataFrame, labels: DataFrame | None = None, most: float = CLOSED) -> DataFrame:
    """source, node, dist over walks that take none of the forbidden turns (lid, next_lid).

    Only at nodes with a forbidden turn does it matter which arc a walk came by: there the states are the arcs that end
    at the node, and pairs of arcs are listed; any other node is one state, so its arcs are listed once. labels (node,
    component) are the connected parts of the edges, if they are known.
    """
    from footfall.operators import reach

    labels = components(weights) if labels is None else labels

    there = weights.select("lid", F.lit(1).alias("ft"), F.col("nf").alias("from"), F.col("nt").alias("to"), F.col("w_ft").alias("w"))
    back = weights.select("lid", F.lit(0).alias("ft"), F.col("nt").alias("from"), F.col("nf").alias("to"), F.col("w_tf").alias("w"))
    arcs = there.unionByName(back).filter(F.col("w") < most).withColumn("arc", (F.col("lid") * 2 + F.col("ft")) * 2 + 1)
    after = arcs.select(F.col("from").alias("to"), F.col("lid").alias("next_lid"))
    watched = _cut(arcs.select("lid", "to").join(forbidden, "lid").join(after, ["to", "next_lid"], "left_semi").select("to").distinct().withColumn("watched", F.lit(True)))
    # Even states are nodes, odd ones arcs.
    head = F.when(F.col("watched"), F.col("arc")).otherwise(F.col("to") * 2)
    arcs = _cut(arcs.join(watched, "to", "left").select("lid", "from", "to", "w", "arc", head.alias("head")))
    origin = watched.withColumnRenamed("to", "from")
    free = arcs.join(origin, "from", "left_anti").select((F.col("from") * 2).alias("a"), F.col("head").alias("b"), "w")
    out = arcs.join(origin, "from", "left_semi").select(F.col("from").alias("to"), F.col("lid").alias("next_lid"), F.col("head").alias("b"), "w")
    bound = arcs.filter("head = arc").select("to", "lid", F.col("arc").alias("a")).join(out, "to").join(forbidden, ["lid", "next_lid"], "left_anti").select("a", "b", "w")
    steps = _cut(free.unionByName(bound).groupBy("a", "b").agg(F.min("w").alias("w")))
    start = arcs.join(sources.select(F.col("node").alias("from")), "from").groupBy(F.col("from").alias("source"), F.col("head").alias("node")).agg(F.min("w").alias("dist"))
    # A node's states are all in its part, so each task tells the least of a node's states and a source is told once.
    # Nodes without an edge are reached from themselves.
    own = labels.select((F.col("node") * 2).alias("node"), "component")
    at = arcs.filter("head = arc").select(F.col("arc").alias("state"), F.col("to").alias("name"))
    ends = labels.select((F.col("node") * 2).alias("state"), F.col("node").alias("name")).unionByName(at)
    inside = own.unionByName(at.join(labels.withColumnRenamed("node", "name"), "name").select(F.col("state").alias("node"), "component"))
    here = sources.join(labels, "node", "left_semi").select(F.col("node").alias("source"), (F.col("node") * 2).alias("node"), F.lit(0.0).alias("dist"))
    found = reach.distances(steps, start.unionByName(here), _cut(inside), ends.withColumnRenamed("state", "node"))
    alone = sources.join(labels, "node", "left_anti").select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    return found.unionByName(alone)


def next_hops(weights: DataFrame, destinations: DataFrame) -> DataFrame:
    """destination, node, next, dist: where to go from each node toward each destination."""
    turned = weights.select("lid", F.col("nt").alias("nf"), F.col("nf").alias("nt"), "w_ft", "w_tf")
    found = shortest(turned, destinations)
    return found.select(F.col("source").alias("destination"), "node", F.col("before").alias("next"), "dist")


def no_turns(edges: DataFrame, points: DataFrame) -> DataFrame:
    """node, lid, opposite: at nodes of four edges, the arm most nearly opposite each; points: node, x, y."""
    four = nodes(edges).filter("degree = 4").select("node")
    ends = both_ways(edges, "lid").join(four, "node", "left_semi")
    here = points.select("node", F.col("x").alias("x0"), F.col("y").alias("y0"))
    there = points.select(F.col("node").alias("other"), "x", "y")
    arms = ends.join(here, "node").join(there, "other")
    size = F.sqrt(F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2))
    arms = arms.select("node", "lid", ((F.col("x") - F.col("x0")) / size).alias("ux"), ((F.col("y") - F.col("y0")) / size).alias("uy"))
    other = arms.select("node", F.col("lid").alias("opposite"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    cosine = F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")
    pairs = arms.join(other, "node").filter("lid <> opposite")
    best = pairs.groupBy("node", "lid").agg(F.min(F.struct(F.round(cosine, 9).alias("c"), "opposite")).alias("best"))
    return best.select("node", "lid", "best.opposite")


def arcs(points: DataFrame, keys: Sequence[str] = ("lid",)) -> DataFrame:
    """Arcs of polylines (lid, seq, x, y): each with its length and the length before it."""
    by = Window.partitionBy(*keys).orderBy("seq")
    ahead = points.withColumn("x2", F.lead("x").over(by)).withColumn("y2", F.lead("y").over(by)).filter(F.col("x2").isNotNull())
    length = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    run = by.rowsBetween(Window.unboundedPreceding, -1)
    return ahead.withColumn("length", length).withColumn("s0", F.coalesce(F.sum("length").over(run), F.lit(0.0)))


def routes(places: DataFrame, distances: DataFrame, most: int) -> DataFrame:
    """Orders of up to ``most`` different places with their length; distances: a, b, dist. A bounded set of places."""
    one = places.select(F.array("place").alias("route"), F.lit(0.0).alias("length"))
    every = one
    last = one
    for _ in range(most - 1):
        step = last.join(distances, F.element_at("route", -1) == F.col("a")).filter(~F.array_contains(F.col("route"), F.col("b")))
        last = step.select(F.array_append("route", F.col("b")).alias("route"), (F.col("length") + F.col("dist")).alias("length"))
        every = every.unionByName(last)
    return every


def rounds(sources: DataFrame, found: DataFrame, distances: DataFrame) -> DataFrame:
    """Each of the ``routes`` as a round from and back to each source (place): place, route, length.

    distances has the ways from sources to places and back; a round with a way that isn't there is left out.
    """
    there = distances.select(F.col("a").alias("place"), F.col("b").alias("first"), F.col("dist").alias("there"))
    back = distances.select(F.col("a").alias("last"), F.col("b").alias("place"), F.col("dist").alias("back"))
    ends = found.withColumn("first", F.element_at("route", 1)).withColumn("last", F.element_at("route", -1))
    begun = ends.join(there.join(sources.select("place"), "place", "left_semi"), "first")
    whole = begun.join(back, ["place", "last"])
    return whole.select("place", "route", (F.col("length") + F.col("there") + F.col("back")).alias("length"))


def route_weights(found: DataFrame, weights: DataFrame, width: float) -> DataFrame:
    """route, length, bin, weight (product of its places' weights) and the running share of weight in the length bin."""
    parts = found.withColumn("place", F.explode("route")).join(weights, "place")
    product = F.when(F.min("w") <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.greatest(F.col("w"), F.lit(1e-300))))))
    whole = parts.groupBy("route", "length").agg(product.alias("weight")).withColumn("bin", F.floor(F.col("length") / width))
    per = Window.partitionBy("bin")
    run = per.orderBy(F.desc(F.round("weight", 9)), "route").rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("share", F.sum("weight").over(run) / F.sum("weight").over(per))
