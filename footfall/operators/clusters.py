"""Ward's linkage over rows: in each round cells of near clusters merge all that no cluster outside can stop.

Ward's linkage is reducible: a merge brings no two other clusters nearer, so mutually nearest clusters may merge in any
order, and all at a time, and give the tree that merging one pair at a time gives (ties aside). For the same reason what a
cluster costs with any cluster outside its cell stays above what it costs at the start of a round, whatever merges there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.graph import _cut, _drop, components, numbered

#: Clusters of a cell at most; and at which the rest of the tree is built in one task.
BLOCK = 16384
#: Clusters that all others meet to be dealt to cells, at most.
PIVOTS = 2048
#: Two blocks of clusters meet in a task; of ``TILE`` clusters there is one block, of f * f times as many f blocks.
TILE = 600
#: Rows and columns of the costs that a task holds at a time.
ROWS, COLUMNS = 256, 1024
#: Clusters of a cell that look for their nearest at a time.
STEP = 64


def _matrix(column):
    """Rows of a column of lists of one length as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _wide(x):
    """Two matrices whose rows' products are the squared distances of the rows of x."""
    import numpy as np

    square, one = (x**2).sum(axis=1)[:, None], np.ones((len(x), 1))
    return np.hstack([-2 * x, square, one]), np.hstack([x, one, square])


def _in_cells(clusters: DataFrame, count: int, block: int, turn: int) -> DataFrame:
    """clusters (name, n, centre) with ``cell``: by the nearest of some clusters, in parts of about ``block`` at most."""
    import numpy as np
    import pyarrow as pa

    some = clusters.orderBy(F.xxhash64("name", F.lit(turn)), "name").limit(min(PIVOTS, -(-2 * count // block)))
    pivots = np.array([r["centre"] for r in some.select("centre").collect()])
    near = np.hstack([-2 * pivots, (pivots**2).sum(axis=1)[:, None]])

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(pa.chunked_array([batch.column("centre")]))
                found = (np.hstack([x, np.ones((len(x), 1))]) @ near.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["name", "n", "centre", "pivot"])

    dealt = clusters.select("name", "n", "centre").mapInArrow(go, "name bigint, n bigint, centre array<double>, pivot bigint")
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    part = F.pmod(F.xxhash64("name"), F.col("parts"))
    return _cut(dealt.join(F.broadcast(sizes), "pivot").select("name", "n", "centre", (F.col("pivot") * (1 << 32) + part).alias("cell")))


def _outside(placed: DataFrame, count: int) -> DataFrame:
    """name, bound, other: the cluster of another cell that merges with each at the least cost; of equals the first cell's.

    Clusters are dealt to blocks by hash and each two blocks meet in one task, as matrices.
    """
    import numpy as np
    import pyarrow as pa

    blocks = max(1, round((count / TILE) ** 0.5))
    own = F.pmod(F.xxhash64("name"), F.lit(blocks))
    rows = placed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = rows.withColumn("tile", F.least("own", "with") * blocks + F.greatest("own", "with"))

    def side(table):
        table = table.sort_by([("cell", "ascending"), ("name", "ascending")])
        name, n, cell = (table.column(c).to_numpy() for c in ("name", "n", "cell"))
        rows, columns = _wide(_matrix(table.column("centre")))
        return {"name": name, "cell": cell, "part": 1 / n, "rows": rows, "columns": columns, "cost": np.full(len(name), np.inf), "at": np.zeros(len(name), np.int64)}

    def better(one, low, cost, at):
        """Keep what is cheaper than before; at(which) tells with whom."""
        which = np.flatnonzero(cost < one["cost"][low : low + len(cost)])
        if len(which):
            one["cost"][low + which] = cost[which]
            one["at"][low + which] = at(which)

    def meet(a, b):
        for i in range(0, len(a["name"]), ROWS):
            rows = slice(i, i + ROWS)
            for j in range(i - i % COLUMNS if a is b else 0, len(b["name"]), COLUMNS):
                columns = slice(max(i, j) if a is b else j, j + COLUMNS)
                cost = a["rows"][rows] @ b["columns"][columns].T
                p, q = a["part"][rows], b["part"][columns]
                scale = p[0] + q[0]
                if (p != p[0]).any() or (q != q[0]).any():
                    cost /= p[:, None] + q[None, :]
                    scale = 1.0
                mine, theirs = a["cell"][rows], b["cell"][columns]
                for c in np.intersect1d(mine, theirs):
                    r, s = np.searchsorted(mine, [c, c + 1]), np.searchsorted(theirs, [c, c + 1])
                    cost[r[0] : r[1], s[0] : s[1]] = np.inf
                if a is b and columns.start == i:
                    k = min(cost.shape)
                    cost[:k, :k] = np.minimum(cost[:k, :k], cost[:k, :k].T)
                # A row meets the columns before it as one of theirs, so it meets all in their order.
                better(b, columns.start, cost.min(axis=0) / scale, lambda w: i + cost[:, w].argmin(axis=0))  # noqa: B023
                better(a, i, cost.min(axis=1) / scale, lambda w: columns.start + cost[w].argmin(axis=1))  # noqa: B023

    def found(one, other):
        keep = np.flatnonzero(np.isfinite(one["cost"]))
        at = one["at"][keep]
        return [one["name"][keep], one["cost"][keep], other["cell"][at], other["name"][at]]

    def go(table: pa.Table) -> pa.Table:
        tile, owner = table.column("tile")[0].as_py(), table.column("own").to_numpy()
        first, second = divmod(tile, blocks)
        a = side(table.filter(pa.array(owner == first)))
        if first == second:
            meet(a, a)
            out = found(a, a)
        else:
            b = side(table.filter(pa.array(owner == second)))
            meet(a, b)
            out = [np.concatenate(c) for c in zip(found(a, b), found(b, a), strict=True)]
        return pa.table([pa.array(c) for c in out], names=["name", "cost", "cell", "other"])

    dealt = tiles.select("tile", "own", "name", "n", "centre", "cell").repartition(blocks * blocks, "tile")
    each = dealt.groupBy("tile").applyInArrow(go, "name bigint, cost double, cell bigint, other bigint")
    least = each.groupBy("name").agg(F.min(F.struct("cost", "cell", "other")).alias("b"))
    return least.select("name", F.col("b.cost").alias("bound"), "b.other")


def _merged(name, n, x, bound):
    """Merges (a, b, cost, n) of clusters in one cell that cost less than ``bound``, what each costs with any outside.

    Also the clusters that are left: name, n, centre, and for those that did not merge whether the bound is not above what
    they cost in the cell. Only clusters whose nearest has merged look for another, and none whose bound is nearer.
    """
    import numpy as np

    np.seterr(invalid="ignore")  # the products with columns of clusters that are gone, which are infinite
    out, live, fresh = [], np.ones(len(name), bool), np.ones(len(name), bool)
    middle = x.mean(axis=0)
    part, (rows, columns) = 1 / n, _wide(x - middle)
    rows_f, columns_f = rows.astype(np.float32), columns.astype(np.float32)
    best, least = np.zeros(len(name), np.int64), np.full(len(name), np.inf)
    ask = np.arange(len(name))
    while True:
        # In single precision first: what is nearest by more than its error is so, the others look again in double.
        short = part.astype(np.float32)
        error = columns.shape[1] * 2.0**-22 * (rows[:, -2] ** 0.5 + rows[live, -2].max() ** 0.5) ** 2 / (part + part[live].min())
        again = []
        for low in range(0, len(ask), STEP):
            some = ask[low : low + STEP]
            cost, place = rows_f[some] @ columns_f.T, np.arange(len(some))
            cost /= short[some, None] + short[None, :]
            cost[place, some] = np.inf
            at = cost.argmin(axis=1)
            limit = cost[place, at] + 2 * error[some]
            cost[place, at] = np.inf
            sure = cost.min(axis=1) > limit
            best[some] = at
            again.append(some[~sure])
        least[ask] = np.einsum("ij,ij->i", rows[ask], columns[best[ask]]) / (part[ask] + part[best[ask]])
        again = np.concatenate([ask[:0], *again])
        for low in range(0, len(again), STEP):
            some = again[low : low + STEP]
            cost, place = rows[some] @ columns.T, np.arange(len(some))
            cost /= part[some, None] + part[None, :]
            cost[place, some] = np.inf
            best[some] = cost.argmin(axis=1)
            least[some] = cost[place, best[some]]
        free = live & (least < bound) & (least < bound[best])
        i = np.flatnonzero(free & (best[best] == np.arange(len(name))) & (np.arange(len(name)) < best))
        if not len(i):
            # Equal costs that rounding keeps from being mutual: the first pair of those.
            i = np.flatnonzero(free & (least[best] >= least - 1e-12 * columns[live, -1].max(initial=0) * n.max(initial=1)))
            if not len(i):
                return out, name[live], n[live], x[live], (fresh & (bound <= least))[live]
            i = i[least[i].argmin()][None]
        i, j = np.minimum(i, best[i]), np.maximum(i, best[i])
        added = ((x[i] - x[j]) ** 2).sum(axis=1) * n[i] * n[j] / (n[i] + n[j])
        both = n[i] + n[j]
        out += zip(name[i].tolist(), name[j].tolist(), added.tolist(), both.astype(int).tolist(), strict=True)
        # What the merged cluster costs with one outside lies between what it would with one of size 1 and of any size.
        small = ((n[i] + 1) * bound[i] + (n[j] + 1) * bound[j] - added) / (both + 1)
        bound[i] = np.minimum(small, bound[i] + bound[j] - added)
        x[i] = (x[i] * n[i, None] + x[j] * n[j, None]) / both[:, None]
        n[i], part[i], fresh[i], live[j] = both, 1 / both, False, False
        rows[i], columns[i] = _wide(x[i] - middle)
        columns[j, -1] = np.inf
        rows_f[i], columns_f[i], columns_f[j, -1] = rows[i], columns[i], np.inf
        best[i], least[i] = j, -np.inf
        moved = np.zeros(len(name), bool)
        moved[i] = moved[j] = True
        ask = np.flatnonzero(live & moved[best] & (least < bound))
        if 2 * live.sum() < len(name):
            at = np.cumsum(live) - 1
            ask, best = at[ask], at[best[live]]
            name, n, x, bound, fresh, part, least = (v[live] for v in (name, n, x, bound, fresh, part, least))
            rows, columns, rows_f, columns_f = (v[live] for v in (rows, columns, rows_f, columns_f))
            live = np.ones(len(name), bool)


def _within(bounded: DataFrame) -> DataFrame:
    """Merges and what is left of each cell of bounded (name, n, centre, cell, bound, other).

    a, b, cost, n of a merge; a, n, centre of a cluster that is left, with ``other`` where that is nearest to it.
    """
    import numpy as np
    import pyarrow as pa

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        name, n, bound = (table.column(c).to_numpy().copy() for c in ("name", "n", "bound"))
        other = dict(zip(name.tolist(), table.column("other").to_pylist(), strict=True))
        made, left, size, x, out = _merged(name, n.astype(float), _matrix(table.column("centre")).copy(), bound)
        nearest = [other[k] if o else None for k, o in zip(left.tolist(), out.tolist(), strict=True)]
        a, b, cost, both = ([r[k] for r in made] for k in range(4))
        none = [None] * len(made)
        return pa.table(
            {
                "a": pa.array(a + left.tolist(), pa.int64()),
                "b": pa.array(b + [None] * len(left), pa.int64()),
                "cost": pa.array(cost + [None] * len(left), pa.float64()),
                "n": pa.array(both + size.astype(int).tolist(), pa.int64()),
                "centre": pa.array(none + list(x), pa.list_(pa.float64())),
                "other": pa.array(none + nearest, pa.int64()),
            }
        )

    return bounded.groupBy("cell").applyInArrow(go, "a bigint, b bigint, cost double, n bigint, centre array<double>, other bigint")


def _paired(done: DataFrame) -> DataFrame:
    """``_within``'s rows, in which clusters of two cells that are each other's nearest are a merge, with its centre."""
    key = [F.least("a", F.coalesce("b", "other")).alias("lo"), F.greatest("a", F.coalesce("b", "other")).alias("hi"), F.col("b").isNotNull().alias("old")]
    met = done.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("a", "b", "cost", "n", "centre"))).alias("r"))
    # Of a cluster whose nearest has another one nearer, or has merged, there is one row.
    p, q = F.col("r")[0], F.get("r", F.lit(1))
    n = p["n"] + q["n"]
    apart = F.aggregate(F.zip_with(p["centre"], q["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    centre = F.zip_with(p["centre"], q["centre"], lambda x, y: (x * p["n"] + y * q["n"]) / n)
    pair = F.struct(p["a"].alias("a"), q["a"].alias("b"), (apart * p["n"] * q["n"] / n).alias("cost"), n.alias("n"), centre.alias("centre"))
    return met.select(F.when(F.size("r") == 2, pair).otherwise(p).alias("r")).select("r.*")


def _equal_merged(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Clusters (name, n, centre) of equal rows (name, centre), and the merges that make them, at no cost, if there are any."""
    kinds = rows.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if kinds.isEmpty():
        return rows.select("name", F.lit(1).cast("bigint").alias("n"), "centre"), None
    placed = numbered(rows, ["centre", "name"])
    made = _cut(placed.groupBy("centre").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), F.min("number").alias("first")))
    again = made.filter("n > 1").select("centre", F.col("name").alias("a"), "first")
    merges = placed.join(again, "centre").filter("name <> a")
    return made.select("name", "n", "centre"), merges.select("a", F.col("name").alias("b"), F.lit(0.0).alias("cost"), (F.col("number") - F.col("first") + 1).alias("n"))


def ward_tree(features: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, cost, n: the merges of Ward's linkage of features (id, feature); clusters are named by their least id.

    cost is what the merge adds to the sum of squares, n the size of what it makes. A written table.
    """
    rows = _cut(features.select(F.col("id").cast("bigint").alias("name"), F.col("feature").cast("array<double>").alias("centre")))
    now, equal = _equal_merged(rows)
    merges = [] if equal is None else [_cut(equal)]
    turn, tables = 0, [rows, *merges]
    while (count := now.count()) > block:
        placed = _in_cells(now, count, block, turn)
        bounds = _outside(placed, count)
        bounded = placed.join(bounds, "name", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        done = _cut(_paired(_within(bounded)))
        tables.append(done)
        merges.append(done.filter("b IS NOT NULL").select("a", "b", "cost", "n"))
        now = done.filter("centre IS NOT NULL").select(F.col("a").alias("name"), "n", "centre")
        _drop(placed)
        turn += 1
    rest = now.select("name", "n", "centre", F.lit(0).alias("cell"), F.lit(float("inf")).alias("bound"), F.lit(None).cast("bigint").alias("other"))
    whole = _within(rest).filter("b IS NOT NULL").select("a", "b", "cost", "n")
    for part in merges:
        whole = whole.unionByName(part)
    out = _cut(whole)
    _drop(*tables)
    return out


def ward_labels(features: DataFrame, clusters: int, block: int = BLOCK) -> DataFrame:
    """id, cluster (its least id) of the partition that leaves out the tree's ``clusters`` - 1 dearest merges."""
    tree = ward_tree(features, block)
    ids = features.select(F.col("id").cast("bigint").alias("id"))
    top = tree.orderBy(F.desc("cost"), F.desc("n"), "a", "b").limit(clusters - 1) if clusters > 1 else tree.limit(0)
    kept = tree.join(top.select("a", "b"), ["a", "b"], "left_anti")
    label = components(kept.select(F.monotonically_increasing_id().alias("lid"), F.col("a").alias("nf"), F.col("b").alias("nt")))
    return ids.join(label.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
