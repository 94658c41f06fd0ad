"""Distances, clusters, smoothing and forecasts of series; numpy works on one bounded series or matrix at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_features(features: DataFrame, queries: DataFrame, block: int = 32768, rows: int = 65536) -> DataFrame:
    """id, best, likeness: for each query the other row of highest cosine; a stated set of queries against all rows.

    Queries are dealt to blocks of about ``block`` and all rows to parts of about ``rows`` by a hash of their id. Each block
    meets each part in one task, as matrices, and leaves one row a query there. A query that has no cosine with any other
    row, as a null or zero vector has none, gets the least other id and a null likeness. Ties go to the least id.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, sent = dict(features.dtypes)["id"], dict(features.dtypes)["feature"]
    sent = sent if sent == "array<float>" else "array<double>"
    known = features.select("id", F.col("feature").cast(sent).alias("x")).filter("id IS NOT NULL")
    asked = queries.select("id", F.col("feature").cast(sent).alias("x")).filter("id IS NOT NULL")
    exact = F.col("x").cast("array<double>")
    whole = lambda df: df.filter((F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull()) & (dot(exact, exact) != 0))
    parts, blocks = max(1, -(-known.count() // rows)), max(1, -(-asked.count() // block))
    dealt = lambda df, own, mine, other, others: whole(df).select(
        F.size("x").alias("width"), F.pmod(F.xxhash64("id"), F.lit(mine)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias(other), "id", "x"
    )
    key = ["width", "part", "block"]

    def matrix(table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("id", "ascending")])
        table = table.take(order)
        x = table.column("x").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        return table.column("id").combine_chunks(), x / np.sqrt((x * x).sum(axis=1))[:, None]

    def go(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and theirs.num_rows:
            (q, a), (f, b) = matrix(mine), matrix(theirs)
            names, wanted = f.to_numpy(zero_copy_only=False), q.to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(names, wanted, "left"), np.searchsorted(names, wanted, "right")
            # Some queries and rows at a time, so that their cosines fit.
            for i in range(0, len(q), 2048):
                for j in range(0, len(f), 4096):
                    like = a[i : i + 2048] @ b[j : j + 4096].T
                    for k in np.flatnonzero((first[i : i + 2048] < j + 4096) & (last[i : i + 2048] > np.maximum(first[i : i + 2048], j))):
                        like[k, max(0, first[i + k] - j) : last[i + k] - j] = -np.inf
                    most = np.round(like.max(axis=1), 9)
                    # The least id of those that round to the same.
                    at = np.where(np.isnan(most), like.argmax(axis=1), (like >= (most - 5e-10)[:, None]).argmax(axis=1))
                    some = ~np.isneginf(most)
                    out.append(pa.table({"id": q.slice(i, 2048).filter(pa.array(some)), "best": f.take(pa.array(j + at[some])), "like": most[some]}))
        return pa.concat_tables(out) if out else pa.table({"id": mine.column("id").slice(0, 0), "best": mine.column("id").slice(0, 0), "like": pa.array([], pa.float64())})

    left, right = dealt(asked, "block", blocks, "part", parts), dealt(known, "part", parts, "block", blocks)
    # A task for each cell, however few bytes it has.
    left, right = left.repartition(parts * blocks, *key), right.repartition(parts * blocks, *key)
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(go, f"id {kind}, best {kind}, like double")
    best = found.groupBy("id").agg(F.max(F.struct("like", (-F.col("best")).alias("neg"))).alias("b")).select("id", (-F.col("b.neg")).alias("best"), "b.like")
    # One row on the sides that are broadcast: the two least ids.
    least = known.agg(F.min("id").alias("least"))
    two = known.join(F.broadcast(least)).filter("id > least").agg(F.min("least").alias("least"), F.min("id").alias("second")).filter("second IS NOT NULL")
    other = F.when(F.col("id") == F.col("least"), F.col("second")).otherwise(F.col("least"))
    every = asked.select("id").distinct().join(best, "id", "left").join(F.broadcast(two))
    return every.select("id", F.coalesce("best", other).alias("best"), F.col("like").alias("likeness"))


def pair_distances(series: DataFrame) -> DataFrame:
    """a, b, l2, corr of all pairs of a few keyed series (key, i, value), aligned by place."""
    a = series.select(F.col("key").alias("a"), "i", F.col("value").alias("x"))
    b = series.select(F.col("key").alias("b"), "i", F.col("value").alias("y"))
    pairs = a.join(b, "i").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("l2"), F.corr("x", "y").alias("corr"))


def per_series(df: DataFrame, key: str, schema: str, function) -> DataFrame:
    """function(times, values) -> dict of columns, for each key's ordered series; a series is as long as its time range."""
    import pandas as pd

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        out = pd.DataFrame(function(frame["t"].to_numpy(), frame["value"].to_numpy(float)))
        out.insert(0, key, frame[key].iloc[0])
        return out

    return df.select(key, "t", "value").groupBy(key).applyInPandas(go, schema)


def cubic_spline(t, x, factor: int = 4) -> dict:
    """Not-a-knot cubic interpolation on a grid ``factor`` times as fine."""
    import numpy as np

    n = len(x)
    at = np.arange((n - 1) * factor + 1) / factor
    if n < 4:
        return {"place": at, "value": np.interp(at, np.arange(n), x)}
    # At the ends the condition leaves 6 m = b for the second place; from there a sweep down and up the three diagonals.
    b = 6 * (x[:-2] - 2 * x[1:-1] + x[2:])
    m = np.zeros(n)
    m[1], m[-2] = b[0] / 6, b[-1] / 6
    rest, share, below, value = [], [], m[1], 0.0
    for k in range(2, n - 2):
        pivot = 4 - value
        below = (b[k - 1] - below) / pivot
        value = 1 / pivot
        rest.append(below)
        share.append(value)
    for k in range(n - 3, 1, -1):
        m[k] = rest[k - 2] - share[k - 2] * m[k + 1]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    i = np.minimum(at.astype(int), n - 2)
    u = at - i
    value = (1 - u) * x[i] + u * x[i + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * m[i] + (u**3 - u) / 6 * m[i + 1]
    return {"place": at, "value": value}


def warping_distance(a, b, band: int | None = None) -> float:
    """Dynamic time warping distance of two series; places more than ``band`` apart aren't matched."""
    import numpy as np

    band = max(len(a), len(b)) if band is None else max(band, abs(len(a) - len(b)))
    before = np.full(len(b) + 1, np.inf)
    before[0] = 0
    for i, x in enumerate(a, 1):
        now = np.full(len(b) + 1, np.inf)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            now[j] = abs(x - b[j - 1]) + min(before[j], before[j - 1], now[j - 1])
        before = now
    return float(before[-1])


def warping_bounds(x, band: int):
    """How far apart any two of the rows of x (series of one length) are at least, by warping within the band.

    A place of one series matches a place of the other's envelope, the least and greatest value within the band.
    """
    import numpy as np

    n = x.shape[1]
    low, high = x.copy(), x.copy()
    for d in range(1, min(band, n - 1) + 1):
        for lag, lead in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
            low[:, lag] = np.minimum(low[:, lag], x[:, lead])
            high[:, lag] = np.maximum(high[:, lag], x[:, lead])
    out = np.empty((len(x), len(x)))
    for i, row in enumerate(x):
        out[i] = (np.maximum(row - high, 0) + np.maximum(low - row, 0)).sum(axis=1)
    return np.maximum(out, out.T)


def nearest_warped(series: DataFrame, band: int, block: int = 512) -> DataFrame:
    """id, best, dist, tried: the other series (id, x: arrays of one length) nearest to each by warping within the band.

    Series are dealt to blocks by hash, and each two blocks meet in one task. There the envelopes' bounds rule out pairs:
    a series meets the others by rising bound, until the bound is not below the least distance so far; tried counts these
    exact distances. Ties go to the least id.
    """
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-2 * series.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    placed = series.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = placed.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"), "own", "id", "x")

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        name, side = frame["id"].to_numpy(), frame["own"].to_numpy()
        x = np.array(frame["x"].to_list(), float)
        bound = warping_bounds(x, band)
        out, mixed = [], (side != side[0]).any()
        for i in range(len(name)):
            best, tried = (np.inf, None), 0
            for j in np.argsort(bound[i], kind="stable").tolist():
                if j == i or (mixed and side[i] == side[j]):
                    continue
                if bound[i, j] > best[0] + 1e-9:
                    break
                tried += 1
                best = min(best, (round(warping_distance(x[i], x[j], band), 9), name[j]))
            if best[1] is not None:
                out.append((name[i], best[1], best[0], tried))
        return pd.DataFrame(out, columns=["id", "best", "dist", "tried"])

    kind = dict(series.dtypes)["id"]
    found = dealt.groupBy("cell").applyInPandas(go, f"id {kind}, best {kind}, dist double, tried bigint")
    return found.groupBy("id").agg(F.min(F.struct("dist", "best")).alias("b"), F.sum("tried").alias("tried")).select("id", "b.best", "b.dist", "tried")


def point_clusters(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """points (x, y) with their cluster, 0 to k - 1, by k-means; a point without both coordinates has none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="_at", handleInvalid="skip").transform(points)
    made = KMeans(k=k, seed=seed, featuresCol="_at", predictionCol="cluster").fit(rows)
    return made.transform(rows).drop("_at")
