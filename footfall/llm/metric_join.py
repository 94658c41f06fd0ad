"""Exact Jaccard join of word-shingle sets: pivots, Voronoi regions and windows of the triangle inequality.

Links are pairs of sets with 100 * intersection >= percent * union, that is, within r = 1 - percent / 100 of each other by
the Jaccard distance, which is a metric.

1. ``signed_sets``: texts with equal sets are one class from here on, known by 64 bits of the set.
2. Unlike texts are all at distance 1 from any pivot, where a window of 2 r holds everything. So classes meet first where
   they can be near at all. Linked sets differ in at most k elements, k by size; the elements are dealt by hash to k + 1
   slices, of which at least one is then equal on both sides. Each class goes to a bucket for each of its slices, for the
   sizes from its own band to the next. Slices of up to ``WEAK`` elements say little: their bucket also names the next slice
   up to one element (among the equal slices of a linked pair there is one after which the next differs in one element at
   most). No link lies outside the buckets.
3. ``bucket_links``: in a bucket, pivots in turn take the classes near them by the L1 distance of folded counts, which is
   never more than the number of differing elements. What is within k of a pivot is its own; what is within 2 k stays, for
   other pivots, but is tied to this one too, so that no linked pair is parted. The components of the ties are clusters.
4. ``joined``: each cluster is a region, joined by full sets. A region of over ``BLOCK`` classes (or ``REGION_BYTES``) gets
   ``PIVOTS`` of its members as pivots; each member goes home to the ring of width r about its nearest pivot, and as a
   replica to every other ring that a class within r of it could be at home in: distances to the pivot from d - r to d + r,
   for pivots up to 2 r farther than the nearest one. Members that pivots connect bear one label, and regions of one label
   are done. Others are joined again, until they fit a task. A ring that holds over ``STUCK`` of its region isn't split again by pivots, but compared block by block.
   Members of a region that fits are all compared, but for those that are known to be connected.
5. Components of the confirmed links; copies follow their class.

The result is exact up to collisions of 64-bit hashes; nothing is estimated.

Defined results: null, empty and blank texts have no shingles and are linked with nothing (component_id is the doc_id);
texts with fewer words than a shingle have their whole sequence as one; a null doc_id is never the smallest, and a class
without any doc_id has a null component; rows of one doc_id are linked through their texts only, so equal ids with unlike
texts may lie in several components; repeated rows have equal results; long texts are cut nowhere: a text's hashes are in
one task at a time, 8 bytes a shingle; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks
from footfall.llm import bytewords as bw
from footfall.llm._common import discard, documents, join_groups, text_batches, tidy, written
from footfall.llm.components import components
from footfall.llm.minhash import text_sets

BATCH = 1 << 20
WEAK = 2
#: Counters of a folded set: about an eighth of its elements, a power of two between these.
FOLDS = (16, 1024)
#: Classes, and bytes of their sets, that one task compares; pivots of a larger region, and the bytes of their sets.
BLOCK, REGION_BYTES = 2048, 32 << 20
PIVOTS, PIVOT_BYTES = 16, 32 << 20
#: Members of a larger region that one task holds against its pivots.
PART = 512
STUCK = 0.75

_U = np.uint64
_SLICE, _FOLD, _VALUE = _U(0x8CB92BA72F3D8DD7), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


@functools.cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, most): band i are the sizes first[i] to first[i + 1] - 1.

    A set of band i is linked with sets of bands i and i + 1 at most, if it is the smaller one, and differs from them in
    most[i] elements at most.
    """
    first = [1, 2]
    while first[-1] < 1 << 31:
        first.append(max(first[-1] + 1, 100 * (first[-1] - 1) // percent + 1))
    last = np.array(first[1:], np.int64) - 1
    return np.array(first[:-1], np.int64), (100 - percent) * (last + 100 * last // percent) // (100 + percent)


def _folds(first: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.log2(np.maximum(first // 8, 1)).astype(np.int64), *FOLDS)


def slice_keys(row: np.ndarray, element: np.ndarray, level: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the buckets of the sets (row, element), cut into ``slices[row]`` slices at ``level[row]``; 0: none."""
    live = slices[row] > 0
    row, element = row[live], element[live]
    offset = np.concatenate([[0], np.cumsum(slices)])
    slot = offset[row] + (bw.mix(element ^ _SLICE) % slices[row].astype(_U)).astype(np.int64)
    value = bw.mix(element + _VALUE)
    total = int(offset[-1])
    sums, count = np.zeros(total, _U), np.bincount(slot, minlength=total)
    np.add.at(sums, slot, value)
    owner = np.repeat(np.arange(len(slices)), slices)
    number = np.arange(total) - offset[owner]
    key = bw.mix(sums + bw.mix(bw.mix(level[owner].astype(_U) + _U(1)) + number.astype(_U)) + count.astype(_U))
    weak = np.flatnonzero(count <= WEAK)
    if not len(weak):
        return owner, key
    after = offset[owner[weak]] + (number[weak] + 1) % slices[owner[weak]]
    order = np.argsort(slot, kind="stable")
    ends = np.cumsum(count)
    size = count[after]
    # The next slice as it is, and without each of its elements.
    which = np.repeat(np.arange(len(weak)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[after] - size, size)
    less = sums[after][which] - value[order[at]]
    strong = np.flatnonzero(count > WEAK)
    owners = [owner[strong], owner[weak], owner[weak][which]]
    keys = [key[strong], bw.mix(key[weak] + bw.mix(sums[after] + _U(1))), bw.mix(key[weak][which] + bw.mix(less + _U(1)))]
    return np.concatenate(owners), np.concatenate(keys)


def signed_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (64 bits of the set), buckets and fold (a byte for each counter) of every row of docs."""
    import pyarrow as pa

    def sign(batches):
        first, most = bands(percent)
        folds = _folds(first)
        for batch in text_batches(batches, limit=BATCH):
            n = batch.num_rows
            row, element, ends = text_sets(batch.column("text"), k)
            size = np.diff(ends, prepend=0).astype(np.int64)
            band = np.searchsorted(first, size, side="right") - 1
            found_row, found_key = [], []
            for level in (band, band - 1):
                slices = np.where((level >= 0) & (most[level] > 0), most[level] + 1, 0)
                owner, key = slice_keys(row, element, level, slices)
                found_row.append(owner)
                found_key.append(key)
            owner, key = np.concatenate(found_row), np.concatenate(found_key)
            order = np.argsort(owner, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
            counters = np.where(size > 0, folds[band], 0)
            offset = np.concatenate([[0], np.cumsum(counters)])
            slot = offset[row] + (bw.mix(element ^ _FOLD) & (counters[row] - 1).astype(_U)).astype(np.int64)
            count = np.minimum(np.bincount(slot, minlength=int(offset[-1])), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size),
                    pa.array(_nodes(row, element, size).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[order].view(np.int64))),
                    pa.array([count[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "buckets", "fold"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        tidy(sign), "doc_id bigint, n_shingles bigint, node bigint, buckets array<bigint>, fold binary"
    )


def _nodes(row: np.ndarray, element: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(size), _U)
    np.add.at(sums, row, bw.mix(element))
    return bw.mix(sums + size.astype(_U))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """bucket, node of the buckets that two or more classes (node, buckets) are in."""
    import pyarrow as pa

    def go(batches):
        held = None  # the last row so far, and whether it has been given out
        for batch in batches:
            bucket, node = (batch.column(c).to_numpy() for c in ("bucket", "node"))
            same = bucket[1:] == bucket[:-1]
            keep = np.zeros(len(bucket), bool)
            keep[1:] |= same
            keep[:-1] |= same
            rows = [(bucket[keep], node[keep])]
            if held is not None and len(bucket) and held[0] == bucket[0]:
                if not held[2]:
                    rows.insert(0, (np.array([held[0]]), np.array([held[1]])))
                if not keep[0]:
                    rows.append((bucket[:1], node[:1]))
                    keep[0] = True
            if len(bucket):
                held = bucket[-1], node[-1], bool(keep[-1])
            out = [np.concatenate(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", "node"])

    exploded = classes.select("node", F.explode("buckets").alias("bucket")).select("bucket", "node")
    return exploded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(go), "bucket bigint, node bigint")


def _pivot_ties(bucket: np.ndarray, size: np.ndarray, folds: list[bytes], percent: int):
    """Places (member, pivot) of ties in whole buckets, given sorted.

    Round after round the first member left of each bucket is its pivot; all buckets are handled at a time.
    """
    if not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    group = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    width = np.minimum.reduceat(np.array([len(f) for f in folds]), starts)[group]
    reach = (100 - percent) * 2 * np.maximum.reduceat(size, starts)[group] // (100 + percent)
    members, pivots = [], []
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        vectors = np.empty((len(own), w), np.int16)
        for i, at in enumerate(own.tolist()):
            fold = np.frombuffer(folds[at], np.uint8)
            if len(fold) > w:
                fold = np.minimum(fold.reshape(-1, w).sum(axis=0), 255)
            vectors[i] = fold
        left = np.arange(len(own))
        while len(left) > 1:
            lead = np.concatenate([[True], group[own[left[1:]]] != group[own[left[:-1]]]])
            pivot = left[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            others, pivot = left[~lead], pivot[~lead]
            far = np.empty(len(others), np.int64)
            for a in range(0, len(others), 4096):
                part = slice(a, a + 4096)
                far[part] = np.abs(vectors[others[part]] - vectors[pivot[part]]).sum(axis=1, dtype=np.int64)
            limit = reach[own[others]]
            tied = far <= 2 * limit
            members.append(own[others[tied]])
            pivots.append(own[pivot[tied]])
            left = others[far > limit]
    return np.concatenate(members or [np.zeros(0, np.int64)]), np.concatenate(pivots or [np.zeros(0, np.int64)])


def bucket_links(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between the classes (node, n_shingles, fold) of each bucket: its linked pairs are connected by them."""
    import pyarrow as pa

    def go(batches):
        for table in blocks.whole_buckets(batches):
            node = table.column("node").to_numpy()
            member, pivot = _pivot_ties(
                table.column("bucket").to_numpy(), table.column("n_shingles").to_numpy(), table.column("fold").to_pylist(), percent
            )
            pairs = np.unique(np.stack([node[member], node[pivot]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], names=["a", "b"])

    dealt = shared.join(classes.select("node", "n_shingles", "fold"), "node").select("bucket", "node", "n_shingles", "fold")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(tidy(go), "a bigint, b bigint")


def cluster_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """node, region and set (sorted 64-bit hashes) of members (node, component, doc_id: any that has this set)."""
    import pyarrow as pa

    def go(batches):
        for batch in text_batches(batches, limit=BATCH):
            row, element, ends = text_sets(batch.column("text"), k)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            size = ends - starts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_nodes(row, element, size).view(np.int64)),
                    pa.array([element[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["node", "set"],
            )

    ids = members.select(F.col("doc_id").alias("_doc")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    sets = texts.mapInArrow(tidy(go), "node bigint, set binary")
    # A doc_id that is there twice may bring sets that weren't asked for.
    found = sets.join(members.select("node", F.col("component").alias("region")), "node")
    return found.groupBy("node", "region").agg(F.first("set").alias("set"))


class _Sets:
    """Sets of one region, their elements numbered, so that one set meets all others in a pass over them."""

    def __init__(self, raw: list[bytes]) -> None:
        sets = [np.frombuffer(x, _U) for x in raw]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.size)
        values, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(values), bool)

    def common(self, i: int) -> np.ndarray:
        """How many elements each set shares with set i."""
        own = self.numbers[self.ends[i] - self.size[i] : self.ends[i]]
        self.flag[own] = True
        sums = np.concatenate([[0], np.cumsum(self.flag[self.numbers])])
        self.flag[own] = False
        return sums[self.ends] - sums[self.ends - self.size]


def _joined_pairs(raw: list[bytes], home: np.ndarray, known: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that is linked, of pairs with a member at home and not of one known component.

    block: members of the same block (0 or more) aren't compared with each other; -1 is none.
    """
    if len(raw) < 2 or (known == known[0]).all():
        return []
    sets, out = _Sets(raw), []
    known = known.copy()
    place = np.arange(len(raw))
    for i in range(len(raw) - 1):
        todo = (place > i) & (known != known[i]) & (home | home[i]) & ((block != block[i]) | (block < 0))
        todo &= 100 * np.minimum(sets.size, sets.size[i]) >= percent * np.maximum(sets.size, sets.size[i])
        if not todo.any():
            continue
        inter = sets.common(i)
        for j in np.flatnonzero(todo & (100 * inter >= percent * (sets.size + sets.size[i] - inter))).tolist():
            if known[j] != known[i]:
                known[known == known[j]] = known[i]
                out.append((i, j))
    return out


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the regions of rows (region, node, known, home, block, set), each in one task."""
    import pyarrow as pa

    def go(batches):
        for table in blocks.whole_buckets(batches):
            node, known, block = (table.column(c).to_numpy() for c in ("node", "known", "block"))
            home = table.column("home").to_numpy()
            a, b = [], []
            for lo, hi in blocks.runs(table.column("bucket").to_numpy()):
                raw = table.column("set").slice(lo, hi - lo).to_pylist()
                for i, j in _joined_pairs(raw, home[lo:hi], known[lo:hi], block[lo:hi], percent):
                    a.append(node[lo + i])
                    b.append(node[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], names=["a", "b"])

    dealt = rows.select(F.col("region").alias("bucket"), "node", "known", "home", "block", "set")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(tidy(go), "a bigint, b bigint")


def _labels(known: np.ndarray, linked: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A node that each member is connected with, the same for members as far as their links with pivots tell.

    known: such a node of each member so far; linked: members x pivots; pivots: the places of the pivots, linked[pivots]
    their links among themselves.
    """
    label = known[pivots]
    tied = linked[pivots] | linked[pivots].T | (label[:, None] == label[None, :])
    while True:
        less = np.where(tied, label[None, :], label[:, None]).min(axis=1)
        if (less == label).all():
            break
        label = less
    with_pivot = linked | (known[:, None] == known[pivots][None, :])
    least = np.where(with_pivot, label[None, :], np.iinfo(np.int64).max).min(axis=1)
    return np.where(with_pivot.any(axis=1), least, known)


def _placed(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The rows (region, node, known, home, set) of regions with sizes (region, members, homes, least, pivots) in the rings
    that they belong to: region, node, known, home, set, parent_members, link (a pivot within r)."""
    import pyarrow as pa

    r = 1 - percent / 100

    def go(batches):
        for table in blocks.whole_buckets(batches):
            for lo, hi in blocks.runs(table.column("bucket").to_numpy()):
                yield from region(table.slice(lo, hi - lo))

    def region(table):
        raw = table.column("set").to_pylist()
        node, known, home, lead = (table.column(c).to_numpy() for c in ("node", "known", "home", "lead"))
        pivots, rows = np.flatnonzero(lead), np.flatnonzero(~lead)
        if not len(rows):
            return
        sets = _Sets(raw)
        every = np.stack([sets.common(p) for p in pivots], axis=1)
        label = _labels(known, 100 * every >= percent * (sets.size[:, None] + sets.size[pivots][None, :] - every), pivots)
        inter = every[rows]
        union = sets.size[rows][:, None] + sets.size[pivots][None, :] - inter
        far = 1 - inter / union
        nearest = far.argmin(axis=1)
        # A pinch of slack keeps rounding from parting a pair; it only adds replicas.
        window = far <= far.min(axis=1)[:, None] + 2 * r + 1e-9
        linked = 100 * inter >= percent * union
        ring = np.floor(far / r + 1e-9).astype(np.int64)
        low = np.floor((far - r) / r - 1e-9).astype(np.int64).clip(0)
        high = np.floor((far + r) / r + 1e-9).astype(np.int64)
        parent, members = table.column("bucket_region")[0].as_py(), table.column("members")[0].as_py()
        for start in range(0, len(rows), 256):
            own = slice(start, start + 256)
            i, j = np.nonzero(window[own])
            i = i + start
            times = high[i, j] - low[i, j] + 1
            which = np.repeat(np.arange(len(i)), times)
            at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[i, j][which]
            i, j = i[which], j[which]
            key = bw.mix(bw.mix(np.full(len(i), parent, np.int64).view(_U) + node[pivots[j]].view(_U)) + at.astype(_U))
            link = pa.array(node[pivots[j]], mask=~linked[i, j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(node[rows[i]]),
                    pa.array(label[rows[i]]),
                    pa.array(home[rows[i]] & (nearest[i] == j) & (ring[i, j] == at)),
                    pa.array([raw[x] for x in rows[i].tolist()], pa.binary()),
                    pa.array(np.full(len(i), members, np.int64)),
                    link,
                ],
                names=["region", "node", "known", "home", "set", "parent_members", "link"],
            )

    share = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    all_rows = join_groups(rows.select("region", "node", "known", "home", "set"), sizes, ["region"], F.col("node")).filter("members IS NOT NULL")
    parts = F.ceil(F.col("members") / PART)
    mine = all_rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(11)), parts)).withColumn("lead", F.lit(False))
    lead = all_rows.filter(F.col("home") & ((share < F.col("pivots") / F.col("homes")) | (F.col("node") == F.col("least"))))
    lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).withColumn("lead", F.lit(True))
    dealt = mine.unionByName(lead).select(
        F.xxhash64("region", "part").alias("bucket"), F.col("region").alias("bucket_region"), "node", "known", "home", "set", "members", "lead"
    )
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(
        tidy(go), "region bigint, node bigint, known bigint, home boolean, set binary, parent_members bigint, link bigint"
    )


def _cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of regions (region, members, weight) in cells of two blocks each, so that all blocks meet."""
    count = F.ceil(F.col("weight") * 2).cast("bigint")
    joined = join_groups(rows, sizes, ["region"], F.col("node")).filter("members IS NOT NULL").withColumn("count", F.greatest(count, F.lit(2).cast("bigint")))
    placed = joined.withColumn("own", F.pmod(F.xxhash64("node", F.lit(13)), F.col("count")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return placed.select(
        F.xxhash64("region", lo, hi).alias("region"),
        "node",
        "known",
        "home",
        F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).cast("bigint").alias("block"),
        "set",
    )


def joined(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all that is linked within each region of sets (node, region, set)."""
    rows = written(sets.select("region", "node", F.col("node").alias("known"), F.lit(True).alias("home"), F.lit(None).cast("bigint").alias("parent_members"), "set"), "regions")
    links: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("region").agg(
            F.count(F.lit(1)).alias("members"),
            F.count(F.when(F.col("home"), 1)).alias("homes"),
            F.min(F.when(F.col("home"), F.col("node"))).alias("least"),
            F.sum(F.length("set")).alias("bytes"),
            F.min("known").alias("k0"),
            F.max("known").alias("k1"),
            F.first("parent_members").alias("parent_members"),
        )
        weight = F.greatest(F.col("members") / BLOCK, F.col("bytes") / REGION_BYTES)
        pivots = F.least(F.lit(float(PIVOTS)), F.lit(float(PIVOT_BYTES)) / (F.col("bytes") / F.col("members")))
        sizes = sizes.filter("k0 <> k1 AND homes > 0").drop("k0", "k1").withColumn("weight", weight).withColumn("pivots", F.greatest(F.lit(2.0), pivots))
        fits = (F.col("weight") <= 1) | (F.col("members") <= 2)
        stuck = F.coalesce(F.col("members") > STUCK * F.col("parent_members"), F.lit(False))
        sizes = written(sizes.withColumn("fate", F.when(fits, 0).when(stuck, 1).otherwise(2)), "region-sizes")
        fates = {r["fate"] for r in sizes.select("fate").distinct().collect()}
        ready = []
        if 0 in fates:
            small = join_groups(rows, sizes.filter("fate = 0").select("region", "fate"), ["region"], F.col("node")).filter("fate IS NOT NULL")
            ready.append(small.select("region", "node", "known", "home", F.lit(-1).cast("bigint").alias("block"), "set"))
        if 1 in fates:
            ready.append(_cells(rows, sizes.filter("fate = 1").select("region", "members", "weight")))
        if ready:
            links.append(written(_verified(functools.reduce(DataFrame.unionByName, ready), percent), "verified"))
        if 2 not in fates:
            discard(rows, sizes)
            out = written(functools.reduce(DataFrame.unionByName, links), "metric-links") if links else None
            discard(*links)
            return out
        large = sizes.filter("fate = 2").select("region", "members", "homes", "least", "pivots")
        placed = written(_placed(rows, large, percent), "rings")
        discard(rows, sizes)
        links.append(written(placed.filter("link IS NOT NULL AND link <> node").select(F.col("node").alias("a"), F.col("link").alias("b")).distinct(), "pivot-links"))
        rows = placed.select("region", "node", "known", "home", "parent_members", "set")
        rows.written_to = placed.written_to


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    if not 50 < percent < 100:
        raise ValueError("percent is 51 to 99")
    signed = written(signed_sets(docs, k, percent), "signed")
    full = signed.filter("n_shingles > 0")
    classes = written(full.dropDuplicates(["node"]), "classes")
    shared = written(shared_buckets(classes), "shared-buckets")
    ties = written(bucket_links(shared, classes, percent), "ties")
    discard(shared)
    clusters = written(components(ties), "clusters")
    discard(ties)
    members = classes.select("node", "doc_id").join(clusters, "node")
    links = joined(cluster_sets(docs, members, k), percent)
    discard(clusters)
    held = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    if links is not None:
        held = held.join(components(links), "node", "left")
    else:
        held = held.withColumn("component", F.lit(None).cast("bigint"))
    # Only classes of several rows, or linked ones, change anything.
    held = written(held.filter("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node")), "held")
    least = held.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = written(join_groups(held.select("node", "component"), least, ["component"], F.col("node")).select("node", "component_id"), "moved")
    discard(classes, held, *([links] if links is not None else []))
    out = join_groups(signed.select("doc_id", "n_shingles", "node"), moved, ["node"], F.col("doc_id"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=3, percent=90)
