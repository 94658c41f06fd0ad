"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

1. ``signatures``: each text's distinct word shingles, a key of the whole set, its SuperMinHash signature and bands.
2. Texts with equal sets are one class from here on, known by a hash of the set; the row of its least doc_id stands for it.
3. Bands group the classes. Within buckets of up to ``SMALL_BUCKET`` classes, pairs whose signatures agree in
   ``MIN_AGREE`` of the slots or more are united; larger buckets are united whole, which only makes more work for the
   next step. The components of these candidate links are clusters: every pair that could be near lies inside one.
4. ``verify_clusters``: pairs of a cluster are confirmed on their full sets, most alike first, skipping pairs that are
   connected already. A cluster of over ``BLOCK`` classes is split into blocks. First each block is confirmed alone, so
   that each text goes to one task. Then one class of each group found so meets those of the other blocks, again and again, which
   unites the parts of a large group of true copies. What is still outside the cluster's main component meets all of it, but by
   signatures of ``WIDE`` slots only: cells of two wide blocks name the texts that agree with one outside their component
   in ``WIDE_AGREE`` of the slots, and only those texts meet in the cells of their two blocks. So no task holds more than
   two blocks, no pair list is ever written, a family of texts that share half of their words costs signatures and not
   texts, and no link that matters for connectivity is lost.
5. Components of the confirmed links; copies follow their class.

A pair of likeness 0.8 shares none of the bands with probability 4e-7, its signatures agree in less than MIN_AGREE of the
slots with about 1e-6, and in less than WIDE_AGREE of the wide slots with about 1e-7. The same tests hold for groups of any
size.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are kept; rows with a null
doc_id have a null component and are kept; repeated rows share their doc_id and are kept or not together; rows of one
doc_id with unlike texts are linked through their own texts only, so they may lie in several components, and each is kept
or not by itself; texts of any length are taken whole, alone in their batch; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks
from footfall.llm import bytewords as bw
from footfall.llm._common import byte_buffer, discard, documents, join_groups, shielded, text_batches, tidy, written
from footfall.llm.components import components

#: 28 bands of 4 values: a pair of likeness 0.8 shares no band with probability 4e-7.
BANDS, ROWS = 28, 4
BATCH = 1 << 20
SMALL_BUCKET = 64
BLOCK = 512
MIN_AGREE = 0.6
#: Slots of the signatures that blocks of a large cluster are compared by, the share that has to agree, and the
#: blocks of texts in a block of signatures.
WIDE, WIDE_AGREE, WIDE_BLOCKS = 256, 0.66, 8

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(row: np.ndarray, element: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures (n_rows x m) of the sets given as (row, element hash).

    Round j gives each element a fraction r and the next place p of its own random permutation of the m slots; slot p
    keeps the least r + j. A row ends once all its slots hold values below j + 1, which later rounds can't undercut, so
    large sets need one round. Whole part and fraction are held as 16 and 48 bits of one number.
    """
    sig = np.full(n_rows * m, _FULL, np.uint64)
    if not len(row):
        return sig.reshape(n_rows, m)
    state = bw.mix(element + np.uint64(0x5851F42D4C957F2D))
    perm = None
    for j in range(m):
        state = bw.mix(state + np.uint64(0x9E3779B97F4A7C15))
        pick = j + ((state & np.uint64(0xFFFF)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            lines = np.arange(len(row))
            slot = perm[lines, pick].astype(np.int64)
            perm[lines, pick] = perm[:, j]
        value = (state >> np.uint64(16)) | (np.uint64(j) << np.uint64(48))
        np.minimum.at(sig, row * m + slot, value)
        if j == m - 1:
            break
        open_rows = (sig.reshape(n_rows, m) >= (np.uint64(j + 1) << np.uint64(48))).any(axis=1)
        left = open_rows[row]
        if not left.any():
            break
        if perm is None:
            row, state, pick = row[left], state[left], pick[left]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(row), 1))
            perm[np.arange(len(row)), pick] = 0
        elif left.sum() < 0.7 * len(row):
            row, state, perm = row[left], state[left], perm[left]
    return sig.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each row; different bands never share keys on purpose."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), np.uint64(b + 1))
        for r in range(rows):
            acc = bw.mix(acc * np.uint64(0x2545F4914F6CDD1D) + sig[:, b * rows + r])
        out[:, b] = acc
    return out


def text_sets(column, k: int):
    """(row, hash, ends) of the distinct k-word shingles of an Arrow text column; row i's are hash[ends[i - 1]:ends[i]]."""
    raw, starts, ends = byte_buffer(column)
    raw = bw.lower(raw)
    row, begin, end = bw.word_bounds(raw, starts, ends)
    word = bw.hash_of(bw.prefix_hash(raw), begin, end)
    row, element = bw.shingles(row, word, k, len(starts))
    return row, element, np.cumsum(np.bincount(row, minlength=len(starts)))


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tkey, n_shingles, key1 and key2 (128 bits of the whole set), sig (a byte per slot), bands of docs (doc_id, tkey, text)."""
    import pyarrow as pa

    def sign(batches):
        for batch in text_batches(batches, limit=BATCH):
            row, element, ends = text_sets(batch.column("text"), k)
            n = batch.num_rows
            sig = super_minhash(row, element, n)
            bands = band_keys(sig).view(np.int64)
            short = bw.mix(sig).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("tkey"),
                    pa.array(np.diff(ends, prepend=0).astype(np.int64)),
                    pa.array(_row_sums(bw.mix(element), ends).view(np.int64)),
                    pa.array(_row_sums(bw.mix(element ^ np.uint64(0xA0761D6478BD642F)), ends).view(np.int64)),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())
                    ),
                ],
                names=["doc_id", "tkey", "n_shingles", "key1", "key2", "sig", "bands"],
            )

    return docs.select("doc_id", "tkey", "text").mapInArrow(
        tidy(sign), "doc_id bigint, tkey bigint, n_shingles bigint, key1 bigint, key2 bigint, sig binary, bands array<bigint>"
    )


def _small_bucket_links(members: DataFrame) -> DataFrame:
    """Links of pairs in one bucket whose signatures agree enough; members: bucket, id, sig, at most SMALL_BUCKET a bucket."""
    import pyarrow as pa

    slots = BANDS * ROWS
    need = MIN_AGREE * slots

    def link(batches):
        for table in blocks.whole_buckets(batches):
            yield from pairs(table)

    def pairs(table):
        bucket, ids = table.column("bucket").to_numpy(), table.column("id").to_numpy()
        raw, _, _ = byte_buffer(table.column("sig"))
        sig = raw.reshape(len(ids), slots)
        for gap in range(1, SMALL_BUCKET):
            at = np.flatnonzero(bucket[gap:] == bucket[:-gap]) if len(bucket) > gap else []
            if not len(at):
                break
            for part in np.array_split(at, 1 + len(at) // 20_000):
                good = part[(sig[part] == sig[part + gap]).sum(axis=1) >= need]
                yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(ids[good + gap])], names=["a", "b"])

    dealt = members.select("bucket", "id", "sig").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(link), "a bigint, b bigint")


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """node, component of the classes (node, sig, bands) that may be near another."""
    bucket = reps.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    sizes = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    shared = written(bucket.join(sizes, "bucket"), "buckets")
    large = shared.filter(F.col("n") > SMALL_BUCKET).select(F.col("id").alias("a"), F.col("least").alias("b"))
    small = shared.filter(F.col("n") <= SMALL_BUCKET).select("bucket", "id")
    small = small.join(reps.select(F.col("node").alias("id"), "sig"), "id")
    # Written first: two Python functions in one stage would hold two workers for each core.
    links = written(large.filter("a <> b").unionByName(_small_bucket_links(small)), "candidate-links")
    discard(shared)
    out = written(components(links), "clusters")
    discard(links)
    return out


def _confirm(sets: list[np.ndarray], sig: np.ndarray, percent: int, left: np.ndarray, same: np.ndarray):
    """Pairs (i, j) of a spanning forest of the confirmed links between the sets.

    Only pairs with one end in ``left`` and, as known so far, in different components ``same`` are tried.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    parent = np.arange(n)
    _, first = np.unique(same, return_index=True)
    parent = first[np.searchsorted(same[first], same)] if n else parent

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ends_a, ends_b, agree = [], [], []
    for i in range(n):
        j = np.arange(i + 1, n)
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (100 * low >= percent * high) & (left[i] | left[j]) & (same[i] != same[j])
        j = j[ok]
        match = (sig[j] == sig[i]).mean(axis=1)
        j, match = j[match >= MIN_AGREE], match[match >= MIN_AGREE]
        agree.append(match)
        ends_a.append(np.full(len(j), i))
        ends_b.append(j)
    if not ends_a:
        return []
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    order = np.argsort(-np.concatenate(agree), kind="stable")
    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        ri, rj = find(i), find(j)
        if ri == rj:
            continue
        both = np.concatenate([sets[i], sets[j]])
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        if 100 * inter >= percent * (len(both) - inter):
            parent[max(ri, rj)] = min(ri, rj)
            out.append((i, j))
    return out


def _verify(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links of members (bucket, id, text, known, left), which meet by bucket."""
    import pyarrow as pa

    def check(batches):
        for table in blocks.whole_buckets(batches):
            yield from groups(table)

    def groups(table):
        bucket, ids = table.column("bucket").to_numpy(), table.column("id").to_numpy()
        known, left = table.column("known").to_numpy(), np.array(table.column("left").to_pylist(), bool)
        found_a, found_b = [], []
        for lo, hi in blocks.runs(bucket):
            if hi - lo < 2:
                continue
            sets, sigs = [], []
            for part in text_batches(table.slice(lo, hi - lo).select(["text"]).combine_chunks().to_batches(), limit=BATCH):
                row, element, ends = text_sets(part.column("text"), k)
                sets += np.split(element, ends[:-1])
                sigs.append(bw.mix(super_minhash(row, element, part.num_rows)).astype(np.uint8))
            for i, j in _confirm(sets, np.concatenate(sigs), percent, left[lo:hi], known[lo:hi]):
                found_a.append(ids[lo + i])
                found_b.append(ids[lo + j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(found_a, np.int64)), pa.array(np.array(found_b, np.int64))], names=["a", "b"]
        )

    dealt = members.select("bucket", "id", "text", "known", "left").repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(tidy(check), "a bigint, b bigint")


def _wide_signatures(texts: DataFrame, k: int) -> DataFrame:
    """node and wide (a byte for each of WIDE slots) of texts (node, text)."""
    import pyarrow as pa

    def sign(batches):
        for batch in text_batches(batches, limit=BATCH):
            row, element, _ = text_sets(batch.column("text"), k)
            sig = bw.mix(super_minhash(row, element, batch.num_rows, WIDE)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "wide"])

    return texts.select("node", "text").mapInArrow(tidy(sign), "node bigint, wide binary")


def _wanted(cells: DataFrame) -> DataFrame:
    """group, lo, hi, id: the texts that two blocks have to compare, from cells of wide signatures.

    cells: bucket, group, id, block, known, left, wide. Two members are a candidate if one is left, they are in
    different components as known so far, and their signatures agree.
    """
    import pyarrow as pa

    def find(batches):
        for table in blocks.whole_buckets(batches):
            bucket, ids, block, known = (table.column(c).to_numpy() for c in ("bucket", "id", "block", "known"))
            left = np.array(table.column("left").to_pylist(), bool)
            raw, _, _ = byte_buffer(table.column("wide"))
            sig, group = raw.reshape(len(ids), WIDE), table.column("group").to_numpy()
            for a, b in blocks.runs(bucket):
                found = [np.zeros((0, 3), np.int64)]
                for i in range(a, b - 1):
                    j = np.arange(i + 1, b)
                    j = j[(left[j] | left[i]) & (known[j] != known[i])]
                    j = j[(sig[j] == sig[i]).sum(axis=1) >= WIDE_AGREE * WIDE]
                    if len(j):
                        lo, hi = np.minimum(block[j], block[i]), np.maximum(block[j], block[i])
                        found.append(np.stack([lo, hi, ids[j]], axis=1))
                        found.append(np.unique(np.stack([lo, hi, np.full(len(j), ids[i])], axis=1), axis=0))
                    if len(found) > 256:
                        found = [np.unique(np.concatenate(found), axis=0)]
                rows = np.unique(np.concatenate(found), axis=0)
                columns = [np.full(len(rows), group[a]), *rows.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["group", "lo", "hi", "id"])

    dealt = cells.repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(tidy(find), "group bigint, lo bigint, hi bigint, id bigint").distinct()


def verify_clusters(docs: DataFrame, reps: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets, enough to connect all that is connected inside each cluster.

    reps: node, doc_id, tkey: the row of docs (doc_id, tkey, text) that stands for each class.
    """
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = join_groups(clusters, sizes, ["component"], F.col("node")).withColumnRenamed("component", "group")
    wanted = placed.join(reps.select("node", "doc_id", "tkey"), "node")
    texts = docs.select("doc_id", "tkey", "text").join(wanted, ["doc_id", "tkey"]).drop("doc_id", "tkey")
    # Rows that are there twice need no second look.
    held = written(texts.dropDuplicates(["node"]), "cluster-texts")
    held = held.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    fresh = (F.col("id").alias("known"), F.lit(True).alias("left"))
    alone = held.select(F.xxhash64("group", "block").alias("bucket"), F.col("node").alias("id"), "text")
    links = written(_verify(alone.select("*", *fresh), k, percent), "near-links")
    large = held.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return links
    ids, text_of = large.select("node", "group", "blocks", "block"), held.select(F.col("node").alias("id"), "text")
    links = blocks.meet_heads(ids, links, lambda meet: _verify(text_of.join(meet, "id").select("*", *fresh), k, percent), BLOCK)
    known = blocks.left_over(ids, links)
    if known.isEmpty():
        return links
    # What is not in a cluster's main component meets the whole of it, first by signatures.
    wide = _wide_signatures(large.join(known.select("node"), "node", "left_semi"), k).withColumnRenamed("node", "id")
    wanted = written(_wanted(blocks.cells(known, BLOCK, WIDE_BLOCKS).join(wide, "id")), "wanted-texts")
    asked = wanted.join(known.select(F.col("node").alias("id"), "known", "left"), "id").join(text_of, "id")
    asked = asked.select(F.xxhash64("group", "lo", "hi").alias("bucket"), "id", "text", "known", "left")
    return links.unionByName(written(_verify(asked, k, percent), "near-links"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text) and text: what tells a row from others of its doc_id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def near_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id, kept of each row of docs."""
    docs = _keyed(docs)
    signed = written(signatures(docs, k), "signatures")
    node = F.xxhash64("key1", "key2", "n_shingles").alias("node")
    full = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("*", node)
    classes = written(full.groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    first = classes.select("rep.doc_id", "rep.tkey")
    reps = written(full.join(first, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"]).select("node", "doc_id", "tkey", "sig", "bands"), "representatives")
    clusters = candidate_clusters(reps)
    links = verify_clusters(docs, reps, clusters, k, percent)
    linked = components(links).withColumnRenamed("component", "_group")
    groups = classes.join(linked, "node", "left").select("node", "copies", F.col("rep.doc_id").alias("least"), "_group")
    # Only classes of several documents, or linked ones, change anything.
    groups = written(groups.filter("copies > 1 OR _group IS NOT NULL").withColumn("_group", F.coalesce("_group", "node")), "groups")
    least = groups.groupBy("_group").agg(F.min("least").alias("component"))
    moved = written(join_groups(groups.select("node", "_group"), least, ["_group"], F.col("node")).select("node", "component"), "moved")
    discard(classes, reps, clusters, groups)
    joined = join_groups(signed.select("doc_id", "tkey", "n_shingles", node), moved, ["node"], F.col("doc_id"))
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "tkey", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    return near_rows(docs, k, percent).drop("tkey")


def minhash_query(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), k=4)


def minhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, with all its columns."""
    dropped = near_rows(docs, k=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")).distinct()
    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_tkey"))
    inner, restored = shielded(docs)
    return restored(inner.join(dropped, same, "left_anti"))
