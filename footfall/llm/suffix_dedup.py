"""Removal of byte strings that repeat anywhere in a corpus, by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere, in the same text or another.

1. ``anchors``: of the k-byte strings in each window of ``length`` bytes, the one of least hash is the window's anchor.
   Equal windows have equal anchors at the same offset, so a repeated window shows as a repeated anchor. An anchor's
   context are all bytes of the windows that chose it. Only these narrow rows are counted and joined.
2. Contexts that are there twice or more are repeats in full. Contexts that are there once, but whose anchor is in
   other contexts too, are compared with those.
3. ``compare``: the contexts that share anchors are dealt to tasks by anchor, in shards; each shard's Burrows-Wheeler
   transform is built, the transforms are merged by interleave refinement, and common prefixes of ``length`` or more
   mark the window starts that repeat. See ``bwt_merge``.
4. Anchors with over ``GROUP`` different contexts, as at the ends of a passage that a third of all texts hold, are first
   split by halves of the offset range: windows of a half share a core of bytes, which becomes the new key. Contexts
   that fall together are settled by their count; after enough halvings a cell is one offset and the key is the window
   itself. So no group is unbounded in one task, and each context takes part in a few rows a level.
5. The spans of each text meet by text, and are cut out.

Every window that is not compared is known to be unique, so the result is exact up to 64-bit hash collisions.

Defined results: null counts as empty; texts shorter than ``length`` stay whole; rows that are there twice are copies of
each other; equal doc_ids with different texts are different texts; an empty table gives no rows; other columns pass
through ``removed``'s ``keep_columns`` and are ignored by the query. Passages of any frequency are handled alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import bwt_merge
from footfall.llm import bytewords as bw
from footfall.llm._common import byte_buffer, discard, documents, join_groups, keep_counted, shielded, text_batches, tidy, written

LENGTH = 400
#: Different contexts of one anchor that one task compares at most.
GROUP = 2048
#: Contexts in a shard, and in the shards that are merged at a time.
SHARD, BLOCK = 4096, 16384
BATCH = 1 << 20
_PLACE = 24


def anchor_size(length: int) -> int:
    return max(1, length // 8)


def _least_places(keys: np.ndarray, window: int) -> np.ndarray:
    """The place of the least key in each window keys[p : p + window], the leftmost of equals."""
    n = len(keys)
    mask = np.uint64((1 << _PLACE) - 1)
    packed = (keys & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    grid = padded.reshape(blocks, window)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    return (np.minimum(after[:count], before[window - 1 : window - 1 + count]) & mask).astype(np.int64)


def find_anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """row, place in the text, lo, hi, key and context hash of each anchor: it serves the windows from lo to hi before it."""
    k = anchor_size(length)
    window = length - k + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none, none
    sums = bw.prefix_hash(raw)
    inverse = bw.powers(len(sums), bw._INVERSE)
    grams = bw.mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])
    place = _least_places(grams, window)
    long = ends - starts >= length
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge[:-1])[: len(place)] > 0)
    if not len(valid):
        return none, none, none, none, none, none
    owners = np.flatnonzero(long)
    row = owners[np.searchsorted(starts[owners], valid, side="right") - 1]
    chosen = place[valid]
    first = np.ones(len(valid), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    tail = np.append(head[1:], len(valid)) - 1
    at, low, high, row = chosen[head], valid[head], valid[tail], row[head]
    lo, hi = at - low, at - high
    context = bw.mix(bw.hash_of(sums, low, high + length) + lo.astype(bw.U64) * bw.U64(0x9E3779B97F4A7C15) + hi.astype(bw.U64))
    return row, at - starts[row], lo, hi, bw.mix(grams[at]).view(np.int64), context.view(np.int64)


def anchors(texts: DataFrame, length: int, most: int = (1 << _PLACE) - 1) -> DataFrame:
    """doc_id, tkey, at, lo, hi, anchor, context of texts (doc_id, tkey, text); a part of a long text has ``most`` bytes."""
    import pyarrow as pa

    def pieces(raw, starts, ends):
        """The batch as it is, or one very long text in parts; each window starts in one part only."""
        if len(raw) <= most:
            yield raw, starts, ends, 0
            return
        for low in range(0, len(raw) - length + 1, most - length + 1):
            part = raw[low : low + most]
            yield part, np.array([0]), np.array([len(part)]), low

    def go(batches):
        for batch in text_batches(batches, limit=BATCH):
            for raw, starts, ends, shift in pieces(*byte_buffer(batch.column("text"))):
                row, at, lo, hi, key, context = find_anchors(raw, starts, ends, length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("tkey").take(take),
                        pa.array(at + shift, pa.int64()),
                        pa.array(lo.astype(np.int32)),
                        pa.array(hi.astype(np.int32)),
                        pa.array(key),
                        pa.array(context),
                    ],
                    names=["doc_id", "tkey", "at", "lo", "hi", "anchor", "context"],
                )

    return texts.select("doc_id", "tkey", "text").mapInArrow(
        tidy(go), "doc_id bigint, tkey bigint, at bigint, lo int, hi int, anchor bigint, context bigint"
    )


def with_contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc_id, tkey, at, lo, hi, anchor, context, n) with the context's bytes in ``bytes``."""
    import pyarrow as pa

    grouped = wanted.groupBy("doc_id", "tkey").agg(
        F.collect_list(F.struct("at", "lo", "hi", "anchor", "context", "n")).alias("items")
    )
    # Rows that are there twice give their contexts twice; one of each is enough.
    joined = _join_by_text(texts, grouped, "inner").dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text", "items")
    names = ["doc_id", "tkey", "at", "lo", "hi", "anchor", "context", "n", "bytes"]

    def go(batches):
        for batch in text_batches(batches, limit=BATCH):
            raw, starts, _ = byte_buffer(batch.column("text"))
            lists = batch.column("items")
            items = lists.flatten()
            owner = pa.array(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()))
            at, lo, hi = (items.field(f).to_numpy(zero_copy_only=False) for f in ("at", "lo", "hi"))
            begin = starts[owner.to_numpy()] + at - lo
            size = lo - hi + length
            data = raw.tobytes()
            found = pa.array([data[b : b + n] for b, n in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner),
                    batch.column("tkey").take(owner),
                    *(items.field(f) for f in ("at", "lo", "hi", "anchor", "context", "n")),
                    found,
                ],
                names=names,
            )

    return joined.mapInArrow(
        tidy(go),
        "doc_id bigint, tkey bigint, at bigint, lo int, hi int, anchor bigint, context bigint, n bigint, bytes binary",
    )


def _join_by_text(texts: DataFrame, side: DataFrame, how: str) -> DataFrame:
    other = side.withColumnsRenamed({"doc_id": "_doc", "tkey": "_tkey"})
    return texts.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")), how).drop(
        "_doc", "_tkey"
    )


def compare(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, tkey, begin, end of the repeated spans of contexts that are there once.

    rows: key (contexts of different keys are not compared), doc_id, tkey, at, lo, hi, n, bytes. Groups are bounded.
    """
    import pyarrow as pa

    left = length - anchor_size(length)
    width = left + length

    def go(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            key = table.column("key").to_numpy()
            while len(key) > BLOCK:
                cut = int(np.searchsorted(key, key[BLOCK], side="left")) or int(np.searchsorted(key, key[0], side="right"))
                if cut >= len(key):
                    break
                yield block(table.slice(0, cut))
                table, key = table.slice(cut), key[cut:]
            held = table
        if held is not None and held.num_rows:
            yield block(held)

    def block(table):
        key = table.column("key").to_numpy()
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint16)
        lo, hi, at = (table.column(c).to_numpy() for c in ("lo", "hi", "at"))
        raw, starts, ends = byte_buffer(table.column("bytes"))
        n = len(key)
        # Deal each group's contexts to the shards in turn.
        count = max(1, -(-n // SHARD))
        shards, members = [], []
        for s in range(count):
            own = np.arange(s, n, count)
            frame = np.zeros((len(own), width), np.uint16)
            for i, j in enumerate(own.tolist()):
                frame[i, left - lo[j] : left - hi[j] + length] = raw[starts[j] : ends[j]].astype(np.uint16) + 1
            shards.append(bwt_merge.Shard(group[own], np.ascontiguousarray(frame.T), left + 1))
            members.append(own)
        found_row, found_lo, found_hi = [], [], []
        for own, hit in zip(members, bwt_merge.merge(shards, length), strict=True):
            flags = np.zeros((len(own), left + 3), np.int8)
            flags[:, 1 : left + 2] = hit.T
            row, edge = np.nonzero(np.diff(flags, axis=1))
            found_row.append(own[row[::2]])
            found_lo.append(left - edge[::2])  # the first column of a run is its largest offset
            found_hi.append(left - edge[1::2] + 1)
        row = np.concatenate(found_row)
        once = table.column("n").to_numpy()[row] == 1
        row = row[once]
        begin = at[row] - np.concatenate(found_lo)[once]
        end = at[row] - np.concatenate(found_hi)[once] + length
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").take(take).combine_chunks(),
                table.column("tkey").take(take).combine_chunks(),
                pa.array(begin, pa.int64()),
                pa.array(end, pa.int64()),
            ],
            names=["doc_id", "tkey", "begin", "end"],
        )

    dealt = rows.select("key", "doc_id", "tkey", "at", "lo", "hi", "n", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(go), "doc_id bigint, tkey bigint, begin bigint, end bigint")


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Contexts (key, c0, c1, ...) cut to the two halves of their offset cell, with the half's core in the key."""
    mid = F.floor((F.col("c0") + F.col("c1")) / 2).cast("int")
    both = rows.withColumn(
        "cell", F.explode(F.array(F.struct(F.col("c0").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("c1").alias("b"))))
    )
    lo, hi = F.least("lo", F.col("cell.b") - 1), F.greatest("hi", F.col("cell.a"))
    cut = both.filter(lo >= hi).select(
        "key", "doc_id", "tkey", "at", "n", "bytes", "lo", "hi", "cell", lo.alias("lo2"), hi.alias("hi2")
    )
    core = F.substring("bytes", F.col("lo") - F.col("cell.a") + 1, F.col("cell.a") - F.col("cell.b") + 1 + length)
    part = F.substring("bytes", F.col("lo") - F.col("lo2") + 1, F.col("lo2") - F.col("hi2") + length)
    return cut.select(
        F.xxhash64("key", "cell.a", "cell.b", core, F.hash(core)).alias("key"),
        "doc_id",
        "tkey",
        "at",
        "n",
        part.alias("bytes"),
        F.col("lo2").alias("lo"),
        F.col("hi2").alias("hi"),
        F.col("cell.a").alias("c0"),
        F.col("cell.b").alias("c1"),
        F.xxhash64(part, "lo2", "hi2", F.hash(part)).alias("context"),
    )


def repeated_spans(texts: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """doc_id, tkey, begin, end: spans of bytes whose windows all repeat; they overlap. A written table."""
    found = written(anchors(texts, length), "anchors")
    # Anchors that are there twice or more; the rest is unique.
    again = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "anchor-counts")
    total = found.count()
    common = written(keep_counted(found, again, ["anchor"], total), "common-anchors")
    discard(found, again)
    used = [common]
    contexts = written(
        common.groupBy("anchor", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tkey", "at", "lo", "hi")).alias("rep")
        ),
        "contexts",
    )
    used.append(contexts)
    whole = contexts.filter("n > 1").select("anchor", "context", F.col("n").alias("times"))
    full = keep_counted(common, whole, ["anchor", "context"], total)
    spans = full.select(
        "doc_id",
        "tkey",
        (F.col("at") - F.col("lo")).alias("begin"),
        (F.col("at") - F.col("hi") + length).alias("end"),
    )
    kinds = (
        contexts.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .filter("kinds > 1 AND least = 1")
        .select("anchor", "kinds")
    )
    open_ = join_groups(contexts, kinds, ["anchor"], F.col("context")).filter(F.col("kinds").isNotNull())
    wanted = open_.select("rep.*", "anchor", "context", "n")
    window = length - anchor_size(length) + 1
    rows = written(
        with_contexts(texts, wanted, length)
        .withColumnRenamed("anchor", "key")
        .withColumn("c0", F.lit(0))
        .withColumn("c1", F.lit(window)),
        "open-contexts",
    )
    used.append(rows)
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group)
        sizes = written(sizes, "large-groups")
        used.append(sizes)
        if sizes.isEmpty():
            out = written(spans.unionByName(compare(rows, length)), "spans")
            discard(*used)
            return out
        spans = spans.unionByName(compare(rows.join(sizes, "key", "left_anti"), length))
        halves = written(
            _halved(join_groups(rows, sizes, ["key"], F.struct("doc_id", "at")).filter(F.col("size").isNotNull()), length),
            "halves",
        )
        same = halves.groupBy("key", "context").agg(
            F.sum("n").alias("times"), F.min(F.struct("doc_id", "tkey", "at")).alias("least")
        )
        kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("fewest"))
        same = join_groups(same, kinds, ["key"], F.col("context"))
        tallied = written(
            join_groups(halves, same, ["key", "context"], F.struct("doc_id", "at")), "tallied"
        )
        discard(halves)
        used.append(tallied)
        # Settled: what is there twice or more. Each text that holds it alone so far gets its span.
        spans = spans.unionByName(
            tallied.filter("times > 1 AND n = 1").select(
                "doc_id", "tkey", (F.col("at") - F.col("lo")).alias("begin"), (F.col("at") - F.col("hi") + length).alias("end")
            )
        )
        # Open: what is there once beside other contexts; one of each of the others stays as evidence.
        first = F.col("least") == F.struct("doc_id", "tkey", "at")
        rows = tallied.filter((F.col("kinds") > 1) & (F.col("fewest") == 1) & first).select(
            "key", "doc_id", "tkey", "at", "lo", "hi", F.col("times").alias("n"), "bytes", "c0", "c1"
        )


def united(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begin, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(
    docs: DataFrame, length: int = LENGTH, keep_columns: tuple[str, ...] = ("doc_id",), whole_characters: bool = False
) -> DataFrame:
    """``keep_columns`` of each row with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary), what is left.

    With ``whole_characters`` a UTF-8 character that a span covers in part stays, so that kept is UTF-8 again.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    base = docs.select(*keep_columns, *(["text"] if "text" not in keep_columns else []))
    texts = base.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tkey", "text")
    spans = repeated_spans(ids, length)
    merged = spans.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = _join_by_text(texts, merged, "left").select(*base.columns, "spans")
    schema = StructType([f for f in base.schema.fields if f.name in keep_columns])
    for f in StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").fields:
        schema = schema.add(f)
    names = [f.name for f in schema.fields]

    def go(batches):
        for batch in text_batches(batches, limit=BATCH):
            raw, starts, ends = byte_buffer(batch.column("text"))
            data = raw.tobytes()
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[starts[i] : ends[i]]
                runs = united([s["begin"] for s in spans], [s["end"] for s in spans]) if spans else []
                if whole_characters:
                    runs = [(a, b) for a, b in (inner(text, a, b) for a, b in runs) if a < b]
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep_columns),
                    *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                ],
                names=names,
            )

    def inner(text: bytes, a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    return joined.mapInArrow(tidy(go), schema)


def suffix_query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and what is left as ``text``: a character cut in two is U+FFFD there, kept_sha256 is of the bytes."""
    cut = removed(documents(spark, sf_dir))
    return cut.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


#: Passages of over 50 words are meant to go; words of this length on average make them this many bytes.
STAGE_LENGTH = 200


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their repeated passages; those of which nothing but blanks is left go."""
    inner, restored = shielded(docs, ("doc_id", "text", "n_chars"))
    cut = removed(inner, STAGE_LENGTH, keep_columns=tuple(inner.columns), whole_characters=True)
    changed = F.col("n_removed") > 0
    rest = F.decode("kept", "UTF-8")
    left = cut.filter(~changed | rest.rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(changed, rest).otherwise(F.col("text"))
    return restored(
        left.withColumn("text", text).withColumn(
            "n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        )
    )
