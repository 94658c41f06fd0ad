"""Document fingerprints by a randomised edit embedding.

The embedding walks over a text with one pointer: at step j it writes the character under the pointer and then moves on,
or stays, by a random bit that depends on j and the character. All texts share these bits, so texts a few edits apart
soon walk in step again and their embeddings differ in few places: edit distance becomes Hamming distance.

A fingerprint samples the embedding at fixed places, ``SAMPLES`` in each octave of steps ([0, 64), [64, 128), [128, 256)
and so on), so that it covers texts of any length to their ends, and keeps ``BITS`` bits of a hash of what stands there.
Likeness weighs octaves by the steps they stand for: it estimates one minus the Hamming distance over the longer
embedding. Characters are code points; the walk uses 256 classes of them, the samples the code points themselves.

``near_classes`` finds near texts: keys over some sampled places (bit-sampled bands) bring texts together, and the
likeness of the fingerprints verifies what is in a bucket. The query returns the class of each text beside the
fingerprints.

Defined results: a null text counts as empty; an empty text has an empty fingerprint and is like another empty text
only; the next document follows by (doc_id, text), null ids first; the last is followed by the first; a table of one row
is its own next document; repeated rows follow each other; an empty table gives no rows; other columns are ignored. A text
with an empty fingerprint, and one that is near no other, is a class alone; a class is named by its least doc_id, and a
row with a null doc_id has the class of its text, which is null where no other id is in it.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks
from footfall.llm import bytewords as bw
from footfall.llm._common import documents, discard, join_groups, text_batches, tidy, written
from footfall.llm.components import components

#: Random bits repeat after this many steps.
PERIOD = 4096
FIRST = 64
SAMPLES = 32
BANDS, BAND_PLACES = 16, 6
#: Members of a bucket that are in one block, and the blocks on a side when a large bucket's rest meets the whole of it.
BLOCK, WIDE_BLOCKS = 512, 4
BATCH = 1 << 20
NEAR = 0.8


def _jumps() -> list[list[int]]:
    """jumps[c][j]: steps until a walk at step j (modulo PERIOD) leaves a character of class c."""
    cell = np.arange(256, dtype=np.uint64)[:, None] * np.uint64(PERIOD) + np.arange(PERIOD, dtype=np.uint64)
    moves = (bw.mix(cell + np.uint64(0x8CB92BA72F3D8DD7)) & np.uint64(1)).astype(bool)
    out = np.zeros((256, PERIOD), np.int64)
    wide = np.concatenate([moves, moves], axis=1)
    ahead = np.full(256, 2 * PERIOD)
    for j in range(2 * PERIOD - 1, -1, -1):
        ahead = np.where(wide[:, j], j, ahead)
        if j < PERIOD:
            out[:, j] = ahead - j + 1
    return [row.tolist() for row in out]


def octaves(steps: int) -> int:
    """How many octaves an embedding of that many steps reaches into."""
    return 0 if steps <= 0 else max(1, (max(steps, 1) - 1).bit_length() - 5)


def sample_places(octave: int) -> np.ndarray:
    """The sampled steps of an octave, ascending."""
    low, high = (0, FIRST) if octave == 0 else (FIRST << (octave - 1), FIRST << octave)
    seeds = bw.mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(octave * 1009 + 7))
    width = (high - low) // SAMPLES
    return low + np.arange(SAMPLES) * width + (seeds % np.uint64(width)).astype(np.int64)


class Walker:
    """Walks over code points and fingerprints; a walk can go on from where a prefix ended."""

    def __init__(self):
        self.jumps = _jumps()
        self.classes = (bw.mix(np.arange(0x110000, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8)
        self.places = [sample_places(k) for k in range(40)]

    def walk(self, points: np.ndarray, step: int = 0) -> np.ndarray:
        """The step at which the walk leaves each character."""
        jumps, mask, out = self.jumps, PERIOD - 1, []
        add = out.append
        for c in self.classes[points].tobytes():
            step += jumps[c][step & mask]
            add(step)
        return np.array(out, np.int64)

    def fingerprint(self, points: np.ndarray, left: np.ndarray) -> bytes:
        """A byte for each sample up to the end of the embedding; the rest of the last octave is 0."""
        if not len(left):
            return b""
        places = np.concatenate(self.places[: octaves(int(left[-1]))])
        at = np.searchsorted(left, places, side="right")
        inside = at < len(points)
        out = np.zeros(len(places), np.uint8)
        mixed = bw.mix(points[at[inside]].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        out[inside] = (mixed % np.uint64(255)).astype(np.uint8) + 1
        return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of the longer embedding on which two texts agree, 0 to 1; of fingerprints from ``Walker``."""
    if not a and not b:
        return 1.0
    n = max(len(a), len(b))
    x = np.frombuffer(a.ljust(n, b"\0"), np.uint8).reshape(-1, SAMPLES)
    y = np.frombuffer(b.ljust(n, b"\0"), np.uint8).reshape(-1, SAMPLES)
    used = (x != 0) | (y != 0)
    same = (x == y) & used
    weight = np.array([FIRST if k == 0 else FIRST << (k - 1) for k in range(len(x))], float)[:, None]
    total = (used * weight).sum()
    return float((same * weight).sum() / total) if total else 0.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (lowercase hex) of each text."""
    import pyarrow as pa

    def go(batches):
        walker = Walker()
        for batch in text_batches(batches, limit=BATCH):
            chars, prints = [], []
            for text in batch.column("text").to_pylist():
                points = _points(text or "")
                chars.append(len(points))
                prints.append(walker.fingerprint(points, walker.walk(points)).hex())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(chars, pa.int64()), pa.array(prints, pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(go), "doc_id bigint, n_chars bigint, fingerprint string")


def in_order_with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to parts by ascending doc_id, with each part's successor as an extra row: part, extra, doc_id, text.

    A job over the ids alone finds where the parts begin; each part's first row is there twice, once more at the end of
    the part before. The driver sees one id for each part, and a row's part is found among them by bisection. Rows of one
    doc_id stay together, so ids are taken to be keys or nearly so.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    ids = docs.select(low.alias("k"))
    firsts = [
        r["k"]
        for r in ids.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()
    ]
    firsts = sorted(set(firsts))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), low.alias("k"))
    if not firsts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("extra"), "doc_id", "text")
    n, starts = len(firsts), np.array(firsts, np.int64)

    @F.pandas_udf("int")
    def placed_at(k: pd.Series) -> pd.Series:
        """Twice the part, and 1 more for a row with the part's least id."""
        part = np.searchsorted(starts, k.to_numpy(), side="right") - 1
        return pd.Series(2 * part + (starts[part] == k.to_numpy()))

    rows = rows.withColumn("place", placed_at("k")).withColumn("part", F.shiftright("place", 1))
    # Which of the rows with a part's least id is first, among repeated ids, is decided after they have met: all go along.
    begins = F.col("place") % 2 == 1
    twice = F.when(
        begins,
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")),
            F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("extra")),
        ),
    ).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))))
    placed = rows.withColumn("at", F.explode(twice)).select("at.part", "at.extra", "doc_id", "text")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n / 2) code points replaced by as many first ones of the next document. Its walk
    goes on from the middle of the text's own.
    """
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def go(batches):
        walker = Walker()
        held = None  # the row that waits for its successor: part, doc_id, text, points, left, fingerprint
        out = []

        def finish(row, text, points, fingerprint):
            _, doc, own, own_points, left, own_print = row
            half = len(own_points) // 2
            keep = len(own_points) - half
            tail = points[:half]
            edited = np.concatenate([own_points[:keep], tail])
            steps = np.concatenate([left[:keep], walker.walk(tail, int(left[keep - 1]) if keep else 0)])
            changed = walker.fingerprint(edited, steps)
            out.append(
                (
                    doc,
                    len(own_points),
                    hashlib.sha256((own[:keep] + text[:half]).encode("utf-8", "surrogatepass")).hexdigest(),
                    own_print.hex(),
                    changed.hex(),
                    likeness(own_print, changed),
                    likeness(own_print, fingerprint),
                )
            )

        def flush():
            rows = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

        for batch in text_batches(batches, limit=BATCH):
            parts, extra, docs_, texts = (batch.column(c) for c in ("part", "extra", "doc_id", "text"))
            for i in range(batch.num_rows):
                part, spare = parts[i].as_py(), extra[i].as_py()
                if spare and (held is None or held[0] != part):
                    continue
                text = texts[i].as_py()
                points = _points(text)
                left = walker.walk(points)
                fingerprint = walker.fingerprint(points, left)
                if held is not None and held[0] == part:
                    finish(held, text, points, fingerprint)
                held = None if spare else (part, docs_[i].as_py(), text, points, left, fingerprint)
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_order_with_next(docs).mapInArrow(tidy(go), schema)


@functools.cache
def _band_places(octave: int, band: int) -> np.ndarray:
    return np.random.default_rng([octave, band]).choice(SAMPLES, BAND_PLACES, replace=False)


def band_words(prints: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """One row of 2 * BANDS words for each fingerprint: octave and sampled bytes of each band, 0 where there is no band.

    The two upper octaves have a place each by whether they are odd, so texts share a bucket where their words are equal.
    """
    out = np.zeros((len(prints), 2, BANDS), np.uint64)
    lines = prints.reshape(len(prints), -1, SAMPLES)
    for octave in range(lines.shape[1]):
        rows = np.flatnonzero((tops - 1 == octave) | (tops - 2 == octave))
        part = lines[rows, octave]
        for b in range(BANDS if len(rows) else 0):
            got = part[:, _band_places(octave, b)].astype(np.uint64)
            word = np.full(len(rows), np.uint64(octave + 1))
            for p in range(BAND_PLACES):
                word = (word << np.uint64(8)) | got[:, p]
            out[rows, octave % 2, b] = np.where((got != 0).all(axis=1), word, np.uint64(0))
    return out.reshape(len(prints), 2 * BANDS)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of an Arrow binary column, filled up with 0 to one length, and the number of octaves of each."""
    raw = column.to_pylist()
    width = max(map(len, raw), default=0)
    prints = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
    return prints, np.array([len(x) // SAMPLES for x in raw], np.int64)


def _forest(prints: np.ndarray, near: float, left: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints, given the components that are ``known``.

    Only pairs with one end in ``left`` are tried, and none whose ends are connected already.
    """
    n = len(prints)
    lines = prints.reshape(n, -1, SAMPLES)
    weight = np.array([FIRST if k == 0 else FIRST << (k - 1) for k in range(lines.shape[1])], float)
    label, out = known.copy(), []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(label[j] != label[i]) & (left[j] | left[i])]
        for part in np.array_split(j, 1 + len(j) // 1024):
            used = (lines[part] != 0) | (lines[i] != 0)
            same = ((lines[part] == lines[i]) & used).sum(axis=2) @ weight
            for k in part[same >= near * (used.sum(axis=2) @ weight)].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out.append((i, k))
    return out


def _confirmed(members: DataFrame, near: float) -> DataFrame:
    """Links (a, b) of members (bucket, id, raw, known, left), which meet by bucket."""
    import pyarrow as pa

    def judge(batches):
        for table in blocks.whole_buckets(batches):
            ids, known = table.column("id").to_numpy(), table.column("known").to_numpy()
            left, found = np.array(table.column("left").to_pylist(), bool), [np.zeros((0, 2), np.int64)]
            matrix, tops = _matrix(table.column("raw"))
            for lo, hi in blocks.runs(table.column("bucket").to_numpy()):
                if hi - lo > 1:
                    prints = matrix[lo:hi, : int(tops[lo:hi].max()) * SAMPLES]
                    found.append(np.array(_forest(prints, near, left[lo:hi], known[lo:hi]), np.int64).reshape(-1, 2) + lo)
            ends = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:, 0]]), pa.array(ids[ends[:, 1]])], names=["a", "b"])

    dealt = members.select("bucket", "id", "raw", "known", "left").repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(tidy(judge), "a bigint, b bigint")


def shared_buckets(raw: DataFrame) -> DataFrame:
    """group, node, members: the fingerprints (id, raw) that share a bucket, by bucket.

    Each of BANDS keys takes BAND_PLACES sampled places of the two upper octaves. Of buckets that hold the same
    fingerprints one is kept, so that close copies are looked at once and not once a band.
    """
    import pyarrow as pa

    def bands(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = band_words(*_matrix(part.column("raw")))
                row, slot = np.nonzero(words)
                key = bw.mix(words[row, slot] + (slot.astype(np.uint64) << np.uint64(58)) + slot.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(key.view(np.int64))], names=["node", "group"]
                )

    bucket = written(raw.mapInArrow(tidy(bands), "node bigint, group bigint"), "print-bands")
    sizes = bucket.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("members > 1")
    sizes = written(sizes.groupBy("members", "all").agg(F.min("group").alias("group")).select("group", "members"), "print-buckets")
    out = written(join_groups(bucket, sizes, ["group"], F.col("node")).filter("members IS NOT NULL"), "shared-buckets")
    discard(bucket, sizes)
    return out


def near_classes(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """The rows of prints (doc_id, fingerprint (hex), any others) with component_id: the class of near texts.

    Fingerprints that are equal, or share a bucket and have a likeness of ``near`` or more, are of one class, and so is
    what these connect. A bucket is compared in blocks of about ``BLOCK``, each alone; then one member of each part found
    meets the others' in turn, and what is left meets the whole bucket in cells of two wide blocks (see ``blocks``). Pairs
    that are connected already are skipped, so a bucket of true copies costs its size, and no list of pairs is written.
    """
    same = prints.filter(F.col("fingerprint") != "").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    same = written(same.select(F.unhex("fingerprint").alias("raw"), "rep", "copies", F.monotonically_increasing_id().alias("id")), "prints")
    raw, shared = same.select("id", "raw"), shared_buckets(same.select("id", "raw"))
    placed = shared.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    alone = placed.select(F.xxhash64("group", "block").alias("bucket"), F.col("node").alias("id"))

    def verify(meet):
        members = meet.join(raw, "id").withColumn("known", F.col("id")).withColumn("left", F.lit(True))
        return _confirmed(members, near)

    links = written(verify(alone), "print-links")
    ids = placed.filter("blocks > 1").drop("members")
    if not ids.isEmpty():
        links = blocks.meet_heads(ids, links, verify, BLOCK)
        known = blocks.left_over(ids, links)
        rest = blocks.cells(known, BLOCK, WIDE_BLOCKS).join(raw, "id")
        links = links.unionByName(written(_confirmed(rest, near), "print-links"))
    found = components(links).select(F.col("node").alias("id"), F.col("component").alias("root"))
    discard(shared)
    # Only classes of several texts, or linked ones, change anything; they meet by 128 bits of their fingerprints.
    known = same.join(found, "id", "left").filter((F.col("copies") > 1) | F.col("root").isNotNull())
    known = written(known.select(F.unhex(F.md5(F.lower(F.hex("raw")))).alias("_key"), "rep", F.coalesce("root", "id").alias("root")), "print-classes")
    least = known.groupBy("root").agg(F.min("rep").alias("_class"))
    classes = join_groups(known.select("_key", "root"), least, ["root"], F.col("_key")).select("_key", "_class")
    joined = join_groups(prints.withColumn("_key", F.unhex(F.md5("fingerprint"))), classes, ["_key"], F.col("doc_id"))
    return joined.select(*prints.columns, F.coalesce("_class", "doc_id").alias("component_id"))


def fingerprint_query(spark, sf_dir: str) -> DataFrame:
    return near_classes(written(edited_fingerprints(documents(spark, sf_dir)), "fingerprints"))
