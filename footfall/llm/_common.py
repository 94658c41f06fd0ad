"""Shared folders, intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles in one numpy pass; bounds the memory of a task.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, a single machine) is a local folder made and set.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="footfall-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/footfall"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go with its end, not whenever the driver's garbage is collected. The table itself
    stays until ``discard``; what a returned DataFrame still reads goes with the shared folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(function):
    """A function for mapInArrow that gives freed memory back when its task ends, since workers live on for other tasks."""

    @functools.wraps(function)
    def run(batches):
        import pyarrow as pa

        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def text_batches(batches, column: str = "text", limit: int = BATCH_BYTES):
    """Slices of Arrow batches whose texts together have about ``limit`` bytes at most (one longer text stands alone)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_buffer(column):
    """(bytes as uint8 array, starts, ends) of a string or binary Arrow array; null counts as empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        ends[~valid] = starts[~valid]
    low = int(offsets[0]) if len(offsets) else 0
    high = int(offsets[-1]) if len(offsets) else 0
    return raw[low:high], starts - low, ends - low


def join_groups(rows, groups, on: list[str], salt, parts: int = 16):
    """rows left join groups (few columns, one row for each key), safe for keys that a third of all rows hold.

    The rows of a key are dealt to ``parts`` parts by the expression ``salt``; each group is there once for each part.
    """
    from pyspark.sql import functions as F

    left = rows.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    right = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*on, "_part"], "left").drop("_part")


def keep_counted(rows, counts, keys: list[str], total: int, share: int = 1000):
    """rows whose ``keys`` are in counts (keys, times), which were taken from the ``total`` rows.

    Keys that hold more than one in ``share`` of all rows are fewer than ``share``: they are broadcast, and their rows stay
    where they are. The rest meet by a shuffle, in which no key is hot.
    """
    from pyspark.sql import functions as F

    hot = F.broadcast(counts.filter(F.col("times") * share > total).select(*keys))
    rest = counts.filter(F.col("times") * share <= total).select(*keys)
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(rest, keys, "left_semi"))


def shielded(docs, used=("doc_id", "text")):
    """docs with every column outside ``used`` under a name that clashes with nothing, and the way back to the old ones."""
    from pyspark.sql import functions as F

    names = docs.columns
    inner = {c: c if c in used else f"_extra{i}" for i, c in enumerate(names)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(inner[c]) for c in names))
    return renamed, lambda df: df.select(*(F.col(inner[c]).alias(c) for c in names))
