"""Streams of detections and counters: file sources, idempotent stores, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from footfall.sources.tables import table


def file_stream(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", archive: str | None = None, **options) -> DataFrame:
    """Files as they come; read ones go to ``archive``, if given."""
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sources.tables`` as a stream, be it one file or a folder of files."""
    # A stream takes a plain path for a folder; a pattern may name either.
    return file_stream(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


def store_once(stream: DataFrame, keys: Sequence[str], store: str, checkpoint: str, order: str, time: str | None = None):
    """Run the stream through what is there now into a Parquet store that holds each key once; the query.

    The store is dealt to folders by the day of ``time``, which is one of the keys, and the batch. Every micro-batch drops
    its own repeats and what the store has of its days; no other day is read. Without ``time`` all of the store is. A
    batch is written under its id, so that one that is run again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int):
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        first = first.withColumn("_day", F.to_date(time) if time else F.lit(None).cast("date")).persist()
        spark = batch.sparkSession
        # The days of one batch: few.
        days = [r["_day"] for r in first.select("_day").distinct().collect() if r["_day"]]
        before = None
        if number:
            schema = StructType([*batch.schema.fields, StructField("_day", DateType()), StructField("batch", LongType())])
            try:
                known = spark.read.schema(schema).parquet(store)
                before = known.filter((F.col("batch") < number) & (F.col("_day").isin(days) | F.col("_day").isNull()))
            except Exception as problem:
                if "PATH_NOT_FOUND" not in str(problem):
                    raise
        new = first if before is None else first.join(before.select(*keys), list(keys), "left_anti")
        dealt = new.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dealt.partitionBy("_day", "batch").parquet(store)
        first.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, stores: dict[str, str], checkpoint: str):
    """Write the rows of a stream to several stores, each folder with those that meet its condition (SQL); start it once.

    A batch has a folder of its own in each store and overwrites it, so a batch that is run again stores nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, condition in stores.items():
            batch.filter(condition).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_devices_stream(stream: DataFrame, freq: str, store: str, checkpoint: str) -> DataFrame:
    """Exact distinct devices per station and bin of a stream: each (station, bin, device) is stored once, then counted."""
    spark = stream.sparkSession
    rows = stream.select(
        F.col("event_type").alias("station_name"), F.window("ts", freq)["start"].alias("bin"), F.col("user_id").alias("mac_address"), "event_id"
    )
    store_once(rows, ["station_name", "bin", "mac_address"], store, checkpoint, "event_id", "bin").awaitTermination()
    kept = spark.read.schema(rows.schema).parquet(store)
    return kept.groupBy("station_name", "bin").agg(F.count(F.lit(1)).alias("devices"))


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], freq: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window of event time, tumbling or sliding; later rows than ``late`` are dropped."""
    window = F.window(time, freq, slide) if slide else F.window(time, freq)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("cnt"))


def sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    """Sessions of rows not further apart than ``gap``; works on batches and streams alike."""
    return df.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("cnt"))


#: Schema of a camera's barrier file.
BARRIER_FILE = "cam_name STRING, timestamp BIGINT, datetime STRING, counter MAP<STRING, MAP<STRING, INT>>"


def barrier_rows(files: DataFrame, meta: DataFrame) -> DataFrame:
    """timestamp, uid, counter: nested counters unfolded and given their ids; meta: cam_name, barrier, direction, uid."""
    flat = files.select("cam_name", "timestamp", F.explode("counter").alias("barrier", "ways")).select(
        "cam_name", "timestamp", "barrier", F.explode("ways").alias("direction", "counter")
    )
    return flat.join(meta, ["cam_name", "barrier", "direction"]).select("timestamp", "uid", "counter")


def two_clock(rows: DataFrame, time: str, keys: Sequence[str], value: str, fast: str, slow: str) -> DataFrame:
    """The latest value of each fast window, summed by slow window."""
    last = rows.groupBy(*keys, F.window(time, fast)["start"].alias("tick")).agg(F.max_by(value, time).alias("v"))
    return last.groupBy(*keys, F.window("tick", slow)["start"].alias("bin")).agg(F.sum("v").alias("total"))
