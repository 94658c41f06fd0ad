"""Mixing sources to target weights with DataFrame expressions only.

``mix_plan`` counts the words of every document, sums them per source, derives each source's target and repetition rate,
and gives each document floor(rate) copies plus one more with probability rate - floor(rate), drawn from a hash of the
seed and the doc_id, so that reruns and retried tasks agree. ``emit_copies`` repeats the rows.

Targets: the sources, ordered by code point with null last, weigh ``weights`` in turn and share the total of all sizes;
a target stops at ``max_rate`` times its source's size and the excess goes to the others by weight until none is above.
That is the level L with sum(min(cap, L * weight)) = total, found with window sums over the table of sources, which has
one row per source.

Defined results: a null or empty text has size 0; null is a source of its own; a null doc_id hashes as the word null;
repeated rows and rows of one doc_id get the same number of copies each; an empty table gives no rows; other columns
stay in ``emit_copies`` and are ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm._common import documents, shielded, written

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, target of a table with source and size."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(int(w)) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    weighed = total.withColumn("w", weight.cast("bigint")).withColumn("cap", F.col("source_size") * max_rate)
    # Capped sources come first in the order of cap / weight. From the first that fits on, levels only fall.
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "source",
        "source_size",
        "w",
        "cap",
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        ).alias("level"),
    ).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    fitting = levels.withColumn("at", F.max(F.when(F.col("fits"), F.col("level"))).over(whole)).withColumn(
        "at", F.coalesce("at", F.lit(0.0))
    )
    target = F.least(F.col("cap").cast("double"), F.col("at") * F.col("w"))
    return fitting.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mix_plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies: one row per row of docs.

    Sizes are counted once and written to the shared folder; only that narrow table is summed and joined. The join with
    the sources is left to Spark, which broadcasts the side if its size allows and splits a hot source otherwise.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, max_rate)
    joined = sizes.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.select("doc_id", "d.source", "size", "source_size", "target", rate.alias("rate"))
    whole = F.floor("rate")
    extra = (chance(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    return rated.withColumn("copies", whole + extra)


def emit_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the plan says.

    The copies are a function of source and doc_id, so the plan is joined by source only and the texts stay in place
    when the table of sources is small enough for Spark to broadcast.
    """
    weights, max_rate, seed = options.get("weights", WEIGHTS), options.get("max_rate", MAX_RATE), options.get("seed", SEED)
    docs, restored = shielded(docs, ("doc_id", "source", "text"))
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = written(source_targets(sizes, weights, max_rate), "mix-rates").select(
        F.col("source").alias("_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor("_rate")
    copies = (whole + (chance(F.col("doc_id"), seed) < F.col("_rate") - whole).cast("bigint")).cast("int")
    return restored(
        joined.withColumn("_copies", copies)
        .filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )


def mix_query(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents, each as often as its source's rate says."""
    return emit_copies(docs)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 3 AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s)
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
    AS level
  FROM c
), t AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE),
      coalesce((SELECT max(level) FROM l WHERE level * w <= cap), 0) * w) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)
      / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
