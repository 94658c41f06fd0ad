"""What each of a set of filters removes, under every order in which they could be applied.

1. ``document_masks``: each document's failures as the bits of one number, and its two labels, as a narrow table.
2. ``mask_cells``: documents counted by (part, mask): at most 2 ** filters rows a part, summed before they are shuffled.
3. ``walk``: all orders of the filters are visited by single swaps of neighbours (plain changes). A swap leaves what is
   removed before it and after it as it was, so only its two steps are read again from the cells. A filter's Shapley sum
   grows by what it removes times the number of orders for which that stood, whenever it changes.

The walk is a function of one part's cells, so parts are walked in parallel and its cost doesn't grow with the documents.
Up to ``MOST_FILTERS`` filters are allowed, as n filters have n! orders; more raise a ValueError.

Defined results: a null text counts as empty; a null part as the empty string; a null doc_id has no smaller one and is
smaller than none, so it never fails the filter for repeated texts, and it has no labels; rows that are there twice share
a doc_id, so neither repeats the other, and both count; several labels of one doc_id count if any of them is 1; texts of
any length are judged whole, in one row; an empty table gives no rows; other columns are ignored. Equal texts are told by
their MD5 and length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import documents, join_groups, tidy, written

MOST_FILTERS = 8
#: Parts that are walked at a time.
PARTS = 64
WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def text_conditions(text: Column) -> list[Column]:
    """Failure conditions A to D on a text that isn't null."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n_words < 100, 100 * distinct < 80 * n_words, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document: bits 0 to 3 are ``text_conditions``, bit 4 a text of a smaller doc_id."""
    text = F.coalesce("text", F.lit(""))
    bits = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_conditions(text)))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    judged = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        bits.alias("mask"),
        F.md5(text).alias("digest"),
        F.length(text).alias("size"),
    )
    narrow = written(judged, "audit-masks")
    held = narrow.groupBy("digest", "size").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # A text that one doc_id holds alone repeats nothing.
    told = join_groups(narrow, held.filter("least < most").drop("most"), ["digest", "size"], F.col("doc_id"))
    repeated = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    # Null ids have no labels: a key of their own for each keeps them out of one task.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.col("digest")))
    marks = marks.filter("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)").withColumn("_key", F.col("doc_id").cast("string"))
    return (
        told.withColumn("_key", key)
        .join(marks.drop("doc_id"), "_key", "left")
        .select(
            "part",
            (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"),
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )
    )


def mask_cells(masks: DataFrame) -> DataFrame:
    """part and cells (array of mask, n, good, toxic; one for each mask that is there) of part, mask, good, toxic."""
    counted = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """Places i whose swaps with i + 1, one after the other, lead from the first order of n things through all others.

    Plain changes: the greatest thing that can still move in its direction moves; all greater ones turn round.
    """
    order, step = list(range(n)), [-1] * n
    while True:
        for thing in range(n - 1, -1, -1):
            at = order.index(thing)
            to = at + step[thing]
            if 0 <= to < n and order[to] < thing:
                break
            step[thing] = -step[thing]
        else:
            return
        order[at], order[to] = order[to], order[at]
        yield min(at, to)


def walk(cells: np.ndarray, filters: Sequence[str]):
    """(orders, counts, shapley) of the cells (parts x masks x [n, good, toxic]).

    counts: parts x orders x steps x [kept, removed, redundant, unique_fails, good_lost, toxic_lost]; shapley: parts x filters.
    """
    k = len(filters)
    mask = np.arange(1 << k)
    everything = cells[:, :, 0].sum(axis=1)
    fails = np.stack([cells[:, mask >> f & 1 > 0, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(k)], axis=1)
    order = list(range(k))
    lost = np.zeros((k, len(cells), 3), np.int64)  # by step
    kept = np.zeros((k, len(cells)), np.int64)
    shapley, since = np.zeros((k, len(cells)), np.int64), [0] * k

    def read(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        lost[step] = cells[:, (mask >> order[step] & 1 > 0) & (mask & before == 0)].sum(axis=1)
        kept[step] = (kept[step - 1] if step else everything) - lost[step, :, 0]

    def shown() -> np.ndarray:
        rows = [kept, lost[:, :, 0], fails.T[order] - lost[:, :, 0], alone.T[order], lost[:, :, 1], lost[:, :, 2]]
        return np.stack(rows, axis=2)  # steps x parts x columns

    for step in range(k):
        read(step)
    names, visits = ["".join(filters)], [shown()]
    for at in swaps(k):
        for step in (at, at + 1):
            shapley[order[step]] += lost[step, :, 0] * (len(visits) - since[order[step]])
            since[order[step]] = len(visits)
        order[at], order[at + 1] = order[at + 1], order[at]
        read(at)
        read(at + 1)
        names.append("".join(filters[f] for f in order))
        visits.append(shown())
    for step, f in enumerate(order):
        shapley[f] += lost[step, :, 0] * (len(visits) - since[f])
    return names, np.stack(visits).transpose(2, 0, 1, 3), shapley.T


def audit(masks: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """One row for each part, order and step of masks (part, mask, good, toxic); ``filters``: a letter for each bit.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    import pyarrow as pa

    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set("".join(filters))) != k:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

    def go(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                part = batch.slice(start, PARTS)
                table = np.zeros((part.num_rows, 1 << k, 3), np.int64)
                lists = part.column("cells")
                row, cell = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
                for i, name in enumerate(_COUNTS):
                    table[row, cell.field("mask").to_numpy(), i] = cell.field(name).to_numpy()
                names, counts, shapley = walk(table, filters)
                place = np.array([[filters.index(c) for c in name] for name in names])
                for p in range(part.num_rows):
                    flat = counts[p].reshape(-1, len(columns))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.column("part")[p].as_py()] * len(flat), pa.string()),
                            pa.array(np.repeat(names, k)),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))),
                            *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(columns))),
                            pa.array(shapley[p][place].ravel()),
                        ],
                        names=["part", "filter_order", "step", *columns, "shapley"],
                    )

    schema = ", ".join(["part string, filter_order string, step int", *(f"{c} bigint" for c in columns), "shapley bigint"])
    return mask_cells(masks).mapInArrow(tidy(go), schema)


def audit_query(spark, sf_dir: str) -> DataFrame:
    return audit(document_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), h AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > h.least THEN 16 ELSE 0 END AS mask
  FROM d JOIN h ON d.t = h.t LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM o
  UNION ALL SELECT filter_order, 2, b2, b1 FROM o
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM o
  UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM o
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM o
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (bit + before)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & before) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & before) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
), y AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY part, bit)
SELECT r.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN y ON r.part = y.part AND r.bit = y.bit
"""
