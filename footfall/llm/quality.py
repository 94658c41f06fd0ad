"""Quality rules on whole texts, with a suffix array of each text for its repetition.

The base rules count words, symbols, repeated lines and words in repeated 3-word windows. The verdict on repetition
sorts all word suffixes of each text: ranks of prefixes of 1, 2, 4, ... words are refined until every suffix stands
alone, neighbours in that order give the longest common prefixes, and the longest prefix that a suffix shares with a
neighbour is the longest repeat that starts there. The spans of repeats of ``min_repeat`` words or more are united; a text
fails if they cover more than ``max_covered`` of its words or one is longer than ``max_longest`` words.

Work is by Arrow batches cut to a bounded number of bytes; no row leaves its partition, so nothing is shuffled.

Defined results: a null text has no words and fails; an empty or blank one too; ties cannot arise, since repeated rows
give repeated results; a very long text is judged whole, alone in its batch, in some 25 times its bytes of memory (16 MB
of two words over and over: see the tests); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import bytewords as bw
from footfall.llm._common import byte_buffer, documents, shielded, text_batches, tidy

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
BATCH = 1 << 20

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... in the order of the keys, equal for equal keys."""
    order = np.argsort(keys).astype(np.int32)
    ordered = keys[order]
    new = np.zeros(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(new, dtype=np.int32)
    return ranks


def suffix_repeats(row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence from it that also starts elsewhere in its text.

    Prefix doubling over all texts of the batch at once. Symbols of different rows never compare equal. Suffixes that
    already stand alone drop out, so later rounds touch the real repeats only. Neighbours in the order that results are
    compared by hashes of 2 ** k words, so no round's ranks are kept: some 60 bytes a word at most.
    """
    n = len(symbol)
    longest = np.zeros(n, np.int32)
    if n < 2:
        return longest
    end = np.searchsorted(row, row, side="right").astype(np.int32)  # where each word's text ends
    rank = dense_ranks(symbol)
    sizes = np.bincount(rank)
    # Classes hold room for all their members, as in a suffix array.
    rank = (np.cumsum(sizes) - sizes).astype(np.int32)[rank]
    del sizes
    first, step = rank, 1
    active = np.arange(n, dtype=np.int32)
    while True:
        active = active[(np.bincount(rank, minlength=n) > 1)[rank[active]]]
        if not len(active):
            break
        key = rank[active].astype(np.int64) * (n + 1)
        follow = active + np.int32(min(step, n))
        inside = follow < end[active]
        key[inside] += rank[follow[inside]].astype(np.int64) + 1
        del follow, inside
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        active = active[order]
        del order
        old = rank[active]
        # New ranks keep the old order: rank + a place within the old class.
        place = np.arange(len(active), dtype=np.int32)
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        del key
        group_start = np.maximum.accumulate(np.where(fresh, place, np.int32(0)))
        fresh[1:] = old[1:] != old[:-1]
        class_start = np.maximum.accumulate(np.where(fresh, place, np.int32(0)))
        rank = rank.copy()
        rank[active] = old + (group_start - class_start)
        step *= 2
    # Neighbours in suffix order, of those that share at least one word with another.
    order = np.argsort(rank, kind="stable").astype(np.int32)
    a, b = order[:-1], order[1:]
    near = first[a] == first[b]
    a, b = a[near], b[near]
    del order, near, rank, first
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(bw.mix(symbol) * bw.powers_at(np.arange(n), bw._BASE), out=sums[1:])
    common = np.zeros(len(a), np.int32)
    room = np.minimum(end[a] - a, end[b] - b)
    for k in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        at = np.flatnonzero(common + (1 << k) <= room)
        low, high = a[at] + common[at], b[at] + common[at]
        # Both hashes brought to the same power: to the place of the other one.
        same = (sums[low + (1 << k)] - sums[low]) * bw.powers_at(high, bw._BASE) == (sums[high + (1 << k)] - sums[high]) * bw.powers_at(low, bw._BASE)
        common[at[same]] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def _found_again(keys: np.ndarray) -> np.ndarray:
    """Places of the keys that are there twice or more."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    return order[again]


def measure(raw, starts, ends, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The base counts and the repetition of each text."""
    rows = len(starts)
    word_row, begin, end = bw.word_bounds(raw, starts, ends)
    word_row = word_row.astype(np.int32)
    sums = bw.prefix_hash(raw)
    word = bw.hash_of(sums, begin, end)
    del end
    n_words = np.bincount(word_row, minlength=rows).astype(np.int64)
    symbols = bw.per_row(_SYMBOL[raw], starts, ends)
    code_points = bw.per_row(~bw._SPACE[raw] & ((raw & 0xC0) != 0x80), starts, ends)

    feeds = np.flatnonzero(raw == 10)
    full = np.flatnonzero(ends > starts)
    feed_row = full[np.searchsorted(starts[full], feeds, side="right") - 1] if len(feeds) else np.zeros(0, np.int64)
    line_row = np.concatenate([full, feed_row])
    line_start = np.concatenate([starts[full], feeds + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    last = np.ones(len(line_row), bool)
    last[:-1] = line_row[1:] != line_row[:-1]
    line_end[last] = ends[line_row[last]]
    # A line with a word: one begins in it.
    filled = np.searchsorted(begin, line_start) < np.searchsorted(begin, line_end)
    line_row, line_start, line_end = line_row[filled], line_start[filled], line_end[filled]
    line_key = bw.mix(bw.hash_of(sums, line_start, line_end) + bw.mix(line_row.astype(bw.U64)))
    del sums, begin, feeds, feed_row, line_start, line_end, order, filled
    _, at = np.unique(line_key, return_index=True)
    dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[at], minlength=rows)
    del line_key, line_row, at

    n = len(word)
    at = np.flatnonzero(word_row[: n - 2] == word_row[2:]) if n > 2 else np.zeros(0, np.int64)
    key = bw.mix(word_row[at].astype(bw.U64))
    for j in range(3):
        key = bw.mix(key * bw.U64(0x2545F4914F6CDD1D) + word[at + j])
    again = at[_found_again(key)]
    del key, at
    mark = np.zeros(n, bool)
    for j in range(3):
        mark[again + j] = True
    repeat_words = np.bincount(word_row[mark], minlength=rows)
    del again, mark

    symbol = bw.mix(word + bw.mix(word_row.astype(bw.U64)))
    del word
    repeat = suffix_repeats(word_row, symbol)
    del symbol
    spans = np.flatnonzero(repeat >= min_repeat)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, spans, 1)
    np.add.at(edge, spans + repeat[spans], -1)
    covered = np.bincount(word_row[np.cumsum(edge[:-1]) > 0], minlength=rows)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, word_row, repeat)
    return {
        "n_words": n_words,
        "word_chars": code_points,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def quality_rules(
    docs: DataFrame,
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    keep_columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep_columns`` of docs with the counts, base_failed and kept of each text."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    chosen = docs.select(*keep_columns, *(["text"] if "text" not in keep_columns else []))
    schema = StructType([f for f in chosen.schema.fields if f.name in keep_columns])
    for f in StructType.fromDDL(FIELDS).fields:
        schema = schema.add(f)

    def judge(batches):
        for batch in text_batches(batches, limit=BATCH):
            found = measure(*byte_buffer(batch.column("text")), min_repeat)
            words = found["n_words"]
            failed = (words < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            good = ~failed & (found["covered_words"] <= max_covered * words) & (found["longest_repeat"] <= max_longest)
            found |= {"base_failed": failed, "kept": good}
            arrays = [batch.column(c) for c in keep_columns]
            arrays += [pa.array(found[f.name]) for f in schema.fields[len(keep_columns) :]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return chosen.mapInArrow(tidy(judge), schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with all their columns."""
    inner, restored = shielded(docs)
    judged = quality_rules(inner, keep_columns=tuple(inner.columns))
    return restored(judged.filter(F.col("kept")))
