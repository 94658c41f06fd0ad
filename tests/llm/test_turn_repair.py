"""The repair of conversations against a search over edit strings (its SQL is run with the other queries')."""

import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.llm import turn_repair

TURNS = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\v\f\r"


def plain_repair(turns):
    """(faults, cost, audit, repaired) of the (role, text) in order: the first complete string that a search by (cost, string) meets."""
    faults = []
    for i, (role, text) in enumerate(turns):
        rest = text.rstrip(BLANK)
        blank, again = not rest, (role, text) in turns[:i]
        faults.append("blank" if blank else "duplicate" if again else "truncated" if rest[-1] not in ".!?" else "")
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        pattern = "".join(r[:1] or "?" for r, _ in said)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", pattern):
            return faults, cost, audit, list(said)
        if not re.fullmatch("s?(ua)*u?", pattern):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*said, (role, ""))))
        if i == len(turns):
            continue
        role, text = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*said, (role, text))))
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*said, (other, text))))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain(rows):
    out = {}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[2:] for r in own]
        numbers = [r[1] for r in own if r[1] is not None]
        faults, cost, audit, repaired = plain_repair(turns)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, repaired)
    return out


def made(seed, conversations=120, most=6):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "Assistant", "sage"]
    texts = ["Hi.", "Hi.", "yes", "ok!", "a?\n ", "", " \t", None, "é…", "x.y", "end. "]
    rows = []
    for conv in range(conversations):
        turns = rnd.choice([0, 0, 1]) and [None] or []
        turns += [i + rnd.choice([0, 0, 0, 3]) for i in range(rnd.randint(1, most))]
        rows += [(conv, t, rnd.choice(roles), rnd.choice(texts)) for t in turns[:most]]
    rows += [(None, t, "user", "null id.") for t in (1, 2)] + [(500, None, None, None)] * 2
    return rows


def test_repair_equals_a_search(spark):
    rows = made(3)
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    for c in ("present", "blank", "last", "audit", "copies"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = turn_repair.repair(turn_repair.damaged(frame)).collect()
    found = {r["conv_id"]: (*tuple(r)[1:8], [tuple(t) for t in r["turns"]]) for r in got}
    assert len(found) == len(got) and found == plain(rows)


def test_repair_of_nothing(spark):
    assert turn_repair.repair(turn_repair.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_a_long_conversation(spark):
    rows = spark.range(60_000).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"), F.lit(True).alias("present")
    )
    got = turn_repair.repair(rows).first()
    # Every second turn becomes the assistant's.
    assert got["cost"] == 90_000 and len(got["turns"]) % 2 == 0
    assert re.fullmatch("(ua)+", "".join(t["role"][0] for t in got["turns"]))
    assert got["illegal"] == 59_999 and got["truncated"] == 0


def test_batches_hold_whole_conversations():
    import pyarrow as pa

    sizes = [3, 1, 4, 1, 5, 9, 2, 6]
    conv = np.repeat(np.arange(len(sizes)), sizes)
    last = np.append(conv[1:] != conv[:-1], True)
    table = pa.table({"conv": conv, "last": last, "text": ["x" * 10] * len(conv)})
    for cut in (1, 3, 7, 50):
        parts = list(turn_repair._whole(table.to_batches(max_chunksize=cut), limit=45))
        assert pa.concat_tables(parts).equals(table)
        assert all(p.column("last")[-1].as_py() for p in parts) and max(p.num_rows for p in parts) <= 18


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, turn_repair.MUST_GO), max_size=7), st.lists(st.integers(0, turn_repair.MUST_GO), max_size=7))
def test_scan_and_trace_equal_a_search(one, two):
    """Symbols as turns: the automaton's cost and letters are the search's."""
    automaton = turn_repair.Automaton()
    symbols = np.array(one + two, np.int32)
    starts, ends = np.array([0, len(one)]), np.array([len(one), len(one) + len(two)])
    cost, after = automaton.scan(symbols, starts, ends)
    arcs, place = automaton.trace(symbols, after, starts, ends)
    for i, own in enumerate((one, two)):
        turns = [("system user assistant tool".split()[x >> 1], f"{n}{'' if x & 1 else '.'}") if x < 8 else ("user", "") for n, x in enumerate(own)]
        _, want, audit, _ = plain_repair(turns)
        letters = "".join(automaton.arcs[a][0] for a in arcs[starts[i] : ends[i]])
        assert (cost[i], letters + {0: "", 1: "II", 2: "I", 3: ""}[int(place[i])]) == (want, audit)


def test_few_states():
    """All conversations share a handful of states."""
    automaton, rnd = turn_repair.Automaton(), np.random.default_rng(1)
    symbols = rnd.integers(0, turn_repair.MUST_GO + 1, 50_000).astype(np.int32)
    automaton.scan(symbols, np.arange(0, 50_000, 10), np.arange(10, 50_010, 10))
    assert len(automaton.vectors) < 100


@pytest.mark.parametrize("text", ["", " \n"])
def test_blank_is_deleted(text):
    assert plain_repair([("user", text)])[1:3] == (4, "D")
