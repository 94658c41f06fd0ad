"""Least-cost repair of conversations whose turns don't alternate, by lazy determinisation of a weighted automaton.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. Edits on the turns in order: K keeps a turn (0), R gives it
the role user or assistant (3), D deletes it (4), I puts in an empty turn of user or assistant (3); a truncated turn that
isn't deleted adds 3, blank and duplicate turns must be deleted.

1. ``damaged`` is the test bed: it damages turns by a hash of conversation and turn.
2. Each turn becomes one of nine symbols: its initial (s, u, a, other) and whether it is truncated, or that it must go.
3. The scan reads the turns from the last to the first. A state of the deterministic automaton is the vector of what is
   still to be paid from each of the four places in the pattern, less its minimum, which goes to the cost. States and
   transitions are made when first met and kept in a table; the vectors are bounded, as any place can be reached from any
   other by insertions, so there are few. From then on the scan is a table lookup for all conversations of a batch at once.
4. The trace goes back over the scan, from the first turn to the last, and takes the tight arc of the least letter. A
   letter determines the next place, so this gives the ASCII-least of the cheapest edit strings. Arcs are cached as well.

Defined results: a null conversation id is a conversation of its own; null turns come first; turns of one number are
ordered by role and text, so ties and repeated rows have one order; a null role or text counts as one space (``damaged``);
a role without a first character (empty) matches no place and can't be kept; an empty table gives no rows; other columns
are ignored. Duplicates are compared in full. A conversation is one row of the result, with its edits in order, so its turns
meet in one task by necessity, which holds them once; texts of any length and any number of conversations pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import tidy

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Places in the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads to, whichever of the two fits.
_TURN = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": 0, "u": 1, "a": 2}
MUST_GO = 8
#: Bytes of texts that are repaired at a time (one longer conversation stands alone).
BATCH = 4 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: each row damaged as crc32("conv_id:turn") % 20 says; a dropped row isn't present."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    copies = F.array_repeat(fate != 0, F.when(fate == 3, 2).otherwise(1))
    return turns.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(shown[2]).alias("role"), text.alias("text"), F.explode(copies).alias("present")
    )


class Automaton:
    """The deterministic automaton as far as it has been met. State 0 is what is to be paid after the last turn."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next = np.zeros((0, MUST_GO + 1), np.int32)
        self.paid = np.zeros((0, MUST_GO + 1), np.int64)
        self.arc = np.zeros((0, MUST_GO + 1, 4), np.int32)
        self.arcs: list[tuple[str, int]] = []
        self.arc_ids: dict[tuple[str, int], int] = {}
        self._state((0, 2 * INSERT, INSERT, 0))

    def _state(self, vector: tuple[int, ...]) -> int:
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            if len(self.vectors) > len(self.next):
                more = max(16, len(self.next))
                self.next = np.concatenate([self.next, np.full((more, MUST_GO + 1), -1, np.int32)])
                self.paid = np.concatenate([self.paid, np.zeros((more, MUST_GO + 1), np.int64)])
                self.arc = np.concatenate([self.arc, np.full((more, MUST_GO + 1, 4), -1, np.int32)])
        return self.ids[vector]

    @staticmethod
    def _edits(after: tuple[int, ...], symbol: int, place: int) -> dict[str, tuple[int, int]]:
        """Letter: (cost to the end, next place) of the edits that take this turn."""
        out = {"D": (DELETE + after[place], place)}
        if symbol == MUST_GO:
            return out
        initial, extra = symbol >> 1, TRUNCATED * (symbol & 1)
        to = SYSTEM if initial == 0 and place == START else _TURN[place] if initial == (1 if _TURN[place] == USER else 2) else None
        if to is not None:
            out["K"] = (extra + after[to], to)
        out["R"] = (REROLE + extra + after[_TURN[place]], _TURN[place])
        return out

    @classmethod
    def _before(cls, after: tuple[int, ...], symbol: int) -> list[int]:
        """What is to be paid from each place before this turn, insertions included."""
        costs = [min(c for c, _ in cls._edits(after, symbol, p).values()) for p in range(4)]
        for _ in range(3):
            costs = [min(c, INSERT + costs[_TURN[p]]) for p, c in enumerate(costs)]
        return costs

    def learn(self, state: int, symbol: int) -> None:
        costs = self._before(self.vectors[state], symbol)
        least = min(costs)
        to = self._state(tuple(c - least for c in costs))
        self.next[state, symbol], self.paid[state, symbol] = to, least

    def learn_arc(self, state: int, symbol: int, place: int) -> None:
        """Letters of the least string of tight arcs that ends with this turn's own edit, and the place it leads to."""
        after, at, letters = self.vectors[state], place, ""
        costs = self._before(after, symbol)
        while True:
            tight = {k: p for k, (c, p) in self._edits(after, symbol, at).items() if c == costs[at]}
            if INSERT + costs[_TURN[at]] == costs[at]:
                tight["I"] = _TURN[at]
            letter = min(tight)
            letters, at = letters + letter, tight[letter]
            if letter != "I":
                break
        found = (letters, at)
        if found not in self.arc_ids:
            self.arc_ids[found] = len(self.arcs)
            self.arcs.append(found)
        self.arc[state, symbol, place] = self.arc_ids[found]

    def scan(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each conversation symbols[starts[i]:ends[i]], state after each turn)."""
        after = np.zeros(len(symbols), np.int32)
        state, cost = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        longer = np.sort(ends - starts)
        for back in range(1, (int(longer[-1]) if len(longer) else 0) + 1):
            own = order[: len(order) - int(np.searchsorted(longer, back))]
            row = ends[own] - back
            symbol, now = symbols[row], state[own]
            new = self.next[now, symbol] < 0
            if new.any():
                for s, x in {*zip(now[new].tolist(), symbol[new].tolist(), strict=True)}:
                    self.learn(s, x)
            after[row] = now
            cost[own] += self.paid[now, symbol]
            state[own] = self.next[now, symbol]
        vectors = np.array(self.vectors, np.int64)
        return cost + vectors[state, START], after

    def trace(self, symbols: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arc of each turn, place of each conversation after its last turn)."""
        arcs = np.zeros(len(symbols), np.int32)
        place = np.zeros(len(starts), np.int32)
        order = np.argsort(starts - ends, kind="stable")
        longer = np.sort(ends - starts)
        for on in range(int(longer[-1]) if len(longer) else 0):
            own = order[: len(order) - int(np.searchsorted(longer, on + 1))]
            row = starts[own] + on
            state, symbol, now = after[row], symbols[row], place[own]
            new = self.arc[state, symbol, now] < 0
            if new.any():
                for key in {*zip(state[new].tolist(), symbol[new].tolist(), now[new].tolist(), strict=True)}:
                    self.learn_arc(*key)
            arcs[row] = self.arc[state, symbol, now]
            to = np.array([p for _, p in self.arcs], np.int32)
            place[own] = to[arcs[row]]
        return arcs, place


def _faults(roles: list[str], texts: list[str], blank: list[bool], closed: list[bool], starts: list[int], ends: list[int]):
    """1 blank, 2 duplicate, 3 truncated or 0 for each turn: the first that holds."""
    out = np.zeros(len(roles), np.int8)
    for a, b in zip(starts, ends, strict=True):
        seen: set[tuple[str, str]] = set()
        for i in range(a, b):
            said = (roles[i], texts[i])
            out[i] = 1 if blank[i] else 2 if said in seen else 0 if closed[i] else 3
            seen.add(said)
    return out


def _whole(batches, limit: int = BATCH):
    """Tables of whole conversations of about ``limit`` bytes of text, of batches sorted by conversation (column ``last``)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.flatnonzero(table.column("last").to_numpy()) + 1
        bytes_to = np.cumsum(pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        for end in ends.tolist():
            now = size + int(bytes_to[end - 1] - (bytes_to[at - 1] if at else 0))
            if now >= limit or end == ends[-1]:
                yield pa.concat_tables([*held, table.slice(at, end - at)])
                held, size, at = [], 0, end
        if at < table.num_rows:
            held.append(table.slice(at))
            size += int(bytes_to[-1] - (bytes_to[at - 1] if at else 0))
    if held:
        yield pa.concat_tables(held)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text, present; none of role, text and present null).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns, the repaired turns (array of role, text).
    Turns that aren't present only make sure that their conversation is in the result.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql.types import StructType

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    marked = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "present",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("closed"),
    )
    # A window over the conversation alone: its sort is the one that the turns are read by.
    following = F.lead(F.lit(1)).over(Window.partitionBy("conv_id").orderBy(*order[1:]))
    dealt = marked.withColumn("last", following.isNull())
    schema = StructType([f for f in turns.schema.fields if f.name == "conv_id"])
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    for f in StructType.fromDDL(", ".join(f"{c} bigint" for c in counts) + ", audit string, turns array<struct<role:string,text:string>>").fields:
        schema = schema.add(f)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def go(batches):
        automaton = Automaton()
        for table in _whole(batches):
            yield block(automaton, table.combine_chunks())

    def block(automaton, table):
        last = np.flatnonzero(table.column("last").to_numpy())
        kept = np.flatnonzero(table.column("present").to_numpy())
        # Conversation i has the present rows from starts[i] to ends[i].
        ends = np.searchsorted(kept, last, side="right")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        rows = table.take(pa.array(kept))
        roles, texts, blank, closed = (rows.column(c).to_pylist() for c in ("role", "text", "blank", "closed"))
        faults = _faults(roles, texts, blank, closed, starts.tolist(), ends.tolist())
        initial = np.array([_INITIALS.get(r[:1], 3) for r in roles], np.int32)
        symbols = np.where((faults == 1) | (faults == 2), MUST_GO, 2 * initial + (faults == 3)).astype(np.int32)
        cost, after = automaton.scan(symbols, starts, ends)
        arcs, place = automaton.trace(symbols, after, starts, ends)
        audits, repaired = [], []
        for a, b, end in zip(starts.tolist(), ends.tolist(), place.tolist(), strict=True):
            letters, left, at = [], [], START
            for i in range(a, b):
                edits, _ = automaton.arcs[arcs[i]]
                letters.append(edits)
                for letter in edits:
                    if letter == "K":
                        at = SYSTEM if initial[i] == 0 else _TURN[at]
                        left.append({"role": roles[i], "text": texts[i]})
                    elif letter != "D":
                        at = _TURN[at]
                        left.append({"role": _ROLE[at], "text": texts[i] if letter == "R" else ""})
            while at not in (START, ASSISTANT):
                at = _TURN[at]
                letters.append("I")
                left.append({"role": _ROLE[at], "text": ""})
            audits.append("".join(letters))
            repaired.append(left)
        pairs = np.zeros(len(roles), bool)
        if len(roles):
            legal = (initial[1:] != 3) & (np.array(_TURN)[initial[:-1] % 3 + 1] == initial[1:] + 1) & (initial[:-1] != 3)
            pairs[1:] = ~legal
            pairs[starts[starts < ends]] = False
        turn = rows.column("turn")
        known = turn.is_valid().to_numpy()
        number = turn.fill_null(0).to_numpy().astype(np.int64)
        gaps = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            own = number[a:b][known[a:b]]  # sorted
            gaps.append(int(own[-1] - own[0]) - int((own[1:] != own[:-1]).sum()) if len(own) else 0)

        def each(flags):
            sums = np.concatenate([[0], np.cumsum(flags)])
            return pa.array(sums[ends] - sums[starts], pa.int64())

        columns = [
            table.column("conv_id").take(pa.array(last)).combine_chunks(),
            pa.array(gaps, pa.int64()),
            *(each(faults == f) for f in (1, 2, 3)),
            each(pairs),
            pa.array(cost, pa.int64()),
            pa.array(audits, pa.string()),
            pa.array(repaired, kind),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return dealt.select("conv_id", "turn", "role", "text", "present", "blank", "closed", "last").mapInArrow(tidy(go), schema)


def repair_query(spark, sf_dir: str) -> DataFrame:
    done = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.withColumn("repaired_sha256", F.sha2(said, 256)).drop("turns")


REPAIR_SQL = r"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bytes
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), h AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, CAST(i AS INTEGER), 1)))),
    lambda c, b: xor(c >> 8, bytes[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % 20 AS fate
  FROM d, k
), x AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h WHERE fate <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM h WHERE fate = 3
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x
), g AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM o
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, substr(role, 1, 1) AS a
  FROM g
), n AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM f GROUP BY conv_id
), v AS (
  SELECT conv_id, n + 1 AS i,
    0 AS c0, '' AS a0, CAST([] AS VARCHAR[]) AS t0, 6 AS c1, 'II' AS a1, ['user:', 'assistant:'] AS t1,
    3 AS c2, 'I' AS a2, ['assistant:'] AS t2, 0 AS c3, '' AS a3, CAST([] AS VARCHAR[]) AS t3
  FROM n
  UNION ALL
  SELECT conv_id, i, y[1].c, y[1].a, y[1].t, z[1].c, z[1].a, z[1].t, p[1].c, p[1].a, p[1].t, q[1].c, q[1].a, q[1].t FROM (
    SELECT conv_id, i, p, q,
      list_sort([b0[1], {c: p[1].c + 3, a: 'I' || p[1].a, t: list_prepend('user:', p[1].t)}]) AS y,
      list_sort([b1[1], {c: p[1].c + 3, a: 'I' || p[1].a, t: list_prepend('user:', p[1].t)}]) AS z
    FROM (
      SELECT conv_id, i, b0, b1,
        list_sort([b2[1], {c: b3[1].c + 3, a: 'I' || b3[1].a, t: list_prepend('assistant:', b3[1].t)}]) AS p,
        list_sort([b3[1], {c: b2[1].c + 3, a: 'I' || b2[1].a, t: list_prepend('user:', b2[1].t)}]) AS q
      FROM (
        SELECT f.conv_id, f.i,
          list_sort([{c: c0 + 4, a: 'D' || a0, t: t0},
            {c: c2 + 3 + extra, a: 'R' || a2, t: list_prepend('user:' || text, t2)},
            {c: extra + CASE f.a WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 1000000 END, a: 'K' || CASE f.a WHEN 's' THEN a1 ELSE a2 END,
             t: list_prepend(role || ':' || text, CASE f.a WHEN 's' THEN t1 ELSE t2 END)}]) AS b0,
          list_sort([{c: c1 + 4, a: 'D' || a1, t: t1},
            {c: c2 + 3 + extra, a: 'R' || a2, t: list_prepend('user:' || text, t2)},
            {c: extra + CASE f.a WHEN 'u' THEN c2 ELSE 1000000 END, a: 'K' || a2, t: list_prepend(role || ':' || text, t2)}]) AS b1,
          list_sort([{c: c2 + 4, a: 'D' || a2, t: t2},
            {c: c3 + 3 + extra, a: 'R' || a3, t: list_prepend('assistant:' || text, t3)},
            {c: extra + CASE f.a WHEN 'a' THEN c3 ELSE 1000000 END, a: 'K' || a3, t: list_prepend(role || ':' || text, t3)}]) AS b2,
          list_sort([{c: c3 + 4, a: 'D' || a3, t: t3},
            {c: c2 + 3 + extra, a: 'R' || a2, t: list_prepend('user:' || text, t2)},
            {c: extra + CASE f.a WHEN 'u' THEN c2 ELSE 1000000 END, a: 'K' || a2, t: list_prepend(role || ':' || text, t2)}]) AS b3
        FROM v JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1000000 END AS extra FROM f) f
          ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1
      )
    )
  )
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(c0, 0) AS BIGINT) AS cost, coalesce(a0, '') AS audit,
  sha256(coalesce(array_to_string(t0, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN (SELECT * FROM v WHERE i = 1) w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
"""
