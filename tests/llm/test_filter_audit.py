"""The audit of filters against a loop over documents and permutations (its SQL is run with the other queries')."""

import itertools
import re
from math import factorial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm import filter_audit
from tests.llm.fixtures import clashing, documents, rows

LABELS = "doc_id bigint, quality int, toxic int"


def plain_audit(docs, labels):
    """(part, order, step): the counts of the contract, one document and one order at a time."""
    good, toxic = ({d for d, *marks in labels if d is not None and marks[i] == 1} for i in (0, 1))
    judged = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(found) < 100,
            "B": 100 * len(set(found)) < 80 * len(found),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, *_ in docs),
        }
        judged.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {j[0] for j in judged}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [j for j in judged if j[0] == part]
            for step, f in enumerate(order, 1):
                gone, late = [j for j in left if f in j[1]], [j for j in judged if j[0] == part and f in j[1]]
                left = [j for j in left if f not in j[1]]
                counts = [len(left), len(gone), len(late) - len(gone), sum(j[1] == {f} for j in late)]
                out[part, order, step] = counts + [sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(p, o, s): (*c, shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def found(df):
    got = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_equals_brute_force(spark):
    extra = [
        (950, "Ab " * 120, "", "s", 1),
        (951, "one two # three", "en", "s", 1),
        (952, None, "en", "s", 1),
        (None, "Ab " * 120, "de", "s", 1),
        (953, " ".join(f"W{i}" for i in range(150)), "en", "s", 1),
    ]
    docs = rows() + extra
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (900, None, 1), (5000, 1, 1)]
    frame = clashing(documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema)))
    labels = spark.createDataFrame(marks, LABELS)
    assert found(filter_audit.audit(filter_audit.document_masks(frame, labels))) == plain_audit(docs, marks)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.document_masks(documents(spark).limit(0), labels)).count() == 0


def test_a_very_long_text(spark):
    text = "Ab " * 2_000_000 + "#"
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, text[:-1], "en")], "doc_id bigint, text string, lang string")
    masks = filter_audit.document_masks(docs, spark.createDataFrame([], LABELS))
    assert sorted(r["mask"] for r in masks.collect()) == [2 + 4, 2 + 4 + 8, 2 + 4 + 8 + 16]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in filter_audit.swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == factorial(n) == 1 + sum(1 for _ in filter_audit.swaps(n))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 5)), max_size=12), st.integers(1, 4))
def test_shapley_sums_to_what_all_orders_remove(cells, k):
    table = np.zeros((1, 1 << k, 3), np.int64)
    for mask, n in cells:
        table[0, mask % (1 << k), 0] += n
    names, counts, shapley = filter_audit.walk(table, "PQRS"[:k])
    assert (counts[0, :, -1, 0] == table[0, 0, 0]).all() and shapley.sum() == factorial(k) * table[0, 1:, 0].sum()
    assert len(set(names)) == factorial(k)


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(None, "ABCDEFGHI")
