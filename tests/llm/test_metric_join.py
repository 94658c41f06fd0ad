"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.llm import metric_join
from tests.llm.fixtures import clashing, documents, rows, words

SCHEMA = "doc_id bigint, text string"


def shingled(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))) if found else frozenset()


def plain_components(docs, k, percent):
    """(doc_id, n_shingles, component_id) of every row, by all pairs that share a shingle."""
    sets, least = [shingled(t, k) for _, t in docs], list(range(len(docs)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    where = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for e in own for j in where[e])
        for e in own:
            where[e].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                least[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            groups[find(i)].append(doc_id)
    return sorted(((d, len(s), min(groups[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def families(seed):
    """Groups of near copies with few to many edits, chains of small steps, copies, and a passage that unlike texts share."""
    rnd = random.Random(seed)
    texts = []
    for size in (60, 25, 8, 2):
        base = words(rnd, rnd.randint(60, 160)).split(" ")
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                own[rnd.randrange(len(own))] = words(rnd, 1)
            texts.append(" ".join(own))
    step = words(rnd, 90).split(" ")
    for _ in range(30):
        step = list(step)
        step[rnd.randrange(len(step))] = words(rnd, 1)
        texts.append(" ".join(step))
    passage = words(rnd, 60)
    texts += [f"{words(rnd, 40)} {passage} {words(rnd, 40)}" for _ in range(40)]
    texts += [words(rnd, n) for n in (1, 2, 3, 9, 10, 11, 12, 12, 30)] + [texts[5]] * 4
    short = words(rnd, 12).split(" ")
    texts += [" ".join(short), " ".join(short[:-1]), " ".join(short[:-2]), " ".join(short[1:])]
    rnd.shuffle(texts)
    return [(i * 3 % 1000 if i % 11 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, k, percent):
    docs = [r[:2] for r in rows()]
    assert found(metric_join.jaccard_components(clashing(documents(spark)), k, percent)) == plain_components(docs, k, percent)


@pytest.mark.parametrize(("block", "pivots", "stuck"), [(512, 16, 0.75), (6, 3, 0.75), (5, 2, 0.2), (8, 4, 0.9)])
def test_regions_join_recursively(spark, monkeypatch, block, pivots, stuck):
    """Small tasks make regions, rings and cells of blocks; one doc_id stands for several texts."""
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "PIVOTS", pivots)
    monkeypatch.setattr(metric_join, "STUCK", stuck)
    docs = families(block)
    got = found(metric_join.jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(5), 3, 90))
    assert got == plain_components(docs, 3, 90)


def test_equal_ids_with_unlike_texts(spark):
    rnd = random.Random(3)
    a, b = words(rnd, 200), words(rnd, 200)
    docs = [(5, a), (5, b), (6, b + " more"), (None, a), (None, b), (None, words(rnd, 9)), (4, None), (4, "  ")]
    assert found(metric_join.jaccard_components(spark.createDataFrame(docs, SCHEMA), 3, 90)) == plain_components(docs, 3, 90)


def test_join_of_nothing(spark):
    assert metric_join.jaccard_components(documents(spark).limit(0), 3, 90).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], SCHEMA)
    assert found(metric_join.jaccard_components(one, 3, 90)) == [(1, 2, 1)]


def test_a_very_long_text(spark):
    text = " ".join(str(i * 7919) for i in range(400_000))
    docs = spark.createDataFrame([(2, text), (3, text + " x"), (4, text[: len(text) // 2])], SCHEMA)
    assert [(a, c) for a, _, c in found(metric_join.jaccard_components(docs, 3, 90))] == [(2, 2), (3, 2), (4, 4)]


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(metric_join.jaccard_query(spark, sf)) == plain_components(docs, 3, 90)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([70, 80, 90, 95]))
def test_linked_sets_share_a_bucket(size, seed, percent):
    """Every linked pair of different sets has a bucket in common, and bands and bounds hold."""
    rnd = np.random.default_rng(seed)
    first, most = metric_join.bands(percent)
    whole = rnd.integers(0, 2**63, size + 60).astype(np.uint64)
    drop, more = rnd.integers(0, 1 + size // 10), rnd.integers(0, 1 + size // 10)
    a, b = whole[: size - drop], whole[drop : size + more]
    inter = len(np.intersect1d(a, b))
    if not inter or 100 * inter < percent * (len(a) + len(b) - inter):
        return
    keys, band = [], [int(np.searchsorted(first, len(x), side="right") - 1) for x in (a, b)]
    assert abs(band[0] - band[1]) <= 1
    assert len(a) + len(b) - 2 * inter <= most[min(band)]
    for x, own in zip((a, b), band, strict=True):
        out = set()
        for level in (own, own - 1):
            slices = np.array([most[level] + 1 if level >= 0 and most[level] else 0])
            out |= set(metric_join.slice_keys(np.zeros(len(x), np.int64), x, np.array([level]), slices)[1].tolist())
        keys.append(out)
    assert set(a.tolist()) == set(b.tolist()) or keys[0] & keys[1]
