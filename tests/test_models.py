"""Seasonal models, Ward's linkage, the p-value of a trend and dense numbers against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions import stats
from footfall.operators import clusters, forecast, graph


def plain_errors(w, order, values, season):
    phi, theta, phi_s, theta_s = forecast._named(order, values)
    e = []
    at = lambda a, i: a[i] if i >= 0 else 0.0
    for t in range(len(w)):
        ar = w[t] - phi * at(w, t - 1) - phi_s * at(w, t - season) + phi * phi_s * at(w, t - season - 1)
        e.append(ar - theta * at(e, t - 1) - theta_s * at(e, t - season) - theta * theta_s * at(e, t - season - 1))
    return np.array(e)


def simulated(order, values, season, n, seed):
    """x whose differences follow the model, with unit noise."""
    rnd = np.random.default_rng(seed)
    phi, theta, phi_s, theta_s = forecast._named(order, values)
    e, w = rnd.standard_normal(n), np.zeros(n)
    at = lambda a, i: a[i] if i >= 0 else 0.0
    for t in range(n):
        w[t] = phi * at(w, t - 1) + phi_s * at(w, t - season) - phi * phi_s * at(w, t - season - 1) + e[t] + theta * at(e, t - 1) + theta_s * at(e, t - season) + theta * theta_s * at(e, t - season - 1)
    x = np.concatenate([rnd.standard_normal(season + 1), np.zeros(n)])
    for t in range(season + 1, len(x)):
        x[t] = w[t - season - 1] + x[t - 1] + x[t - season] - x[t - season - 1]
    return x


@pytest.mark.parametrize("order", forecast.ORDERS)
def test_errors_equal_a_plain_loop(order):
    rnd = np.random.default_rng(1)
    w, values = rnd.standard_normal(150), rnd.uniform(-0.99, 0.99, sum(order))
    assert np.allclose(forecast.errors(w, order, values, 7), plain_errors(w, order, values, 7), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("order", "values"), [((1, 0, 0, 0), (0.6,)), ((0, 1, 0, 1), (-0.5, -0.6)), ((1, 1, 0, 1), (0.7, 0.4, -0.5)), ((0, 0, 1, 0), (-0.4,))])
def test_known_coefficients_are_found(spark, order, values):
    x = simulated(order, values, 12, 3000, 5)
    series = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "key string, t bigint, value double")
    rows = {tuple(r["order"]): r for r in forecast.fitted(series, "key", 12).collect()}
    assert set(rows) == set(forecast.ORDERS) and all(r["n"] == 3000 for r in rows.values())
    assert np.allclose(rows[order]["values"], values, atol=0.05)
    assert rows[order]["sse"] / 3000 == pytest.approx(1, abs=0.1)
    # The best order has the true one's parts, and at most idle ones beside them.
    best = min(rows.values(), key=lambda r: r["aic"])["order"]
    assert all(b >= o for b, o in zip(best, order, strict=True))


def test_no_other_coefficients_are_better():
    x = simulated((1, 1, 0, 1), (0.5, 0.3, -0.4), 6, 400, 2)
    w = forecast.differenced(x, 6)
    values, sse, aic = forecast.fit(w, (1, 1, 0, 1), 6)
    assert aic == pytest.approx(400 * math.log(sse / 400) + 8)
    for i in range(3):
        for step in (-0.02, 0.02):
            near = values.copy()
            near[i] += step
            assert (plain_errors(w, (1, 1, 0, 1), near, 6) ** 2).sum() >= sse


def test_forecasts(spark):
    """A season with a slope goes on; short series have none."""
    rows = [("line", i, 3.0 * i + (i % 4) ** 2) for i in range(40)] + [("short", i, 1.0) for i in range(5)]
    out = forecast.forecast(spark.createDataFrame(rows, "key string, t bigint, value double"), "key", 4, 9).collect()
    assert [r["value"] for r in sorted(out, key=lambda r: r["step"])] == pytest.approx([3.0 * i + (i % 4) ** 2 for i in range(40, 49)])
    assert {r["key"] for r in out} == {"line"}
    x = simulated((1, 1, 1, 1), (0.5, 0.3, 0.2, -0.4), 5, 100, 3)
    got = forecast.ahead(x, (1, 1, 1, 1), (0.5, 0.3, 0.2, -0.4), 5, 3)
    # A forecast is what makes the next errors 0.
    w = forecast.differenced(np.concatenate([x, got]), 5)
    assert np.allclose(plain_errors(w, (1, 1, 1, 1), (0.5, 0.3, 0.2, -0.4), 5)[-3:], 0, atol=1e-8)


def plain_ward(points):
    """(members of the merged cluster, cost) of each merge, the cheapest pair first."""
    groups = [([i], np.array(x, float)) for i, x in points]
    out = []
    while len(groups) > 1:
        best = min(
            ((((len(a) * len(b)) / (len(a) + len(b))) * ((x - y) ** 2).sum(), i, j) for i, (a, x) in enumerate(groups) for j, (b, y) in enumerate(groups) if i < j),
        )
        cost, i, j = best
        (a, x), (b, y) = groups[i], groups[j]
        groups[i] = (a + b, (x * len(a) + y * len(b)) / (len(a) + len(b)))
        del groups[j]
        out.append((frozenset(a + b), round(float(cost), 6)))
    return out


@pytest.mark.parametrize("block", [6, 40, 1024])
def test_ward_tree_equals_the_plain_algorithm(spark, block):
    rnd = np.random.default_rng(3)
    points = [(int(i) * 7 + 1, x.tolist()) for i, x in enumerate(np.concatenate([rnd.normal(m, 1, (30, 3)) for m in (0, 4, 9)]))]
    frame = spark.createDataFrame(points, "id bigint, feature array<double>")
    held = {i: [i] for i, _ in points}
    got = []
    for r in sorted(clusters.ward_tree(frame, block).collect(), key=lambda r: r["n"] * 0 + r["cost"]):
        held[r["a"]] = held[r["a"]] + held[r["b"]]
        got.append((frozenset(held[r["a"]]), round(r["cost"], 6)))
        assert r["n"] == len(held[r["a"]]) and r["a"] == min(held[r["a"]])
    assert got == plain_ward(points)


def test_ward_labels(spark):
    rnd = np.random.default_rng(8)
    points = [(i, (rnd.normal(0, 0.1, 4) + 5 * (i % 3)).tolist()) for i in range(60)] + [(100, [0.0] * 4), (101, [0.0] * 4)]
    frame = spark.createDataFrame(points, "id bigint, feature array<double>")
    for block in (8, 1024):
        labels = {r["id"]: r["cluster"] for r in clusters.ward_labels(frame, 3, block).collect()}
        assert labels == {i: i % 3 for i in range(60)} | {100: 0, 101: 0}
    assert {r["cluster"] for r in clusters.ward_labels(frame, 1).collect()} == {0}
    assert clusters.ward_labels(frame.limit(0), 3).count() == 0


def checked_tree(spark, points, block):
    """(members of the merged cluster, cost) of each merge of ``ward_tree``, the cheapest first, and how many tables it wrote."""
    written = []
    before = clusters._cut
    clusters._cut = lambda df: written.append(1) or before(df)
    try:
        tree = clusters.ward_tree(spark.createDataFrame(points, "id bigint, feature array<double>"), block).collect()
    finally:
        clusters._cut = before
    held, got = {i: [i] for i, _ in points}, []
    for r in sorted(tree, key=lambda r: (round(r["cost"], 9), r["n"], r["b"])):
        held[r["a"]] = held[r["a"]] + held[r["b"]]
        got.append((frozenset(held[r["a"]]), round(r["cost"], 6)))
        assert r["n"] == len(held[r["a"]]) and r["a"] == min(held[r["a"]])
    return got, len(written)


def test_near_rows_merge_in_one_round(spark):
    rnd = np.random.default_rng(4)
    middles = rnd.normal(0, 50, (12, 5))
    points = [(i * 3, (middles[i % 12] + rnd.normal(0, 1, 5)).tolist()) for i in range(96)]
    got, tables = checked_tree(spark, points, 32)
    assert got == plain_ward(points)
    assert tables <= 8


def test_equal_rows_merge_at_once(spark):
    points = [(i, [1.0, 2.0, 0.0]) for i in range(50)] + [(100 + i, [float(i) ** 2, 0.5, float(i)]) for i in range(9)]
    got, tables = checked_tree(spark, points, 12)
    assert sorted(c for _, c in got) == sorted(c for _, c in plain_ward(points))
    assert got[:49] == [(frozenset(range(k)), 0.0) for k in range(2, 51)]
    assert tables <= 8


@pytest.mark.parametrize("size", [5, 25])
def test_cells_merge_only_what_the_whole_tree_has(size):
    rnd = np.random.default_rng(size)
    x, cell = rnd.normal(0, 1, (120, 3)), rnd.integers(0, 120 // size, 120)
    tree = set(plain_ward(list(enumerate(x.tolist()))))
    apart = ((x[:, None] - x[None]) ** 2).sum(-1) / 2
    apart[cell[:, None] == cell[None, :]] = np.inf
    found = 0
    for c in range(120 // size):
        own = np.flatnonzero(cell == c)
        merges, name, n, centre, _ = clusters._merged(own, np.ones(len(own)), x[own], apart[own].min(axis=1))
        held = {i: [i] for i in own.tolist()}
        for a, b, cost, both in merges:
            held[a] = held[a] + held.pop(b)
            assert (frozenset(held[a]), round(cost, 6)) in tree and both == len(held[a])
        for k, m, y in zip(name.tolist(), n, centre, strict=True):
            assert m == len(held[k]) and np.allclose(y, x[held[k]].mean(axis=0))
        found += len(merges)
    assert found > 0


def test_ward_tree_of_equal_distances_ends(spark):
    points = [(i, [float(i % 7), float(i // 7)]) for i in range(70)]
    for block in (16, 1024):
        tree = clusters.ward_tree(spark.createDataFrame(points, "id bigint, feature array<double>"), block).collect()
        assert len({r["b"] for r in tree}) == len(tree) == 69
        assert sum(r["cost"] for r in tree) == pytest.approx(((np.array([x for _, x in points]) - [3, 4.5]) ** 2).sum())


def numeric_p(t, freedom, steps=200_001):
    """2 P(T > t) by Simpson's rule over the angle, t = sqrt(freedom) tan(angle)."""
    angle = np.linspace(math.atan(abs(t) / math.sqrt(freedom)), math.pi / 2, steps)
    y = np.cos(angle) ** (freedom - 1)
    if freedom == 1:
        y = np.ones_like(angle)
    h = angle[1] - angle[0]
    inner = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    log_scale = math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2) - 0.5 * math.log(math.pi)
    return 2 * math.exp(log_scale) * inner


def test_p_values_equal_a_numeric_integral(spark):
    rows = [(float(t), f) for f in (1, 2, 3, 5, 8, 30, 100, 371, 998) for t in (0.0, 0.01, 0.3, 1.0, -2.0, 3.7, 12.0)]
    got = spark.createDataFrame(rows, "t double, f int").select("t", "f", stats.t_two_sided(F.col("t"), F.col("f")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(numeric_p(r["t"], r["f"]), abs=1e-9)


def test_dense_numbers(spark):
    rnd = random.Random(1)
    keys = rnd.sample(range(10_000), 700)
    rows = spark.createDataFrame([(k, rnd.randrange(3), float(k), 1.0) for k in keys for _ in range(2)], "node bigint, lid bigint, x double, y double")
    got = graph.placed_nodes(rows).collect()
    assert sorted((r["number"], r["node"]) for r in got) == list(enumerate(sorted(keys)))
    assert graph.numbered(rows.limit(0), ["node"]).count() == 0
