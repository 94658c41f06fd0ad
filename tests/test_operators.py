"""Small frames with results worked out by hand or by numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.functions import calendar, geo, text
from footfall.operators import documents, flows, graph, joins, learning, series, spatial, stats


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "key string, i int, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_interpolation_is_flat_at_both_ends(spark):
    out = series.interpolate(frame(spark, [None, 2.0, None, 4.0, None, None]), ["key"], "i", "v")
    assert column(out, "v") == [2, 2, 3, 4, 4, 4]
    assert column(series.interpolate(frame(spark, [None, None]), ["key"], "i", "v"), "v") == [None, None]


def test_rolling_mean_is_closed_at_both_ends(spark):
    out = column(series.rolling_mean3(frame(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]), ["key"], "i", "v"), "mean")
    assert [round(x, 4) for x in out] == [1.5, 2.3333, 3.75, 7.5, 15.0, 18.6667]


def by_fourier(x, box):
    n = len(x)
    pad = n - box
    kernel = np.concatenate([np.zeros(pad // 2), np.ones(box) / box, np.zeros(pad - pad // 2)])
    return np.fft.fftshift(np.real(np.fft.ifft(np.fft.fft(x) * np.fft.fft(kernel))))


@pytest.mark.parametrize("n,box", [(144, 5), (144, 10), (145, 10), (96, 8), (97, 8), (7, 7), (9, 4)])
def test_box_smooth_is_the_centred_kernel(spark, n, box):
    x = np.random.default_rng(n + box).normal(size=n)
    out = column(series.box_smooth(frame(spark, x.tolist()), ["key"], "i", "v", box), "smooth")
    assert np.allclose(out, by_fourier(x, box))
    assert math.isclose(np.mean(out), x.mean(), abs_tol=1e-9)


def test_upsampling_keeps_the_total(spark):
    rows = spark.sql("SELECT 'a' AS key, timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS bin, (id * 7 % 5) + 1.0 AS v FROM range(10)")
    out = series.upsample_total(rows, ["key"], "v", 3600, 900).agg(F.sum("v"), F.count("*")).first()
    assert math.isclose(out[0], rows.agg(F.sum("v")).first()[0]) and out[1] == 37


def test_carry_lets_an_exact_one_wait(spark):
    rates = spark.createDataFrame([("a", 0, 4), ("a", 1, 0), ("a", 2, 6)], "key string, i int, rate int")
    out = stats.carried_counts(rates, ["key"], "i", "rate", 4).orderBy("i", "part")
    assert [r["created"] for r in out.collect()] == [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 2, 1]


def test_paths_collapse_runs(spark):
    stations = "1123311"
    rows = spark.createDataFrame([(i, 7, s) for i, s in enumerate(stations)], "event_id int, mac_address int, station_name string").withColumn(
        "date_time", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, event_id)")
    )
    assert flows.collapsed_paths(rows).count() == 4
    od = {(r["origin"], r["destination"]): r["trips"] for r in flows.od_matrix(rows).collect()}
    assert od == {("1", "2"): 1, ("2", "3"): 1, ("3", "1"): 1}
    assert text.collapsed(F.lit(stations)) is not None
    assert rows.select(text.collapsed(F.lit(stations))).first()[0] == "1231"


def test_next_after_is_strict(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 1), ("k", 5), ("k", 6)], "k string, t int")
    got = {r["t"]: r["n"] for r in joins.next_after(left, right, ["k"], "t", "n").collect()}
    assert got == {1: 5, 5: 6, 9: None}


def test_insert_ignore_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    once = joins.insert_ignore(rows.limit(0), rows, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, joins.insert_ignore(once, rows, ["k"], "v").collect())) == [(1, "a"), (2, "c")]


def test_components_and_paths_on_a_ring(spark):
    ring = [(i, i, (i + 1) % 12) for i in range(12)] + [(100, 50, 51)]
    edges = spark.createDataFrame(ring, "lid bigint, nf bigint, nt bigint").selectExpr("*", "1.0 AS length", "1.0 AS speed", "1 AS cnt_ft", "1 AS cnt_tf", "0 AS oneway")
    labels = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(12)}, 50: 50, 51: 50}
    dist = {r["node"]: r["dist"] for r in graph.shortest(graph.directed_weights(edges), spark.createDataFrame([(0,)], "node bigint")).collect()}
    assert dist == {i: min(i, 12 - i) for i in range(12)}
    assert graph.chains(edges).select("chain").distinct().count() == 2
    assert graph.drop_small(edges, 0.5).count() == 12


@settings(max_examples=20, deadline=None)
@given(st.integers(1900, 2199))
def test_easter_monday_is_a_monday_in_season(spark, year):
    day = spark.range(1).select(calendar.easter_monday(F.lit(year))).first()[0]
    assert day.weekday() == 0 and (3, 23) <= (day.month, day.day) <= (4, 26)


def test_known_easters(spark):
    got = [spark.range(1).select(calendar.easter_monday(F.lit(y))).first()[0].isoformat()[5:] for y in (2000, 2019, 2024, 1981, 1954)]
    assert got == ["04-24", "04-22", "04-01", "04-20", "04-19"]


def test_winding_and_crossing(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    one = spark.range(1)
    assert one.select(geo.in_ring(F.lit(2.0), F.lit(2.0), ring)).first()[0]
    assert not one.select(geo.in_ring(F.lit(5.0), F.lit(2.0), ring)).first()[0]
    way = lambda *p: one.select(geo.oriented_crossing(*map(F.lit, (0.0, 0.0, 0.0, 4.0, *p)))).first()[0]
    assert way(-1.0, 2.0, 1.0, 2.0) == -way(1.0, 2.0, -1.0, 2.0) != 0
    assert way(1.0, 1.0, 2.0, 2.0) == 0


def test_patch_rolls_back(spark):
    doc = F.create_map(F.lit("a"), F.lit("1"))
    ops = F.expr("array(named_struct('op','add','path','/b','from',cast(null as string),'value','2'), named_struct('op','test','path','/a','from',cast(null as string),'value','9'))")
    assert spark.range(1).select(documents.patched(doc, ops)).first()[0] is None
    assert spark.range(1).select(documents.patched(doc, F.slice(ops, 1, 1))).first()[0] == {"a": "1", "b": "2"}


@pytest.mark.parametrize("n", [4, 5, 6, 40])
def test_spline_equals_the_dense_system(n):
    x = np.random.default_rng(n).normal(size=n)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2], b[i] = (1, 4, 1), 6 * (x[i - 1] - 2 * x[i] + x[i + 1])
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    m = np.linalg.solve(a, b)
    middle = (x[:-1] + x[1:]) / 2 - (m[:-1] + m[1:]) / 16
    assert np.allclose(learning.cubic_spline(None, x, 2)["value"][1::2], middle)


def test_spline_of_five_years_of_hours():
    import tracemalloc

    tracemalloc.start()
    out = learning.cubic_spline(None, np.sin(np.arange(43_800) / 50), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(out["value"], np.sin(out["place"] / 50), atol=1e-6) and peak < 100e6


def test_spline_and_smoothing_keep_cubics():
    t = np.arange(12)
    x = 0.5 * t**3 - t
    fine = learning.cubic_spline(t, x.astype(float), 4)
    assert np.allclose(fine["value"], 0.5 * fine["place"] ** 3 - fine["place"])


def test_smoothing_is_a_fit_to_each_window(spark):
    """Series of every length against polynomials fitted window by window; cubics stay as they are."""
    rng = np.random.default_rng(4)
    data = {n: rng.normal(size=n).round(3) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 30)} | {40: np.arange(40) ** 3 / 100 - np.arange(40)}
    rows = spark.createDataFrame([(n, i, float(v)) for n, x in data.items() for i, v in enumerate(x)], "k int, t int, v double")
    got = {(r["k"], r["t"]): r["smooth"] for r in series.savitzky_golay(rows, ["k"], "t", "v", 7, 3).collect()}
    assert len(got) == sum(data)
    for n, x in data.items():
        w = min(7, n - (n + 1) % 2)
        for i, v in enumerate(x):
            if w > 3:
                low = min(max(i - w // 2, 0), n - w)
                v = np.polyval(np.polyfit(np.arange(w), x[low : low + w], 3), i - low)
            assert abs(got[n, i] - v) < 1e-8
    assert all(abs(got[40, i] - v) < 1e-8 for i, v in enumerate(data[40]))


def test_quantiles_without_a_group_in_one_task(spark):
    """Cuts of repeated, null and single values equal those of the exact percentile."""
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 300)] + [("b", float(v)) for v in rng.normal(size=101)] + [("c", 7.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["k"]: r["cuts"] for r in stats.quantiles(df, ["k"], "v", qs).collect()}
    by = {k: [v for name, v in rows if name == k and v is not None] for k in "abc"}
    assert set(got) == set(by) and all(np.allclose(got[k], np.quantile(by[k], qs)) for k in by)


def test_warping_ignores_pauses():
    assert learning.warping_distance([1, 2, 3], [1, 1, 2, 2, 3]) == 0


@pytest.mark.parametrize("block", [12, 512])
def test_nearest_by_warping_equals_all_pairs(spark, block):
    rnd = np.random.default_rng(4)
    waves = [np.sin(np.arange(20) / 3 + rnd.uniform(0, 6)) * rnd.uniform(1, 4) + rnd.normal(0, 0.2, 20) + 3 * (i % 4) for i in range(40)]
    waves[7] = waves[3]
    rows = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(waves)], "id bigint, x array<double>")
    got = {r["id"]: r for r in learning.nearest_warped(rows, 2, block).collect()}
    for i in range(40):
        want = min((round(learning.warping_distance(waves[i], waves[j], 2), 9), j) for j in range(40) if j != i)
        assert (got[i]["dist"], got[i]["best"]) == pytest.approx(want)
    # The envelopes leave less than a third of the exact distances to compute.
    assert sum(r["tried"] for r in got.values()) < 40 * 39 / 3 * (1 if block == 512 else 2)


def test_warping_bounds_are_bounds():
    rnd = np.random.default_rng(5)
    x = rnd.normal(0, 1, (12, 15)).cumsum(axis=1)
    for band in (0, 1, 4, 30):
        bound = learning.warping_bounds(x, band)
        assert all(bound[i, j] <= learning.warping_distance(x[i], x[j], band) + 1e-9 for i in range(12) for j in range(12))


def test_next_after_takes_later_rows_only(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 9), ("b", 2)], "key string, t int")
    right = spark.createDataFrame([("a", 3), ("a", 5), ("a", 5), ("b", 1), ("c", 4)], "key string, t int")
    got = sorted((tuple(r) for r in joins.next_after(left, right, ["key"], "t", "nxt").select("key", "t", "nxt").collect()), key=repr)
    assert got == [("a", 1, 3), ("a", 3, 5), ("a", 3, 5), ("a", 9, None), ("b", 2, None)]


def test_draws_take_the_first_share_that_reaches_them(spark):
    from footfall.operators import agents

    shares = spark.createDataFrame([(0, 0.25, ["x"]), (0, 1.0, ["y", "z"])], "bin bigint, share double, route array<string>")
    draws = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.25), (3, 0, 0.3), (4, 1, 0.5)], "id bigint, bin bigint, u double")
    got = {r["id"]: r["route"] for r in agents.created_from_weights(draws, shares).collect()}
    assert got == {1: ["x"], 2: ["x"], 3: ["y", "z"], 4: None}


def test_components_of_a_star_and_a_chain(spark):
    links = [(50, x) for x in range(51, 90)] + [(i, i + 1) for i in range(200, 230)] + [(229, 60), (7, 8)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "nf bigint, nt bigint")).collect()}
    assert got == {**{i: 50 for i in [*range(50, 90), *range(200, 231)]}, 7: 7, 8: 7}


def test_sparse_keys_go_with_both_ways(spark):
    from footfall.operators import demand

    rows = [("a", w, b, 1) for w in ("IN", "OUT") for b in range(10)] + [("b", "IN", b, 1) for b in range(10)] + [("b", "OUT", 0, 1)]
    got = demand.without_sparse(spark.createDataFrame(rows, "key string, way string, bin int, cnt int"), "key", "way", 10, 0.5)
    assert {r["key"] for r in got.collect()} == {"a"} and got.count() == 20


def test_nearest_arc_within_reach(spark):
    arcs = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 3.0, 10.0, 3.0), (3, 5.0, 5.0, 5.0, 5.0)], "aid int, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.5), (3, 40.0, 0.0), (4, 12.0, 3.0), (5, 5.0, 4.5)], "id int, x double, y double")
    got = {r["id"]: (r["aid"], r["dist"], r["share"]) for r in spatial.nearest_arc(points, arcs, 4.0).collect()}
    assert got == {1: (1, 1.0, 0.5), 2: (1, 1.5, 0.5), 4: (2, 2.0, 1.0), 5: (3, 0.5, 0.0)}


def test_attached_subgraphs(spark):
    at = {1: (0, 0), 2: (10, 0), 3: (20, 0), 4: (2, 1), 5: (2, 9), 6: (18, 3), 7: (18, 2), 8: (90, 90), 9: (91, 90)}
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "node bigint, x double, y double")
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 5, 4), (4, 6, 7), (5, 8, 9)], "lid bigint, nf bigint, nt bigint")
    got = {tuple(r) for r in spatial.attached_subgraphs(edges, points, 3.0).collect()}
    assert got == {(1, 1, 2), (2, 2, 3), (3, 5, 1), (4, 6, 3)}


def test_suppressed_boxes(spark):
    rows = [(1, 1, 0.9, 0.0, 10.0), (1, 2, 0.8, 1.0, 11.0), (1, 3, 0.7, 4.0, 14.0), (1, 4, 0.9, 0.0, 10.0), (2, 5, 0.1, 0.0, 10.0)]
    boxes = spark.createDataFrame(rows, "frame int, id int, score double, x1 double, x2 double").selectExpr("*", "0D AS y1", "1D AS y2")
    assert sorted(map(tuple, spatial.suppressed(boxes, ["frame"], 0.5).collect())) == [(1, 1), (1, 3), (2, 5)]


def test_slices_and_unions(spark):
    cuts = [(a, b, c) for a in (None, -9, -2, 0, 1, 9) for b in (None, -9, -1, 0, 2, 9) for c in (1, 2, -1, -3)]
    x = F.slice(F.array(*map(F.lit, range(5))), F.lit(1), F.col("id").cast("int"))
    rows = spark.range(6).select(x.alias("x")).select("x", *(documents.sliced("x", *c).alias(str(i)) for i, c in enumerate(cuts)), documents.picked("x", 0, -1, 3, -9).alias("u"))
    for r in rows.collect():
        assert all(r[str(i)] == list(r["x"])[slice(*c)] for i, c in enumerate(cuts))
        assert r["u"] == [list(r["x"])[i] for i in (0, -1, 3, -9) if -len(r["x"]) <= i < len(r["x"])]


def test_descendants(spark):
    texts = [(1, '{"a":{"n":1,"b":[{"n":2},{"n":{"n":[3]}}]},"n":"x"}'), (2, None), (3, "[1"), (4, '{"n":null}'), (5, "[]")]
    got = documents.descendants(spark.createDataFrame(texts, "k int, d string"), "d", "n").collect()
    assert sorted(map(tuple, got)) == [(1, '"x"'), (1, "1"), (1, "2"), (1, "[3]"), (1, '{"n":[3]}'), (4, "null")]


def test_point_clusters(spark):
    rows = [(i, 100.0 * (i % 3) + i / 100, 5.0) for i in range(30)] + [(99, None, 1.0)]
    got = learning.point_clusters(spark.createDataFrame(rows, "id int, x double, y double"), 3).collect()
    assert len(got) == 30
    assert len({(r["id"] % 3, r["cluster"]) for r in got}) == 3


def test_nearest_features_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, feature array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, -2)
    for block in (7, 4096):
        got = learning.nearest_features(rows, rows.filter("id % 2 = 0"), block).collect()
        assert {r["id"]: r["best"] for r in got} == {i: int(like[i].argmax()) for i in range(0, 40, 2)}


def test_nearest_features_in_parts_with_ties_and_rows_without_a_cosine(spark):
    x = {1: [1.0, 0.0], 2: [2.0, 0.0], 3: [3.0, 0.0], 4: [0.0, 0.0], 5: None, 6: [1.0, 1.0], 7: [1.0, 0.0, 0.0], 8: [0.0, None]}
    rows = spark.createDataFrame(list(x.items()), "id bigint, feature array<float>")
    got = {r["id"]: (r["best"], r["likeness"]) for r in learning.nearest_features(rows, rows, block=3, rows=2).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0), 6: (1, round(0.5**0.5, 9)), 4: (1, None), 5: (1, None), 7: (1, None), 8: (1, None)}


def test_notation_of_places(spark):
    rows = [("+44.5+011.25/", 44.5, 11.25), ("+4430-01115/", 44.5, -11.25), ("-443018.0+0111506.0/", -44.505, 11.251667), ("none", None, None), ("", None, None), (None, None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(geo.from_iso6709(F.col("t")).alias("p")).select("p.lat", "p.lon").collect()
    for (_, lat, lon), r in zip(rows, got, strict=True):
        assert (r["lat"] is None) == (lat is None) and (lat is None or abs(r["lat"] - lat) < 1e-6 and abs(r["lon"] - lon) < 1e-6)
    there = spark.range(1).select(geo.to_iso6709(F.lit(-5.25), F.lit(0.5)).alias("t")).first()["t"]
    assert there == "-05.250000+000.500000/"


def test_orders_of_items(spark):
    one = lambda items, n: spark.createDataFrame([(items,)], "x array<string>").select(text.permutations("x", n).alias("p")).first()["p"]
    assert sorted(one(["a", "b", "c"], 2)) == ["a", "a b", "a c", "b", "b a", "b c", "c", "c a", "c b"]
    assert one([], 2) == [] and one(None, 2) is None


def test_bounds_are_whole_bins():
    assert series.aligned_bounds("2024-01-03 07:13:20", "2024-01-05 00:05:00", 15) == ("2024-01-03 07:00:00", "2024-01-04 23:59:59")


def test_pairs_of_places(spark):
    from footfall.operators import demand

    got = sorted(tuple(r) for r in demand.ordered_pairs(spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "place string")).collect())
    assert got == [(a, b, 0) for a in "abc" for b in "abc" if a != b]


def test_rounds_need_all_their_ways(spark):
    dist = spark.createDataFrame([("s", "a", 1.0), ("a", "s", 2.0), ("a", "b", 4.0), ("b", "s", 8.0), ("b", "a", 16.0)], "a string, b string, dist double")
    places = spark.createDataFrame([("a",), ("b",)], "place string")
    found = graph.routes(places, dist.filter("a <> 's' AND b <> 's'"), 2)
    got = {tuple(r["route"]): r["length"] for r in graph.rounds(spark.createDataFrame([("s",)], "place string"), found, dist).collect()}
    assert got == {("a",): 3.0, ("a", "b"): 13.0}


def test_choice_in_reach(spark):
    from footfall.operators import demand

    rows = [(1, 0.0, 0.0, 0, 2.0), (2, 3.0, 0.0, 0, 1.0), (3, 0.0, 4.0, 0, 3.0), (4, 1.0, 1.0, 9, 5.0), (5, 50.0, 0.0, 0, 5.0)]
    got = demand.choice_in_radius(spark.createDataFrame(rows, "place int, x double, y double, component int, score double"), 4.5).collect()
    assert {(r["place"], r["other"]): (r["share"], r["upto"]) for r in got} == {(1, 2): (0.25, 0.25), (1, 3): (0.75, 1.0), (2, 1): (1.0, 1.0), (3, 1): (1.0, 1.0)}


def test_compared_days(spark):
    """Differences to days that have no rows are null; a constant difference stays what it is."""
    rows = [("a", f"2024-01-0{day}", slot, 10 * day) for day in (1, 2, 4) for slot in range(8)]
    df = spark.createDataFrame(rows, "k string, day string, slot int, cnt int").withColumn("day", F.to_date("day"))
    got = {(r["day"].day, r["slot"]): (r["smooth"], r["less_1"], r["less_3"]) for r in series.compared_days(df, ["k"], 8, (1, 3), 5).collect()}
    assert len(got) == 24
    assert all(got[1, s] == (10.0, None, None) and got[2, s] == (20.0, 10.0, None) and got[4, s] == (40.0, None, 30.0) for s in range(8))


def test_nearest_in_cells_meets_few_points(spark):
    """The levels of cells give what one level gives, ties and points without a neighbour included, on dense and bare ground."""
    from footfall.operators import joins

    left = [(i, (i * 37 % 101) / 4, (i * 61 % 89) / 4) for i in range(300)] + [(900, 95.0, 95.0), (901, None, 1.0), (902, 60.0, 3.0)]
    right = [(i, (i * 7 % 40) / 2, (i * 11 % 40) / 2) for i in range(400)] + [(1000, 55.0, 3.0), (1001, 65.0, 3.0), (2000, 71.0, 3.0)]
    cell = lambda v: int(v // 10)
    want = {}
    for i, x, y in left:
        near = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), o) for o, u, v in right if x is not None and abs(cell(x) - cell(u)) <= 1 and abs(cell(y) - cell(v)) <= 1]
        want[i] = min(near)[::-1] if near else (None, None)
    a = spark.createDataFrame(left, "id bigint, x double, y double")
    b = spark.createDataFrame(right, "other bigint, ox double, oy double")
    rows = joins.nearest_in_cells(a, b, 10.0).collect()
    assert {r["id"]: (r["other"], r["dist"]) for r in rows} == want and len(rows) == len(left)
    assert want[902][1] == 5.0 and want[902][0] == 1000 and want[900] == (None, None)


def test_equal_places_meet_once(spark, monkeypatch):
    """Many points and arcs in few places: the nearest arcs and joined ends are those of all pairs, from few distances."""
    points = [(i, float(i % 5 * 4), float(i % 3)) for i in range(200)]
    arcs = [(i, float(i % 7), 0.0, float(i % 7 + 3), 2.0) for i in range(210)]
    p = spark.createDataFrame(points, "id bigint, x double, y double")
    met = []
    cells = spatial.arc_cells
    monkeypatch.setattr(spatial, "arc_cells", lambda a, *rest: met.append(a.count()) or cells(a, *rest))
    got = {r["id"]: (r["aid"], round(r["dist"], 9)) for r in spatial.nearest_arc(p, spark.createDataFrame(arcs, "aid bigint, ax double, ay double, bx double, by double"), 5.0).collect()}

    def gap(x, y, ax, ay, bx, by):
        s = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return round(math.hypot(x - ax - s * (bx - ax), y - ay - s * (by - ay)), 9)

    best = {i: min((gap(x, y, *a[1:]), a[0]) for a in arcs) for i, x, y in points}
    assert got == {i: (a, d) for i, (d, a) in best.items() if d <= 5} and met == [7]
    ends = {r["node"]: r["to"] for r in spatial.joined_ends(p.withColumnRenamed("id", "node"), 4.2).collect()}
    near = {i: min(j for j, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 4.2**2) for i, x, y in points}
    assert ends == {i: j for i, j in near.items() if j < i}


def test_radius_join_sends_no_side_to_the_driver(spark):
    """Small files may hold many points, so pairs in a radius are found without a broadcast."""
    p = spark.range(50).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    out = joins.within_radius(p, p.toDF("other", "ox", "oy"), 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
