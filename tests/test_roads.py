"""The road graph of the whole table, against brute force on a small table."""

import heapq
from collections import Counter, defaultdict

import pytest

from footfall.operators import graph
from footfall.plans import catalogue, roads
from footfall.sources.tables import table

#: part, supplier, line rows: a component around the parts 0 and 100, a chain, a pair apart, and repeated pairs.
PAIRS = [(p, s) for p, s in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (100, 2), (3, 2), (3, 0), (7, 5), (8, 5), (8, 6), (300, 99), (301, 99), (12, 40)) for _ in range(1 + (p + s) % 3)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("roads"))
    rows = [(i, p, s, 1, (i % 4) / 40) for i, (p, s) in enumerate(PAIRS)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.fixture(scope="module")
def edges(spark, small):
    return roads.road_edges(spark, small).collect()


def run(spark, d, name):
    return catalogue.QUERIES[name](spark, d).collect()


def neighbours(edges):
    out = defaultdict(set)
    for e in edges:
        out[e["nf"]].add(e["nt"])
        out[e["nt"]].add(e["nf"])
    return out


def groups(edges):
    near, label = neighbours(edges), {}
    for node in sorted(near):
        todo = [] if node in label else [node]
        while todo:
            at = todo.pop()
            if at not in label:
                label[at] = node
                todo += near[at]
    return label


def costs(edges, start, turned=False):
    arcs = defaultdict(list)
    for e in edges:
        if e["oneway"] in (0, 1):
            arcs[e["nt" if turned else "nf"]].append((e["nf" if turned else "nt"], e["length"]))
        if e["oneway"] in (0, 2):
            arcs[e["nf" if turned else "nt"]].append((e["nt" if turned else "nf"], e["length"]))
    best, heap = {}, [(0.0, start)]
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for other, w in arcs[node]:
                heapq.heappush(heap, (cost + w, other))
    return best


def test_no_row_is_left_out(spark, sf):
    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = roads.road_edges(spark, sf)
    assert got.agg({"cnt_ft": "sum"}).first()[0] == table.count()
    assert got.count() == got.select("lid").distinct().count() == table.select("l_partkey", "l_suppkey").distinct().count()


def test_line_features_have_every_order(spark, sf):
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert catalogue.QUERIES["line_features"](spark, sf).count() == orders


def test_components(spark, small, edges):
    label = groups(edges)
    assert len(set(label.values())) == 4
    assert {r["node"]: r["component"] for r in run(spark, small, "connected_components")} == label
    sizes = Counter(label.values())
    want = {e["lid"] for e in edges if sizes[label[e["nf"]]] >= 0.4 * len(label)}
    assert {r["lid"] for r in run(spark, small, "small_subgraphs")} == want and 0 < len(want) < len(edges)


@pytest.mark.parametrize("name,key,turned", [("shortest_paths", "source", False), ("next_hop_costs", "destination", True)])
def test_paths(spark, small, edges, name, key, turned):
    starts = [n for n in neighbours(edges) if n % 100 == 0]
    assert sorted(starts) == [-100, 0, 100, 300]
    want = {(s, n): c for s in starts for n, c in costs(edges, s, turned).items()}
    got = run(spark, small, name)
    assert {(r[key], r["node"]): r["dist"] for r in got} == want and len(got) == len(want) > len(starts)


def test_transitions(spark, small, edges):
    ends = defaultdict(dict)
    for e in edges:
        ends[e["nf"]][e["lid"]], ends[e["nt"]][e["lid"]] = e["cnt_ft"], e["cnt_tf"]
    want = {}
    for node, out in ends.items():
        for lid in out:
            total = sum(c for x, c in out.items() if x != lid)
            want |= {(node, lid, x): round(c / total, 9) for x, c in out.items() if x != lid}
    # The rows of each node's edges say all shares.
    rows = run(spark, small, "transition_matrix")
    assert len(rows) == 2 * len(edges)
    got = {}
    for x in rows:
        for y in rows:
            if x["node"] == y["node"] and x["lid"] != y["lid"]:
                left = x["total"] - x["cnt"]
                got[x["node"], x["lid"], y["lid"]] = round(y["cnt"] / left if left >= 1 else 1 / x["others"], 9)
    assert got == want
    shares = {(r["node"], r["lid"], r["next_lid"]): r["share"] for r in run(spark, small, "transition_shares")}
    assert shares == {k: v for k, v in want.items() if k[0] % 100 == 0}
    every = graph.transitions(roads.road_edges(spark, small)).collect()
    assert {(r["node"], r["lid"], r["next_lid"]): round(r["share"], 9) for r in every} == want


def test_best_paths_lead_from_source_to_target(spark, small, edges):
    arcs = {}
    for e in edges:
        if e["oneway"] in (0, 1):
            arcs[e["nf"], e["nt"]] = e["length"]
        if e["oneway"] in (0, 2):
            arcs[e["nt"], e["nf"]] = e["length"]
    stops = [n for n in neighbours(edges) if n % 100 == 0]
    best = {s: costs(edges, s) for s in stops}
    paths = defaultdict(dict)
    for r in run(spark, small, "best_paths"):
        paths[r["source"], r["target"]][r["step"]] = (r["a"], r["b"])
    assert set(paths) == {(s, t) for s in stops for t in stops if s != t and t in best[s]}
    for (source, target), steps in paths.items():
        walk = [steps[i] for i in reversed(range(len(steps)))]
        assert walk[0][0] == source and walk[-1][1] == target and all(x[1] == y[0] for x, y in zip(walk, walk[1:], strict=False))
        assert sum(arcs[x] for x in walk) == best[source][target]
    used = Counter(x for steps in paths.values() for x in steps.values())
    assert {(r["a"], r["b"]): r["used"] for r in run(spark, small, "path_usage")} == used


def test_forbidden_turns_equal_brute_force(spark, small, edges):
    ways = [(e["lid"], a, b, e["length"]) for e in edges for a, b, ok in ((e["nf"], e["nt"], (0, 1)), (e["nt"], e["nf"], (0, 2))) if e["oneway"] in ok]
    lids = sorted({e["lid"] for e in edges})
    forbidden = {(x, y) for i, x in enumerate(lids) for j, y in enumerate(lids) if (i * 3 + j) % 4 == 0}
    want = {}
    for source in (0, -100, 100):
        heap, best = [(w, i) for i, (_, a, _, w) in enumerate(ways) if a == source], {}
        heapq.heapify(heap)
        while heap:
            cost, i = heapq.heappop(heap)
            if i not in best:
                best[i] = cost
                for j, (lid, a, _, w) in enumerate(ways):
                    if a == ways[i][2] and (ways[i][0], lid) not in forbidden:
                        heapq.heappush(heap, (cost + w, j))
        want[source, source] = 0.0
        for i, cost in best.items():
            key = (source, ways[i][2])
            want[key] = min(cost, want.get(key, cost))
    weights = graph.directed_weights(roads.road_edges(spark, small))
    turns = spark.createDataFrame(sorted(forbidden), "lid bigint, next_lid bigint")
    sources = spark.createDataFrame([(0,), (-100,), (100,)], "node bigint")
    got = {(r["source"], r["node"]): r["dist"] for r in graph.shortest_with_turns(weights, turns, sources).collect()}
    assert got == want


def test_forbidden_turns_go_without_a_round_for_each_hop(spark, monkeypatch):
    monkeypatch.setattr(graph, "_spread", None)
    n = 40
    # A road of n edges with a way round at node 20, where the straight turn is forbidden.
    rows = [(i, i, i + 1) for i in range(n)] + [(100, 20, 99), (101, 99, 20)]
    weights = spark.createDataFrame([(*r, 1.0, 1e8) for r in rows], "lid bigint, nf bigint, nt bigint, w_ft double, w_tf double")
    turns = spark.createDataFrame([(19, 20)], "lid bigint, next_lid bigint")
    got = graph.shortest_with_turns(weights, turns, spark.createDataFrame([(0,)], "node bigint")).collect()
    assert {r["node"]: r["dist"] for r in got} == {i: float(i if i <= 20 else i + 2) for i in range(n + 1)} | {99: 21.0}


#: A chain of four edges, a direct edge beside a chain of two, a ring without an end, a loop, and loose ends.
CHAINED = [
    (1, 10, 11), (2, 11, 12), (3, 13, 12), (4, 13, 14), (5, 14, 20), (6, 14, 21), (7, 10, 20), (8, 10, 22),
    (9, 50, 51), (10, 51, 52), (11, 52, 50), (12, 20, 23), (13, 23, 10), (14, 60, 60),
]


def chained(spark):
    return spark.createDataFrame([(*e, float(e[0])) for e in CHAINED], "lid bigint, nf bigint, nt bigint, length double")


def test_chains_become_one_edge(spark):
    got = {r["lid"]: r for r in graph.contracted(chained(spark)).collect()}
    assert set(got) == {e[0] for e in CHAINED} - {2, 3, 4}
    assert got[1][1:] == (10, 14, 10.0, 4)
    # The edge 7 joins 10 and 20 already, so the chain of 12 and 13 stays; so do the ring and the loop.
    assert all(tuple(got[e[0]][1:3]) == e[1:] and got[e[0]]["edges"] == 1 for e in CHAINED if e[0] > 4)


def test_long_chain_takes_few_rounds_and_keeps_order(spark):
    n = 300
    edges = [(1000 + i * 37 % n, i, i + 1) if i % 3 else (1000 + i * 37 % n, i + 1, i) for i in range(n)]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "lid bigint, nf bigint, nt bigint, length double")
    places = graph.chain_places(df)
    got = {r["lid"]: (r["place"], r["forward"], r["nf"], r["nt"]) for r in places.collect()}
    assert got == {lid: (min(a, b), a < b, 0, n) for lid, a, b in edges}
    points = spark.createDataFrame([(lid, k, float(p), 0.0) for lid, a, b in edges for k, p in enumerate((a, (a + b) / 2, b))], "lid bigint, seq int, x double, y double")
    line = graph.chain_points(places, points).orderBy("seq").collect()
    assert [r["x"] for r in line] == [k / 2 for k in range(2 * n + 1)]


def test_no_edges_no_chains(spark):
    assert graph.contracted(chained(spark).filter("lid < 0")).count() == 0


def test_edges_are_counted_in_tasks_of_bounded_rows(spark, sf, monkeypatch):
    n = table(spark, sf, "lineitem").count()
    monkeypatch.setattr(roads, "LINES", 500)
    assert roads.road_edges(spark, sf).rdd.getNumPartitions() == -(-n // 500)
