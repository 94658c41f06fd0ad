"""Queries over points, arcs, rings and rasters. Each part is a short arc, each customer a point, on a square of 1,000."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.operators import cover, graph, learning, spatial
from footfall.sources.tables import table


def _arcs(spark, d):
    p = F.col("p_partkey")
    x, y = (p * 7919 % 1000).cast("double"), (p * 104729 % 1000).cast("double")
    return table(spark, d, "part").select(p.alias("aid"), x.alias("ax"), y.alias("ay"), (x + 3 + p % 5).alias("bx"), (y + 2 - p % 4).alias("by"))


def _points(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), (c * 6007 % 1000 + 0.25).alias("x"), (c * 31337 % 1000 + 0.5).alias("y"))


def nearest_arc(spark, d):
    out = spatial.nearest_arc(_points(spark, d), _arcs(spark, d), 20.0)
    return out.select("id", "aid", F.round("dist", 6).alias("dist"), F.round("share", 6).alias("share"))


def arc_cells(spark, d):
    return spatial.near_cells(_arcs(spark, d), 10.0)


#: Two bridges as closed lines, and how high they are.
BRIDGES = {1: ([(100, 100), (600, 140), (560, 700), (100, 100)], 4.5), 2: ([(300, 50), (320, 950), (340, 50), (300, 50)], 3.25)}


def _borders(spark):
    rows = [(k, *map(float, (*a, *b))) for k, (ring, _) in BRIDGES.items() for a, b in zip(ring, ring[1:], strict=False)]
    return spark.createDataFrame(rows, "poly int, ax double, ay double, bx double, by double")


def bridge_crossings(spark, d):
    return spatial.crossing_arcs(_arcs(spark, d), _borders(spark), 25.0)


def bridge_clearance(spark, d):
    heights = spark.createDataFrame([(k, h) for k, (_, h) in BRIDGES.items()], "poly int, height double")
    return spatial.least_over(spatial.crossing_arcs(_arcs(spark, d), _borders(spark), 25.0), heights, "height")


def arc_levels(spark, d):
    n = F.col("id")
    raster = spark.range(2500).select((n % 50 * 20 + 10.0).alias("rx"), (F.floor(n / 50) * 20 + 10.0).alias("ry"), (n * 37 % 11).cast("double").alias("value"))
    return spatial.raster_level(_arcs(spark, d), raster, 20.0).select("aid", F.round("level", 6).alias("level"))


def _polylines(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lid"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rows.groupBy("lid", "seq").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def halfway_points(spark, d):
    arcs = graph.arcs(_polylines(spark, d))
    wanted = arcs.groupBy("lid").agg((F.round(F.sum("length"), 9) / 2).alias("s"))
    return spatial.at_length(arcs, wanted).select("lid", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def polylines_inside(spark, d):
    return spatial.inside_box(_polylines(spark, d), (5.0, 0.0), (45.0, 9.0))


def grid_occupancy(spark, d):
    return spatial.grid_counts(_points(spark, d), 50.0, 20, 20)


def close_ends(spark, d):
    return spatial.joined_ends(_points(spark, d).withColumnRenamed("id", "node"), 12.5)


def merged_subgraphs(spark, d):
    """Each order is a street of its own, its lines' points are the nodes; all that come near are tied to the greatest."""
    node = (F.col("lid") * 8 + F.col("seq")).alias("node")
    # Nodes and edges are read several times: neither is to be made from the lines each time.
    points = graph._cut(_polylines(spark, d).select("lid", "seq", node, "x", "y"))
    ahead = points.withColumn("nt", F.lead("node").over(Window.partitionBy("lid").orderBy("seq"))).filter("nt IS NOT NULL")
    edges = graph._cut(ahead.select(F.col("node").alias("lid"), F.col("node").alias("nf"), "nt"))
    return spatial.attached_subgraphs(edges, points.select("node", "x", "y"), 1.5)


def box_suppression(spark, d):
    """Each line is a box in the frame of its order."""
    size = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("id")).agg(
        F.max(size).alias("score"), F.min("l_quantity").alias("x1"), (F.min("l_tax") * 100).alias("y1")
    )
    boxes = rows.withColumn("x2", F.col("x1") + 20 + F.col("id")).withColumn("y2", F.col("y1") + 8)
    return spatial.suppressed(boxes, ["frame"], 0.3)


def coordinate_means(spark, d):
    """The means of eight clusters of the customers' points."""
    return learning.point_clusters(_points(spark, d), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("cnt"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def voronoi_areas(spark, d):
    """How much of the square is nearest to each customer's point, and the corners of that cell."""
    out = cover.voronoi_cells(_points(spark, d), (0.0, 0.0, 1000.0, 1000.0), 25.0)
    return out.select("id", F.round("area", 4).alias("area"), F.size("ring").alias("corners"))


def arcs_in_squares(spark, d):
    """The arcs in the square around each customer's point."""
    squares = _points(spark, d).select(F.col("id").alias("qid"), "x", "y", (8.0 + F.col("id") % 30).alias("reach"))
    return cover.arcs_near(_arcs(spark, d), squares, 10.0)


def box_corners(spark, d):
    p = _points(spark, d)
    left, top, right, bottom = spatial.corners(F.col("x"), F.col("y"), F.col("id") % 90 + 1.0, F.col("id") % 70 + 1.0, 0.64, 600)
    return p.select("id", *(F.round(c, 6).alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))


def box_around(spark, d):
    names = ("south", "west", "north", "east")
    box = spatial.box_around(44 + F.col("x") / 1000, 12 + F.col("y") / 1000, 500.0)
    return _points(spark, d).select("id", *(F.round(c, 9).alias(n) for c, n in zip(box, names, strict=True)))


_A = """a AS (SELECT p_partkey AS aid, CAST(p_partkey * 7919 % 1000 AS DOUBLE) AS ax, CAST(p_partkey * 104729 % 1000 AS DOUBLE) AS ay,
  p_partkey * 7919 % 1000 + 3.0::DOUBLE + p_partkey % 5 AS zx, p_partkey * 104729 % 1000 + 2.0::DOUBLE - p_partkey % 4 AS zy FROM part)"""
_P = "p AS (SELECT c_custkey AS id, c_custkey * 6007 % 1000 + 0.25::DOUBLE AS x, c_custkey * 31337 % 1000 + 0.5::DOUBLE AS y FROM customer)"
_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / nullif(pow(zx - ax, 2) + pow(zy - ay, 2), 0), 0)))"
_D = f"sqrt(pow(x - (ax + {_T} * (zx - ax)), 2) + pow(y - (ay + {_T} * (zy - ay)), 2))"
_B = "b(poly, cx, cy, dx, dy) AS (VALUES " + ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (ring, _) in BRIDGES.items() for a, b in zip(ring, ring[1:], strict=False)) + ")"


def _o(p: str, q: str, r: str) -> str:
    return f"sign(({q}y - {p}y) * ({r}x - {q}x) - ({q}x - {p}x) * ({r}y - {q}y))"


_HITS = f"hits AS (SELECT DISTINCT aid, poly FROM a, b WHERE {_o('a', 'z', 'c')} * {_o('a', 'z', 'd')} < 0 AND {_o('c', 'd', 'a')} * {_o('c', 'd', 'z')} < 0)"
_L = """q AS (SELECT l_orderkey AS lid, l_linenumber AS seq, min(l_quantity) AS x, min(l_discount * 100) AS y FROM lineitem GROUP BY ALL)"""

SQL = {
    "nearest_arc": f"""WITH {_A}, {_P}, m AS (SELECT id, aid, {_D} AS dist, {_T} AS share FROM p, a) SELECT id, aid, round(dist, 6) AS dist, round(share, 6) AS share FROM m WHERE dist <= 20 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, aid) = 1""",
    "arc_cells": f"""WITH {_A}, c AS (SELECT *, (cx + 0.5::DOUBLE) * 10 AS x, (cy + 0.5::DOUBLE) * 10 AS y FROM a, range(-3, 106) s(cx), range(-3, 106) t(cy)
  WHERE cx BETWEEN floor(least(ax, zx) / 10) - 1 AND floor(greatest(ax, zx) / 10) + 1 AND cy BETWEEN floor(least(ay, zy) / 10) - 1 AND floor(greatest(ay, zy) / 10) + 1) SELECT aid, cx, cy FROM c WHERE {_D} < 18.1""",
    "bridge_crossings": f"WITH {_A}, {_B}, {_HITS} SELECT aid, poly FROM hits",
    "bridge_clearance": f"WITH {_A}, {_B}, {_HITS} SELECT aid, min(CASE poly WHEN 1 THEN 4.5::DOUBLE ELSE 3.25::DOUBLE END) AS height FROM hits GROUP BY 1",
    "arc_levels": f"""WITH {_A}, r AS (SELECT n % 50 * 20 + 10.0::DOUBLE AS rx, n // 50 * 20 + 10.0::DOUBLE AS ry, CAST(n * 37 % 11 AS DOUBLE) AS value FROM range(2500) t(n)),
m AS (SELECT aid, min(value) AS level FROM a JOIN r ON pow((ax + zx) / 2 - rx, 2) + pow((ay + zy) / 2 - ry, 2) <= 200 GROUP BY 1 HAVING min(value) <> 0)
SELECT a.aid, round(coalesce(level, (SELECT avg(level) FROM m)), 6) AS level FROM a LEFT JOIN m ON m.aid = a.aid""",
    "halfway_points": f"""WITH {_L}, g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM q WINDOW w AS (PARTITION BY lid ORDER BY seq)), l AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS length FROM g WHERE x2 IS NOT NULL),
k AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY lid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, round(sum(length) OVER (PARTITION BY lid), 9) / 2 AS s FROM l)
SELECT lid, round(x + (s - s0) / length * (x2 - x), 5) AS x, round(y + (s - s0) / length * (y2 - y), 5) AS y FROM k WHERE s >= s0 AND s < s0 + length""",
    "polylines_inside": f"WITH {_L} SELECT lid FROM q GROUP BY 1 HAVING bool_and(x BETWEEN 5 AND 45 AND y BETWEEN 0 AND 9)",
    "grid_occupancy": f"WITH {_P} SELECT cx, cy, count(id) AS cnt FROM range(20) s(cx), range(20) t(cy) LEFT JOIN p ON floor(x / 50) = cx AND floor(y / 50) = cy GROUP BY ALL",
    "close_ends": f"WITH {_P} SELECT a.id AS node, min(b.id) AS to FROM p a JOIN p b ON b.id < a.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 156.25 GROUP BY 1",
    "merged_subgraphs": f"""WITH {_L}, n AS (SELECT lid, lid * 8 + seq AS node, lead(lid * 8 + seq) OVER o AS nt, lead(x) OVER o AS zx, lead(y) OVER o AS zy, x, y, count(*) OVER (PARTITION BY lid) AS n,
  seq = min(seq) OVER (PARTITION BY lid) OR seq = max(seq) OVER (PARTITION BY lid) AS loose FROM q WINDOW o AS (PARTITION BY lid ORDER BY seq)),
m AS (SELECT lid FROM n WHERE n > 1 ORDER BY n DESC, lid LIMIT 1), s AS (SELECT node AS aid, nt, x AS ax, y AS ay, zx, zy FROM n WHERE nt IS NOT NULL AND lid IN (FROM m)), g AS (SELECT lid, node, x, y FROM n WHERE loose AND n > 1 AND lid NOT IN (FROM m)),
t AS (SELECT lid, node, aid, nt, {_D} AS dist, {_T} AS share FROM g, s),
r AS (SELECT lid, node, CASE WHEN share < 0.5 THEN aid ELSE nt END AS to FROM t WHERE dist <= 1.5 QUALIFY row_number() OVER (PARTITION BY lid ORDER BY dist, node, aid) = 1)
SELECT p.node AS lid, coalesce(f.to, p.node) AS nf, coalesce(b.to, p.nt) AS nt FROM n p LEFT JOIN r f ON f.node = p.node LEFT JOIN r b ON b.node = p.nt WHERE p.nt IS NOT NULL AND (p.lid IN (FROM m) OR p.lid IN (SELECT lid FROM r))""",
    "arcs_in_squares": f"""WITH {_A}, {_P}, q AS (SELECT *, 8.0::DOUBLE + id % 30 AS reach FROM p),
c AS (SELECT *, floor(least(ax, zx) / 10) AS l, floor(greatest(ax, zx) / 10) AS r, floor(least(ay, zy) / 10) AS o, floor(greatest(ay, zy) / 10) AS u FROM a),
s AS (SELECT *, floor((x - reach) / 10) AS x0, floor((x + reach) / 10) AS x1, floor((y - reach) / 10) AS y0, floor((y + reach) / 10) AS y1 FROM q)
SELECT id AS qid, aid FROM s JOIN c ON r >= x0 AND l <= x1 AND u >= y0 AND o <= y1
WHERE (least(r, x1 - 1) >= greatest(l, x0 + 1) AND least(u, y1 - 1) >= greatest(o, y0 + 1)) OR {_D} <= reach""",
    "box_suppression": """WITH RECURSIVE o AS (SELECT l_orderkey AS frame, l_linenumber AS id, max(l_extendedprice) AS score, min(l_quantity) AS x, min(l_tax) * 100 AS y FROM lineitem GROUP BY ALL),
p AS MATERIALIZED (SELECT frame, id, x, y, x + 20 + id AS u, y + 8 AS v, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS r FROM o),
k AS (SELECT frame, r, [struct_pack(id := id, x := x, y := y, u := u, v := v)] AS b FROM p WHERE r = 1
  UNION ALL SELECT frame, p.r, CASE WHEN len(list_filter(b, lambda c: greatest(0, least(c.u, p.u) - greatest(c.x, p.x)) * greatest(0, least(c.v, p.v) - greatest(c.y, p.y)) > 0.3 * ((c.u - c.x) * (c.v - c.y) + (p.u - p.x) * (p.v - p.y)
    - greatest(0, least(c.u, p.u) - greatest(c.x, p.x)) * greatest(0, least(c.v, p.v) - greatest(c.y, p.y))))) > 0 THEN b ELSE list_append(b, struct_pack(id := p.id, x := p.x, y := p.y, u := p.u, v := p.v)) END FROM k JOIN p USING (frame) WHERE p.r = k.r + 1)
SELECT frame, unnest(b).id AS id FROM k QUALIFY row_number() OVER (PARTITION BY frame ORDER BY r DESC) = 1""",
    "box_corners": f"WITH {_P}, " + "s AS (SELECT id, x, y, (id % 90 + 1.0::DOUBLE) / 2 AS w, (id % 70 + 1.0::DOUBLE) / 2 AS h FROM p) SELECT id, " + ", ".join(f"round(greatest(0, least(600, ({v}) * 0.64::DOUBLE)), 6) AS \"{n}\"" for v, n in (("x - w", "left"), ("y - h", "top"), ("x + w", "right"), ("y + h", "bottom"))) + " FROM s",
    "box_around": f"""WITH {_P}, s AS (SELECT id, radians(44 + x / 1000) AS f, 12 + y / 1000 AS lon, 500.0::DOUBLE / 6371000.0::DOUBLE AS a FROM p), u AS (SELECT *, asin(sin(f) * cos(a) + cos(f) * sin(a) * cos(radians(225))) AS f1, asin(sin(f) * cos(a) + cos(f) * sin(a) * cos(radians(45))) AS f2 FROM s)
SELECT id, round(degrees(f1), 9) AS south, round(lon + degrees(atan2(sin(radians(225)) * sin(a) * cos(f), cos(a) - sin(f) * sin(f1))), 9) AS west, round(degrees(f2), 9) AS north, round(lon + degrees(atan2(sin(radians(45)) * sin(a) * cos(f), cos(a) - sin(f) * sin(f2))), 9) AS east FROM u""",
}

QUERIES = {name: globals()[name] for name in (*SQL, "coordinate_means", "voronoi_areas")}
