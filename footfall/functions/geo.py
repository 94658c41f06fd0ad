"""Plane and local-tangent geometry as column expressions; coordinates are degrees x 1e6 where named ilat, ilon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a millionth of a degree along a meridian, and radians of one. Fixed values.
METRES = 0.1110704
RADIANS = 1.745329e-8


def distance(ilat1: Column, ilon1: Column, ilat2: Column, ilon2: Column) -> Column:
    """Metres between near points, on the plane tangent at the second."""
    dx = METRES * F.cos(ilat2 * RADIANS) * (ilon1 - ilon2)
    dy = METRES * (ilat1 - ilat2)
    return F.sqrt(dx * dx + dy * dy)


def to_plane(ilat: Column, ilon: Column, ilat0: Column, ilon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return METRES * F.cos(ilat0 * RADIANS) * (ilon - ilon0), METRES * (ilat - ilat0)


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of the way from a to b of the point nearest to p, 0 to 1."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    share = F.try_divide((px - ax) * dx + (py - ay) * dy, length)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p to the segment from a to b."""
    t = projection(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), 2) + F.pow(py - (ay + t * (by - ay)), 2))


def orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """1 clockwise, -1 counterclockwise, 0 in line."""
    value = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    return F.signum(value).cast("int")


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Do the open segments ab and cd cross in one inner point?"""
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def _between(px, py, qx, qy, rx, ry) -> Column:
    return rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))


def oriented_crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """How a move from c to d crosses the barrier ab: 1, -1, or 0; a start on the barrier does not count again."""
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    return (
        F.when((o1 != o2) & (o3 != o4), o2)
        .when((o1 == 0) & _between(ax, ay, bx, by, cx, cy), F.lit(0))
        .when((o2 == 0) & _between(ax, ay, bx, by, dx, dy), -o1)
        .when((o3 == 0) & _between(cx, cy, dx, dy, ax, ay), o2)
        .when((o4 == 0) & _between(cx, cy, dx, dy, bx, by), o2)
        .otherwise(F.lit(0))
    )


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Winding test of (x, y) in a closed ring, an array of structs (x, y) whose last point is its first."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )

    def turn(acc: Column, e: Column) -> Column:
        left = (e["bx"] - e["ax"]) * (y - e["ay"]) - (x - e["ax"]) * (e["by"] - e["ay"])
        up = (e["ay"] <= y) & (e["by"] > y) & (left > 0)
        down = (e["ay"] > y) & (e["by"] <= y) & (left < 0)
        return acc + F.when(up, 1).when(down, -1).otherwise(0)

    return F.aggregate(edges, F.lit(0), turn) != 0


def centroid(ring: Column) -> Column:
    """Mean of a ring's vertices."""
    n = F.size(ring)
    return F.struct(
        (F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["x"]) / n).alias("x"),
        (F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["y"]) / n).alias("y"),
    )


def grid_cell(value: Column, low: float, side: float, cells: int) -> Column:
    """Row or column of a grid, kept off its border."""
    return F.greatest(F.lit(1), F.least(F.lit(cells - 2), F.floor((value - low) / side).cast("int")))


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two boxes."""
    width = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    height = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    inter = width * height
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.coalesce(F.try_divide(inter, union), F.lit(0.0))


def to_dms(degrees: Column) -> Column:
    """Degrees, minutes and fractional seconds."""
    size = F.abs(degrees)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    return F.struct(
        (F.signum(degrees) * whole).alias("degrees"),
        minutes.cast("int").alias("minutes"),
        (((size - whole) * 60 - minutes) * 60).alias("seconds"),
    )


def from_dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    sign = F.when(degrees < 0, -1).otherwise(1)
    return sign * (F.abs(degrees) + minutes / 60 + seconds / 3600)


def to_iso6709(lat: Column, lon: Column) -> Column:
    """Signed degrees of a point as one text, ``+44.500000+011.250000/``; six places, widths as the norm has them."""

    def part(x: Column, width: int) -> Column:
        digits = F.lpad(F.format_string("%.6f", F.abs(x).cast("double")), width, "0")
        return F.concat(F.when(x < 0, "-").otherwise("+"), digits)

    return F.concat(part(lat, 9), part(lon, 10), F.lit("/"))


def from_iso6709(text: Column) -> Column:
    """lat and lon in degrees of a point's text whose parts are degrees, degrees and minutes, or with seconds as well.

    How many digits stand before a part's dot says which; what doesn't fit the form is null.
    """

    def part(sign_and_digits: Column, degrees: int) -> Column:
        size = F.regexp_replace(sign_and_digits, "^[+-]", "")
        whole = F.length(F.substring_index(size, ".", 1))
        rest = lambda at: F.substr(size, F.lit(at), F.length(size)).try_cast("double")
        two = lambda at: F.substr(size, F.lit(at), F.lit(2)).try_cast("double")
        head = F.substr(size, F.lit(1), F.lit(degrees)).try_cast("double")
        value = (
            F.when(whole == degrees, size.try_cast("double"))
            .when(whole == degrees + 2, head + rest(degrees + 1) / 60)
            .when(whole == degrees + 4, head + two(degrees + 1) / 60 + rest(degrees + 3) / 3600)
        )
        return F.when(sign_and_digits.startswith("-"), -value).otherwise(value)

    form = r"^([+-][0-9]+(?:[.][0-9]+)?)([+-][0-9]+(?:[.][0-9]+)?)"
    return F.struct(part(F.regexp_extract(text, form, 1), 2).alias("lat"), part(F.regexp_extract(text, form, 2), 3).alias("lon"))
