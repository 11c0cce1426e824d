"""Geodesy as column expressions: no UDFs, so everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra.functions.quaternions import let

#: Mean Earth radius, WGS-84 semi-major axis and first eccentricity squared.
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_E2 = 6.69437999014e-3


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle metres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_range(lat: Column, lon: Column) -> Column:
    """Finite and in range, which NaN is not; null where that depends on a null."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)


def valid(lat: Column, lon: Column) -> Column:
    """Finite and in range; NaN and null are not."""
    return F.coalesce(in_range(lat, lon), F.lit(False))


def ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """struct x, y, z of a WGS-84 position in degrees and metres."""
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(p), 2))
    return F.struct(((n + alt) * F.cos(p) * F.cos(q)).alias("x"), ((n + alt) * F.cos(p) * F.sin(q)).alias("y"), ((n * (1 - WGS84_E2) + alt) * F.sin(p)).alias("z"))


def from_ecef(x: Column, y: Column, z: Column, steps: int = 8) -> Column:
    """struct lat, lon (degrees), alt, by fixed-point steps on the latitude."""
    return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.sqrt(x * x + y * y).alias("p")), lambda v: _geodetic(v["x"], v["y"], v["z"], v["p"], steps))


def _geodetic(x: Column, y: Column, z: Column, p: Column, steps: int) -> Column:
    def step(lat: Column, _: Column) -> Column:
        n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(lat), 2))
        return F.atan2(z + F.lit(WGS84_E2) * n * F.sin(lat), p)

    def placed(lat: Column) -> Column:
        n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(lat), 2))
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(lat) - n).alias("alt"))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, p * (1 - WGS84_E2)), step), placed)


def enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float = 0.0) -> Column:
    """struct e, n, u: the ECEF offset from a reference point turned into its tangent frame."""
    both = F.struct(ecef(lat, lon, alt).alias("a"), ecef(F.lit(lat0), F.lit(lon0), F.lit(alt0)).alias("b"))
    return let(both, lambda p: _turned(p["a"], p["b"], lat0, lon0))


def _turned(here: Column, there: Column, lat0: float, lon0: float) -> Column:
    dx, dy, dz = (here[k] - there[k] for k in "xyz")
    p, q = F.radians(F.lit(lat0)), F.radians(F.lit(lon0))
    return F.struct(
        (-F.sin(q) * dx + F.cos(q) * dy).alias("e"),
        (-F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz).alias("n"),
        (F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz).alias("u"),
    )


def tangent(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """struct e, n by the radii of curvature at a reference point: good near it only."""
    s2 = F.pow(F.sin(F.radians(F.lit(lat0))), 2)
    w = F.sqrt(1 - F.lit(WGS84_E2) * s2)
    prime, meridian = F.lit(WGS84_A) / w, F.lit(WGS84_A * (1 - WGS84_E2)) / F.pow(w, 3)
    return F.struct((F.radians(lon - lon0) * prime * F.cos(F.radians(F.lit(lat0)))).alias("e"), (F.radians(lat - lat0) * meridian).alias("n"))


def tile_key(lat: Column, lon: Column, step: float) -> Column:
    """deg:{1/step}:{row}:{column} of the square tile that holds a point."""
    per = round(1 / step)
    return F.concat_ws(":", F.lit("deg"), F.lit(str(per)), F.floor(lat * per).cast("string"), F.floor(lon * per).cast("string"))


def tile_bounds(key: Column) -> Column:
    """struct min_lat, max_lat, min_lon, max_lon of a tile key."""
    part = lambda k: F.element_at(F.split(key, ":"), k).cast("double")
    return F.struct((part(3) / part(2)).alias("min_lat"), ((part(3) + 1) / part(2)).alias("max_lat"), (part(4) / part(2)).alias("min_lon"), ((part(4) + 1) / part(2)).alias("max_lon"))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct distance, fraction: the nearest point of a segment to a point."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return let(t, lambda t: F.struct(F.sqrt(F.pow(px - ax - t * (bx - ax), 2) + F.pow(py - ay - t * (by - ay), 2)).alias("distance"), t.alias("fraction")))


def polyline_length(points: Column) -> Column:
    """Length of an array of struct x, y."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def nearest_on_polyline(px: Column, py: Column, points: Column) -> Column:
    """struct distance, along: the first closest point of an array of struct x, y and its distance from the start."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    legs = F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    zero = F.struct(F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("along"), F.lit(0.0).alias("done"))

    def step(s: Column, leg: Column) -> Column:
        p, q = leg["p"], leg["q"]
        size = F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))

        def nearer(near: Column) -> Column:
            closer = near["distance"] < s["distance"]
            return F.struct(F.when(closer, near["distance"]).otherwise(s["distance"]).alias("distance"), F.when(closer, s["done"] + near["fraction"] * size).otherwise(s["along"]).alias("along"), (s["done"] + size).alias("done"))

        return let(point_segment(px, py, p["x"], p["y"], q["x"], q["y"]), nearer)

    found = F.aggregate(legs, zero, step)
    return F.struct(found["distance"].alias("distance"), found["along"].alias("along"))
