"""Quaternions as structs w, x, y, z; vectors as structs x, y, z. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; without it each use would repeat the value's whole expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def norm(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def unit(q: Column) -> Column:
    """q over its length; null for a zero quaternion."""

    def scaled(q: Column) -> Column:
        n = F.nullif(F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]), F.lit(0.0))
        return quaternion(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n)

    return let(q, scaled)


def multiply(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _product(p["a"], p["b"]))


def _product(a: Column, b: Column) -> Column:
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q: v + 2 w (u x v) + 2 u x (u x v)."""
    return let(F.struct(q.alias("q"), v.alias("v")), lambda p: _rotated(p["q"], p["v"]))


def _rotated(q: Column, v: Column) -> Column:
    cx, cy, cz = q["y"] * v["z"] - q["z"] * v["y"], q["z"] * v["x"] - q["x"] * v["z"], q["x"] * v["y"] - q["y"] * v["x"]
    return vector(
        v["x"] + 2 * (q["w"] * cx + q["y"] * cz - q["z"] * cy),
        v["y"] + 2 * (q["w"] * cy + q["z"] * cx - q["x"] * cz),
        v["z"] + 2 * (q["w"] * cz + q["x"] * cy - q["y"] * cx),
    )


def from_rotation(v: Column) -> Column:
    """The quaternion of a rotation vector; a first-order form near zero."""
    return let(v, _from_rotation)


def _from_rotation(v: Column) -> Column:
    angle = norm(v)
    k = F.when(angle > 1e-12, F.sin(angle / 2) / angle).otherwise(F.lit(0.5))
    return quaternion(F.cos(angle / 2), v["x"] * k, v["y"] * k, v["z"] * k)


def propagate(q: Column, rate: Column, seconds: Column) -> Column:
    """q after turning at a body rate for some time."""
    return unit(multiply(q, from_rotation(vector(rate["x"] * seconds, rate["y"] * seconds, rate["z"] * seconds))))


def distance(a: Column, b: Column) -> Column:
    """The angle of the rotation between unit quaternions; q and -q are the same."""
    dot = let(F.struct(a.alias("a"), b.alias("b")), lambda p: _dot(p["a"], p["b"]))
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot)))


def _dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def slerp(a: Column, b: Column, t: Column, linear_above: float = 0.9995) -> Column:
    """Between a and b along the shorter arc; linear, then made unit, where they nearly agree."""

    def weighed(p: Column) -> Column:
        near, angle = F.abs(p["dot"]) > linear_above, F.acos(F.least(F.lit(1.0), F.abs(p["dot"])))
        sign = F.when(p["dot"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        wa = F.when(near, 1 - p["t"]).otherwise(F.sin((1 - p["t"]) * angle) / F.sin(angle))
        wb = F.when(near, p["t"]).otherwise(F.sin(p["t"] * angle) / F.sin(angle)) * sign
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), wa.alias("wa"), wb.alias("wb"))

    pair = let(F.struct(a.alias("a"), b.alias("b"), t.alias("t")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["t"].alias("t"), _dot(p["a"], p["b"]).alias("dot")))
    return unit(let(let(pair, weighed), lambda p: quaternion(*(p["wa"] * p["a"][k] + p["wb"] * p["b"][k] for k in "wxyz"))))


def remove_gravity(q: Column, force: Column, gravity: float = 9.80665) -> Column:
    """Linear acceleration in the body frame: measured specific force less the turned-back reaction to gravity."""
    up = rotate(conjugate(q), vector(F.lit(0.0), F.lit(0.0), F.lit(gravity)))
    return let(F.struct(force.alias("f"), up.alias("u")), lambda p: vector(*(p["f"][k] - p["u"][k] for k in "xyz")))
