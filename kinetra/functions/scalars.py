"""Likelihoods, schedules, text and tag parsing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_log_likelihood(residual: Column, sigma: Column) -> Column:
    return -0.5 * F.pow(residual / sigma, 2) - F.log(sigma) - 0.5 * math.log(2 * math.pi)


def mahalanobis2(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Squared distance of an offset under a 2x2 covariance; null if that is singular."""
    det = sxx * syy - sxy * sxy
    return (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / F.when(det > 0, det)


def largest_eigenvalue(sxx: Column, sxy: Column, syy: Column) -> Column:
    return (sxx + syy) / 2 + F.sqrt(F.pow((sxx - syy) / 2, 2) + sxy * sxy)


def schedule(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through knots (ascending), flat beyond both ends."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def category(text: Column) -> Column:
    """Trimmed, lower case; blank or null becomes <unknown>."""
    return F.coalesce(F.nullif(F.lower(F.trim(text)), F.lit("")), F.lit("<unknown>"))


def camel_case(text: Column) -> Column:
    """snake_case to camelCase."""
    parts = F.split(text, "_")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "\\s+", " "))


def max_speed(tag: Column) -> Column:
    """Metres a second of an OSM maxspeed tag: km/h, or mph where it says so; null if it is no number."""
    number = F.regexp_extract(tag, "^\\s*([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.lower(tag).contains("mph"), number * 0.44704).otherwise(number / 3.6)


def one_way(tag: Column, junction: Column) -> Column:
    """forward, reverse or both."""
    tag = F.lower(F.trim(tag))
    return F.when(tag.isin("-1", "reverse"), "reverse").when(tag.isin("yes", "true", "1") | (junction == "roundabout"), "forward").otherwise("both")


def digitize(x: Column, edges: list[float]) -> Column:
    """How many edges are at most x: bins are half open, [a, b)."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: infinite over zero by both signs, NaN for zero over zero."""
    less = (a < 0) != b.cast("string").startswith("-")
    over_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(less, float("-inf")).when(~less, float("inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    """ln x as IEEE has it: minus infinity at zero, NaN below."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))
