"""Map-matching likelihoods and measurement models as column expressions.

Angles are in radians counter-clockwise from east unless a name says course (clockwise from north).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra.functions.angles import difference
from kinetra.functions.scalars import gaussian_log_likelihood, mahalanobis2


def position_log_likelihood(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column, floor: float) -> Column:
    """Of an offset under a 2x2 covariance whose variances are at least floor^2; null if that is singular."""
    a, c = F.greatest(sxx, F.lit(floor**2)), F.greatest(syy, F.lit(floor**2))
    det = a * c - sxy * sxy
    return -0.5 * mahalanobis2(dx, dy, a, sxy, c) - math.log(2 * math.pi) - 0.5 * F.log(F.when(det > 0, det))


def heading_log_likelihood(vx: Column, vy: Column, variance: Column, road: Column, least_speed: float, floor: float) -> Column:
    """Of a road's heading given that of motion; 0 below least_speed, where motion has no usable heading."""
    sigma = F.greatest(F.lit(floor), F.sqrt(F.greatest(variance, F.lit(0.0))))
    score = gaussian_log_likelihood(difference(F.atan2(vy, vx), road, 2 * math.pi), sigma)
    return F.when(F.sqrt(vx * vx + vy * vy) >= least_speed, score).otherwise(F.lit(0.0))


def speed_limit_log_likelihood(speed: Column, limit: Column, tolerance: float, sigma: float, weight: float) -> Column:
    """A weak penalty for speed over a tagged limit and tolerance; 0 where there is no tag."""
    over = F.greatest(F.lit(0.0), speed - limit - tolerance)
    return F.coalesce(-0.5 * weight * F.pow(over / sigma, 2), F.lit(0.0))


def transition_log_likelihood(route: Column, moved: Column, sigma: Column, longest: float, slack: float) -> Column:
    """Of a route's length given the displacement; minus infinity if there is none within the bound of the search."""
    bound = F.least(F.lit(longest), moved + slack + 3 * sigma)
    return F.when(route <= bound, gaussian_log_likelihood(route - moved, sigma)).otherwise(F.lit(-math.inf))


def gnss_velocity(speed: Column, course: Column, speed_sigma: Column, course_sigma: Column) -> Column:
    """Velocity of speed and course over ground with its covariance: struct ve, vn, see, sen, snn.

    A course error is a cross-track speed error, speed times its deviation. Null unless all are usable.
    """
    e, n = F.sin(course), F.cos(course)
    along, cross = speed_sigma * speed_sigma, F.greatest(F.lit(1e-6), F.pow(F.greatest(speed, F.lit(0.1)) * course_sigma, 2))
    found = F.struct((speed * e).alias("ve"), (speed * n).alias("vn"), (along * e * e + cross * n * n).alias("see"), ((along - cross) * e * n).alias("sen"), (along * n * n + cross * e * e).alias("snn"))
    return F.when((speed >= 0) & (speed_sigma > 0) & (course_sigma > 0) & course.isNotNull(), found)


def forward_speed(ve: Column, vn: Column, heading: Column, observed: Column) -> Column:
    """Innovation of a speed along the vehicle's axis."""
    return observed - (ve * F.cos(heading) + vn * F.sin(heading))


def lateral_speed(ve: Column, vn: Column, heading: Column) -> Column:
    """Innovation of the non-holonomic constraint: no speed across the vehicle's axis."""
    return vn * -F.cos(heading) + ve * F.sin(heading)


def constraint_sigma(base: float, yaw_rate: Column, confidence: Column, soft_rate: float) -> Column:
    """Deviation of the non-holonomic constraint: wider in turns and where calibration is weak."""
    return base * (1 + F.pow(F.abs(yaw_rate) / max(soft_rate, 1e-6), 2)) / F.greatest(confidence, F.lit(1e-3))


def polyline_offset(dx: Column, dy: Column, road: Column) -> Column:
    """Innovation of a soft road constraint: the offset across a road of that heading."""
    return dy * F.cos(road) - dx * F.sin(road)


def scalar_gate(innovation: Column, variance: Column, sigma: Column, gate: float) -> Column:
    """Whether a scalar measurement passes a gate on its normalised innovation squared."""
    return innovation * innovation / (variance + sigma * sigma) <= gate


def scalar_update(x: Column, innovation: Column, variance: Column, sigma: Column) -> Column:
    """A Kalman update of a scalar state: struct value, variance (Joseph form)."""
    k = variance / (variance + sigma * sigma)
    return F.struct((x + k * innovation).alias("value"), (F.pow(1 - k, 2) * variance + k * k * sigma * sigma).alias("variance"))
