"""Operators on raw sensor rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard gravity, and the units that each kind of sensor may report.
STANDARD_GRAVITY = 9.80665
UNITS = {"accelerometer": {"m/s^2": 1.0, "g": STANDARD_GRAVITY}, "gyroscope": {"rad/s": 1.0, "deg/s": math.pi / 180}}


def to_si(value: Column, kind: Column, unit: Column) -> Column:
    """value in SI units; a unit that the kind of sensor cannot have is an error."""
    out = None
    for k, units in UNITS.items():
        for u, factor in units.items():
            hit = (kind == k) & (unit == u)
            out = F.when(hit, value * factor) if out is None else out.when(hit, value * factor)
    return out.otherwise(F.raise_error(F.concat(F.lit("unit "), F.coalesce(unit, F.lit("null")), F.lit(" of "), F.coalesce(kind, F.lit("null")))).cast("double"))


def stationary(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, least: int, mean: tuple[float, float], variance: float, top: float) -> DataFrame:
    """n and still: whether the newest rows are calm (mean in range, small variance, no large value)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    df = df.withColumn("n", F.count("*").over(w))
    calm = F.avg(value).over(w).between(*mean) & (F.var_pop(value).over(w) < variance) & (F.max(F.abs(F.col(value))).over(w) < top)
    return df.withColumn("still", (F.col("n") >= least) & calm)


#: Flags of a fix that make it unusable for each purpose.
_TIME = ("timestamp_invalid", "timestamp_regression")
_SPEED = ("speed_unavailable", "speed_invalid", "speed_accuracy_unavailable", "speed_accuracy_invalid", "speed_accuracy_too_large")
_COURSE = ("course_unavailable", "course_invalid", "course_accuracy_unavailable", "course_accuracy_invalid", "course_accuracy_too_large", "course_speed_too_low")
_POSITION = ("position_nonfinite", "latitude_out_of_range", "longitude_out_of_range", "horizontal_accuracy_unavailable", "horizontal_accuracy_invalid", "horizontal_accuracy_too_large")
REJECTS = {"position": (*_TIME, *_POSITION), "speed": (*_TIME, *_SPEED), "course": (*_TIME, *_SPEED, *_COURSE)}


def gnss_quality(fixes: DataFrame, key: list[str], arrival: list[str], gap: int, accuracy: float, speed_accuracy: float, course_speed: float, course_accuracy: float) -> DataFrame:
    """fixes with interval (since the latest earlier time), flags, and whether position, speed and course are usable.

    Columns t, lat, lon, accuracy, speed, speed_accuracy, course, course_accuracy. Time may only advance in order of
    arrival; a gap is flagged and rejects nothing.
    """
    w = Window.partitionBy(*key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("t") >= 0, F.col("t"))).over(w)
    df = fixes.withColumn("_latest", latest).withColumn("interval", F.when((F.col("t") >= 0) & (F.col("t") > F.col("_latest")), F.col("t") - F.col("_latest")))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    c = F.col
    both = finite(c("lat")) & finite(c("lon"))

    def given(name: str, column: str, valid: Column, most: float | None = None) -> dict[str, Column]:
        out = {f"{name}_unavailable": c(column).isNull(), f"{name}_invalid": ~(finite(c(column)) & valid)}
        return out if most is None else {**out, f"{name}_too_large": finite(c(column)) & valid & (c(column) > most)}

    flags = {"timestamp_invalid": c("t") < 0, "timestamp_regression": (c("t") >= 0) & (c("t") <= c("_latest")), "gnss_gap": c("interval") > gap}
    flags |= {"position_nonfinite": ~both, "latitude_out_of_range": both & (F.abs(c("lat")) > 90), "longitude_out_of_range": both & (F.abs(c("lon")) > 180)}
    flags |= given("horizontal_accuracy", "accuracy", c("accuracy") >= 0, accuracy) | given("speed", "speed", c("speed") >= 0) | given("speed_accuracy", "speed_accuracy", c("speed_accuracy") >= 0, speed_accuracy)
    flags |= given("course", "course", (c("course") >= 0) & (c("course") < 2 * math.pi)) | given("course_accuracy", "course_accuracy", c("course_accuracy") >= 0, course_accuracy)
    flags["course_speed_too_low"] = finite(c("speed")) & (c("speed") < course_speed)
    df = df.withColumn("flags", F.array_compact(F.array(*[F.when(held, F.lit(name)) for name, held in flags.items()]))).drop("_latest")
    return df.withColumns({f"{use}_usable": ~F.arrays_overlap("flags", F.array(*map(F.lit, bad))) for use, bad in REJECTS.items()})
