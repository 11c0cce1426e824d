"""Window features, filters, means of rotations, and calibration evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape_features(window: Column) -> Column:
    """struct mean, std, low, high, rms, iqr, crossings of an array: higher-order functions in the JVM."""
    n = F.size(window)
    total = lambda f: F.aggregate(window, F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / n
    s = F.sort_array(window)

    def quantile(p: float) -> Column:
        at = (n - 1) * p
        low = F.element_at(s, F.floor(at).cast("int") + 1)
        high = F.element_at(s, F.ceil(at).cast("int") + 1)
        return low + (high - low) * (at - F.floor(at))

    pairs = F.zip_with(F.slice(window, F.lit(1), n - 1), F.slice(window, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.size(F.filter(pairs, lambda p: (p["a"] >= 0) != (p["b"] >= 0)))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(total(lambda x: x * x) / n - mean * mean, F.lit(0.0))).alias("std"), F.array_min(window).alias("low"), F.array_max(window).alias("high"), F.sqrt(total(lambda x: x * x) / n).alias("rms"), (quantile(0.75) - quantile(0.25)).alias("iqr"), (crossed / F.greatest(n - 1, F.lit(1))).alias("crossings"))


def allowed(df: DataFrame, keys: list[str], names: list[str], target: str) -> DataFrame:
    """keys and the allowed features in order; the target among them, or a feature that df lacks, is an error."""
    if target in names or target in keys:
        raise ValueError(f"the target {target} is no feature")
    lost = [c for c in names if c not in df.columns]
    if lost:
        raise ValueError(f"features are missing: {lost}")
    return df.select(*keys, *names)


#: Names of shape_features, in order.
SHAPES = ("mean", "std", "low", "high", "rms", "iqr", "crossings")


def _magnitude(axes: list[str]) -> Column:
    return F.transform(F.arrays_zip(*axes), lambda r: F.sqrt(sum((r[a] * r[a] for a in axes), F.lit(0.0))))


def window_features(df: DataFrame, windows: dict[str, str], triples: dict[str, list[str]]) -> DataFrame:
    """df with <name>_<shape> for each window column, and for each triple of axes the mean and deviation of its magnitude.

    windows: name and array column; triples: name and the array columns of its axes. All in the JVM.
    """
    for name, column in windows.items():
        df = df.withColumn("_f", shape_features(F.col(column))).select("*", *[F.col(f"_f.{s}").alias(f"{name}_{s}") for s in SHAPES]).drop("_f")
    for name, axes in triples.items():
        df = df.withColumn("_f", shape_features(_magnitude(axes))).select("*", F.col("_f.mean").alias(f"{name}_mean"), F.col("_f.std").alias(f"{name}_std")).drop("_f")
    return df


def low_frequency_share(window: Column, rate: float, below: float) -> Column:
    """Share of a window's power (less its mean) at or below a frequency: a Fourier transform, hence a vectorised UDF."""

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                x = np.asarray(x, float)
                power = np.abs(np.fft.rfft(x - x.mean())) ** 2
                total = power[1:].sum()
                out.append(float(power[1:][np.fft.rfftfreq(len(x), 1 / rate)[1:] <= below].sum() / total) if total > 1e-12 else 0.0)
            yield pd.Series(out)

    return share(window)


def mean_rotation(df: DataFrame, key: list[str], q: str, weight: str, order: list[str]) -> DataFrame:
    """Weighted mean quaternion of each key; signs are aligned to the first in order. Partial sums, no Python."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, F.col(q).alias("_q")))["_q"].alias("_first"))
    j = df.join(first, key)
    dot = sum((F.col(f"{q}.{k}") * F.col(f"_first.{k}") for k in "wxyz"), F.lit(0.0))
    sign = F.when(dot < 0, -F.col(weight)).otherwise(F.col(weight))
    sums = j.groupBy(*key).agg(*[F.sum(sign * F.col(f"{q}.{k}")).alias(k) for k in "wxyz"])
    n = F.sqrt(sum((F.col(k) * F.col(k) for k in "wxyz"), F.lit(0.0)))
    return sums.select(*key, F.struct(*[(F.col(k) / n).alias(k) for k in "wxyz"]).alias(q))


def low_pass(x: np.ndarray, rate: float, cut: float) -> np.ndarray:
    """Zero-phase second-order Butterworth: forward and backward, ends mirrored. Not causal, so for offline use only."""
    c = 1 / np.tan(np.pi * cut / rate)
    b = np.array([1.0, 2.0, 1.0]) / (1 + np.sqrt(2) * c + c * c)
    a = np.array([1.0, 2 * (1 - c * c), 1 - np.sqrt(2) * c + c * c]) / np.array([1.0, *[1 + np.sqrt(2) * c + c * c] * 2])
    pad = min(9, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        out = np.empty_like(y)
        z1 = z2 = 0.0
        z1, z2 = y[0] * (1 - b[0]), y[0] * (b[2] - a[2])
        for i, v in enumerate(y):
            out[i] = b[0] * v + z1
            z1 = b[1] * v - a[1] * out[i] + z2
            z2 = b[2] * v - a[2] * out[i]
        y = out[::-1]
    return y[pad : pad + len(x)]


def filtered(df: DataFrame, key: str, order: list[str], value: str, rate: float, cut: float, id_: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({id_: pdf[id_].to_numpy(), "smooth": low_pass(pdf[value].to_numpy(float), rate, cut) if len(pdf) > 2 else pdf[value].to_numpy(float)})

    return df.select(*dict.fromkeys([key, *order, value, id_])).groupBy(key).applyInPandas(run, f"{id_} bigint, smooth double")


def soft_pull(offset: Column, heading: Column, gain: float, width: float) -> Column:
    """How far a position moves towards a road: nothing beyond width or against its heading, less for a poor heading."""
    w = F.when((F.abs(offset) <= width) & (F.cos(heading) > 0), gain * F.cos(heading) * (1 - F.abs(offset) / width)).otherwise(F.lit(0.0))
    return offset * w
