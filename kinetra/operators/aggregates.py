"""Aggregates: metrics, grouped and weighted quantiles, ranks and weights.

Sums, counts and moments combine before the shuffle. Exact quantiles need a group's values in order: they keep the distinct
values of a group with their counts, in one buffer (percentile) or one sorted window, which grows with those values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles_with_fallback(df: DataFrame, group: str, value: str, probabilities: list[float], least: int = 1) -> DataFrame:
    """Linear quantiles of each group; groups of fewer than least rows get those of all rows. One pass by grouping sets."""
    p = F.array(*[F.lit(x) for x in probabilities])
    both = df.withColumn("_g", F.explode(F.array(F.lit(False), F.lit(True)))).groupBy("_g", F.when(~F.col("_g"), F.col(group)).alias(group)).agg(F.percentile(value, p).alias("q"), F.count("*").alias("n"))
    all_ = both.filter("_g").select(F.col("q").alias("_all"))
    own = both.filter("not _g").join(F.broadcast(all_))  # one row
    return own.select(group, "n", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("_all")).alias("q"))


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, probabilities: list[float]) -> DataFrame:
    """group, p, quantile: midpoint cumulative weights (cum - w/2) / total, interpolated and clamped at the ends.

    Equal values are summed first, so a window sees distinct values of a group only.
    """
    sums = df.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*group).orderBy(value)
    sums = sums.withColumn("_at", (F.sum("_w").over(w) - F.col("_w") / 2) / F.sum("_w").over(Window.partitionBy(*group)))
    sums = sums.withColumns({"_at1": F.lead("_at").over(w), "_v1": F.lead(value).over(w), "_n": F.row_number().over(w)})
    grid = sums.withColumn("p", F.explode(F.array(*[F.lit(x) for x in probabilities])))
    low = (F.col("_n") == 1) & (F.col("p") <= F.col("_at"))
    high = F.col("_at1").isNull() & (F.col("p") > F.col("_at"))
    inside = (F.col("p") > F.col("_at")) & (F.col("p") <= F.col("_at1"))
    moved = F.col(value) + (F.col("_v1") - F.col(value)) * (F.col("p") - F.col("_at")) / (F.col("_at1") - F.col("_at"))
    found = grid.filter(low | high | inside)
    return found.select(*group, "p", F.when(inside, moved).otherwise(F.col(value)).alias("quantile"))


def nearest_rank(df: DataFrame, group: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """group, n and the sorted value at index floor(n p) for each p, as columns p50, p95, ...: not interpolated."""
    w = Window.partitionBy(*group).orderBy(value)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*group))})
    pick = lambda p: F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value)))
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[pick(p).alias(f"p{round(100 * p)}") for p in probabilities])


def regression_metrics(df: DataFrame, group: list[str], actual: str, predicted: str) -> DataFrame:
    """n, mae, rmse, r2 (1 - SSE / SST; null below two rows or without spread), worst."""
    e = F.col(predicted) - F.col(actual)
    n, sst = F.count(actual), F.var_pop(actual) * F.count(actual)
    return df.groupBy(*group).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when((n >= 2) & (sst > 0), 1 - F.sum(e * e) / sst).alias("r2"), F.max(F.abs(e)).alias("worst"),
    )


def macro(df: DataFrame, inner: list[str], outer: list[str], measure: Column, name: str) -> DataFrame:
    """Mean over inner groups of the mean within each."""
    means = df.groupBy(*outer, *inner).agg(F.avg(measure).alias("_m"))
    return means.groupBy(*outer).agg(F.avg("_m").alias(name), F.count("*").alias("groups"))


def pinball(actual: Column, predicted: Column, p: float) -> Column:
    return F.greatest((actual - predicted) * p, (actual - predicted) * (p - 1))


def normalised_entropy(p: str) -> Column:
    """Entropy of a distribution over a group's rows by its greatest value; 0 for a single row."""
    raw = F.sum(F.when(F.col(p) > 0, -F.col(p) * F.ln(p)).otherwise(0.0))
    return F.when(F.count("*") > 1, raw / F.ln(F.count("*"))).otherwise(F.lit(0.0))


def softmax(df: DataFrame, key: list[str], score: str, name: str = "posterior") -> DataFrame:
    w = Window.partitionBy(*key)
    df = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return df.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def mixture(df: DataFrame, key: list[str], p: str, mean: str, variance: str, floor: float = 0.0) -> DataFrame:
    """mean and variance of a mixture by the law of total variance, in one pass."""
    pm = F.sum(F.col(p) * F.col(mean)) / F.sum(p)
    second = F.sum(F.col(p) * (F.col(variance) + F.col(mean) * F.col(mean))) / F.sum(p)
    return df.groupBy(*key).agg(pm.alias("mean"), F.greatest(second - pm * pm, F.lit(floor)).alias("variance"))


def audit(df: DataFrame, key: list[str], disposition: str, kinds: list[str]) -> DataFrame:
    """total and the count of each disposition in fixed columns; the parts conserve the total."""
    return df.groupBy(*key).agg(F.count("*").alias("total"), *[F.count_if(F.col(disposition) == k).alias(k) for k in kinds])


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules], F.lit(otherwise))
    return out


def balanced_weights(df: DataFrame, group: list[str], strata: list[str], low: float, high: float) -> DataFrame:
    """weight: inverse frequency of a row's stratum in its group, made mean 1, clipped."""
    count = F.count("*").over(Window.partitionBy(*group, *strata))
    df = df.withColumn("_w", 1 / count)
    df = df.withColumn("_w", F.col("_w") / F.avg("_w").over(Window.partitionBy(*group)))
    return df.withColumn("weight", F.greatest(F.lit(low), F.least(F.lit(high), F.col("_w")))).drop("_w")


def top(df: DataFrame, key: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each key under a total order, with their rank from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).filter(F.col(name) < k)
