"""Contracts as assertion queries: each returns the rows that break it, none if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strictly_increasing(df: DataFrame, key: list[str], order: list[str], t: str) -> DataFrame:
    return df.withColumn("_p", F.lag(t).over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_p") >= F.col(t)).drop("_p")


def at_least(df: DataFrame, key: list[str], n: int) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") < n)


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def each_once(rows: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that covered does not hold exactly once, and keys it should not hold."""
    n = covered.groupBy(*key).agg(F.count("*").alias("times"))
    return rows.select(*key).join(n, key, "full_outer").filter(F.coalesce("times", F.lit(0)) != 1)


def conserved(audit: DataFrame, total: str, parts: list[str]) -> DataFrame:
    return audit.filter(sum((F.col(p) for p in parts), F.lit(0)) != F.col(total))


def sums_to_one(df: DataFrame, key: list[str], p: str, slack: float = 1e-6) -> DataFrame:
    return df.groupBy(*key).agg(F.sum(p).alias("mass")).filter(F.abs(F.col("mass") - 1) > slack)


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns (quantiles) are null, not finite, or cross."""
    bad = F.lit(False)
    for a, b in zip(columns, columns[1:], strict=False):
        bad = bad | (F.col(a) > F.col(b))
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return df.filter(bad)


def breaking(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule (null counts as broken), with the names of the rules they break."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", names).filter(F.size("broken") > 0)


def same_columns(df: DataFrame, names: list[str]) -> None:
    if df.columns != names:
        raise ValueError(f"columns {df.columns}, not {names}")
