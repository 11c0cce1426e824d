"""Clean tables, window arrays and session fixtures on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_clean(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A clean table as Parquet, or as CSV with a header for readers that have nothing else."""
    writer = df.write.mode("overwrite")
    writer.parquet(f"{path}.parquet") if kind == "parquet" else writer.option("header", True).csv(f"{path}.csv")


def read_clean(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet form of a clean table or, where there is none, its CSV form with the types of schema."""
    try:
        return spark.read.schema(schema).parquet(f"{path}.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.read.schema(schema).option("header", True).csv(f"{path}.csv")


def write_windows(windows: DataFrame, path: str) -> None:
    """Window arrays as compressed Parquet columns; all windows of a column must have one length."""
    arrays = [c for c, t in windows.dtypes if t.startswith("array")]
    sizes = windows.agg(*[F.min(F.size(c)).alias(f"lo_{c}") for c in arrays], *[F.max(F.size(c)).alias(f"hi_{c}") for c in arrays]).first()
    uneven = [c for c in arrays if sizes[f"lo_{c}"] != sizes[f"hi_{c}"]]
    if uneven:
        raise ValueError(f"windows differ in length: {uneven}")
    windows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def fixtures(rows: DataFrame, key: str, order: str, first: int, parts: dict[str, list[str]]) -> DataFrame:
    """key and record (JSON) of the first rows of each session: its index, its time from the session's start, and a struct
    for each of parts, of the columns that it names."""
    w = Window.partitionBy(key).orderBy(order)
    df = rows.withColumn("index", F.row_number().over(w) - 1).withColumn("relative_time_ms", (F.col(order) - F.min(order).over(w)) / 1e6).filter(F.col("index") < first)
    return df.select(key, "index", F.to_json(F.struct("index", "relative_time_ms", *[F.struct(*c).alias(n) for n, c in parts.items()])).alias("record"))
