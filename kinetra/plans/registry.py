"""Registration of queries: a name, a function of (spark, sf_dir), and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def query(sql: str | None = None):
    """Register the function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("$EV", EV).replace("$HOUR", str(HOUR)).replace("$DAY", str(DAY))
        return f

    return add


#: events as a sensor stream: t in nanoseconds of session time, k from the properties.
EV = "ev AS (SELECT event_id, epoch_us(ts) * 1000 AS t, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", (micros * 1000).alias("t"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


KEY, ORDER = ["user_id"], ["t", "event_id"]
