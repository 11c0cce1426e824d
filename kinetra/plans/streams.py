"""Streaming queries over the events files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.operators import folds
from kinetra.plans.registry import HOUR, ORACLE_SQL, ORDER, query
from kinetra.plans import sequential  # noqa: F401  (its SQL is that of the batch form)
from kinetra.streaming import sources, stateful


def _timed(stream):
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return stream.select("event_id", (micros * 1000).alias("t"), "ts", "user_id", "event_type", "value")


@query(ORACLE_SQL["w3_cadence_sampling"])
def st_cadence_stream(spark, d):
    """The cadence fold on a stream: the same rows as in batch."""
    return stateful.folded(_timed(sources.event_stream(spark, d)), folds.Cadence(24 * HOUR), "user_id", ORDER, "ts")


@query()
def st_pairing_stream(spark, d):
    """One-to-one pairing of two streams with bounded skew."""
    return stateful.folded(_timed(sources.event_stream(spark, d)), folds.Pairing(12 * HOUR, "view", "click"), "user_id", ORDER, "ts")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT start, event_type, n, total FROM w, m WHERE start + INTERVAL 1 DAY <= mark""")
def st_windowed_counts(spark, d):
    """Daily windows that the watermark has passed when the source is drained."""
    out = sources.drain(sources.windowed_counts(sources.event_stream(spark, d), "ts", "1 day", "1 hour", ["event_type"]))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
