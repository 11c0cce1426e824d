"""Folds on streams: the same state machines as in batch, by transformWithState.

Rows of a key are kept in state until the watermark has passed them; a timer then releases them in the fold's order. So
neither the order of files nor the cut into micro-batches changes the result, and no row is lost that is not later than
the watermark allows (`late`; files in no order need one longer than the span of the data) and later than 1970. A marker row at CLOSING ends a
bounded stream: it moves the watermark past everything, the rest is released and the fold finishes.

The fold's state is one JSON value a key. Classes travel to Python workers by value, since the runner that Spark starts on
the driver for such queries does not see the files that were added to the session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

import kinetra.operators.folds
from kinetra.operators.folds import Fold
from kinetra.session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the marker row (nanoseconds must hold it), and the time in milliseconds, that of 2200, from which on a stream has ended.
CLOSING = "2262-01-01 00:00:00"
END_MS = 7_258_118_400_000


class FoldProcessor(StatefulProcessor):
    """Rows carry `stream_ms`, their event time in milliseconds (rounded up), and `stream_end`, whether they are the marker."""

    def __init__(self, fold: Fold, key: str, order: list[str], names: list[str], end_ms: int):
        self.fold, self.key, self.order, self.names, self.end_ms = fold, key, order, names, end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = StructType([StructField("json", StringType())])
        self.handle = handle
        self.state = handle.getValueState("fold", one)
        self.waiting = handle.getListState("waiting", one)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [r for pdf in rows for r in pdf[~pdf["stream_end"]].drop(columns=["stream_end", "stream_ts"]).to_dict("records")]
        if found:
            self.waiting.appendList([(json.dumps({c: _plain(x) for c, x in r.items()}),) for r in found])
            self.handle.registerTimer(min(int(r["stream_ms"]) for r in found) + 1)
            self.handle.registerTimer(self.end_ms)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [json.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r["stream_ms"] < now), key=lambda r: [r[c] for c in self.order])
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.initial()
        out = []
        if due:
            left = [r for r in held if r["stream_ms"] >= now]
            state, out = self.fold.rows(state, iter(due))
            if left:
                self.waiting.put([(json.dumps(r),) for r in left])
                self.handle.registerTimer(min(r["stream_ms"] for r in left) + 1)
            else:
                self.waiting.clear()
            self.state.update((json.dumps(state),))
        if expiredTimerInfo.getExpiryTimeInMs() == self.end_ms:
            out += self.fold.finish(state)
            self.state.clear()
        yield pd.DataFrame([(key[0], *o) for o in out], columns=self.names)

    def close(self) -> None:
        pass


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def folded(stream: DataFrame, fold: Fold, key: str, order: list[str], ts: str, late: str = "300 days") -> DataFrame:
    """The fold's outputs for each key of all that a stream's source holds now: run to the end, closed, and read back.

    ts: the column of event time; late: how far behind the latest event time a row may come.
    """
    import kinetra.streaming.stateful as own

    for module in (kinetra.operators.folds, own):
        cloudpickle.register_pickle_by_value(module)
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    kind = dict(stream.dtypes)[key]
    names = [key, *[c.strip().split(" ")[0] for c in fold.schema.split(",")]]
    columns = list(dict.fromkeys([key, *order, *fold.columns]))
    # In nanoseconds rounded up: a row is released when the watermark is past all of its millisecond.
    ms = F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")
    rows = stream.select(*columns, F.col(ts).cast("timestamp").alias("stream_ts"), ms.alias("stream_ms"), F.lit(False).alias("stream_end"))
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/closing")
    closing = spark.readStream.schema(rows.schema).parquet(f"{path}/closing")
    timed = rows.unionByName(closing).withWatermark("stream_ts", late)
    processor = FoldProcessor(fold, key, order, names, END_MS)
    out = timed.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {fold.schema}", "Append", "EventTime")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for last in (False, True):
            if last:
                marker = spark.range(1).select(F.lit(CLOSING).cast("timestamp").alias("stream_ts"), F.lit(True).alias("stream_end"))
                marker.select(*[F.col(c) if c in ("stream_ts", "stream_end") else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).write.mode("append").parquet(f"{path}/closing")
            query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(out.schema).parquet(f"{path}/out")
