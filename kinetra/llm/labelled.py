"""Bounded samples of training rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.session import durable

#: At most so many labelled documents fit a classifier: those with the least hash of doc_id.
SAMPLE = 12000


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; -1 for a row without doc_id, which has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def _labels(labels: DataFrame, target: str) -> DataFrame:
    rows = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def _first(rows: DataFrame, sample: int, name: str) -> DataFrame:
    chosen = rows.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample).drop("_h")
    return durable(chosen, name)


def _texts(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """doc_id, text and y: one text (the least) of each document of rows, which are at most a sample and so may be sent out."""
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return durable(found.select("doc_id", "text", "y"), name)


def training(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of at most sample labelled documents that are not held out; one with both labels counts as 1."""
    return _texts(docs, _first(_labels(labels, target).filter(~held_out), sample, f"labels-{target}"), f"labelled-{target}")


def unlabelled(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, sample: int) -> DataFrame:
    """doc_id, text and y (-1) of at most sample documents without a label that are not held out."""
    rows = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out).distinct().join(_labels(labels, target), "doc_id", "left_anti")
    return _texts(docs, _first(rows.withColumn("y", F.lit(-1)), sample, f"unlabelled-{target}"), f"unlabelled-texts-{target}")
