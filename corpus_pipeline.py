"""The training-corpus pipeline: five stages, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import decontamination, neardup, packing, queries, suffixes, tokens, toxicity, workers
from kinetra.session import durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_CARRY = ("doc_id", "lang", "source", "n_chars")


def _begin(spark: SparkSession) -> None:
    """Executors start each stage without the heap that the one before has left."""
    queries.tuned(spark)
    workers.slim(spark)


def _with_length(before: DataFrame, text: str) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now, where it changed."""
    changed = ~F.col("_before").eqNullSafe(F.length(text))
    return before.select("doc_id", F.col(text).alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the labels of documents in docs."""
    _begin(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, _CARRY).filter(F.col("_toxicity") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id. Rows without doc_id stay."""
    _begin(spark)
    docs = docs.select(*COLUMNS)
    gone = neardup.classes(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur earlier; a document that loses all of its text goes."""
    _begin(spark)
    found = suffixes.deduplicate(docs.select(*COLUMNS).withColumn("_before", F.length("text")), (*_CARRY, "_before"))
    return _with_length(found.filter((F.col("n_removed") == 0) | (F.length("kept") > 0)), "kept")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    _begin(spark)
    docs = docs.select(*COLUMNS).withColumn("_before", F.length("text"))
    return _with_length(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), (*_CARRY, "_before")), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    _begin(spark)
    return packing.pack_documents(docs, tokens.public(queries.TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("suffix-array-dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL can express none of the trained model, the sampling and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
