"""Token ids on disk: documents compressed one by one against a shared zstandard dictionary.

A store is a folder of Parquet files whose rows are shards; the payload of a shard is this binary format
(little-endian):

    magic      4 bytes   "KTS1"
    width      1 byte    bytes of an id: 2 or 4
    dictionary 32 bytes  SHA-256 of the dictionary that the documents need
    count      4 bytes   number of documents n
    doc_ids    8n bytes  signed, ascending
    tokens     8(n+1)    ids before each document of the shard, and their sum
    offsets    8(n+1)    place of each document's frame in the part that follows, and its length
    frames               a zstandard frame for each document

so one short document is read by one index lookup and one small frame. The dictionary is a table of its own in the
folder. Parquet only carries the payloads, since it is what Spark writes to and reads from any store.

The dictionary is trained on the driver from at most SAMPLE documents, those with the least hash of doc_id, at most
SAMPLE_BYTES of each one's ids; everything else covers all rows. Documents lie in ascending doc_id order: shards are
ranges of doc_id, at most RANGES of them (at most that many numbers reach the driver); a range becomes one or more
shards of about SHARD_BYTES.

Defined results: a null or empty text is a document with the end id only; rows with equal doc_id lie next to each
other, ordered by their ids; rows without doc_id come first, in shards of their own (NAMELESS ranges by content) that no lookup
finds; an empty table makes a store without shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.llm import tokens
from kinetra.llm.workers import lean

MAGIC = b"KTS1"
END_ID = 2
SAMPLE = 2000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 8 << 20
RANGES = 4096
RANGE_ROWS = 1000
NAMELESS = 64
LEVEL = 3


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for samples; empty if there is too little to train on."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True)


class Shard:
    """Reader of one payload."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.dtype = np.dtype("<u2" if payload[4] == 2 else "<u4")
        if payload[5:37] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        (n,) = struct.unpack_from("<I", payload, 37)
        self.doc_ids = np.frombuffer(payload, "<i8", n, 41)
        self.tokens = np.frombuffer(payload, "<i8", n + 1, 41 + 8 * n)
        self.offsets = np.frombuffer(payload, "<i8", n + 1, 49 + 16 * n)
        self.frames = memoryview(payload)[57 + 24 * n :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        frame = self.frames[self.offsets[k] : self.offsets[k + 1]]
        return np.frombuffer(self.reader.decompress(frame), self.dtype)

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(k) if k < len(self) and self.doc_ids[k] == doc_id else None


def payload(doc_ids: list[int], counts: list[int], frames: list[bytes], dictionary_hash: bytes, width: int) -> bytes:
    sums = lambda x: np.concatenate([[0], np.cumsum(np.array(x, np.int64))]).astype("<i8").tobytes()
    head = MAGIC + bytes([width]) + dictionary_hash + struct.pack("<I", len(doc_ids))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), sums(counts), sums([len(f) for f in frames]), *frames])


def _compressed(path: str, end_id: int, dictionary: bytes, bounds: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = tokens.encoder(path), compressor(dictionary)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            raw = [enc.encode(t or "") + end for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            other = np.array([-1 - zlib.crc32(r) % NAMELESS for r in raw], np.int64)
            part = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "right"), other).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), ids, pa.array([len(r) // enc.dtype.itemsize for r in raw], pa.int64()), pa.array([pack.compress(r) for r in raw], pa.binary())],
                names=["part", "doc_id", "n", "frame"],
            )

    return run


def _shards(dictionary_hash: bytes, width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, counts, frames, size = None, 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([ids[-1]], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([payload([i or 0 for i in ids], counts, frames, dictionary_hash, width)], pa.binary())],
                names=["part", "number", "first_doc", "last_doc", "n_tokens", "payload"],
            )

        for batch in batches:
            for p, i, n, f in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame")), strict=True):
                if ids and (p != part or size + len(f) > SHARD_BYTES):
                    yield shard()
                    number = number + 1 if p == part else 0
                    ids, counts, frames, size = [], [], [], 0
                part = p
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if ids:
            yield shard()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) into a store at path."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id").count()
    ranges = max(1, min(RANGES, -(-rows // RANGE_ROWS)))
    inner = [k / ranges for k in range(1, ranges)]
    bounds = np.array(docs.stat.approxQuantile("doc_id", inner, 0.25 / ranges) if inner else [], np.float64).astype(np.int64)
    enc = tokens.encoder(tokenizer)
    chosen = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(SAMPLE)
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    end = np.array([end_id], enc.dtype).tobytes()
    dictionary = train(sorted(enc.encode(r.text or "") + end for r in sample.toLocalIterator()))
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").write.parquet(f"{path}/dictionary")
    coded = docs.mapInArrow(_compressed(tokenizer, end_id, dictionary, bounds), "part int, doc_id bigint, n bigint, frame binary")
    ordered = coded.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "doc_id", "n", "frame")
    shards = ordered.mapInArrow(_shards(hashlib.sha256(dictionary).digest(), enc.dtype.itemsize), "part int, number int, first_doc bigint, last_doc bigint, n_tokens bigint, payload binary")
    shards.write.parquet(f"{path}/shards")


def _read(dictionary: bytes, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, named, raw in zip(batch.column("before").to_pylist(), batch.column("named").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(raw.as_py(), dictionary)
                wide = [shard.ids(k).astype("<u4").tobytes() for k in range(len(shard))]
                columns = [pa.array(shard.doc_ids) if named else pa.nulls(len(shard), pa.int64()), pa.array(shard.tokens[:-1] + before), pa.array(np.diff(shard.tokens)), pa.array([zlib.crc32(w) for w in wide], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(wide, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    # Totals by range have at most RANGES rows; the window over them and over the few shards of a range is small.
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    index = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("_inner")).join(ranges, "part")
    index = index.select("part", "number", (F.col("_base") + F.col("_inner")).alias("before"))
    placed = shards.select("part", "number", "payload").join(F.broadcast(index), ["part", "number"]).select("before", (F.col("part") >= 0).alias("named"), "payload")
    return placed.mapInArrow(_read(dictionary, with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def lookup(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document: only shards whose range holds it are read, and one frame of them."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    held = spark.read.parquet(f"{path}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("payload")
    for r in held.toLocalIterator():
        found = Shard(bytes(r.payload), dictionary).find(doc_id)
        if found is not None:
            return found
    return None
