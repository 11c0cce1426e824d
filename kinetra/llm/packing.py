"""Best-two-fit packing of token pieces into sequences of bounded length.

Pieces are cut from documents (ids and an end id; only longer documents are cut). The plan is made from the number of
pieces of each length, which is bounded by the sequence length whatever the corpus: a bin is filled greedily, largest
fitting piece first; then its smallest piece is replaced by two unpacked pieces when they fill the gap it leaves more
tightly. The pattern of lengths found so is repeated as often as the counts allow, so each pattern uses up a length
and there are at most as many patterns as lengths. Pieces are numbered within their length in hashed parts (no task
gets a whole length) and look up their pattern, copy and place by that number.

Defined results: a null text is empty; an empty text is one piece with the end id only; equal pieces are
interchangeable; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm import tokens
from kinetra.llm.workers import lean
from kinetra.session import durable

CAPACITY = 4096
END_ID = 1
PARTS = 256


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences): best-two-fit over counts of lengths."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    out = []

    def drop(n: int) -> None:
        sizes.pop(bisect_right(sizes, n) - 1)

    while sizes:
        used: dict[int, int] = {}

        def free(n: int, used: dict[int, int] = used) -> int:
            return left[n] - used.get(n, 0)

        def largest(room: int) -> int | None:
            k = bisect_right(sizes, room) - 1
            while k >= 0 and not free(sizes[k]):
                k -= 1
            return sizes[k] if k >= 0 else None

        bin_, room = [], capacity
        while (n := largest(room)) is not None:
            bin_.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        if room and bin_:
            small = bin_[-1]
            gap = room + small
            used[small] -= 1
            best = (room, None)
            for a in sizes[: bisect_right(sizes, gap)]:
                if not free(a) or 2 * a > gap:
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(gap - a)
                used[a] -= 1
                if b is not None and gap - a - b < best[0]:
                    best = (gap - a - b, (a, b))
                    if not best[0]:
                        break
            if best[1] is None:
                used[small] += 1
            else:
                bin_ = sorted([*bin_[:-1], *best[1]], reverse=True)
                for n in best[1]:
                    used[n] = used.get(n, 0) + 1
        used = {n: u for n, u in used.items() if u}
        times = min(left[n] // u for n, u in used.items())
        out.append((bin_, times))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                drop(n)
    return out


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.frombuffer(enc.encode(text or "") + end, enc.dtype).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    raw = ids[a : a + capacity].tobytes()
                    rows.append(i)
                    out.append((k, a, len(raw) // 4, zlib.crc32(raw), raw))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kept = [batch.column(c).take(pa.array(rows, pa.int32())) for c in batch.schema.names if c != "text"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            names = ["piece", "start", "length", "ids_crc32", "ids"][: 4 + with_ids]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=[*(c for c in batch.schema.names if c != "text"), *names])

    return run


def pieces(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """carry, piece, start, length, ids_crc32 and, if asked for, ids (packed unsigned 32-bit) of every piece."""
    df = docs.select(*carry, "text")
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k != "text")
    return df.mapInArrow(_pieces(path, capacity, end_id, with_ids), f"{kinds}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


class Places:
    """For a length and a number within it: sequence and offset."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base, used = 0, {}
        for lengths, times in patterns:
            at = 0
            for k, n in enumerate(lengths):
                if k == 0 or n != lengths[k - 1]:
                    many = lengths.count(n)
                    rows.setdefault(n, []).append((used.get(n, 0), many, base, at))
                    used[n] = used.get(n, 0) + many * times
                at += n
            base += times
        self.rows = {n: np.array(r, np.int64) for n, r in rows.items()}

    def find(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[length]
        first, many, base, at = r[np.searchsorted(r[:, 0], number, "right") - 1].T
        k = number - first
        return base + k // many, at + (k % many) * length


def _placed(places: Places):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                sequence[own], offset[own] = places.find(int(n), number[own])
            kept = [c for c in batch.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(rows: DataFrame, order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """rows (with a length each) with sequence_id and offset: gapless from 0 in each sequence."""
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    rows = durable(rows.withColumn("_part", part), "pieces")
    counts = durable(rows.groupBy("length", "_part").agg(F.count("*").alias("_n")), "piece-counts")
    patterns = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order))
    # offsets has at most capacity x PARTS rows, however large the corpus.
    numbered = rows.withColumn("_place", place).join(offsets, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    kept = [c for c in rows.columns if c != "_part"]
    numbered = numbered.select(*kept, (F.col("_offset") + F.col("_place") - 1).alias("_number"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in numbered.dtypes if k != "_number")
    return numbered.mapInArrow(_placed(Places(patterns)), f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, carry, capacity, end_id, with_ids), (*carry, "piece"), capacity)
