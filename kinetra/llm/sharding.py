"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group and stay together. Groups in order of falling size enter the shard with the tightest
remaining capacity that holds them, found in a balanced search tree of remaining capacities; the capacity is the smallest
that needs no more than the given shards. A group larger than an even share gets a shard of its own first, and the rest
is spread over the other shards. The law is `bytes`: sizes are near equal, as far as the indivisible groups allow.

Groups of one size are interchangeable, and the tightest shard stays the tightest while it takes them, so the packing runs
over the distinct sizes and their numbers: those come to the driver, and there are at most sqrt(2 * all bytes) of them.
Every group finds its shard by its rank among the groups of its size, counted in PARTS parts by hash, so no task gets all
groups of a size.

Defined results: a null text is a group of its own kind with a size of OVERHEAD; an empty text likewise; ties of equal
size go by hash and key; repeated rows share their group and shard, each with its own slot; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.session import durable

OVERHEAD = 16
PARTS = 256

BLOCK = 512


class CapacityTree:
    """Remaining capacities of open bins in sorted blocks of bounded length (a two-level search tree)."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least remaining capacity that holds size."""
        lo = bisect_left(self.blocks, (size, -1), key=lambda b: b[-1])
        if lo == len(self.blocks):
            return None
        block = self.blocks[lo]
        found = block.pop(bisect_left(block, (size, -1)))
        if not block:
            self.blocks.pop(lo)
        return found

    def add(self, room: int, which: int) -> None:
        lo = min(bisect_left(self.blocks, (room, which), key=lambda b: b[-1]), len(self.blocks) - 1)
        if lo < 0:
            self.blocks.append([(room, which)])
            return
        block = self.blocks[lo]
        insort(block, (room, which))
        if len(block) > BLOCK:
            self.blocks[lo : lo + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each size (falling order, none above capacity) runs (bin, items): how its items enter bins, one after the other.

    None if it takes more than most bins.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, count in zip(sizes, counts, strict=True):
        runs = []
        while count:
            found = tree.tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            n = min(count, found[0] // size)
            runs.append((found[1], n))
            tree.add(found[0] - n * size, found[1])
            count -= n
        out.append(runs)
    return out


def balanced(sizes: list[int], counts: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """Runs (shard, items) of each size (falling order): the least capacity by which best-fit-decreasing needs no more than shards."""
    left, total, alone, k = list(counts), sum(s * c for s, c in zip(sizes, counts, strict=True)), 0, 0
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    while k < len(sizes) and alone < shards - 1 and sizes[k] * (shards - alone) > total:
        out[k].append((alone, 1))
        total, alone, left[k] = total - sizes[k], alone + 1, left[k] - 1
        k += not left[k]
    rest, many, bins = sizes[k:], left[k:], shards - alone
    if not rest:
        return out
    least = max(rest[0], -(-total // bins))
    low, high, step = least - 1, least, 1
    while (best := best_fit_decreasing(rest, many, high, bins)) is None:
        low, high, step = high, least + step, 2 * step
    while high - low > 1:
        mid = (low + high) // 2
        found = best_fit_decreasing(rest, many, mid, bins)
        if found is None:
            low = mid
        else:
            high, best = mid, found
    for runs, more in zip(out[k:], best, strict=True):
        runs += [(b + alone, n) for b, n in more]
    return out


def _planned(groups: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """_bytes of each size with _ends (ranks at which its runs end) and _shards (of the runs)."""
    found = counts.groupBy("_bytes").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_bytes")).toArrow()
    sizes, many = found.column("_bytes").to_pylist(), found.column("_n").to_pylist()
    ends, where = [], []
    for runs in balanced(sizes, many, shards):
        ends.append([sum(n for _, n in runs[: k + 1]) for k in range(len(runs))])
        where.append([shard for shard, _ in runs])
    plan = pa.table([pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(where, pa.list_(pa.int32()))], names=["_bytes", "_ends", "_shards"])
    return groups.sparkSession.createDataFrame(plan, "_bytes bigint, _ends array<bigint>, _shards array<int>")


def assign(docs: DataFrame, shards: int, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, size, text_crc32, shard and slot (gapless from 0 in each shard) for every row of docs."""
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        *carry,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(b"null")).otherwise(F.unhex(F.sha2(raw, 256))).alias("_key"),
    )
    rows = durable(rows, "shard-rows")
    groups = durable(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(PARTS)).cast("int")), "shard-groups")
    counts = durable(groups.groupBy("_bytes", "_part").agg(F.count("*").alias("_n")), "shard-sizes")
    before = Window.partitionBy("_bytes").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bytes", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bytes", "_part").orderBy("_key"))
    ranked = groups.withColumn("_place", place).join(offsets, ["_bytes", "_part"]).withColumn("_rank", F.col("_offset") + F.col("_place") - 1)
    run = F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))) + 1
    placed = ranked.join(_planned(groups, counts, shards), "_bytes").select("_key", F.element_at("_shards", run).alias("shard"))
    return slotted(rows.join(placed, "_key").select(*carry, "size", "text_crc32", "shard"), "shard", [F.col(c) for c in carry])


def slotted(df: DataFrame, shard: str, order: list[Column]) -> DataFrame:
    """df with slot: gapless from 0 in each shard.

    Rows of a shard are numbered in PARTS parts by hash, so that no task gets a whole shard; the parts' counts
    (shards x PARTS rows at most) give the offsets.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    df = durable(df.withColumn("_part", part), "slot-parts")
    counts = df.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_shard"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order))
    joined = df.withColumn("_place", place).join(F.broadcast(offsets), (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[c for c in df.columns if c != "_part"], (F.col("_offset") + F.col("_place") - 1).cast("long").alias("slot"))


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The placement of every document, under the law `bytes`."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
