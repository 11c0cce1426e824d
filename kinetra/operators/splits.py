"""Splits that keep groups whole.

Group sizes are aggregated in Spark; the greedy assignment runs on the driver over the groups themselves, and its result
(a row a group) is joined back. Beyond GROUPS groups, `balanced_folds` and `deficit_split` run over the distinct sizes and
their numbers instead: groups of one size go round the splits in cycles, and each finds its own by its rank. The other
splits gather groups by hash into GROUPS bundles first, which are then what stays whole. So neither driver memory nor the
broadcast grows with the groups.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPS = 100_000
BUCKETS = 256


def _many(df: DataFrame, group: str) -> bool:
    return df.select(group).distinct().limit(GROUPS + 1).count() > GROUPS


def _units(df: DataFrame, group: str, *more: Column) -> tuple[DataFrame, list]:
    """df with _unit (the group, or its bundle) and (unit, rows, more aggregates) by unit."""
    many = _many(df, group)
    df = df.withColumn("_unit", F.pmod(F.xxhash64(group), F.lit(GROUPS)).cast("string") if many else F.col(group).cast("string"))
    sizes = df.groupBy("_unit").agg(F.count("*").alias("n"), *more).collect()
    return df, sorted((tuple(r) for r in sizes), key=lambda r: (r[0] is not None, r[0]))


def _back(df: DataFrame, rows: list[tuple], name: str, kind: str) -> DataFrame:
    plan = df.sparkSession.createDataFrame(rows, f"_of string, {name} {kind}")
    # At most GROUPS rows.
    return df.join(F.broadcast(plan), F.col("_unit").eqNullSafe(F.col("_of"))).drop("_unit", "_of")


def _cycles(sizes: list[tuple[int, int]], loads: list, by_groups: bool) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For each (size, number of groups), by falling size: (rank of the first group, splits that take turns from there on).

    Each group goes to the least load, then to the fewest groups if by_groups, then to the first split. Splits less than
    one size above the least take one group each before any takes a second, so they go on in turns until the least of
    the others is reached.
    """
    loads, groups, out = list(loads), [0] * len(loads), []
    for size, number in sizes:
        segments, at = [], 0
        while at < number:
            least = min(loads)
            turn = sorted((k for k in range(len(loads)) if loads[k] < least + size), key=lambda k: (loads[k], groups[k] if by_groups else 0, k))
            rest = [loads[k] for k in range(len(loads)) if k not in turn]
            n = min(number - at, (min(rest) - least) // size * len(turn)) if rest else number - at
            segments.append((at, turn))
            for i, k in enumerate(turn):
                taken = n // len(turn) + (i < n % len(turn))
                loads[k] += taken * size
                groups[k] += taken
            at += n
        out.append((size, segments))
    return out


def _turns(df: DataFrame, group: str, loads: list, by_groups: bool) -> DataFrame:
    """df with _split, the number of the split of each row's group: the greedy over single groups, however many.

    Groups of one size are ranked by hash and name. At most sqrt(2 * rows) distinct sizes reach the driver.
    """
    spark = df.sparkSession
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(BUCKETS)))
    cells = sizes.groupBy("_n", "_bucket").agg(F.count("*").alias("_m"))
    found = cells.groupBy("_n").agg(F.sum("_m").alias("m")).collect()
    plan = _cycles(sorted(((r[0], r[1]) for r in found), reverse=True), loads, by_groups)
    cycles = spark.createDataFrame(plan, "_n long, _cycles array<struct<start: long, turn: array<int>>>")
    before = F.sum("_m").over(Window.partitionBy("_n").orderBy("_bucket")) - F.col("_m")
    # A row a distinct size, and at most BUCKETS times as many.
    ranked = sizes.join(cells.withColumn("_before", before).drop("_m"), ["_n", "_bucket"]).join(F.broadcast(cycles), "_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_n", "_bucket").orderBy("_group")) - 1
    ranked = ranked.withColumn("_rank", rank)
    cycle = F.element_at(F.filter("_cycles", lambda c: c["start"] <= F.col("_rank")), -1)
    turn = F.element_at(cycle["turn"], (F.pmod(F.col("_rank") - cycle["start"], F.size(cycle["turn"])) + 1).cast("int"))
    return df.join(ranked.select("_group", turn.alias("_split")), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def balanced_folds(df: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """fold of each row: groups by falling size, ties by a seeded permutation of sorted names, each to the fold with the
    fewest rows, then the fewest groups, then the least number. Beyond GROUPS groups, ties go by hash and name."""
    if _many(df, group):
        return _turns(df, group, [0] * folds, True).withColumnRenamed("_split", "fold")
    df, units = _units(df, group)
    tie = np.empty(len(units), np.int64)
    tie[np.random.default_rng(seed).permutation(len(units))] = np.arange(len(units))
    heap = [(0, 0, k) for k in range(folds)]
    out = []
    for i in sorted(range(len(units)), key=lambda i: (-units[i][1], tie[i])):
        weight, groups, fold = heapq.heappop(heap)
        out.append((units[i][0], fold))
        heapq.heappush(heap, (weight + units[i][1], groups + 1, fold))
    return _back(df, out, "fold", "int")


def deficit_split(df: DataFrame, group: str, shares: dict[str, float], spread: bool = True) -> DataFrame:
    """split of each row: groups by falling size, each to the split that is furthest below its share; fewer groups than
    splits go to the first splits in order if spread."""
    if _many(df, group):
        total = df.count()
        names = F.array(*[F.lit(s) for s in shares])
        dealt = _turns(df, group, [-Fraction(share * total) for share in shares.values()], False)
        return dealt.withColumn("split", F.element_at(names, F.col("_split") + 1)).drop("_split")
    df, units = _units(df, group)
    total, held, out = sum(u[1] for u in units), dict.fromkeys(shares, 0), []
    for i, (unit, n) in enumerate(sorted(units, key=lambda u: -u[1])):
        name = list(shares)[i] if spread and len(units) < len(shares) else max(shares, key=lambda s: shares[s] * total - held[s])
        held[name] += n
        out.append((unit, name))
    return _back(df, out, "split", "string")


def best_holdout(df: DataFrame, group: str, value: str, share: float, tries: int, seed: int = 42) -> DataFrame:
    """held_out of each row: of many random holdouts of whole groups the one nearest to the whole in size, mean and spread."""
    df, units = _units(df, group, F.sum(value).alias("s"), F.sum(F.pow(value, F.lit(2))).alias("q"))
    n, s, q = (np.array([float(u[k] or 0) for u in units]) for k in (1, 2, 3))
    spread = lambda n, s, q: np.sqrt(max(q / n - (s / n) ** 2, 0.0))
    whole = spread(n.sum(), s.sum(), q.sum())
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(units), bool))
    for _ in range(tries):
        pick = rng.random(len(units)) < share
        if pick.any() and not pick.all():
            size, total, square = n[pick].sum(), s[pick].sum(), q[pick].sum()
            score = abs(size / n.sum() - share) / share + (abs(total / size - s.sum() / n.sum()) + abs(spread(size, total, square) - whole)) / (whole + 1e-12)
            if score < best[0]:
                best = (score, pick)
    return _back(df, [(u[0], bool(p)) for u, p in zip(units, best[1], strict=True)], "held_out", "boolean")


def descriptor_folds(df: DataFrame, group: str, value: str, folds: int) -> DataFrame:
    """fold of each row: groups by falling size, each to the fold that keeps sizes and sums of value most even."""
    df, units = _units(df, group, F.sum(value).alias("s"))
    total = np.array([sum(u[1] for u in units), sum(float(u[2] or 0) for u in units)])
    held, out = np.zeros((folds, 2)), []
    for unit, n, s in sorted(units, key=lambda u: -u[1]):
        mine = np.array([n, float(s or 0)])
        k = int(np.argmin([(((held[f] + mine) / total) ** 2).sum() - ((held[f] / total) ** 2).sum() for f in range(folds)]))
        held[k] += mine
        out.append((unit, k))
    return _back(df, out, "fold", "int")


def out_of_fold_mean(df: DataFrame, fold: str, folds: int, value: str) -> DataFrame:
    """predicted: the mean of value over the rows of all other folds."""
    sums = df.groupBy(fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    others = sums.withColumn("_to", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).filter(F.col("_to") != F.col(fold))
    means = others.groupBy(F.col("_to").cast(df.schema[fold].dataType).alias(fold)).agg((F.sum("_s") / F.sum("_n")).alias("predicted"))
    return df.join(means, fold)
