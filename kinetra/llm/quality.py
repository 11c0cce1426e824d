"""Quality by a sparse rule ensemble over document statistics.

Each whole text becomes a few statistics. Small trees are grown on bootstrap draws of a bounded sample of labelled
training rows; every path from a root to a node is a rule, the conjunction of its threshold conditions. A logistic
regression with a lasso penalty keeps few of the rules, and those are compiled into one Spark column expression over
the statistics, which scores every document.

Defined results: a null or empty text has zero statistics and the score the rules give for them; without labelled rows
of both classes the score is the share of label 1 (one half without any); repeated rows are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm import labelled
from kinetra.llm.words import Words, chunks, utf8
from kinetra.llm.workers import lean

FOLDS = 3
TREES = 60
DEPTH = 3
THRESHOLDS = 24
LASSO = 0.002
CHUNK_BYTES = 2 << 20

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "bang", "bar", "not_ascii", "distinct", "repeat", "commonest", "lines", "line_repeat", "short_words", "long_words", "pair_repeat"]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many different hashes, and how often the commonest occurs."""
    different, most = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, row))
        r, x = row[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])]))
        np.maximum.at(most, r[first], np.diff(np.append(first, len(r))))
        different = np.bincount(r[first], minlength=n).astype(np.float64)
    return different, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.float64)
    kind = _KIND[data]
    words = Words(data, offsets)
    row = words.row()
    count = np.diff(words.first).astype(np.float64)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    length = words.end - words.start
    per = lambda mask: np.bincount(row, mask, n) / some
    upper, lower = sums(kind == 1), sums(kind == 2)
    different, most = _distinct(row, words.hash, n)
    same = np.zeros(len(row), bool)
    pair = np.zeros(len(row), np.uint64)
    if len(row) > 1:
        next_ = row[1:] == row[:-1]
        same[1:] = next_ & (words.hash[1:] == words.hash[:-1])
        pair[1:] = words.hash[1:] * np.uint64(3) ^ words.hash[:-1]
        pairs, pair_row = pair[1:][next_], row[1:][next_]
    else:
        pairs, pair_row = pair[:0], row[:0]
    pair_different, _ = _distinct(pair_row, pairs, n)
    breaks = data == 10
    ends = np.unique(np.concatenate([np.flatnonzero(breaks), offsets[1:] - 1])) if len(data) else np.zeros(0, np.int64)
    ends = ends[ends >= 0]
    line_row = np.searchsorted(offsets, ends, "right") - 1
    starts = np.maximum(np.concatenate([[0], ends[:-1] + 1]), offsets[line_row]) if len(ends) else ends
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * np.uint64(2) + np.uint64(1))])
    first, last = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends, "right")
    real = last > first
    line_different, _ = _distinct(line_row[real], (total[last] - total[first])[real], n)
    lines = np.bincount(line_row[real], minlength=n).astype(np.float64)
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.bincount(row, length, n) / some, upper / np.maximum(upper + lower, 1),
        sums(kind == 3) / bytes_, sums(kind == 4) / bytes_, sums(kind == 5) / bytes_, sums(data == 33) / bytes_, sums(data == 124) / bytes_,
        sums(data >= 128) / bytes_, different / some, per(same), most / some, np.log1p(lines), 1 - line_different / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        per(length <= 3), per(length >= 14), 1 - pair_different / np.maximum(count - 1, 1) - (count < 2),
    ])


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
for _c in b".,;:?'\"-()":
    _KIND[_c] = 4
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KIND[_c] = 5


#: A condition: (statistic, at most the threshold?, threshold).
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, columns: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: set[Rule]) -> None:
    if path:
        out.add(tuple(sorted(path)))
    total, ones = weight.sum(), (weight * y).sum()
    if not depth or total < 20 or ones < 1e-9 or total - ones < 1e-9:
        return
    best = (1e-6, None)
    parent = ones * (total - ones) / total
    for j in columns:
        for t in cuts[j]:
            left = x[:, j] <= t
            n, k = weight[left].sum(), (weight * y)[left].sum()
            if n < 5 or total - n < 5:
                continue
            gain = parent - k * (n - k) / n - (ones - k) * (total - n - ones + k) / (total - n)
            if gain > best[0]:
                best = (gain, (j, t, left))
    if best[1] is None:
        return
    j, t, left = best[1]
    _grow(x[left], y[left], weight[left], columns, cuts, depth - 1, (*path, (int(j), True, float(t))), out)
    _grow(x[~left], y[~left], weight[~left], columns, cuts, depth - 1, (*path, (int(j), False, float(t))), out)


def rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Paths of trees on bootstrap draws, each over a random third of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for j in range(x.shape[1])]
    out: set[Rule] = set()
    for _ in range(trees):
        draw = rng.integers(0, len(x), min(len(x), 3000))
        columns = rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False)
        weight = np.where(y[draw] == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        _grow(x[draw], y[draw], weight, columns, cuts, depth, (), out)
    return sorted(out)


def apply(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for j, low, t in rule:
        held &= (x[:, j] <= t) if low else (x[:, j] > t)
    return held


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights (many of them zero) and intercept, by accelerated proximal gradient steps."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log(max(y.mean(), 1e-4) / max(1 - y.mean(), 1e-4)))
    u = np.ones(k) / np.sqrt(k)
    for _ in range(20):
        u = z.T @ (z @ u)
        norm = np.linalg.norm(u)
        u /= norm
    step = 1 / (norm / n / 4 + 0.25)
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        g = (p - y) / n
        moved = v - step * (z.T @ g)
        w2 = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b2 = c - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as one Spark expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for j, low, t in rule:
                c = F.col(f"_s.{STATISTICS[j]}")
                held = held & ((c <= t) if low else (c > t))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


@lean
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK_BYTES)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        own = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=STATISTICS)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), own], names=[*kept, "_s"])


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and _s, a struct of STATISTICS, for every row."""
    df = docs.select(*carry, "text")
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k != "text")
    return df.mapInArrow(_measured, f"{kinds}, _s struct<{', '.join(f'{s}: double' for s in STATISTICS)}>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE, folds: int = FOLDS, penalty: float = LASSO) -> Ensemble:
    rows = measured(labelled.training(docs, labels, "quality", labelled.fold(folds) == 1, sample), ("doc_id", "y"))
    got = rows.select("doc_id", "y", "_s.*").orderBy("doc_id").collect()
    y = np.array([r.y for r in got], np.float64)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    x = np.array([r[2:] for r in got], np.float64)
    found = rules(x, y)
    z = np.column_stack([apply(r, x) for r in found]).astype(np.float64)
    w, b = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble([found[k] for k in kept], [float(w[k]) for k in kept], b)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by rules fitted on the training folds."""
    model = fit(docs, labels)
    out = measured(docs).select("doc_id", (labelled.fold(FOLDS) == 1).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
