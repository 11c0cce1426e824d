"""Benchmark decontamination: an FM-index per shard of training documents.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Each shard (a bounded run of documents inside one partition) becomes a sequence over the benchmark's vocabulary.
Stretches that cannot hold a window (a word, or a pair of neighbours, that no window has) become one separator; the
rest is indexed, every distinct window is searched backward through wavelet ranks, its occurrences are located from
sampled suffix positions, and hit words that touch are merged into removal spans. Documents are never shuffled.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES; each further block is another pass that
adds to the hits, so its size is not bounded by memory.

Defined results: a null or empty text has no words and no hits; a null benchmark text has no windows, an item
without item_id is left out; items with equal
windows all count; repeated rows are judged row by row; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.fmindex import FMIndex
from kinetra.llm.words import Words, chunks, utf8
from kinetra.llm.workers import lean

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20

_FIELDS = [("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("span_begin", pa.list_(pa.int32())), ("span_end", pa.list_(pa.int32()))]


class Phrases:
    """The distinct windows of a block of benchmark items, over a vocabulary of word ids from 2."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        words = Words(*utf8(pa.array([t for _, t in items], pa.string())))
        self.vocabulary = np.unique(words.hash)
        ids = np.searchsorted(self.vocabulary, words.hash) + 2
        self.alphabet = len(self.vocabulary) + 2
        starts, lengths, owner = [], [], []
        for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b > a:
                here = np.arange(a, max(a + 1, b - window + 1))
                starts.append(here)
                lengths.append(np.full(len(here), min(window, b - a)))
                owner.append(np.full(len(here), row))
        self.width = window
        if not starts:
            self.patterns = np.zeros((0, window), np.int64)
            self.lengths = np.zeros(0, np.int64)
            return
        start, length, row = map(np.concatenate, (starts, lengths, owner))
        full = np.full((len(start), window), 0, np.int64)
        for k in range(window):
            has = length > k
            full[has, window - 1 - k] = ids[start[has] + length[has] - 1 - k]
        self.patterns, which = np.unique(full, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.array([i for i, _ in items], np.int64)[row]], 1), axis=0)
        self.item = pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min())
        left, right = self.patterns[:, :-1].ravel(), self.patterns[:, 1:].ravel()
        self.links = np.unique((left * self.alphabet + right)[left > 0])

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids; 1 for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 1)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def occurrences(phrases: Phrases, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word place, window) of every occurrence in one shard; first: the first word of each document."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.patterns) or not len(ids):
        return none
    known = ids > 1
    link = np.zeros(len(ids) + 1, bool)
    both = np.flatnonzero(known[:-1] & known[1:])
    link[both + 1] = _member(phrases.links, ids[both] * phrases.alphabet + ids[both + 1])
    link[first] = False
    begin = np.flatnonzero(known & ~link[:-1])
    end = np.flatnonzero(known & ~(link[1:] & np.append(known[1:], False))) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none
    size = end - begin + 1
    offset = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(offset - begin, size)
    text = np.ones(len(place), np.int64)
    inner = place < np.repeat(end, size)
    text[inner] = ids[place[inner]]
    index = FMIndex(text, phrases.alphabet)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
    return place[index.locate(rows)], window


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """values (sorted by row) as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _passes(phrases: Phrases, first_pass: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, SHARD_BYTES):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place, window = occurrences(phrases, phrases.ids(words.hash), words.first)
                marks = np.zeros(len(words.start) + 1, np.int64)
                if len(place):
                    np.add.at(marks, place, 1)
                    np.add.at(marks, place + phrases.lengths[window], -1)
                hit = np.cumsum(marks)[:-1] > 0
                row = words.row()
                n = np.diff(phrases.item_first)[window] if len(place) else np.zeros(0, np.int64)
                at = np.repeat(phrases.item_first[:-1][window] - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(place) else np.zeros(0, np.int64)
                found = np.unique(np.stack([np.repeat(row[place], n), phrases.item[at]], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
                hits, items = np.flatnonzero(hit), found[:, 1]
                hit_row, item_row = row[hits], found[:, 0]
                if not first_pass:
                    old = batch.slice(a, b - a)
                    before = old.column("hit")
                    hits = np.concatenate([hits, before.flatten().to_numpy() + np.repeat(words.first[:-1], before.value_lengths().to_numpy())])
                    hits = np.unique(hits)
                    hit_row = row[hits]
                    before = old.column("items")
                    both = np.concatenate([found, np.stack([np.repeat(np.arange(b - a), before.value_lengths().to_numpy()), before.flatten().to_numpy()], 1)])
                    both = np.unique(both, axis=0)
                    items, item_row = both[:, 1], both[:, 0]
                opens = np.ones(len(hits), bool)
                opens[1:] = (hits[1:] != hits[:-1] + 1) | (hit_row[1:] != hit_row[:-1])
                closes = np.append(opens[1:], True)[: len(hits)]
                base = (offsets[a : b + 1] - offsets[a])[hit_row]
                columns = [
                    pa.array(np.diff(words.first), pa.int64()),
                    _lists((hits - words.first[hit_row]).astype(np.int32), hit_row, b - a, pa.int32()),
                    _lists(items, item_row, b - a, pa.int64()),
                    _lists((words.start[hits] - base)[opens].astype(np.int32), hit_row[opens], b - a, pa.int32()),
                    _lists((words.end[hits] - base)[closes].astype(np.int32), hit_row[closes], b - a, pa.int32()),
                ]
                kept = [k for k in batch.schema.names if k not in dict(_FIELDS)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in kept), *columns], names=[*kept, *dict(_FIELDS)])

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items of benchmark, at most limit bytes at once; a longer item is a block of its own."""
    block: list[tuple[int, str | None]] = []
    size = 0
    for r in benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull()).toLocalIterator():
        n = len((r[1] or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of benchmark in docs, a row for each of docs.

    Columns: carry, text, n_words, hit (places of hit words), items (ids of items with occurring windows, ascending),
    span_begin and span_end (merged removal spans, UTF-8 byte places in text).
    """
    out = docs.select(*carry, "text")
    kinds = ", ".join(f"`{k}` {t}" for k, t in out.dtypes)
    schema = f"{kinds}, n_words bigint, hit array<int>, items array<bigint>, span_begin array<int>, span_end array<int>"
    for k, block in enumerate(blocks(benchmark, block_bytes)):
        out = out.mapInArrow(_passes(Phrases(block, window), k == 0), schema)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of contamination(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, **options)
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, (begin, end) in enumerate(zip(batch.column("span_begin").to_pylist(), batch.column("span_end").to_pylist(), strict=True)):
            if begin:
                raw, out, at = texts[i].encode(), [], 0
                for a, b in zip(begin, end, strict=True):
                    out.append(raw[at:a])
                    at = b
                texts[i] = b"".join([*out, raw[at:]]).decode()
        kept = [k for k in batch.schema.names if k not in dict(_FIELDS)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in kept], names=kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """carry and text of docs with the removal spans cut out; texts without a hit stay as they are."""
    found = contamination(docs, benchmark, carry, **options)
    return found.mapInArrow(_cut, ", ".join(f"`{k}` {t}" for k, t in found.dtypes if k not in dict(_FIELDS)))
