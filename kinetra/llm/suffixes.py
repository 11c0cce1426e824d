"""Exact removal of repeated byte strings by longest-previous-factor arrays.

Every byte that is covered by a SPAN-byte string which also starts earlier (in a smaller doc_id, or earlier in the same
document) is removed; the first occurrence stays. Matches never cross documents.

The suffixes of a corpus do not fit one machine, so they are dealt out by content, such that equal strings meet:

1. Each start of a SPAN-byte string is owned by an anchor, the GRAM bytes with the least hash inside the string
   (leftmost on ties), so equal strings have equal anchors. Consecutive starts of one anchor form a piece: the starts,
   and the bytes they cover (its context). No more than hashes of anchor and context leave the scan.
2. Pieces meet by anchor. Of pieces with equal context all but the first lie later than an equal string, at every
   start; an anchor with one context is settled by that. Each scan task sends a context once and settles repeats of
   its own, so an anchor that a third of all documents hold has at most one row for each task and context.
3. First pieces of an anchor with several contexts fetch their bytes. The pieces of an anchor are concatenated; their
   suffixes are sorted by joined ranks, equal ones in corpus order; starts whose longest previous factor reaches SPAN
   in that order are removed.
   An anchor with more than HOT contexts is split: its starts go one by one, keyed by the hash of their SPAN bytes.

Anchors that a great many documents have in different contexts (of a common line, say) are known before pieces meet: a
first scan counts contexts by buffers of BUFFER_PIECES pieces, and anchors that reach LOCAL in some and HOT in all are
dealt by anchor and context. Any other anchor has fewer than LOCAL contexts for each buffer of the corpus.

Defined results: a null text is empty and loses nothing; texts shorter than SPAN bytes lose nothing; rows with equal
doc_id and text are the same document given twice, each gets that document's result; different texts under one doc_id
are ordered by their hash; very long texts are scanned in overlapping parts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.words import U64, mix, powers, utf8
from kinetra.llm.words import chunks as row_chunks
from kinetra.llm.workers import lean
from kinetra.session import durable

SPAN = 100
GRAM = 24
HOT = 4096
LOCAL = 16
SALTS = 256
CHUNK_BYTES = 64 << 10
PART_BYTES = 1 << 20
PLACE_BITS = 21
BUFFER_PIECES = 200_000
SORT_BYTES = 60 << 10
ROW_BYTES = 8

_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    x = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    h = x[:-16] * _A
    h += x[8:-8] * _B
    h += x[16:] * _C
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each window of width values; values are compared by all but their PLACE_BITS low bits."""
    mask = U64((1 << PLACE_BITS) - 1)
    v, done = (h & ~mask) | np.arange(len(h), dtype=U64), 1
    while done < width:
        step = min(done, width - done)
        v = np.minimum(v[step:], v[:-step])
        done += step
    return (v & mask).astype(np.int32)


def string_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end] for each pair."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(data * power[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64) * _B)


def pieces(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor, context) of the pieces of some documents."""
    if len(data) < span:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    h = _grams(data)
    at = _least(h, span - GRAM + 1)
    edge = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= span
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - span + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[: len(at)] > 0)
    anchor = at[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    lo = start[first]
    return lo, count, mix(h[anchor[first]]), string_hashes(data, lo, lo + count - 1 + span)


def _parts(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the part in its row, bytes, offsets): runs of rows, or overlapping parts of a long one."""
    for a, b in row_chunks(offsets, CHUNK_BYTES):
        size = offsets[b] - offsets[a]
        if b - a == 1 and size > PART_BYTES:
            for at in range(0, int(size) - span + 1, PART_BYTES):
                part = data[offsets[a] + at : min(offsets[a] + at + PART_BYTES + span - 1, offsets[b])]
                yield a, at, part, np.array([0, len(part)])
        else:
            yield a, 0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _runs(order: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs of starts, as (rows of order that begin a run, counts); order sorts by document and lo."""
    if not len(order):
        return order, order
    d, t, s, n = doc[order], tag[order], lo[order], count[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + n[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order)) - 1
    return order[first], s[last] + n[last] - s[first]


_PIECE = ["key", "context", "doc_id", "tag", "lo", "n", "seen"]


def _settle(key: np.ndarray, context: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which pieces repeat the key and context of an earlier one here."""
    order = np.lexsort((lo, tag, doc, context, key))
    k, c = key[order], context[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = (doc[order] != doc[head]) | (tag[order] != tag[head]) | (lo[order] != lo[head])
    seen = np.zeros(len(order), bool)
    seen[order] = later
    return seen


def _settled(key: np.ndarray, context: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of _PIECE with repeats merged into seen runs, and the rows that are kept as they are."""
    seen = _settle(key, context, doc, tag, lo, count)
    open_, done = np.flatnonzero(~seen), np.flatnonzero(seen)
    done = done[np.lexsort((lo[done], tag[done], doc[done]))]
    first, total = _runs(done, doc, tag, lo, count)
    spread = mix(doc[first].astype(U64) ^ mix(lo[first].astype(U64)))
    join = lambda a, b: np.concatenate([a, b])
    return [join(key[open_], spread), join(context[open_], np.zeros(len(first), U64)), join(doc[open_], doc[first]), join(tag[open_], tag[first]), join(lo[open_], lo[first]), join(count[open_], total), join(np.zeros(len(open_), bool), np.ones(len(first), bool))], open_


def _batch(columns: list[np.ndarray], extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    key, context, doc, tag, lo, count, seen = columns
    arrays = [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(seen)]
    return pa.RecordBatch.from_arrays([*arrays, *(extra or {}).values()], names=[*_PIECE, *(extra or {})])


def _buffers(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[list[np.ndarray]]:
    """Key, context, doc_id, tag, lo and n of all pieces, about BUFFER_PIECES at once."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        doc, tag = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        for row, at, part, own in _parts(data, offsets, span):
            lo, count, anchor, context = pieces(part, own, span)
            if len(lo):
                r = np.searchsorted(own, lo, "right") - 1
                held.append([anchor, context, doc[row + r], tag[row + r], lo - own[r] + at, count])
                size += len(lo)
        if size > BUFFER_PIECES:
            yield list(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield list(map(np.concatenate, zip(*held, strict=True)))


def _scan(span: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(batches, span):
            yield _batch(_settled(*buffer)[0])

    return run


def _frequent(span: int, local: int):
    """(key, contexts) of anchors with at least local contexts in a buffer."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, context, *_ in _buffers(batches, span):
            order = np.lexsort((context, key))
            k, c = key[order], context[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            keys, n = np.unique(k[fresh], return_counts=True)
            often = n >= local
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["key", "contexts"])

    return run


def _fetch(span: int, hot: int):
    """Bytes of undecided pieces; the starts of hot anchors one by one, keyed by their own bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            data = np.ascontiguousarray(data)
            lists = batch.column("undecided")
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            key, lo, count, group = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "n", "group"))
            lo, count = lo.astype(np.int64), count.astype(np.int64)
            key = key.view(U64) if key.dtype == np.int64 else key.astype(np.int64).view(U64)
            doc, tag = batch.column("doc_id").to_numpy()[row], batch.column("tag").to_numpy()[row]
            cool = np.flatnonzero(group <= hot)
            begin = offsets[row] + lo
            raw = data.tobytes()
            if len(cool):
                texts = [raw[a:b] for a, b in zip(begin[cool].tolist(), (begin[cool] + count[cool] - 1 + span).tolist(), strict=True)]
                zeros = np.zeros(len(cool), U64)
                yield _batch([key[cool], zeros, doc[cool], tag[cool], lo[cool], count[cool], zeros > 0], {"bytes": pa.array(texts, pa.binary())})
            warm = np.flatnonzero(group > hot)
            if len(warm):
                n = count[warm]
                which = np.repeat(warm, n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a = begin[which] + step
                h = string_hashes(data, a, a + span)
                columns, open_ = _settled(h, h, doc[which], tag[which], lo[which] + step, np.ones(len(which), np.int64))
                texts = [raw[x : x + span] for x in a[open_].tolist()] + [b""] * (len(columns[0]) - len(open_))
                yield _batch(columns, {"bytes": pa.array(texts, pa.binary())})

    return run


def _dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct values."""
    order = np.argsort(x)
    y = x[order]
    rank = np.zeros(len(x), U64)
    np.cumsum(y[1:] != y[:-1], out=rank[1:], dtype=U64)
    out = np.empty_like(rank)
    out[order] = rank
    return out


def _ranks(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """The rank of the span bytes from each start among those of all starts.

    Ranks of 8 bytes are joined, as many as one integer holds, to ranks of wider strings, until one joint spans all.
    """
    if span < 8:
        return _dense(sum(text[starts + k].astype(U64) << U64(8 * (7 - k)) for k in range(span)))
    word = np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text).data, 0, (1,)).astype(U64)
    rank, width = _dense(word), 8
    while True:
        bits = int(rank.max()).bit_length() or 1
        fit = 64 // bits
        if fit * width >= span:
            last = span - width
            steps = [*range(0, last, width), last]
            return _dense(_joint(rank, starts, steps, U64(bits)))
        steps = range(0, fit * width, width)
        rank = _dense(_joint(rank, np.arange(len(rank) - steps[-1]), steps, U64(bits)))
        width *= fit


def _joint(rank: np.ndarray, at: np.ndarray, steps: Iterable[int], bits: U64) -> np.ndarray:
    key = np.zeros(len(at), U64)
    for step in steps:
        key <<= bits
        key |= rank[at + step]
    return key


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value (-1: none), by pointer jumping."""
    before = np.arange(-1, len(x) - 1)
    live = np.flatnonzero(before >= 0)
    live = live[x[before[live]] >= x[live]]
    while len(live):
        before[live] = before[before[live]]
        live = live[before[live] >= 0]
        live = live[x[before[live]] >= x[live]]
    return before


def longest_previous(text: np.ndarray, starts: np.ndarray, span: int = SPAN, least: int = 1) -> np.ndarray:
    """Longest previous factor of each start, up to span: starts are in corpus order, each with span bytes of text.

    In the order of suffixes (equal ones by position), the longest match that begins earlier is with the nearest smaller
    position on either side; a match of span bytes is with the one before. Lengths below least may be given as 0.
    """
    rank = _ranks(text, starts, span)
    order = np.argsort(rank, kind="stable")
    out = np.zeros(len(order), np.int64)
    sorted_ = rank[order]
    whole = np.zeros(len(order), bool)
    whole[1:] = sorted_[1:] == sorted_[:-1]
    out[order[whole]] = span
    if least >= span:
        return out
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    best = np.zeros(len(order), np.int64)
    place = starts[order]
    for other, some in ((before, before >= 0), (after, after < len(order))):
        i, j = place[some], place[other[some]]
        common, rest = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(rest):
            rest = rest[text[i[rest] + common[rest]] == text[j[rest] + common[rest]]]
            common[rest] += 1
            rest = rest[common[rest] < span]
        best[some] = np.maximum(best[some], common)
    out[order] = best
    return out


def _whole_keys(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows of batches, sorted by key, in runs of whole keys that pass limit bytes by one key at most."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        ends = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False) + ROW_BYTES)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if last is not None and key[0] != last:
            cuts = np.append(0, cuts)
        filled = np.where(cuts > 0, ends[cuts - 1], 0)
        a, begin = 0, 0
        while (k := np.searchsorted(filled, begin + limit - size)) < len(cuts):
            cut = int(cuts[k])
            if cut > a:
                held.append(batch.slice(a, cut - a))
            if held:
                yield pa.Table.from_batches(held)
            held, size, a, begin = [], 0, cut, int(filled[k])
            cuts, filled = cuts[k + 1 :], filled[k + 1 :]
        held.append(batch.slice(a))
        size, last = size + int(ends[-1]) - begin, key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _decide(span: int):
    """Whole groups of equal key, gathered up to SORT_BYTES, are sorted together: equal strings have equal keys."""

    def decided(table: pa.Table) -> pa.RecordBatch:
        doc, tag, lo, count = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "tag", "lo", "n"))
        seen, key = table.column("seen").to_numpy(), table.column("key").to_numpy()
        done = np.flatnonzero(seen)
        open_ = np.flatnonzero(~seen)
        open_ = open_[np.lexsort((key[open_], lo[open_], tag[open_], doc[open_]))]
        if len(open_):
            fresh = np.ones(len(open_), bool)
            fresh[1:] = np.any([c[open_][1:] != c[open_][:-1] for c in (doc, tag, lo, key)], axis=0)
            open_ = open_[fresh]
        removed = [(doc[done], tag[done], lo[done], count[done])]
        if len(open_):
            column = table.column("bytes").combine_chunks().take(pa.array(open_)).cast(pa.large_binary())
            text = np.frombuffer(column.buffers()[2], np.uint8)
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(open_) + 1)
            n = count[open_]
            which = np.repeat(np.arange(len(open_)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(longest_previous(text, offsets[which] + step, span, span) >= span)
            owner = open_[which[hit]]
            removed.append((doc[owner], tag[owner], lo[owner] + step[hit], np.ones(len(hit), np.int64)))
        d, t, s, n = map(np.concatenate, zip(*removed, strict=True))
        first, total = _runs(np.lexsort((s, t, d)), d, t, s, n)
        return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), pa.array(s[first].astype(np.int32)), pa.array(total.astype(np.int32))], names=["doc_id", "tag", "lo", "n"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(decided, _whole_keys(batches, SORT_BYTES))

    return run


def removals(docs: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """doc_id, tag (hash of the text), lo, n: runs of starts of strings of docs (doc_id, tag, text) that also start earlier."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = docs.mapInArrow(_scan(span), "key bigint, context bigint, doc_id bigint, tag bigint, lo int, n int, seen boolean")
    counts = docs.mapInArrow(_frequent(span, LOCAL), "key bigint, contexts bigint").groupBy("key").agg(F.sum("contexts").alias("n")).filter(F.col("n") > hot)
    frequent = durable(counts.select("key", F.lit(True).alias("frequent")), "frequent")
    salt = F.when(F.col("frequent"), F.pmod(F.col("context"), F.lit(SALTS))).otherwise(0).cast("int")
    met = scanned.join(frequent, "key", "left").withColumn("salt", salt).repartition(parts, "key", "salt")
    same = Window.partitionBy("key", "salt", "context", "seen").orderBy("doc_id", "tag", "lo")
    met = met.withColumn("_rank", F.rank().over(same))
    first = (F.col("_rank") == 1) & ~F.col("seen")
    here = F.sum(first.cast("int")).over(Window.partitionBy("key", "salt"))
    met = met.withColumn("group", F.when(F.col("frequent"), F.lit(hot + 1)).otherwise(here))
    gone = F.col("seen") | (F.col("_rank") > 1)
    found = met.select("key", "doc_id", "tag", "lo", "n", F.col("group").cast("int").alias("group"), gone.alias("gone")).filter(F.col("gone") | (F.col("group") > 1))
    found = durable(found, "repeats")
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of the scan now
    open_ = found.filter(~F.col("gone")).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "lo", "n", "group")).alias("undecided"))
    fetched = docs.join(open_, ["doc_id", "tag"]).select("doc_id", "tag", "text", "undecided").mapInArrow(_fetch(span, hot), "key bigint, context bigint, doc_id bigint, tag bigint, lo int, n int, seen boolean, bytes binary")
    groups = fetched.drop("context").repartition(parts, "key").sortWithinPartitions("key")
    decided = durable(groups.mapInArrow(_decide(span), "doc_id bigint, tag bigint, lo int, n int"), "factors")
    spark._jvm.System.gc()
    return found.filter("gone").select("doc_id", "tag", "lo", "n").unionAll(decided)


def _cut(span: int, digest: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs")
            sizes, removed, spans, out = [], [], [], []
            for text, own in zip(texts, runs, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(raw))
                if not own.is_valid:
                    removed.append(0)
                    spans.append(0)
                    out.append(hashlib.sha256(raw).hexdigest() if digest else text.as_py())
                    continue
                lo, n = (own.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "n"))
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + n - 1 + span, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode(errors="ignore"))
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.string())]
            carry = [c for c in batch.schema.names if c not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=[*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicate(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), digest: bool = False, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """carry (with doc_id), n_bytes, n_removed, n_spans and kept for every row: the text that is left, or its SHA-256.

    A text that is cut inside a character loses the rest of that character; the SHA-256 is of the exact bytes.
    """
    rows = docs.select(*carry, "text", F.xxhash64("text").alias("tag"))
    gone = removals(rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "tag", "text"), span, hot)
    runs = gone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    joined = rows.join(runs, ["doc_id", "tag"], "left").select(*carry, "text", "runs")
    kinds = ", ".join(f"`{k}` {t}" for k, t in joined.dtypes if k not in ("text", "runs"))
    return joined.mapInArrow(_cut(span, digest), f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
