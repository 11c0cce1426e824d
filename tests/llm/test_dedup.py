"""Decontamination, near duplicates and repeat removal against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetra.llm import decontamination, fmindex, neardup, suffixes, workers
from kinetra.llm.words import words_of, utf8
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = words_of(texts)
    assert np.diff(found.first).tolist() == [len(split(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    assert len(set(found.hash.tolist())) == len(set(flat))


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(2, 4), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_fm_index_finds_every_occurrence(text, pattern):
    index = fmindex.FMIndex(np.array(text), 5)
    lo, hi = index.search(np.array([pattern]), np.array([len(pattern)]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert got == [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


def contaminated(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, docs, rows, nothing, block):
    items = [(1, " ".join(split(rows[2][1])[20:45])), (2, "a"), (10, " ".join(split(rows[2][1])[25:33])), (11, None), (12, ""), (13, "never seen anywhere at all"), (14, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.hits(docs, bench, block_bytes=block).collect())
    assert got == contaminated(rows, items)
    clean = decontamination.decontaminate(docs, bench, block_bytes=block)
    assert not any(r.contaminated for r in decontamination.hits(clean, bench).collect())
    assert {r.doc_id: r.text for r in clean.collect()}[1] == rows[1][1]
    assert decontamination.hits(nothing, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.hits(docs, bench.limit(0)).collect())


def removed(rows, span):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if d in out:
            continue
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - span + 1):
            if seen.setdefault(raw[k : k + span], (d, k)) != (d, k):
                gone[k : k + span] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, local", [(4096, 16), (1, 16), (1, 1), (2, 2)])
def test_repeats(docs, rows, nothing, hot, local, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 4000)
    monkeypatch.setattr(suffixes, "LOCAL", local)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.deduplicate(docs, digest=True, hot=hot).collect()}
    assert got == removed(rows, 100)
    assert suffixes.digest(nothing).count() == 0


def test_arrays_of_a_chunk_stay_in_the_heap():
    """Eight bytes for each byte of a chunk or of a sort are below what workers map and give back one by one."""
    assert 8 * suffixes.CHUNK_BYTES < workers.MAPPED
    assert 8 * suffixes.SORT_BYTES < workers.MAPPED


@given(st.lists(st.tuples(st.integers(0, 6), st.binary(max_size=30)), max_size=60), st.integers(1, 9), st.integers(1, 150))
@settings(max_examples=60, deadline=None)
def test_runs_of_whole_keys(rows, batch, limit):
    rows = sorted(rows, key=lambda r: r[0])
    table = pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "bytes": pa.array([r[1] for r in rows], pa.binary())})
    runs = [list(zip(*t.to_pydict().values(), strict=True)) for t in suffixes._whole_keys(iter(table.to_batches(batch)), limit)]
    assert [r for run in runs for r in run] == rows
    assert all(a[-1][0] != b[0][0] for a, b in zip(runs, runs[1:], strict=False))
    for run in runs:
        before = [len(b) + suffixes.ROW_BYTES for k, b in run if k != run[-1][0]]
        assert sum(before) < limit


@given(st.binary(min_size=30, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)), st.sampled_from([5, 8, 12, 20]))
@settings(max_examples=40, deadline=None)
def test_whole_matches_alone_are_the_same(raw, span):
    text, starts = np.frombuffer(raw, np.uint8), np.arange(len(raw) - span + 1)
    assert ((suffixes.longest_previous(text, starts, span, span) == span) == (suffixes.longest_previous(text, starts, span) == span)).all()
    assert [raw.find(raw[i : i + span]) < i for i in starts] == (suffixes.longest_previous(text, starts, span, span) == span).tolist()


@given(st.binary(min_size=30, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)))
@settings(max_examples=40, deadline=None)
def test_longest_previous_factor(raw):
    span = 12
    starts = np.arange(len(raw) - span + 1)
    got = suffixes.longest_previous(np.frombuffer(raw, np.uint8), starts, span)
    for i in starts:
        best = 0
        for j in range(i):
            n = 0
            while n < span and raw[i + n] == raw[j + n]:
                n += 1
            best = max(best, n)
        assert got[i] == best


def test_near_duplicates(spark, docs, rows, nothing):
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert set(got) == {d for d, _ in rows}
    rare = neardup.rarity(docs)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    ids = sorted(texts)
    table = {}
    for d in ids:
        _, h, weight = neardup.shingles(*utf8(__import__("pyarrow").array([texts[d]])), rare)
        table[d] = (h, weight)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            same = texts[i] is not None and texts[i] == texts[j]
            if i < j and (same or neardup.similarity(*table[i], *table[j]) >= neardup.SIMILARITY):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {d: find(d) for d in ids}
    assert got[30] == got[31] == 3 and got[33] == 5 and got[26] == 21 and got[20] == 20
    assert neardup.classes(nothing).count() == 0


def test_many_near_copies_stay_linear_and_whole(spark):
    base = prose(5, 300).split()
    rows = []
    for k in range(150):
        copy = list(base)
        copy[(k * 2) % 300] = f"changed{k}"
        rows.append((k, " ".join(copy)))
    got = {r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


@pytest.mark.parametrize("block", [1 << 20, 60_000])
def test_near_pairs_inside_a_template_family(spark, monkeypatch, block):
    """Texts (a, b) of one template are too far from each other, but for (a, 2k) and (a, 2k + 1), which share a change."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    base, rows = prose(9, 800).split(), []
    for a in range(17):
        for b in range(17):
            copy = list(base)
            for c in range(6):
                copy[5 * (17 * c + (a + c * b) % 17) + 4] = f"shared{a}x{b // 2}" if c == 0 else f"own{a}x{b}x{c}"
            rows.append((17 * a + b, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rare, table = neardup.rarity(df), []
    for _, text in rows:
        _, h, weight = neardup.shingles(*utf8(__import__("pyarrow").array([text])), rare)
        table.append((h, weight))
    near = {(i, j) for i in range(len(rows)) for j in range(i) if neardup.similarity(*table[i], *table[j]) >= neardup.SIMILARITY}
    assert near == {(17 * a + b + 1, 17 * a + b) for a in range(17) for b in range(0, 16, 2)}
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == {d: d - (d % 17) % 2 if d % 17 < 16 else d for d, _ in rows}


def test_no_link_is_lost_in_large_mixed_buckets(spark):
    """400 texts of one template, half of it shared by all: buckets hold hundreds of texts and many components."""
    rng, common = np.random.default_rng(4), prose(3, 300)
    rows = []
    for k in range(200):
        own = prose(5000 + k, 150).split()
        near = list(own)
        for i in rng.choice(150, rng.integers(1, 14), replace=False):
            near[i] = f"other{k}x{i}"
        rows += [(2 * k, common + " " + " ".join(own)), (2 * k + 1, common + " " + " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rare, table = neardup.rarity(df), []
    for _, text in rows:
        _, h, weight = neardup.shingles(*utf8(__import__("pyarrow").array([text])), rare)
        table.append((h, weight))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(*table[i], *table[j]) >= neardup.SIMILARITY:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 30 < sum(root[k] != k for k in range(len(rows))) < 190
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert [got[k] for k in range(len(rows))] == root


def test_texts_of_one_document_are_one_class(spark):
    texts = {k: prose(300 + k, 80) for k in range(5)}
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (3, texts[1]), (9, texts[2] + " tail"), (5, texts[3]), (6, texts[4])]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 7: 3, 9: 3, 5: 5, 6: 6}
