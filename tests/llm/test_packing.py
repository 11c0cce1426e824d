"""Shards, packing, the token store, exact search and page text."""

import math
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetra.llm import packing, sharding, tokens, tokenstore, topk, wrappers
from kinetra.llm.htmlblocks import blocks

PATH = tokens.public("word_bpe_49k.json")


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def one_by_one(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        room, i = min(fits) if fits else (capacity, len(rooms))
        if not fits:
            rooms.append(capacity)
        rooms[i] = room - s
        out.append(i)
    return out


def counted(sizes):
    sizes, counts = np.unique(sizes, return_counts=True)
    return sizes[::-1].tolist(), counts[::-1].tolist()


@given(st.lists(st.integers(1, 40), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing(items):
    sizes, counts = counted(items)
    runs = sharding.best_fit_decreasing(sizes, counts, 40)
    assert [b for own in runs for b, n in own for _ in range(n)] == one_by_one(sorted(items, reverse=True), 40)
    shards = sharding.balanced(sizes, counts, 4)
    assert [sum(n for _, n in own) for own in shards] == counts and max(b for own in shards for b, _ in own) < 4


def test_balanced_packs_as_single_groups_would():
    """50,000 groups: the runs of sizes are those of best-fit-decreasing over single groups, and shards are near equal."""
    rng = np.random.default_rng(8)
    items = np.minimum(rng.lognormal(5, 1.2, 50_000).astype(int) + 16, 20_000).tolist()
    sizes, counts = counted(items)
    runs = sharding.balanced(sizes, counts, 40)
    held = [0] * 40
    for s, own in zip(sizes, runs, strict=True):
        for b, n in own:
            held[b] += s * n
    assert sum(held) == sum(items) and max(held) - sum(items) / 40 < 20
    assert [b for own in runs for b, n in own for _ in range(n)] == one_by_one(sorted(items, reverse=True), max(held))


def test_shards_of_many_groups_are_near_equal(spark):
    rng = np.random.default_rng(2)
    rows = [(k, ("x" * int(n)) + str(k % 4000)) for k, n in enumerate(rng.integers(0, 400, 6000))]
    held = defaultdict(int)
    for r in sharding.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        held[r.shard] += r.size
    assert len(held) == 40 and max(held.values()) - min(held.values()) < 0.002 * max(held.values())


def test_shards(docs, rows, nothing):
    got = sharding.digest(docs, 5).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    by_text, slots, held = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        by_text[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.digest(nothing, 5).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=25))
@settings(max_examples=80, deadline=None)
def test_plan_packs_each_length_as_often_as_it_occurs(counts):
    used = defaultdict(int)
    patterns = packing.plan(counts, 60)
    for lengths, times in patterns:
        assert sum(lengths) <= 60 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts and len(patterns) <= 4 * len(counts) + 4


def best_two_fit(items, capacity):
    """Piece by piece: fill with the largest that fits, then put two pieces where the smallest was if they fill its gap better."""
    items, bins = sorted(items, reverse=True), []
    while items:
        taken, room = [], capacity
        for x in list(items):
            if x <= room:
                items.remove(x)
                taken.append(x)
                room -= x
        if room:
            small, gap = taken[-1], room + taken[-1]
            free = sorted([*items, small])
            pairs = [(gap - x - y, x, y) for i, x in enumerate(free) for y in free[i + 1 :] if x + y <= gap]
            if pairs and min(pairs)[0] < room:
                _, x, y = min(pairs)
                taken[-1:] = [x, y]
                free.remove(x)
                free.remove(y)
                items = free[::-1]
        bins.append(sorted(taken, reverse=True))
    return sorted(bins)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_two_fit_piece_by_piece(items):
    counts = {n: items.count(n) for n in set(items)}
    found = [sorted(lengths, reverse=True) for lengths, times in packing.plan(counts, 30) for _ in range(times)]
    assert sorted(found) == best_two_fit(items, 30)


def test_packing(docs, rows, nothing):
    got = packing.pack_documents(docs, PATH, with_ids=True).collect()
    places = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 4096
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096
    text = dict(rows)
    for doc in {d for d, _ in rows} - {44}:
        own = sorted((r.piece, r.start, bytes(r.ids)) for r in got if r.doc_id == doc)
        assert np.frombuffer(b"".join(x[2] for x in own), "<u4").tolist() == [*ids(text[doc]), 1]
    assert packing.pack_documents(nothing, PATH).count() == 0
    assert len(places) <= math.ceil(sum(r.length for r in got) / 4096) + 1


def test_encoder_agrees_with_the_library_on_odd_texts():
    odd = ["it's I'LL don't <|endoftext|>x a\tb\xa0c ½²3 İstanbul ΣΑΣ é 日本 \x1c z ...'s !!'re", "é é́", "a\nb  c\r\nd", "ǅ ŉ ﬁ ẞ", "'S 'Re_x-y"]
    enc = tokens.encoder(PATH)
    assert [np.frombuffer(enc.encode(t), enc.dtype).tolist() for t in odd] == [ids(t) for t in odd]


def test_token_store(spark, docs, rows, nothing, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs, path, PATH)
    got = sorted(tokenstore.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    for (doc, text), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        own = np.array([*ids(text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(own), zlib.crc32(own.tobytes()))
        assert bytes(r.ids) == own.tobytes()
        at += len(own)
    assert tokenstore.lookup(spark, path, 4).tolist() == [*ids(dict(rows)[4]), 2]
    assert tokenstore.lookup(spark, path, 5000) is None
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(None, rows[0][1]), (None, None), (None, rows[0][1])], "doc_id long, text string"))
    tokenstore.write(more, f"file://{tmp_path}/nameless", PATH)
    again = sorted(tokenstore.read(spark, f"file://{tmp_path}/nameless").collect(), key=lambda r: r.start)
    first = [(r.doc_id, r.n_tokens) for r in again[:3]]
    assert sorted(n for _, n in first) == [1, len(ids(rows[0][1])) + 1, len(ids(rows[0][1])) + 1] and {d for d, _ in first} == {None}
    base = sum(n for _, n in first)
    assert [(r.doc_id, r.start - base, r.n_tokens, r.ids_crc32) for r in again[3:]] == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]
    assert tokenstore.lookup(spark, f"file://{tmp_path}/nameless", 4).tolist() == [*ids(dict(rows)[4]), 2]
    tokenstore.write(nothing, f"file://{tmp_path}/empty", PATH)
    assert tokenstore.read(spark, f"file://{tmp_path}/empty").count() == 0
    with pytest.raises(ValueError):
        tokenstore.Shard(bytes(spark.read.parquet(f"{path}/shards").first().payload), b"another dictionary")


@pytest.mark.parametrize("block", [8192, 3])
def test_exact_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[50]
    rows = [(int(i), [float(v) for v in r], "extra") for i, r in enumerate(x)]
    rows += [(1000, None, "e"), (1050, [float("nan")] * 16, "e"), (1100, [1.0] * 15 + [None], "e"), (1150, [float("inf")] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    expected = []
    for i in range(0, 400, 50):
        s = q @ q[i]
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
        expected += [(i, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0
    # Other lengths are searched by themselves; empty vectors score 0.
    other = [(5000, [1.0, 2.0], "e"), (5001, [3.0, 1.0], "e"), (5002, [1.0], "e"), (6000, [], "e"), (6001, [], "e")]
    more = df.unionByName(spark.createDataFrame(other, df.schema))
    assert sorted(map(tuple, topk.top_k(more).collect())) == sorted([*expected, (5000, 1, 5001, 256 * 256 * 5), (6000, 1, 6001, 0)])


def page(n, body):
    return f"""<!doctype html><html><head><title>t</title><script>var x="<p>no</p>"</script></head><body><header class="site"><h2>Site</h2></header>
    <div class="cookie-notice">We use cookies</div><div id="wrap"><div class="post-content"><header class="entry-header"><h1>Title {n}</h1></header><div>{body}</div>
    <p>More  text&nbsp;{n} &lt;x&gt;<br>line<form><input>Mail</form></p><ul><li>one {n}<li>two</ul></div><div class="sidebar"><p>Links</p></div>
    <section id="comments"><div class="comment"><p>nice {n}</p></div></section></div><div>All rights</div><footer>foot</footer>"""


def test_wrappers(spark, nothing):
    rows = [(k, f"http://a.example.com/{k}", page(k, f"<p>Body {k} " + "lorem " * 20 + "</p>" * (k % 2)), 1) for k in range(12)]
    rows += [(100, "http://b.example.org", None, 1), (101, None, "<p>alone", 1), (102, "x", "", 1), (103, "http://c.example.org/1", "<article><h1>T &amp; U</h1><p>one<p><b>two<aside>no</aside><nav>menu</nav></article><footer>f", 1)]
    rows.append(rows[3])
    got = defaultdict(list)
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)).collect():
        got[r.page_id].append(r.text)
    for k in range(12):
        assert got[k][0] == "\n".join([f"Title {k}", " ".join([f"Body {k}"] + ["lorem"] * 20), f"More text {k} <x> line", f"one {k}", "two"])
    assert len(got[3]) == 2 and got[100] == [""] and got[102] == [""] and got[101] == ["alone"] and got[103] == ["T & U\none\ntwo"]


def test_comments_may_be_articles():
    got = blocks('<article class="post no-comments"><p>text</p></article><article class="comment"><p>nice</p></article><p class="ad">buy</p>')
    assert [(drop, text) for _, drop, text in got] == [(False, "text"), (True, "nice"), (True, "buy")]


@given(st.text(alphabet="<>/pdiv \"'=!-abc&;", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_read(raw):
    for path, drop, text in blocks(raw):
        assert text == " ".join(text.split()) and text


@pytest.mark.parametrize("unwanted", ['<div id="ad-1">Buy</div>', '<div role="search">Buy</div>', '<div style="display:none">Buy</div>'])
def test_wanted_blocks_after_dropped_ones_of_the_same_path(unwanted):
    pages = [blocks(f"<article><h1>T{k}</h1>{unwanted}<div>Real text {k}</div></article>") for k in range(5)]
    wrapper = wrappers.tokens(pages[0])
    for p in pages[1:]:
        wrapper = wrappers.align(wrapper, wrappers.tokens(p))
    assert [wrappers.Wrapper(wrapper).text(p) for p in pages] == [f"T{k}\nReal text {k}" for k in range(5)]
    assert wrappers.Wrapper(wrappers.tokens(pages[0])).text(pages[0]) == "T0\nReal text 0"


def test_layouts_of_a_host_and_pages_without_host(spark):
    words = " ".join(f"word{k}" for k in range(30))
    rows = [(0, "http://a.example.com/0", f"<article><p>in article {words}</p></article><p>out</p>")]
    rows += [(k, f"http://a.example.com/{k}", f"<div class=content><h1>Head {k}</h1><p>Own {k} {words}</p></div><p>menu</p>") for k in range(1, 9)]
    rows += [(k, f"http://a.example.com/{k}", f"<section><p>Other {k} {words}</p></section>") for k in range(9, 11)]
    rows += [(k, [None, "nowhere"][k % 2], f"<{tag}><p>Lone {k} {words}</p></{tag}>") for k, tag in enumerate(["article", "div", "section", "main"], 20)]
    rows += [(k, "http://copies.example.com/", f"<h1>Same head</h1><p>Same {words}</p>") for k in range(30, 36)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    expected = {0: f"in article {words}"} | {k: f"Head {k}\nOwn {k} {words}" for k in range(1, 9)} | {k: f"Other {k} {words}" for k in range(9, 11)}
    expected |= {k: f"Lone {k} {words}" for k in range(20, 24)} | {k: f"Same head\nSame {words}" for k in range(30, 36)}
    assert got == expected


@pytest.mark.parametrize(
    "attributes, dropped",
    [
        ('title="the hidden treasure"', False),
        ('data-id="promo-7"', False),
        ("data-text='a class=\"ad\" b' alt=\"it's hidden\"", False),
        ("title = x data-hidden=1 my-role=search", False),
        ('title="a" hidden', True),
        ("ID = 'promo-7' title=x", True),
        ("data-x=1 role=search", True),
        ('aria-hidden="false" STYLE="color:red; display: none"', True),
        ("class=ad/", True),
    ],
)
def test_attributes_are_read_whole(attributes, dropped):
    assert blocks(f"<p {attributes}>text</p>")[0][1:] == (dropped, "text")


def site(n, extra=""):
    """Pages with neutral names: what is template and what is article shows only from page to page."""
    body = "".join(f"<p>Own {n} part {k} " + "lorem ipsum " * 5 + "</p>" + f"<h3>Sub {n} {k}</h3>" * (k % 2) for k in range(1 + n % 4))
    return f"<body><div class=x1><p>Start here</p><p>Your town</p></div><div class=x2><article><h1>Head {n}</h1><div class=x3>Read us daily</div>{body}<div class=x4>Write to us</div>{extra}</article></div><p>The end</p>"


def test_template_text_is_found_by_inference_only(spark):
    rows = [(n, f"http://a.example.com/{n}", site(n, "<section><p>Rare</p></section>" * (n == 5))) for n in range(12)]
    rows += [(100 + n, f"http://b{n}.example.com/", site(n)) for n in range(3)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for n in range(12):
        own = [text for text in got[n].split("\n")]
        assert own[0] == f"Head {n}" and own[1].startswith(f"Own {n} part 0") and not {"Read us daily", "Write to us", "Start here", "The end"} & set(own)
        assert len(own) == 1 + sum(1 + k % 2 for k in range(1 + n % 4)) + (n == 5)
        alone = wrappers.Wrapper(wrappers.tokens(blocks(site(n)))).text(blocks(site(n)))
        assert "Read us daily" in alone and "Write to us" in alone
    assert got[5].endswith("Rare")
    assert all("Read us daily" in got[100 + n] for n in range(3))


def test_wrappers_do_not_depend_on_partitions(spark):
    rows = [(n, f"http://a.example.com/{n}", site(n * 7 % 23, "<section><p>Rare</p></section>" * (n % 5 == 0)).replace("<h3>", "<h4>" if n % 3 else "<h3>")) for n in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", wrappers.host(F.col("url")))
    found = [sorted(map(tuple, wrappers.infer(x).collect())) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("page_id")).repartition(5, "page_id"))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def test_repeated_groups_fold():
    nodes, members = wrappers.stream([("a", False, "1")] + [(k, False, str(i)) for i in range(5) for k in "bcd"] + [("b", False, "x")])
    assert [n[0] for n in nodes] == ["a", "b", "c", "d", "b"] and [n[3] for n in nodes] == [False, True, True, True, False]
    assert members[2] == [2, 5, 8, 11, 14]


def test_long_pages_are_aligned_in_seconds():
    rng = np.random.default_rng(1)
    page = [(f"a/{k}", False, str(i)) for i, k in enumerate(rng.integers(0, 40, 50_000))]
    began = time.process_time()
    a, b = wrappers.tokens(page), wrappers.tokens(page[1000:30_000] + page[:1000] + page[30_000:])
    whole = wrappers.align(a, b)
    assert time.process_time() - began < 30
    keys = [n[:2] for n in whole]
    for part in (a, b):
        at = iter(keys)
        assert all(n[:2] in at for n in part[:2000:97])
    assert wrappers.Wrapper(whole).text(page) == "\n".join(t for _, _, t in page)


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=100, deadline=None)
def test_alignment_is_a_common_subsequence(a, b):
    a, b = [(x, False) for x in a], [(x, False) for x in b]
    found = wrappers._common(a, b)
    assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    assert wrappers._common(a, a) == [(k, k) for k in range(len(a))]
