"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of blocks. Neighbouring blocks of one path and one fate (dropped or not) are one token, and tokens that
follow each other in the same order again (a group of up to PERIOD of them) fold into one repeated group. A host's wrapper
is a sequence of nodes, each a path with a text part, and each possibly optional or repeated: streams are aligned, tokens
that only one side has become optional nodes, folded ones are repeated, and these and texts that differ become slots (a node
whose text never differed is template text). Alignment pairs equal occurrences of a path and keeps a longest rising chain of
pairs, in n log n steps for any length.

Streams of one structure combine first, in any order and already in the scan; the structures of a host are dealt by their
hash into SALTS groups and aligned in order of their hash, and then the groups' wrappers in order. So a wrapper does not
depend on how pages lie in partitions, and a host that holds a third of all pages never meets in one task before it is a
few wrappers. Wrappers keep no page texts.

Each page is read by its host's wrapper, whatever its markup: nodes on a path that cannot hold the article are dropped, and
so is template text (equal on LEAST_PAGES different pages). Of the rest, what lies inside an <article> or <main> stays; on
a page without one, what lies inside the element named like an article, or any other, that holds most of the host's varying
text, or of the page's own, where a page has less than SHARE of its text in the former.

Defined results: a null or empty page has an empty text; markup that is broken is read as far as it goes; a host with few
pages (or a url without host) has no template text and is read by itself; repeated rows are read row by row and count as
one page.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.htmlblocks import blocks, like_article
from kinetra.llm.workers import lean
from kinetra.session import durable

LEAST_PAGES = 4
PERIOD = 8
HELD = 2000
SALTS = 32
BROADCAST_BYTES = 32 << 20
#: Shares of a host's varying text that the main element holds: one named like an article, and any other.
SHARE, WHOLE = 0.6, 0.9

#: A node: path, dropped, optional, repeated, text hash (None: a slot), hashes of different pages (the least LEAST_PAGES), characters.
Node = list


def _key(node: Node) -> tuple[str, bool]:
    return node[0], node[1]


def _pages(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:LEAST_PAGES]


def _repeat(a: Node, b: Node) -> Node:
    """A node for two that follow each other."""
    return [a[0], a[1], a[2] and b[2], True, None, _pages(a[5], b[5]), a[6] + b[6]]


def _same(a: Node, b: Node) -> Node:
    """A node for two that stand at one place."""
    return [a[0], a[1], a[2] or b[2], a[3] or b[3], a[4] if a[4] == b[4] else None, _pages(a[5], b[5]), a[6] + b[6]]


def stream(page: list[tuple[str, bool, str]]) -> tuple[list[Node], list[list[int]]]:
    """A page as a wrapper of its own, and the blocks of each node."""
    nodes: list[Node] = []
    members: list[list[int]] = []
    own = crc32("\n".join(text for _, drop, text in page if not drop).encode())
    for at, (path, drop, text) in enumerate(page):
        nodes.append([path, drop, False, False, crc32(text.encode()), [own], len(text)])
        members.append([at])
        period = 1
        while period <= PERIOD and 2 * period <= len(nodes):
            if all(_key(nodes[-k]) == _key(nodes[-k - period]) for k in range(1, period + 1)):
                for k in range(-period, 0):
                    nodes[k - period] = _repeat(nodes[k - period], nodes[k])
                    members[k - period] += members[k]
                del nodes[-period:], members[-period:]
                period = 0
            period += 1
    return nodes, members


def tokens(page: list[tuple[str, bool, str]]) -> list[Node]:
    return stream(page)[0]


def _common(a: list[tuple[str, bool]], b: list[tuple[str, bool]]) -> list[tuple[int, int]]:
    """Places of a common subsequence: equal ends, and between them the longest rising chain of the k-th occurrences of a
    key on either side."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[tuple[str, bool], list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    last: list[int] = []
    pairs: list[tuple[int, int, int]] = []
    for i in range(head, len(a) - tail):
        if where.get(a[i]):
            j = where[a[i]].pop()
            k = bisect_left(ends, j)
            pairs.append((i, j, last[k - 1] if k else -1))
            ends[k : k + 1], last[k : k + 1] = [j], [len(pairs) - 1]
    middle = []
    at = last[-1] if last else -1
    while at >= 0:
        i, j, at = pairs[at]
        middle.append((i, j))
    return [(k, k) for k in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of what either wrapper covers."""
    out: list[Node] = []
    i = j = 0

    def add(node: Node) -> None:
        if out and _key(out[-1]) == _key(node):
            out[-1] = _repeat(out[-1], node)
        else:
            out.append(node)

    def only(nodes: list[Node]) -> None:
        for n in nodes:
            add([*n[:2], True, *n[3:]])

    for p, q in _common([_key(n) for n in a], [_key(n) for n in b]):
        only(a[i:p])
        only(b[j:q])
        add(_same(a[p], b[q]))
        i, j = p + 1, q + 1
    only(a[i:])
    only(b[j:])
    return out


def _structure(nodes: list[Node]) -> str:
    return hashlib.blake2b(json.dumps([_key(n) for n in nodes]).encode(), digest_size=12).hexdigest()


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _batch(rows: list[tuple[str, str, list[Node]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in rows], pa.string()), pa.array([s for _, s, _ in rows], pa.string()), pa.array([json.dumps(w) for _, _, w in rows], pa.string())], names=["host", "structure", "wrapper"])


@lean
def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of pages, those of one host and structure as one."""
    found: dict[tuple[str, str], list[Node]] = {}
    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes = tokens(blocks(page or "")) if name else []
            if nodes:
                key = name, _structure(nodes)
                found[key] = list(map(_same, found[key], nodes)) if key in found else nodes
        if len(found) > HELD:
            yield _batch([(*k, w) for k, w in found.items()])
            found = {}
    if found:
        yield _batch([(*k, w) for k, w in found.items()])


@lean
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for the neighbouring rows of a host and group; of those, equal structures combine first."""
    key: tuple | None = None
    whole: list[Node] = []
    last: tuple[str, list[Node]] | None = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("host", "salt", "structure", "wrapper"))
        for name, salt, structure, raw in zip(*columns, strict=True):
            nodes = json.loads(raw)
            if key == (name, salt) and last[0] == structure:
                last = structure, list(map(_same, last[1], nodes))
                continue
            if key is not None:
                whole = align(whole, last[1]) if whole else last[1]
                if key != (name, salt):
                    yield _batch([(key[0], f"{key[1]:04}", whole)])
                    whole = []
            key, last = (name, salt), (structure, nodes)
    if key is not None:
        yield _batch([(key[0], f"{key[1]:04}", align(whole, last[1]) if whole else last[1])])


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host of pages (host, html)."""
    kinds = "host string, structure string, wrapper string"
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = pages.select("host", "html").mapInArrow(_structures, kinds)
    for salt in (F.pmod(F.crc32(F.col("structure").cast("binary")), F.lit(SALTS)).cast("int"), F.lit(0)):
        out = out.withColumn("salt", salt).repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "structure", "wrapper").mapInArrow(_aligned, kinds)
    return out.select("host", "wrapper")


def _in_article(path: str) -> bool:
    return any(e.partition(".")[0].partition("#")[0] in ("article", "main") for e in path.split("/"))


def _has_article(page: list[tuple[str, bool, str]]) -> bool:
    return any(not drop and _in_article(path) for path, drop, _ in page)


def _main(texts: list[tuple[str, int]]) -> str:
    """The element that holds most of the characters of texts (path, characters)."""
    weight: Counter[str] = Counter()
    for path, chars in texts:
        elements = path.split("/")
        for depth in range(len(elements)):
            weight["/".join(elements[:depth])] += chars
    total = weight.get("", 0)
    named = [p for p, chars in weight.items() if chars >= SHARE * total and like_article(p.rpartition("/")[2])]
    whole = [p for p, chars in weight.items() if chars >= WHOLE * total]
    return max(named or whole or [""], key=lambda p: p.count("/") + bool(p))


def _within(path: str, main: str) -> bool:
    return not main or (path + "/").startswith(main + "/")


class Wrapper:
    """Reads pages of a host."""

    def __init__(self, nodes: list[Node]):
        self.keys = [_key(n) for n in nodes]
        self.template = [n[4] is not None and len(n[5]) >= LEAST_PAGES for n in nodes]
        varying = [n for n, t in zip(nodes, self.template, strict=True) if not n[1] and not t]
        self.main = _main([(n[0], n[6]) for n in varying])

    def text(self, page: list[tuple[str, bool, str]]) -> str:
        own, members = stream(page)
        matched = dict((q, p) for p, q in _common(self.keys, [_key(n) for n in own]))
        template = {at for q, p in matched.items() if self.template[p] for at in members[q]}
        left = [(path, text) for at, (path, drop, text) in enumerate(page) if not drop and at not in template]
        if _has_article(page):
            return "\n".join(text for path, text in left if _in_article(path))
        inside = sum(len(text) for path, text in left if _within(path, self.main))
        main = self.main
        if inside < SHARE * sum(len(text) for _, text in left):
            main = _main([(path, len(text)) for path, text in left])
        return "\n".join(text for path, text in left if _within(path, main))


def _read(wrappers: dict[str, str] | None):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper] = {}
        for batch in batches:
            names, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            given = batch.column("wrapper").to_pylist() if wrappers is None else [wrappers.get(n) for n in names]
            texts = []
            for name, page, raw in zip(names, pages, given, strict=True):
                found = blocks(page or "")
                if not raw:
                    texts.append(Wrapper(tokens(found)).text(found))
                    continue
                if name not in ready:
                    if len(ready) > HELD:
                        ready.clear()
                    ready[name] = Wrapper(json.loads(raw))
                texts.append(ready[name].text(found))
            kept = [c for c in batch.schema.names if c not in ("host", "html", "wrapper")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return run


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """carry and text, the main text, of every row of pages (url, html).

    Wrappers are sent to all executors if they are at most BROADCAST_BYTES together; else pages join them by host.
    """
    spark = pages.sparkSession
    pages = pages.select(*carry, host(F.col("url")).alias("host"), "html")
    wrappers = durable(infer(pages), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kinds = ", ".join(f"`{k}` {t}" for k, t in pages.select(*carry).dtypes) + ", text string"
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.toLocalIterator()})
        return pages.mapInArrow(_shared(shared), kinds)
    return pages.join(wrappers, "host", "left").select(*carry, "host", "html", "wrapper").mapInArrow(_read(None), kinds)


def _shared(wrappers):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read(wrappers.value)(batches)

    return run
