"""Connected components of links between integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.session import durable


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least id around the node."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(moved.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and two hash sums of distinct links: equal for equal sets, and by a chance of 2^-64 for others."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.hash("b", "a"), F.lit(1 << 30)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link (a, b), but for roots themselves; root is the least id of the component.

    Minima are partial aggregates and joins may be split where a node has very many links; no component meets in one task.
    """
    links = durable(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = _mark(links)
    while True:
        links = durable(_small_star(_large_star(links)), "stars")
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
