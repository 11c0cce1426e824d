"""Road graphs as three DataFrames: nodes, segments, and the directed traversals that segments allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.session import durable


def traversals(segments: DataFrame) -> DataFrame:
    """edge_id, direction, source, target, length for each legal direction; geometry (if any) is turned for reverse."""
    forward = F.when(F.col("allows_forward"), F.struct(F.lit("forward").alias("direction"), F.col("start_node_id").alias("source"), F.col("end_node_id").alias("target")))
    reverse = F.when(F.col("allows_reverse"), F.struct(F.lit("reverse").alias("direction"), F.col("end_node_id").alias("source"), F.col("start_node_id").alias("target")))
    return segments.withColumn("_d", F.explode(F.array_compact(F.array(forward, reverse)))).select("edge_id", "_d.*", "length")


def problems(nodes: DataFrame, segments: DataFrame, most: float = 0.5) -> DataFrame:
    """edge_id and what is wrong with it: duplicate id, unknown endpoint, no legal direction, no length. Empty if all is well."""
    known = nodes.select("node_id").distinct()
    twice = segments.groupBy("edge_id").count().filter("count > 1").select("edge_id", F.lit("duplicate id").alias("problem"))
    ends = segments.select("edge_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id"))
    unknown = ends.join(known, "node_id", "left_anti").select("edge_id", F.lit("unknown endpoint").alias("problem")).distinct()
    bad = segments.select("edge_id", F.when(~F.col("allows_forward") & ~F.col("allows_reverse"), "no legal direction").when(F.coalesce(F.col("length") <= 0, F.lit(True)), "no length").alias("problem")).filter("problem is not null")
    return twice.unionAll(unknown).unionAll(bad)


def degrees(segments: DataFrame) -> DataFrame:
    """node_id, degree (distinct segments), is_intersection (two or more)."""
    ends = segments.select("edge_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id")).distinct()
    return ends.groupBy("node_id").agg(F.count("*").alias("degree")).withColumn("is_intersection", F.col("degree") >= 2)


def shortest(edges: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """source, target and the length of the shortest directed path of at most `most`, for each pair (null: none; 0: itself).

    All sources advance together: a round joins the frontier of each with the edges and keeps least distances, so the work
    is shuffled by node and bounded by `most`, and no task or driver holds the graph.
    """
    edges = edges.groupBy("source", "target").agg(F.min("length").alias("length")).filter(F.col("length") <= most)
    reached = durable(pairs.select(F.col("source").alias("origin")).distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("far"), F.lit(True).alias("fresh")), "reached")
    while True:
        step = reached.filter("fresh").join(edges, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node"), (F.col("far") + F.col("length")).alias("far")).filter(F.col("far") <= most)
        both = reached.select("origin", "node", "far", F.lit(False).alias("new")).unionAll(step.select("origin", "node", "far", F.lit(True).alias("new")))
        best = both.groupBy("origin", "node").agg(F.min(F.struct("far", "new")).alias("b"))
        reached = durable(best.select("origin", "node", "b.far", F.col("b.new").alias("fresh")), "reached")
        if not reached.filter("fresh").limit(1).count():
            break
    found = reached.select(F.col("origin").alias("source"), F.col("node").alias("target"), F.col("far").alias("distance"))
    return pairs.join(found, ["source", "target"], "left")


def snapped_distance(same: Column, from_along: Column, to_along: Column, from_length: Column, connector: Column) -> Column:
    """Route distance between points on traversals: along one, or out of the first, over the connector, into the second."""
    return F.when(same & (to_along >= from_along), to_along - from_along).otherwise(from_length - from_along + connector + to_along)


def corridor(points: DataFrame, key: list[str], order: str, x: str, y: str, spacing: float, buffer: float, side: float) -> DataFrame:
    """key and tile (i, j) of every tile that a buffered route touches: legs are sampled every spacing at most."""
    w = Window.partitionBy(*key).orderBy(order)
    legs = points.withColumns({"_x1": F.coalesce(F.lead(x).over(w), F.col(x)), "_y1": F.coalesce(F.lead(y).over(w), F.col(y))})
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("_x1") - F.col(x), 2) + F.pow(F.col("_y1") - F.col(y), 2)) / spacing)).cast("int")
    legs = legs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_k") / F.col("_n")
    legs = legs.withColumns({"_px": at(x, "_x1"), "_py": at(y, "_y1")})
    cover = lambda c: F.sequence(F.floor((F.col(c) - buffer) / side), F.floor((F.col(c) + buffer) / side))
    return legs.withColumn("i", F.explode(cover("_px"))).withColumn("j", F.explode(cover("_py"))).select(*key, "i", "j").distinct()


def coverage(points: DataFrame, key: list[str], order: str, x: str, y: str, parts: dict[str, Column], spacing: float, buffer: float, side: float) -> DataFrame:
    """key, tile (i, j) and part: a corridor for each part of a route; a tile belongs to the first part (in order) that touches it."""
    names = list(parts)
    member = F.explode(F.array_compact(F.array(*[F.when(held, F.lit(k)) for k, held in enumerate(parts.values())])))
    tiles = corridor(points.withColumn("_part", member), [*key, "_part"], order, x, y, spacing, buffer, side)
    first = tiles.groupBy(*key, "i", "j").agg(F.min("_part").alias("_part"))
    return first.select(*key, "i", "j", F.element_at(F.array(*map(F.lit, names)), F.col("_part") + 1).alias("part"))


def ahead(df: DataFrame, heading: Column, reach: Column, half_width: float, most: int) -> DataFrame:
    """df with a row for each tile (i east, j north of the row's own, most away at most) in a box that is turned with the
    heading (clockwise from north): reach ahead, half_width to either side, nothing behind."""
    grid = F.array(*[F.lit(i) for i in range(-most, most + 1)])
    df = df.withColumn("_h", heading).withColumn("_reach", reach).withColumn("i", F.explode(grid)).withColumn("j", F.explode(grid))
    dot = F.round(F.col("i") * F.sin("_h") + F.col("j") * F.cos("_h"), 9)
    beside = F.round(F.col("i") * F.cos("_h") - F.col("j") * F.sin("_h"), 9)
    return df.filter(dot.between(0, F.col("_reach")) & (F.abs(beside) <= half_width)).drop("_h", "_reach")


def soft_match(distance: Column, heading: Column, sigma: float, continues: Column, connected: Column, on_route: Column) -> Column:
    """Score of a candidate road: Gaussian in distance, cosine of heading, and factors for continuity, topology, route."""
    bonus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(1.0))
    return F.exp(-0.5 * F.pow(distance / sigma, 2)) * F.greatest(F.lit(0.0), F.cos(heading)) * bonus(continues, 1.4) * bonus(connected, 1.3) * bonus(on_route, 1.5)
