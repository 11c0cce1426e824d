"""Road data: versioned graphs, tiles, region packs, OSM extracts, encoded lines."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions.scalars import max_speed, one_way
from kinetra.session import shared_dir

NODES = "node_id string, position_enu_m array<double>, is_intersection boolean, has_traffic_signal boolean"
SEGMENTS = "edge_id string, start_node_id string, end_node_id string, centerline_enu_m array<array<double>>, allows_forward boolean, allows_reverse boolean, attributes struct<road_class string, source_way_id string, speed_limit_mps double, lane_count int, is_link boolean, is_tunnel boolean, is_bridge boolean, is_roundabout boolean>"
POINT = "struct<latitude: double, longitude: double>"
TILE = f"key struct<scheme: string, key: string>, bounds struct<minLat: double, maxLat: double, minLon: double, maxLon: double>, segments array<struct<id: string, name: string, startPoint: {POINT}, endPoint: {POINT}, lengthMeters: double, bearingDeg: double, directionality: string, oneWay: boolean, speedLimitMps: double, roadClass: string, startNodeId: string, endNodeId: string, geometry: array<{POINT}>>>, nodes array<struct<id: string, coordinate: {POINT}, connectedSegmentIds: array<string>>>"
SCHEMA_VERSION = 1


def safe_name(name: str) -> str:
    """A member's file name inside the graph's folder; anything that could leave it is an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
        raise ValueError(f"not a plain file name: {name!r}")
    return name


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, segments, manifest). Members are verified against the manifest's SHA-256 before they are parsed."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))
    if manifest.get("schema_version") != SCHEMA_VERSION or manifest.get("coordinate_frame") != "navigation_enu":
        raise ValueError("the manifest's version or frame is not supported")
    out = []
    for part, schema in (("nodes", NODES), ("segments", SEGMENTS)):
        name, expected = safe_name(manifest[f"{part}_filename"]), manifest[f"{part}_sha256"]
        if not re.fullmatch("[0-9a-f]{64}", expected):
            raise ValueError("a digest is 64 hexadecimal digits")
        found = spark.read.format("binaryFile").load(f"{folder}/{name}").select(F.sha2("content", 256).alias("h")).first().h
        if found != expected:
            raise ValueError(f"{name} does not have the checksum of the manifest")
        out.append(spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}"))
    return out[0], out[1], manifest


def load_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE).option("multiLine", "true").json(path)


BOUNDS = "struct<minLat: double, maxLat: double, minLon: double, maxLon: double>"
PACK = f"id string, bbox {BOUNDS}, tileScheme string, tiles array<struct<key: struct<scheme: string, key: string>, fileName: string, bounds: {BOUNDS}, segmentCount: int, nodeCount: int>>"


def load_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tiles, problems) of a region pack: a manifest and the tile files it lists.

    tiles are those without a problem. Problems (tile, problem): a listed tile without file, a file that is not listed,
    another scheme than the pack's, other numbers of segments or nodes than listed, bounds beyond those of the pack.
    """
    listed = spark.read.schema(PACK).option("multiLine", "true").json(f"{folder}/manifest.json").select("bbox", "tileScheme", F.explode("tiles").alias("m"))
    listed = listed.select(F.col("m.key.key").alias("tile"), F.lit(True).alias("_listed"), "bbox", "tileScheme", "m.segmentCount", "m.nodeCount")
    found = load_tiles(spark, f"{folder}/tiles").withColumn("tile", F.col("key.key"))
    j = listed.join(found, "tile", "full_outer")
    beyond = F.lit(False)
    for side in ("Lat", "Lon"):
        beyond = beyond | (F.col(f"bounds.max{side}") < F.col(f"bbox.min{side}")) | (F.col(f"bounds.min{side}") > F.col(f"bbox.max{side}"))
    why = F.when(F.col("key").isNull(), "no file").when(F.col("_listed").isNull(), "not listed").when(F.col("key.scheme") != F.col("tileScheme"), "scheme")
    why = why.when(F.size("segments") != F.col("segmentCount"), "segments").when(F.size("nodes") != F.col("nodeCount"), "nodes").when(beyond, "bounds")
    j = j.withColumn("problem", why)
    return j.filter("problem is null").select(*found.columns), j.filter("problem is not null").select("tile", "problem")


def tile_segments(tiles: DataFrame) -> DataFrame:
    """The bridge of tiles and segments: a segment may lie in several tiles."""
    return tiles.select(F.col("key.key").alias("tile"), F.explode("segments").alias("s")).select("tile", "s.*")


def osm_segments(elements: DataFrame) -> DataFrame:
    """Ways of an OSM extract (type, id, nodes, tags) as segments between neighbouring nodes."""
    ways = elements.filter("type = 'way' and tags['highway'] is not null and size(nodes) > 1")
    steps = ways.select("id", "tags", F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("a"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("b"))).alias("i", "n"))
    way = one_way(F.col("tags")["oneway"], F.col("tags")["junction"])
    return steps.select(F.concat_ws("-", "id", "i").alias("edge_id"), F.col("n.a").alias("start_node_id"), F.col("n.b").alias("end_node_id"), (way != "reverse").alias("allows_forward"), (way != "forward").alias("allows_reverse"), F.col("tags")["highway"].alias("road_class"), max_speed(F.col("tags")["maxspeed"]).alias("speed_limit_mps"))


def bucket_tiles(points: DataFrame, lat: str, lon: str, step: float, path: str) -> None:
    """Write rows partitioned by their tile key, so that later reads prune to the tiles they need."""
    from kinetra.functions.geodesy import tile_key

    points.withColumn("tile", tile_key(F.col(lat), F.col(lon), step)).write.partitionBy("tile").parquet(path)


def polyline(encoded: Column) -> Column:
    """Points of an encoded polyline, by a vectorised UDF: the code is a bit stream without a built-in decoder."""

    @F.pandas_udf("array<struct<latitude: double, longitude: double>>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_polyline)

    return decode(encoded)


def decode_polyline(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    values, value, shift = [], 0, 0
    for c in text:
        chunk = ord(c) - 63
        value |= (chunk & 31) << shift
        shift += 5
        if chunk < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    out, lat, lon = [], 0, 0
    for a, b in zip(values[::2], values[1::2], strict=False):
        lat, lon = lat + a, lon + b
        out.append({"latitude": lat / 1e5, "longitude": lon / 1e5})
    return out


ROUTE = f"id string, name string, points array<{POINT}>"


def parse_routes(lines: DataFrame) -> DataFrame:
    """Routes from JSON, with what is wrong: no id, fewer than two points, points out of range."""
    r = lines.select(F.from_json("value", ROUTE).alias("r")).select("r.*")
    bad = F.exists("points", lambda p: ~p["latitude"].between(-90, 90) | ~p["longitude"].between(-180, 180))
    why = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.coalesce(F.size("points"), F.lit(0)) < 2, "too few points").when(bad, "point out of range")
    return r.withColumn("problem", why)


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A CSV report: nested columns become JSON text, arrays of notes are joined."""
    cols = []
    for name, kind in df.dtypes:
        if kind == "array<string>":
            cols.append(F.array_join(name, " | ").alias(name))
        elif kind.startswith(("struct", "array", "map")):
            cols.append(F.to_json(name).alias(name))
        else:
            cols.append(F.col(name))
    df.select(*cols).write.csv(path, header=True)


def write_tiles(df: DataFrame, tile: str) -> DataFrame:
    """df written as Parquet with a folder for each tile, in the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}/tiles-{uuid.uuid4().hex[:12]}"
    df.repartition(tile).write.partitionBy(tile).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tile_manifest(tiles: DataFrame, tile: str, id_: str) -> DataFrame:
    """tile, rows, first and last id of each tile."""
    return tiles.groupBy(tile).agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"))
