"""Folds, streams, graphs, splits, contracts and sources on hand-made rows."""

import hashlib
import json
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra import schemas
from kinetra.functions import geodesy, quaternions, scalars
from kinetra.operators import features, folds, graph, joins, splits
from kinetra.operators import timeseries as ts
from kinetra.sources import recordings, roads, tables


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_geodesy_round_trip(spark):
    p = geodesy.ecef(F.lit(52.4), F.lit(-1.5), F.lit(90.0))
    back = one(spark, geodesy.from_ecef(p["x"], p["y"], p["z"]))
    assert back.lat == pytest.approx(52.4, abs=1e-9) and back.lon == pytest.approx(-1.5, abs=1e-9) and back.alt == pytest.approx(90, abs=1e-4)
    far, near = one(spark, geodesy.enu(F.lit(52.401), F.lit(-1.499), F.lit(0.0), 52.4, -1.5)), one(spark, geodesy.tangent(F.lit(52.401), F.lit(-1.499), 52.4, -1.5))
    assert far.e == pytest.approx(near.e, abs=0.02) and far.n == pytest.approx(near.n, abs=0.02)


def test_polyline_geometry(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))])
    assert one(spark, geodesy.polyline_length(line)) == 20
    assert tuple(one(spark, geodesy.nearest_on_polyline(F.lit(12.0), F.lit(4.0), line))) == (2.0, 14.0)


def test_slerp_is_halfway_and_takes_the_short_arc(spark):
    zero = F.lit(0.0)
    a = quaternions.quaternion(F.lit(1.0), zero, zero, zero)
    b = quaternions.from_rotation(quaternions.vector(zero, zero, F.lit(1.0)))
    minus = quaternions.quaternion(*(-b[k] for k in "wxyz"))
    for other in (b, minus):
        assert one(spark, quaternions.distance(quaternions.slerp(a, other, F.lit(0.5)), a)) == pytest.approx(0.5)
    g = one(spark, quaternions.remove_gravity(a, quaternions.vector(zero, zero, F.lit(9.80665))))
    assert tuple(g) == pytest.approx((0, 0, 0))


def test_tags_and_text(spark):
    assert one(spark, scalars.max_speed(F.lit("30 mph"))) == pytest.approx(13.4112)
    assert one(spark, scalars.max_speed(F.lit("walk"))) is None
    assert one(spark, scalars.one_way(F.lit("-1"), F.lit(None).cast("string"))) == "reverse"
    assert one(spark, scalars.camel_case(F.lit("min_lat_deg"))) == "minLatDeg"
    assert one(spark, scalars.strip_tags(F.lit("<b>a</b> <i>b</i>"))) == "a b"


def test_asof_ties_go_backward(spark):
    left = spark.createDataFrame([(1, 10), (1, 100)], "k int, t long")
    right = spark.createDataFrame([(1, 0, "a"), (1, 20, "b")], "k int, t long, v string")
    got = {r.t: r.v for r in ts.asof(left, right, ["k"], "t", ["v"], "nearest", 50).collect()}
    assert got == {10: "a", 100: None}


def test_pairing_is_one_to_one(spark):
    rows = [(1, 0, 1, "a"), (1, 5, 2, "b"), (1, 6, 3, "b"), (1, 40, 4, "a"), (1, 70, 5, "b"), (1, 75, 6, "a")]
    df = spark.createDataFrame(rows, "k int, t long, event_id long, event_type string")
    got = sorted(tuple(r)[1:] for r in folds.batch(df, folds.Pairing(10, "a", "b"), "k", ["t", "event_id"]).collect())
    assert got == [(1, 2, 5), (6, 5, 75)]


@pytest.mark.parametrize("files", [1, 4, 16])
def test_streams_equal_batch_whatever_the_files(spark, tmp_path, files):
    """Rows dealt to files at random: neither their order nor the cut into micro-batches loses or changes a row."""
    from kinetra.streaming import stateful

    rng = np.random.default_rng(files)
    rows = [(int(i), int(rng.integers(0, 400)), int(rng.integers(0, 5)), ["view", "click", "other"][int(rng.integers(0, 3))]) for i in range(300)]
    # Seconds of session time, several rows a second.
    df = spark.createDataFrame([(i, (86_400 + t) * 10**9, u, e, i % 7, float(i % 11), float(t)) for i, t, u, e in rows], "event_id long, t long, user_id long, event_type string, edge long, emission double, along double")
    df = df.withColumn("ts", F.timestamp_millis((F.col("t") / 1_000_000).cast("long")))
    for k in range(files):
        df.filter(F.pmod(F.xxhash64("event_id", F.lit(files)), F.lit(files)) == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1 if files < 16 else 5).parquet(str(tmp_path / "in"))
    for fold in (folds.Cadence(20 * 10**9), folds.Pairing(6 * 10**9, "view", "click"), folds.Viterbi(3, 30 * 10**9, 50.0)):
        if files == 4 or isinstance(fold, folds.Pairing):
            got = sorted(map(tuple, stateful.folded(stream, fold, "user_id", ["t", "event_id"], "ts").collect()))
            assert got and got == sorted(map(tuple, folds.batch(df, fold, "user_id", ["t", "event_id"]).collect()))


def test_streams_run_from_any_folder(tmp_path):
    """The package is found by all workers wherever the driver stands and however it came to the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom kinetra.session import local_session\nfrom kinetra.plans import catalog\nprint('rows', catalog.QUERIES['st_cadence_stream'](local_session('far', '2', 2), '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 0, done.stderr[-2000:]


def test_modes():
    m = folds.Mode(15, 2)
    rows = [(0, False, False), (1, True, True), (10, False, False), (16, False, False), (17, True, True), (18, True, True)]
    _, out = m.rows(m.initial(), iter({"t": t, "event_id": t, "fix": f, "accepted": a} for t, f, a in rows))
    assert [o[1] for o in out] == ["initialising", "aided", "aided", "dead_reckoning", "recovery", "aided"]


def test_filter_covariance_stays_symmetric_and_positive():
    f = folds.ErrorState()
    s, rng = f.initial(), np.random.default_rng(0)
    for k in range(200):
        row = {"t": k * 10**8, "event_id": k, "fix": k % 10 == 0, "px": 0.0, "py": 0.0, "pz": 0.0}
        row |= dict(zip(("ax", "ay", "az"), rng.normal(0, 0.1, 3), strict=True)) | dict(zip(("gx", "gy", "gz"), rng.normal(0, 0.01, 3), strict=True))
        s, _ = f.step(s, row)
        p = np.array(s["P"])
        assert np.allclose(p, p.T) and np.linalg.eigvalsh(p).min() > -1e-9
    assert np.linalg.norm(s["p"]) < 20


def test_filter_constant_acceleration_and_gate():
    f = folds.ErrorState()
    s = f.initial()
    for k in range(101):
        s, _ = f.step(s, {"t": k * 10**8, "event_id": k, "ax": 1.0, "ay": 0.0, "az": 0.0, "gx": 0.0, "gy": 0.0, "gz": 0.0, "fix": False})
    assert s["v"][0] == pytest.approx(10) and s["p"][0] == pytest.approx(50)
    assert f.correct(s, np.array([1e5, 0, 0]))[1] is False and f.correct(s, np.array([52.0, 0, 0]))[1] is True


def test_matrix_exponential():
    a = np.array([[0.0, 3.0], [-3.0, 0.0]])
    assert np.allclose(folds.matrix_exponential(a), [[math.cos(3), math.sin(3)], [-math.sin(3), math.cos(3)]])


def test_viterbi_prefers_continuity():
    v = folds.Viterbi(2, 100, 1.0)
    rows = [{"t": t, "edge": e, "emission": m, "along": a} for t, e, m, a in ((0, 1, 0.0, 0.0), (0, 2, -0.1, 50.0), (1, 1, -0.2, 1.0), (1, 2, 0.0, 90.0), (2, 1, 0.0, 2.0), (9999, 7, 0.0, 0.0))]
    s, out = v.rows(v.initial(), iter(rows))
    assert out + v.finish(s) == [(0, 1), (1, 1), (2, 1), (9999, 7)]


def test_shortest_path(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 9.0)], "source long, target long, length double")
    p = spark.createDataFrame([(1, 3), (1, 4), (2, 2), (4, 1)], "source long, target long")
    assert {(r.source, r.target): r.distance for r in graph.shortest(e, p, 8.0).collect()} == {(1, 3): 2.0, (1, 4): None, (2, 2): 0.0, (4, 1): None}


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 5, (200, 2)))]
    df = spark.createDataFrame(pts, "a long, x double, y double")
    got = {(r.a, r.b) for r in joins.within(df, df.withColumnRenamed("a", "b"), "a", "b", 0.7).collect()}
    assert got == {(i, j) for i, x, y in pts for j, u, v in pts if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 0.7}


def test_points_are_never_broadcast(spark):
    """The side of nine cells a point is far larger than the optimizer's estimate; at the edge of cells no pair is lost."""
    edge = float(np.nextafter(1.5, 0))
    df = spark.createDataFrame([(1, edge, 0.0), (2, 3.0, 0.0), (3, 3.1, 0.0)], "a int, x double, y double")
    out = joins.within(df, df.withColumnRenamed("a", "b"), "a", "b", 1.5)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b) for r in out.filter("a < b").collect()) == [(i, j) for i, x in ((1, edge), (2, 3.0)) for j, y in ((2, 3.0), (3, 3.1)) if i < j and y - x <= 1.5]


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(i % 37, float(i)) for i in range(500)], "g long, v double")
    for out, name in ((splits.balanced_folds(df, "g", 4), "fold"), (splits.deficit_split(df, "g", {"a": 0.7, "b": 0.3}), "split"), (splits.best_holdout(df, "g", "v", 0.2, 50), "held_out"), (splits.descriptor_folds(df, "g", "v", 3), "fold")):
        assert out.count() == 500 and out.groupBy("g").agg(F.countDistinct(name).alias("n")).filter("n > 1").count() == 0
    n = [r["count"] for r in splits.balanced_folds(df, "g", 4).groupBy("fold").count().collect()]
    assert max(n) - min(n) <= 14


def test_many_groups_are_dealt_like_single_ones(spark, monkeypatch):
    """Beyond GROUPS, sizes of splits are those of the greedy over the groups themselves."""
    rng = np.random.default_rng(5)
    sizes = [int(n) for n in np.concatenate([[90, 40, 40, 7], rng.geometric(0.2, 300), np.ones(200)])]
    df = spark.createDataFrame([(g if g else None,) for g, n in enumerate(sizes) for _ in range(n)], "g long")
    count = lambda out, name: sorted(tuple(r) for r in out.groupBy(name).agg(F.count("*"), F.countDistinct(F.struct("g"))).collect())
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    single = count(splits.balanced_folds(df, "g", 5), "fold"), count(splits.deficit_split(df, "g", shares), "split")
    monkeypatch.setattr(splits, "GROUPS", 10)
    folds_, split = splits.balanced_folds(df, "g", 5), splits.deficit_split(df, "g", shares)
    assert (count(folds_, "fold"), count(split, "split")) == single
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.6), (2, 1, 0.5), (2, 1, 0.4)], "k int, t long, p double")
    assert schemas.strictly_increasing(df, ["k"], ["t", "p"], "t").count() == 1
    assert schemas.unique(df, ["k", "t"]).count() == 1
    assert [r.k for r in schemas.sums_to_one(df, ["k"], "p").collect()] == [2]
    assert schemas.breaking(df, {"small": F.col("p") < 0.55}).first().broken == ["small"]


def test_records_and_quarantine(spark):
    good = {"timestamp_ns": 1, "source": "phone", "source_id": "a", "kind": "gyroscope", "x": 1.0, "y": 2.0, "z": 3.0, "unit": "rad/s", "frame": "sensor"}
    lines = spark.createDataFrame([(json.dumps(good),), ("{broken",), (json.dumps({k: v for k, v in good.items() if k != "unit"}),)], "value string")
    ok, bad = recordings.parse_records(lines)
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"malformed", "missing unit"}
    with pytest.raises(ValueError):
        recordings.find_column(["Speed a", "speed b"], "speed")


def test_paired_journey(spark, tmp_path):
    s = "TIME SINCE START (ms),ACCELEROMETER X (m/s²),ACCELEROMETER Y (m/s²),ACCELEROMETER Z (m/s²),GYROSCOPE Roll (rad/s),GYROSCOPE Pitch (rad/s),GYROSCOPE Yaw (rad/s),GPS LATITUDE,GPS LONGITUDE\n"
    s += "".join(f"{t},0,0,9.8,0,0,0,52,-1\n" for t in (0, 100, 100, 300)) + "400,x,0,9.8,0,0,0,52,-1\n"
    v = "Time Since Start of Day (seconds),Indicated Vehicle Speed (km/hr),Latitude (degrees),Longitude (degrees)\n" + "".join(f"{t},36,52,-1\n" for t in (50.0, 50.175, 50.2))
    (tmp_path / "S-j1.csv").write_bytes(s.encode("cp1252"))
    (tmp_path / "V-j1.csv").write_bytes(v.encode("cp1252"))
    (tmp_path / "S-j2.csv").write_bytes(s.encode("cp1252"))
    got = sorted((r.t // 10**6, r.speed) for r in recordings.aligned_journey(spark, str(tmp_path), "j1").collect())
    assert got == [(0, 10.0), (100, 10.0)]
    both, lonely = recordings.pairs(spark, str(tmp_path))
    assert [r.id for r in both.collect()] == ["j1"] and lonely.first().missing == "vehicle"
    assert recordings.inventory(spark, str(tmp_path)).first().files == 3


def write_graph(folder, tamper=False, name="nodes.jsonl"):
    nodes = "".join(json.dumps({"node_id": n, "position_enu_m": [0.0, 1.0], "is_intersection": False, "has_traffic_signal": False}) + "\n" for n in "ab")
    segments = json.dumps({"edge_id": "e", "start_node_id": "a", "end_node_id": "b", "centerline_enu_m": [[0.0, 0.0], [1.0, 1.0]], "allows_forward": True, "allows_reverse": False, "attributes": {"road_class": "primary"}}) + "\n"
    (folder / "nodes.jsonl").write_text(nodes + " " * tamper)
    (folder / "segments.jsonl").write_text(segments)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (folder / "manifest.json").write_text(json.dumps({"schema_version": 1, "coordinate_frame": "navigation_enu", "nodes_filename": name, "segments_filename": "segments.jsonl", "nodes_sha256": digest(nodes), "segments_sha256": digest(segments)}))


def test_graph_loader(spark, tmp_path):
    write_graph(tmp_path)
    nodes, segments, _ = roads.load_graph(spark, str(tmp_path))
    assert nodes.count() == 2 and segments.first().attributes.road_class == "primary"
    write_graph(tmp_path, tamper=True)
    with pytest.raises(ValueError, match="checksum"):
        roads.load_graph(spark, str(tmp_path))
    write_graph(tmp_path, name="../nodes.jsonl")
    with pytest.raises(ValueError, match="plain"):
        roads.load_graph(spark, str(tmp_path))


def test_roads(spark, tmp_path):
    points = roads.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@")
    assert [(p["latitude"], p["longitude"]) for p in points] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    df = spark.createDataFrame([("_p~iF~ps|U",), (None,)], "e string")
    assert [r.p is None for r in df.select(roads.polyline(F.col("e")).alias("p")).collect()] == [False, True]
    osm = spark.createDataFrame([("way", 7, [1, 2, 3], {"highway": "residential", "oneway": "yes", "maxspeed": "50"}), ("node", 1, None, None)], "type string, id long, nodes array<long>, tags map<string,string>")
    got = roads.osm_segments(osm).orderBy("edge_id").collect()
    assert [(r.edge_id, r.start_node_id, r.end_node_id, r.allows_reverse) for r in got] == [("7-0", 1, 2, False), ("7-1", 2, 3, False)]
    routes = spark.createDataFrame([(json.dumps({"id": "r", "points": [{"latitude": 1, "longitude": 2}, {"latitude": 99, "longitude": 2}]}),), (json.dumps({"id": ""}),)], "value string")
    assert {r.problem for r in roads.parse_routes(routes).collect()} == {"point out of range", "no id"}
    roads.report_csv(spark.createDataFrame([(1, ["a", "b"], {"k": 1})], "i int, notes array<string>, m map<string,int>"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().notes == "a | b"


def run(fold, rows):
    state, out = fold.rows(fold.initial(), iter(rows))
    return out + fold.finish(state)


def test_calibration_states():
    m = folds.Calibration(5.0, 3, 100)
    evidence = [10.0, 11.0, 12.0, None, 40.0, 41.0, 42.0, 41.0, None]
    times = [0, 10, 20, 30, 40, 50, 60, 70, 300]
    out = run(m, [{"t": t, "event_id": i, "evidence": e} for i, (t, e) in enumerate(zip(times, evidence, strict=True))])
    assert [o[1] for o in out] == ["warming", "warming", "tracking", "tracking", "recalibrating", "recalibrating", "tracking", "tracking", "degraded"]
    assert out[2][2] == pytest.approx(11.0) and out[6][2] == pytest.approx(41.0)


def test_orientation_follows_rates_and_gravity():
    m = folds.Orientation(0.2)
    still = [{"t": k * 10**8, "event_id": k, "ax": 0.0, "ay": 0.0, "az": 9.80665, "gx": 0.0, "gy": 0.0, "gz": math.pi / 20} for k in range(101)]
    w, x, y, z = run(m, still)[-1][1:]
    assert (x, y) == pytest.approx((0, 0), abs=1e-9) and 2 * math.atan2(z, w) == pytest.approx(math.pi / 2, abs=1e-6)
    tilted = [{**r, "ax": 9.80665 * math.sin(0.3), "az": 9.80665 * math.cos(0.3), "gz": 0.0} for r in still]
    q = np.array(run(m, tilted)[-1][1:])
    assert folds._matrix(q).T @ np.array([0, 0, 1.0]) == pytest.approx([math.sin(0.3), 0, math.cos(0.3)], abs=1e-3)


def test_route_progress_never_falls_and_penalises_going_back():
    rows = [([0.0, 50.0], [1.0, 2.0]), ([30.0, 10.0], [5.0, 4.0]), ([60.0, 5.0], [40.0, 1.0]), ([], [])]
    out = run(folds.RouteProgress(20.0, 100.0), [{"event_id": i, "alongs": a, "offsets": o} for i, (a, o) in enumerate(rows)])
    assert [o[1] for o in out] == [0.0, 10.0, 10.0, 10.0]
    out = run(folds.RouteProgress(2.0, 100.0), [{"event_id": i, "alongs": a, "offsets": o} for i, (a, o) in enumerate(rows)])
    assert [o[1] for o in out] == [0.0, 10.0, 60.0, 60.0]


def test_recovery_needs_two_fixes_that_agree():
    rows = [(0, 0, 0), (5, 1, 1), (40, 500, 0), (41, 900, 0), (42, 910, 0), (43, 911, 0)]
    out = run(folds.Recovery(15, 80.0), [{"t": t, "event_id": t, "fix": True, "x": x, "y": y} for t, x, y in rows])
    assert [o[1] for o in out] == ["aided", "aided", "pending", "pending", "reinitialised", "aided"]


def test_low_pass_keeps_slow_and_drops_fast():
    t = np.arange(400) / 10
    slow, fast = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 4 * t)
    out = features.low_pass(slow + fast, 10.0, 1.0)
    assert np.abs(out - slow)[40:-40].max() < 0.02
    assert features.low_pass(np.full(50, 3.0), 10.0, 2.0) == pytest.approx(np.full(50, 3.0))


def test_low_frequency_share(spark):
    t = np.arange(50) / 10
    rows = [([float(x) for x in np.sin(2 * np.pi * f * t)],) for f in (1.0, 4.0)] + [([2.0] * 50,), ([float(x) for x in np.sin(2 * np.pi * 1.0 * t) + np.sin(2 * np.pi * 4.0 * t)],)]
    got = [r.s for r in spark.createDataFrame(rows, "w array<double>").coalesce(1).select(features.low_frequency_share(F.col("w"), 10.0, 3.0).alias("s")).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.5], abs=1e-6)


def test_tick_applies_updates_in_order_and_follows_them():
    m = folds.Tick({"forward": 0.1, "yaw": 0.01, "nhc": 0.1, "road": 1.0, "route": 1.0}, gate=1e9)
    rows = [{"t": k * 10**8, "event_id": k, "ax": 0.0, "ay": 0.0, "az": 0.0, "gx": 0.0, "gy": 0.0, "gz": 0.0, "forward": 10.0, "yaw": 0.5, "nhc": True, "road_nx": -math.sin(0.5), "road_ny": math.cos(0.5), "road_at": 2.0, "route_nx": None, "route_ny": None, "route_at": None} for k in range(100)]
    state, out = m.rows(m.initial(), iter(rows))
    assert out[-1][4] == "propagate,forward,yaw,nhc,road" and out[-1][3] == pytest.approx(10.0, abs=0.2)
    assert np.array(state["v"][:2]) == pytest.approx([10 * math.cos(0.5), 10 * math.sin(0.5)], abs=0.3)
    assert -math.sin(0.5) * state["p"][0] + math.cos(0.5) * state["p"][1] == pytest.approx(2.0, abs=0.3)
    cov = np.array(state["P"])
    assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0
    rows[5]["forward"], rows[5]["nhc"] = None, False
    assert m.rows(m.initial(), iter(rows[:6]))[1][-1][4] == "propagate,yaw,road"


def test_splits_are_those_of_single_groups(spark, monkeypatch):
    """Greedy assignments and random holdouts against plain Python over the groups themselves."""
    rng = np.random.default_rng(1)
    rows = [(f"g{int(g):03}", float(v)) for g, v in zip(np.minimum(rng.geometric(0.05, 1500), 60), rng.normal(10, 3, 1500), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    sizes, sums, squares = {}, {}, {}
    for g, v in rows:
        sizes[g], sums[g], squares[g] = sizes.get(g, 0) + 1, sums.get(g, 0) + v, squares.get(g, 0) + v * v
    names = sorted(sizes)
    tie = {names[i]: rank for rank, i in enumerate(np.random.default_rng(42).permutation(len(names)))}
    load, count, fold = [0] * 4, [0] * 4, {}
    for g in sorted(names, key=lambda g: (-sizes[g], tie[g])):
        k = min(range(4), key=lambda k: (load[k], count[k], k))
        fold[g], load[k], count[k] = k, load[k] + sizes[g], count[k] + 1
    assert {r.g: r.fold for r in splits.balanced_folds(df, "g", 4).select("g", "fold").distinct().collect()} == fold
    shares, held, split = {"a": 0.7, "b": 0.3}, {"a": 0, "b": 0}, {}
    for g in sorted(names, key=lambda g: -sizes[g]):
        split[g] = max(shares, key=lambda s: shares[s] * len(rows) - held[s])
        held[split[g]] += sizes[g]
    assert {r.g: r.split for r in splits.deficit_split(df, "g", shares).select("g", "split").distinct().collect()} == split
    even, where = np.zeros((3, 2)), {}
    whole = np.array([len(rows), sum(sums.values())])
    for g in sorted(names, key=lambda g: -sizes[g]):
        mine = np.array([sizes[g], sums[g]])
        where[g] = int(np.argmin([(((even[f] + mine) / whole) ** 2).sum() - ((even[f] / whole) ** 2).sum() for f in range(3)]))
        even[where[g]] += mine
    assert {r.g: r.fold for r in splits.descriptor_folds(df, "g", "v", 3).select("g", "fold").distinct().collect()} == where
    picks = np.random.default_rng(42)
    v, best = np.array([x for _, x in rows]), (np.inf, None)
    for _ in range(60):
        chosen = {g for g, p in zip(names, picks.random(len(names)) < 0.2, strict=True) if p}
        inside = np.array([g in chosen for g, _ in rows])
        if inside.any() and not inside.all():
            score = abs(inside.mean() - 0.2) / 0.2 + (abs(v[inside].mean() - v.mean()) + abs(v[inside].std() - v.std())) / v.std()
            best = min(best, (score, tuple(sorted(chosen))))
    got = splits.best_holdout(df, "g", "v", 0.2, 60).filter("held_out").select("g").distinct().collect()
    assert tuple(sorted(r.g for r in got)) == best[1]
    monkeypatch.setattr(splits, "GROUPS", 10)
    bundled = splits.balanced_folds(df, "g", 4).groupBy("g").agg(F.countDistinct("fold").alias("n"))
    assert {r.n for r in bundled.collect()} == {1}


def test_journey_by_dates(spark, tmp_path):
    s = "DATE (YYYY-MO-DD HH-MI-SS_SSS),ACCELEROMETER X (m/s²),ACCELEROMETER Y (m/s²),ACCELEROMETER Z (m/s²),GYROSCOPE Roll (rad/s),GYROSCOPE Pitch (rad/s),GYROSCOPE Yaw (rad/s),GPS LATITUDE,GPS LONGITUDE,GPS SPEED (Kmh)\n"
    s += "".join(f"2020-01-02 03:04:{t},0,0,9.8,0,0,0,52,-1,7\n" for t in ("05:000", "05:100", "05:100", "06:500")) + "no date,0,0,9.8,0,0,0,52,-1,7\n"
    v = "Time Since Start of Day (seconds),Indicated Vehicle Speed (km/hr),Latitude (degrees),Longitude (degrees)\n" + "".join(f"{t},36,52,-1\n" for t in (50.0, 50.175, 50.2))
    (tmp_path / "S-j1.csv").write_bytes(s.encode("cp1252"))
    (tmp_path / "V-j1.csv").write_bytes(v.encode("cp1252"))
    got = sorted((r.t // 10**6, r.speed, r.gps_speed) for r in recordings.aligned_journey(spark, str(tmp_path), "j1", clock="date").collect())
    assert got == [(0, 10.0, 7.0), (100, 10.0, 7.0)]


def test_clean_tables_windows_and_fixtures(spark, tmp_path):
    df = spark.createDataFrame([("a", i * 10**8, float(i), -float(i)) for i in range(5)] + [("b", 7 * 10**9, 1.5, None)], "s string, t long, x double, y double")
    schema = "s string, t long, x double, y double"
    for kind in ("csv", "parquet"):
        tables.write_clean(df, str(tmp_path / "clean"), kind)
        assert sorted(map(tuple, tables.read_clean(spark, str(tmp_path / "clean"), schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    w = ts.count_windows(df.filter("s = 'a'"), ["s"], ["t"], ["x"], 3)
    tables.write_windows(w.select("t", "x_window"), str(tmp_path / "windows"))
    assert [r.x_window for r in spark.read.parquet(str(tmp_path / "windows")).orderBy("t").collect()] == [[0.0, 1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]
    with pytest.raises(ValueError):
        tables.write_windows(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), str(tmp_path / "bad"))
    got = [(r.s, json.loads(r.record)) for r in tables.fixtures(df, "s", "t", 2, {"accel": ["x", "y"]}).orderBy("s", "index").collect()]
    assert got[1] == ("a", {"index": 1, "relative_time_ms": 100.0, "accel": {"x": 1.0, "y": -1.0}}) and len(got) == 3 and got[2][1]["accel"] == {"x": 1.5}


def test_asof_of_equal_right_times_takes_the_least_values(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 20)], "k int, t long")
    right = spark.createDataFrame([(1, 10, v) for v in (3.0, 1.0, 2.0)] * 2, "k int, t long, v double").repartition(4)
    for direction, expected in (("backward", [None, 1.0, 1.0]), ("forward", [1.0, 1.0, None]), ("nearest", [1.0, 1.0, 1.0])):
        assert [r.v for r in ts.asof(left, right, ["k"], "t", ["v"], direction).orderBy("t").collect()] == expected


def test_region_pack(spark, tmp_path):
    def tile(key, segments, lat=1.0, scheme="deg"):
        return {"key": {"scheme": scheme, "key": key}, "bounds": {"minLat": lat, "maxLat": lat + 0.1, "minLon": 0.0, "maxLon": 0.1}, "segments": [{"id": f"s{i}"} for i in range(segments)], "nodes": []}

    made = {"a": tile("a", 2), "b": tile("b", 1), "c": tile("c", 1, lat=9.0), "d": tile("d", 1, scheme="other"), "e": tile("e", 1)}
    (tmp_path / "tiles").mkdir()
    for key, t in made.items():
        (tmp_path / "tiles" / f"{key}.json").write_text(json.dumps(t))
    counts = {"a": 2, "b": 5, "c": 1, "d": 1, "f": 1}
    entries = [{"key": {"scheme": "deg", "key": k}, "fileName": f"tiles/{k}.json", "segmentCount": n, "nodeCount": 0} for k, n in counts.items()]
    (tmp_path / "manifest.json").write_text(json.dumps({"id": "p", "bbox": {"minLat": 0.0, "maxLat": 2.0, "minLon": 0.0, "maxLon": 1.0}, "tileScheme": "deg", "tiles": entries}))
    tiles_, problems = roads.load_pack(spark, str(tmp_path))
    assert [r.key.key for r in tiles_.collect()] == ["a"]
    assert {tuple(r) for r in problems.collect()} == {("b", "segments"), ("c", "bounds"), ("d", "scheme"), ("e", "not listed"), ("f", "no file")}
