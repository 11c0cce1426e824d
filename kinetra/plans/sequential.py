"""State machines, graphs and geometry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra import schemas
from kinetra.functions import angles, geodesy, quaternions, scalars
from kinetra.operators import aggregates as ag
from kinetra.operators import folds, graph
from kinetra.operators import timeseries as ts
from kinetra.plans.registry import DAY, HOUR, ORDER, query, stream
from kinetra.session import table


@query("""WITH RECURSIVE $EV, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
kept(user_id, i, t, event_id) AS (SELECT user_id, i, t, event_id FROM r WHERE i = 1 UNION ALL
 SELECT n.user_id, n.i, n.t, n.event_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY r.i) AS q FROM kept k JOIN r ON r.user_id = k.user_id AND r.i > k.i AND r.t - k.t >= 24 * $HOUR) n WHERE q = 1)
SELECT user_id, event_id FROM kept""")
def w3_cadence_sampling(spark, d):
    return folds.batch(stream(spark, d), folds.Cadence(24 * HOUR), "user_id", ORDER)


@query("""WITH RECURSIVE $EV, r AS (SELECT user_id, event_id, t, value AS x, CAST(k AS DOUBLE) AS y, k * 3.6 AS h, value / 10 AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
s(user_id, i, event_id, reason, x, y, h, v, t) AS (SELECT user_id, i, event_id, 'first', x, y, h, v, t FROM r WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, why, CASE WHEN why IS NULL THEN px ELSE x END, CASE WHEN why IS NULL THEN py ELSE y END, CASE WHEN why IS NULL THEN ph ELSE h END, CASE WHEN why IS NULL THEN pv ELSE v END, CASE WHEN why IS NULL THEN pt ELSE t END FROM
 (SELECT r.*, s.x AS px, s.y AS py, s.h AS ph, s.v AS pv, s.t AS pt, CASE WHEN sqrt(pow(r.x - s.x, 2) + pow(r.y - s.y, 2)) >= 80 THEN 'distance' WHEN abs(r.h - s.h) >= 250 THEN 'heading' WHEN abs(r.v - s.v) >= 10 THEN 'speed' WHEN r.t - s.t >= 5 * $DAY THEN 'time' END AS why FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, event_id, reason FROM s WHERE reason IS NOT NULL""")
def p12_coverage_coalescing(spark, d):
    df = stream(spark, d).withColumns({"x": F.col("value"), "y": F.col("k").cast("double"), "heading": (F.col("k") * 3.6), "speed": F.col("value") / 10})
    return folds.batch(df, folds.Coalesce(80.0, 250.0, 10.0, 5 * DAY), "user_id", ORDER)


@query()
def j2_greedy_pairing(spark, d):
    return folds.batch(stream(spark, d), folds.Pairing(12 * HOUR, "view", "click"), "user_id", ORDER)


@query("""WITH RECURSIVE $EV, r AS (SELECT *, event_type = 'view' AS fix, value < 100 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
s(user_id, i, event_id, mode, seen, streak) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'initialising', CAST(NULL AS BIGINT), CAST(0 AS INT) FROM r WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, CASE WHEN fix AND ok THEN CASE WHEN mode IN ('dead_reckoning', 'recovery') AND run < 2 THEN 'recovery' ELSE 'aided' END WHEN quiet THEN 'dead_reckoning' ELSE mode END, CASE WHEN fix AND ok THEN t ELSE seen END, CASE WHEN NOT (fix AND ok) AND quiet THEN 0 ELSE run END FROM
 (SELECT r.user_id, r.i, r.event_id, r.t, r.fix, r.ok, s.mode, s.seen, coalesce(r.t - s.seen >= 48 * $HOUR, false) AS quiet, CAST(CASE WHEN r.fix AND r.ok THEN s.streak + 1 WHEN r.fix THEN 0 ELSE s.streak END AS INT) AS run FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, event_id, mode, streak FROM s WHERE i > 0""")
def w17_navigation_modes(spark, d):
    df = stream(spark, d).withColumns({"fix": F.col("event_type") == "view", "accepted": F.col("value") < 100})
    return folds.batch(df, folds.Mode(48 * HOUR, 2), "user_id", ORDER)


@query()
def w13_w14_calibration_states(spark, d):
    df = stream(spark, d).withColumn("evidence", F.when(F.col("event_type") == "view", F.col("value")))
    return folds.batch(df, folds.Calibration(40.0, 4, 100 * HOUR), "user_id", ORDER)


def _imu(spark, d):
    v, k = F.col("value") / 100, F.col("k") / 100.0
    return stream(spark, d).withColumns({"ax": v - 0.5, "ay": k - 0.5, "az": F.lit(9.8), "gx": (k - 0.5) / 1e4, "gy": (v - 0.5) / 1e4, "gz": F.lit(0.0), "fix": F.col("event_type") == "view", "px": F.col("value"), "py": F.col("k").cast("double"), "pz": F.lit(0.0)})


@query()
def w15_orientation_filter(spark, d):
    return folds.batch(_imu(spark, d), folds.Orientation(0.05), "user_id", ORDER)


@query()
def w16_error_state_filter(spark, d):
    """Time is scaled so that hours between events are seconds between samples."""
    df = _imu(spark, d).withColumns({"t": (F.col("t") / 3600).cast("long"), "az": F.lit(0.0)})
    return folds.batch(df, folds.ErrorState(fix=30.0, longest=60.0), "user_id", ["t", "event_id"])


@query()
def w19_incremental_viterbi(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("trip"), F.col("l_orderkey").alias("t"), F.col("l_partkey").alias("edge"), (-F.col("l_discount") * 10).alias("emission"), F.col("l_quantity").alias("along")).distinct()
    return folds.batch(df, folds.Viterbi(4, 500, 10.0), "trip", ["t", "edge", "emission", "along"])


@query()
def w21_route_progress(spark, d):
    df = stream(spark, d).withColumns({"alongs": F.array(F.col("k") * 1.0, F.col("value")), "offsets": F.array(F.col("value") / 10, F.col("k") / 10.0)})
    return folds.batch(df, folds.RouteProgress(20.0, 100.0), "user_id", ORDER)


@query("""WITH RECURSIVE $EV, r AS (SELECT user_id, event_id, k * 3.6 AS h, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
s(user_id, i, event_id, smooth) AS (SELECT user_id, i, event_id, CAST(h AS DOUBLE) FROM r WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, x - 360 * floor(x / 360) FROM (SELECT r.user_id, r.i, r.event_id, s.smooth + 0.35 * ((r.h - s.smooth + 540) - 360 * floor((r.h - s.smooth + 540) / 360) - 180) AS x FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, event_id, round(smooth + 1e-9, 6) AS smooth FROM s""")
def x24_heading_average(spark, d):
    out = folds.batch(stream(spark, d).withColumn("heading", F.col("k") * 3.6), folds.Smoothed(0.35), "user_id", ORDER)
    return out.select("user_id", "event_id", F.round(F.col("smooth") + 1e-9, 6).alias("smooth"))


@query("""WITH RECURSIVE $EV, r AS (SELECT user_id, event_id, t, value / 1e5 AS a, event_type = 'error' AS still, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
s(user_id, i, event_id, t, v) AS (SELECT user_id, i, event_id, t, CAST(0 AS DOUBLE) FROM r WHERE i = 1 UNION ALL
 SELECT r.user_id, r.i, r.event_id, r.t, CASE WHEN r.still THEN 0.0 ELSE greatest(0.0, (s.v + r.a * ((r.t - s.t) / 1e9)) * exp(-1e-5 * ((r.t - s.t) / 1e9))) END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, event_id, round(v, 5) AS speed FROM s""")
def x29_kinematic_baseline(spark, d):
    df = stream(spark, d).withColumns({"a": F.col("value") / 1e5, "still": F.col("event_type") == "error"})
    return folds.batch(df, folds.Kinematic(1e-5), "user_id", ORDER).select("user_id", "event_id", F.round("speed", 5).alias("speed"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS source, (l_partkey * 7) % 100 AS target, 1.0 + (l_partkey % 10) AS length FROM lineitem)"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), ((F.col("l_partkey") * 7) % 100).alias("target"), (1.0 + F.col("l_partkey") % 10).alias("length")).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, m AS (SELECT source, target, min(length) AS length FROM e GROUP BY 1, 2),
p(origin, node, far) AS (SELECT DISTINCT source, source, CAST(0.0 AS DOUBLE) FROM m UNION SELECT p.origin, m.target, p.far + m.length FROM p JOIN m ON m.source = p.node WHERE p.far + m.length <= 4),
q AS (SELECT DISTINCT l_suppkey AS source, (l_partkey * 13) % 100 AS target FROM lineitem)
SELECT q.source, q.target, min(far) AS distance FROM q LEFT JOIN p ON p.origin = q.source AND p.node = q.target GROUP BY 1, 2""")
def r1_bounded_shortest_path(spark, d):
    """For every pair of nodes that a line item asks for."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), ((F.col("l_partkey") * 13) % 100).alias("target")).distinct()
    return graph.shortest(_edges(spark, d), pairs, 4.0)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_partkey % 3 = 0 AND l_tax >= l_discount THEN l_tax - l_discount ELSE 1 - l_discount + l_quantity + l_tax END, 6) AS distance FROM lineitem""")
def r2_snapped_route_distance(spark, d):
    l = table(spark, d, "lineitem")
    dist = graph.snapped_distance(F.col("l_partkey") % 3 == 0, F.col("l_discount"), F.col("l_tax"), F.lit(1.0), F.col("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(dist, 6).alias("distance"))


def _segments(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), (F.col("p_partkey") % 40).alias("start_node_id"), ((F.col("p_partkey") * 3 + 1) % 45).alias("end_node_id"), (F.col("p_size") % 2 == 0).alias("allows_forward"), (F.col("p_size") % 3 == 0).alias("allows_reverse"), F.col("p_retailprice").alias("length"))


_SEG = "s AS (SELECT p_partkey AS edge_id, p_partkey % 40 AS a, (p_partkey * 3 + 1) % 45 AS b, p_size % 2 = 0 AS f, p_size % 3 = 0 AS r, p_retailprice AS length FROM part)"


@query(f"""WITH {_SEG} SELECT edge_id, 'unknown endpoint' AS problem FROM s WHERE a >= 40 OR b >= 40 UNION ALL SELECT edge_id, 'no legal direction' FROM s WHERE NOT f AND NOT r""")
def r3_graph_validation(spark, d):
    nodes = spark.range(40).withColumnRenamed("id", "node_id")
    return graph.problems(nodes, _segments(spark, d))


@query(f"""WITH {_SEG} SELECT edge_id, 'forward' AS direction, a AS source, b AS target FROM s WHERE f UNION ALL SELECT edge_id, 'reverse', b, a FROM s WHERE r""")
def r4_traversal_expansion(spark, d):
    return graph.traversals(_segments(spark, d)).select("edge_id", "direction", "source", "target")


@query(f"""WITH {_SEG}, n AS (SELECT DISTINCT edge_id, unnest([a, b]) AS node_id FROM s) SELECT node_id, count(*) AS degree, count(*) >= 2 AS is_intersection FROM n GROUP BY 1""")
def a36_r5_node_degrees(spark, d):
    return graph.degrees(_segments(spark, d))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_retailprice / 100 AS x, CAST(p_size AS DOUBLE) AS y FROM part), l AS (SELECT *, coalesce(lead(x) OVER w, x) AS x1, coalesce(lead(y) OVER w, y) AS y1 FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
n AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) / 2.0) AS INT)) AS n FROM l), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n), q AS (SELECT p_brand, x + (x1 - x) * k / n AS px, y + (y1 - y) * k / n AS py FROM k)
SELECT p_brand, count(*) AS tiles FROM (SELECT DISTINCT p_brand, i, unnest(range(CAST(floor((py - 1) / 5) AS BIGINT), CAST(floor((py + 1) / 5) AS BIGINT) + 1)) AS j FROM (SELECT p_brand, py, unnest(range(CAST(floor((px - 1) / 5) AS BIGINT), CAST(floor((px + 1) / 5) AS BIGINT) + 1)) AS i FROM q)) GROUP BY 1""")
def r6_corridor_tiles(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 100).alias("x"), F.col("p_size").cast("double").alias("y"))
    return graph.corridor(p, ["p_brand"], "p_partkey", "x", "y", 2.0, 1.0, 5.0).groupBy("p_brand").agg(F.count("*").alias("tiles"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_retailprice / 100 AS x, CAST(p_size AS DOUBLE) AS y, row_number() OVER w AS n, count(*) OVER (PARTITION BY p_brand) AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
z AS (SELECT *, unnest(['active', 'forward', 'rear']) AS part FROM p), u AS (SELECT * FROM z WHERE CASE part WHEN 'active' THEN 3 * n BETWEEN c AND 2 * c WHEN 'forward' THEN 3 * n >= 2 * c ELSE 3 * n <= c END),
l AS (SELECT *, coalesce(lead(x) OVER w, x) AS x1, coalesce(lead(y) OVER w, y) AS y1 FROM u WINDOW w AS (PARTITION BY p_brand, part ORDER BY p_partkey)),
n AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) / 2.0) AS INT)) AS m FROM l), k AS (SELECT *, unnest(range(0, m + 1)) AS k FROM n), q AS (SELECT p_brand, part, x + (x1 - x) * k / m AS px, y + (y1 - y) * k / m AS py FROM k),
t AS (SELECT DISTINCT p_brand, part, i, unnest(range(CAST(floor((py - 1) / 5) AS BIGINT), CAST(floor((py + 1) / 5) AS BIGINT) + 1)) AS j FROM (SELECT p_brand, part, py, unnest(range(CAST(floor((px - 1) / 5) AS BIGINT), CAST(floor((px + 1) / 5) AS BIGINT) + 1)) AS i FROM q))
SELECT p_brand, i, j, min(part) AS part FROM t GROUP BY 1, 2, 3""")
def r7_coverage_plan(spark, d):
    """Tiles of a route by the first of its parts that touches them: around the vehicle, ahead of it, behind it."""
    w = Window.partitionBy("p_brand")
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 100).alias("x"), F.col("p_size").cast("double").alias("y"), F.row_number().over(w.orderBy("p_partkey")).alias("n"), F.count("*").over(w).alias("c"))
    n, c = F.col("n"), F.col("c")
    return graph.coverage(p, ["p_brand"], "p_partkey", "x", "y", {"active": (3 * n).between(c, 2 * c), "forward": 3 * n >= 2 * c, "rear": 3 * n <= c}, 2.0, 1.0, 5.0)


@query("""WITH $EV, g AS (SELECT unnest(range(-6, 7)) AS i), h AS (SELECT unnest(range(-6, 7)) AS j), p AS (SELECT event_id, i, j, round(i * sin(radians(k * 3.6)) + j * cos(radians(k * 3.6)), 9) AS ahead, round(i * cos(radians(k * 3.6)) - j * sin(radians(k * 3.6)), 9) AS beside, greatest(1.0, least(5.0, value / 20)) AS reach FROM ev, g, h)
SELECT event_id, count(*) AS tiles, min(i) AS west, max(i) AS east, min(j) AS south, max(j) AS north FROM p WHERE ahead BETWEEN 0 AND reach AND abs(beside) <= 1.5 GROUP BY 1""")
def r8_free_drive_plan(spark, d):
    """Tiles of a box turned with the heading that reaches farther at speed: the half plane ahead, by the dot product."""
    df = stream(spark, d).withColumn("reach", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("value") / 20)))
    t = graph.ahead(df, F.radians(F.col("k") * 3.6), F.col("reach"), 1.5, 6)
    return t.groupBy("event_id").agg(F.count("*").alias("tiles"), *[f(c).cast("long").alias(n) for n, f, c in (("west", F.min, "i"), ("east", F.max, "i"), ("south", F.min, "j"), ("north", F.max, "j"))])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, exp(-0.5 * pow(l_quantity / 25, 2)) * greatest(0.0, cos(l_discount * 10)) * (CASE WHEN l_linestatus = 'F' THEN 1.4 ELSE 1.0 END) * (CASE WHEN l_returnflag = 'A' THEN 1.3 ELSE 1.0 END) * (CASE WHEN l_tax > 0.04 THEN 1.5 ELSE 1.0 END) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s / sum(s) OVER (PARTITION BY l_orderkey), 6) AS probability FROM s""")
def r9_soft_matcher(spark, d):
    l = table(spark, d, "lineitem")
    s = graph.soft_match(F.col("l_quantity"), F.col("l_discount") * 10, 25.0, F.col("l_linestatus") == "F", F.col("l_returnflag") == "A", F.col("l_tax") > 0.04)
    return l.withColumn("s", s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("l_orderkey")), 6).alias("probability"))


@query("""SELECT event_id, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(value / 1000) / 2), 2) + cos(radians(52)) * cos(radians(52 + value / 1000)) * pow(sin(radians(0.01) / 2), 2)))), 3) AS metres,
 concat_ws(':', 'deg', '100', CAST(floor((52 + value / 1000) * 100) AS BIGINT), CAST(floor(-1.5 * 100) AS BIGINT)) AS tile FROM events""")
def f_geodesy(spark, d):
    df = table(spark, d, "events").withColumn("lat", 52 + F.col("value") / 1000)
    return df.select("event_id", F.round(geodesy.haversine(F.lit(52.0), F.lit(-1.5), F.col("lat"), F.lit(-1.49)), 3).alias("metres"), geodesy.tile_key(F.col("lat"), F.lit(-1.5), 0.01).alias("tile"))


@query("""WITH $EV, a AS (SELECT event_id, k * 3.6 AS h, value FROM ev) SELECT event_id, round((h - value + 180) - 360 * floor((h - value + 180) / 360) - 180, 6) AS signed, round(abs((h - value + 180) - 360 * floor((h - value + 180) / 360) - 180), 6) AS unsigned FROM a""")
def f_angles(spark, d):
    h, v = F.col("k") * 3.6, F.col("value")
    return stream(spark, d).select("event_id", F.round(angles.difference(h, v, 360.0), 6).alias("signed"), F.round(angles.separation(h, v, 360.0), 6).alias("unsigned"))


@query("""WITH $EV SELECT event_id, round(cos(value / 100), 6) AS x, round(sin(value / 100), 6) AS y, 0.0 AS z, round(2 * acos(least(1.0, abs(cos(value / 200)))), 6) AS turned FROM ev""")
def f_quaternions(spark, d):
    """A turn about z by value / 100: the rotated x axis, and the angle to the identity."""
    zero = F.lit(0.0)
    q = quaternions.from_rotation(quaternions.vector(zero, zero, F.col("value") / 100))
    v = quaternions.rotate(q, quaternions.vector(F.lit(1.0), zero, zero))
    one = quaternions.quaternion(F.lit(1.0), zero, zero, zero)
    return stream(spark, d).select("event_id", F.round(v["x"], 6).alias("x"), F.round(v["y"], 6).alias("y"), F.round(v["z"], 6).alias("z"), F.round(quaternions.distance(q, one), 6).alias("turned"))


@query("""SELECT p_partkey, round(-0.5 * pow((p_retailprice - 1500) / p_size, 2) - ln(p_size) - 0.5 * ln(2 * pi()), 4) AS loglik, round((4 * p_size * p_size - 2 * p_size * 3 + 2 * 9) / 7.0, 6) AS m2, round(3 + sqrt(1 + 1), 6) AS eig,
 round(CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 1 + (p_size - 10) * 0.1 ELSE 3 END, 6) AS sched FROM part""")
def f_likelihoods(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(scalars.gaussian_log_likelihood(F.col("p_retailprice") - 1500, s), 4).alias("loglik"), F.round(scalars.mahalanobis2(s, F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(4.0)), 6).alias("m2"), F.round(scalars.largest_eigenvalue(F.lit(2.0), F.lit(1.0), F.lit(4.0)), 6).alias("eig"), F.round(scalars.schedule(s, [(10.0, 1.0), (30.0, 3.0)]), 6).alias("sched"))


@query("""SELECT c_mktsegment, coalesce(nullif(lower(trim(c_mktsegment)), ''), '<unknown>') AS category, count(*) AS n FROM customer GROUP BY 1, 2""")
def f_category(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment", scalars.category(F.col("c_mktsegment")).alias("category")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM t WHERE p_type <> 'PROMO') SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN c USING (p_type)""")
def f_category_codes(spark, d):
    """Sorted codes of the categories that training saw; unseen ones are -1."""
    p = table(spark, d, "part")
    codes = p.filter("p_type <> 'PROMO'").select("p_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("p_type")) - 1)
    return p.join(codes, "p_type", "left").select("p_partkey", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


@query("""WITH c AS (SELECT l_orderkey, list({'x': l_quantity, 'y': l_extendedprice / 1000} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pts FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_sum(list_transform(range(1, len(pts)), lambda i: sqrt(pow(pts[i + 1].x - pts[i].x, 2) + pow(pts[i + 1].y - pts[i].y, 2)))), 4) AS length FROM c WHERE len(pts) > 1""")
def a39_polyline_length(spark, d):
    pts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pts.alias("pts")).filter(F.size("pts") > 1)
    return g.select("l_orderkey", F.round(geodesy.polyline_length(F.col("pts")), 4).alias("length"))


@query("""WITH $EV, h AS (SELECT l_linenumber AS axis_a, corr(l_quantity, l_discount) AS qd, corr(l_quantity, l_tax) AS qt, corr(l_discount, l_tax) AS dt FROM lineitem GROUP BY 1) SELECT axis_a AS line, unnest(['quantity-discount', 'quantity-tax', 'discount-tax']) AS pair, round(unnest([qd, qt, dt]), 6) AS r FROM h""")
def x6_axis_correlation_matrix(spark, d):
    l = table(spark, d, "lineitem")
    names = [("quantity", "discount"), ("quantity", "tax"), ("discount", "tax")]
    wide = l.groupBy(F.col("l_linenumber").alias("line")).agg(*[F.round(F.corr(f"l_{a}", f"l_{b}"), 6).alias(f"{a}-{b}") for a, b in names])
    return wide.unpivot("line", [f"{a}-{b}" for a, b in names], "pair", "r")


@query("""SELECT user_id, count(*) AS rows_used, round(avg(value), 5) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 1000 GROUP BY 1""")
def x5_mounting_audit(spark, d):
    """The mean over the first rows of each recording, as the operator defines it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).filter("n <= 1000").groupBy("user_id").agg(F.count("*").alias("rows_used"), F.round(F.avg("value"), 5).alias("mean"))


_FOLDS = "a AS (SELECT DISTINCT o_custkey, CASE WHEN o_totalprice > 450000 THEN 3 ELSE o_custkey % 3 END AS fold FROM orders)"


def _assigned(spark, d):
    """A fold assignment with mistakes: some journeys are in two folds."""
    return table(spark, d, "orders").select("o_custkey", F.when(F.col("o_totalprice") > 450000, 3).otherwise(F.col("o_custkey") % 3).cast("long").alias("fold")).distinct()


@query(f"WITH {_FOLDS} SELECT o_custkey, count(*) AS folds, CAST(min(fold) AS BIGINT) AS first_fold FROM a GROUP BY 1 HAVING count(*) > 1")
def x13_fold_uniqueness(spark, d):
    """Journeys in more than one fold; an assignment is valid if there are none."""
    a = _assigned(spark, d)
    return a.join(schemas.unique(a, ["o_custkey"]), "o_custkey").groupBy("o_custkey").agg(F.max("rows").alias("folds"), F.min("fold").alias("first_fold"))


@query(f"WITH {_FOLDS}, u AS (SELECT o_custkey, CAST(min(fold) AS BIGINT) AS fold FROM a GROUP BY 1 HAVING count(*) = 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fold FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN u USING (o_custkey)")
def x14_fold_remapping(spark, d):
    """Folds of journeys carried over to the finer grain of line items; rows of journeys without one fold are left out."""
    folds_ = _assigned(spark, d).groupBy("o_custkey").agg(F.min("fold").alias("fold"), F.count("*").alias("n")).filter("n = 1")
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(folds_, "o_custkey")
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fold")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def x16_resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""WITH $EV, w AS (SELECT event_id, avg(value) OVER x AS m, stddev_pop(value) OVER x AS s, min(k) OVER x AS c FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT event_id, round(m, 7) AS mean, round(s, 4) AS std, c AS confidence FROM w""")
def x19_uncertainty_features(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-49, 0)
    return stream(spark, d).select("event_id", F.round(F.avg("value").over(w), 7).alias("mean"), F.round(F.stddev_pop("value").over(w), 4).alias("std"), F.min("k").over(w).alias("confidence"))


@query("""SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS characters FROM pages GROUP BY 1""")
def a38_storage_by_host(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("characters"))
