"""Predicates, audits, features and the remaining script operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra import schemas
from kinetra.functions import geodesy, quaternions, scalars
from kinetra.operators import aggregates as ag
from kinetra.operators import features, folds
from kinetra.operators import timeseries as ts
from kinetra.plans.registry import DAY, HOUR, KEY, ORDER, query, stream
from kinetra.session import table
from kinetra.sources import roads


def _w():
    return Window.partitionBy("user_id").orderBy("t", "event_id")


@query("""WITH $EV SELECT event_id, value < 3 AS too_slow, (value BETWEEN -90 AND 90 AND (k * 4 - 180) BETWEEN -180 AND 180) AS valid_position, CASE WHEN NOT isnan(ln(value)) THEN round(ln(value), 6) END AS finite FROM ev""")
def p4_p6_p7_predicates(spark, d):
    """By the SQL, only NaN is not finite: the logarithm of zero stays minus infinity. Unknown positions are neither valid nor not."""
    df = stream(spark, d)
    log = scalars.logarithm(F.col("value"))
    return df.select("event_id", (F.col("value") < 3).alias("too_slow"), geodesy.in_range(F.col("value"), (F.col("k") * 4 - 180).cast("double")).alias("valid_position"), F.when(~F.isnan(log), F.round(log, 6)).alias("finite"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, l_tax FROM lineitem""")
def p8_feature_allow_list(spark, d):
    """Rows as a model may see them: their keys and allowed features, in order, never the target."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return features.allowed(table(spark, d, "lineitem"), keys, ["l_discount", "l_quantity", "l_tax"], "l_extendedprice")


@query("""WITH $EV, f AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS anchor FROM ev)
SELECT event_id, coalesce(t - anchor BETWEEN 0 AND 24 * $HOUR, false) AS fresh, coalesce(t - anchor BETWEEN 0 AND 24 * $HOUR, false) AND k >= 50 AND abs(value - 50) < 40 AS constraint_applies FROM f""")
def p9_p10_age_gates(spark, d):
    anchor = F.max(F.when(F.col("event_type") == "view", F.col("t"))).over(_w())
    df = stream(spark, d).withColumn("fresh", F.coalesce((F.col("t") - anchor).between(0, 24 * HOUR), F.lit(False)))
    return df.select("event_id", "fresh", (F.col("fresh") & (F.col("k") >= 50) & (F.abs(F.col("value") - 50) < 40)).alias("constraint_applies"))


@query("""WITH RECURSIVE $EV, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev WHERE event_type = 'view'),
kept(user_id, i, t, event_id) AS (SELECT user_id, i, t, event_id FROM r WHERE i = 1 UNION ALL
 SELECT n.user_id, n.i, n.t, n.event_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY r.i) AS q FROM kept k JOIN r ON r.user_id = k.user_id AND r.i > k.i AND r.t - k.t >= 2 * $DAY) n WHERE q = 1)
SELECT user_id, event_id FROM kept""")
def p11_x26_greedy_downsample(spark, d):
    return folds.batch(stream(spark, d).filter("event_type = 'view'"), folds.Cadence(2 * DAY), "user_id", ORDER)


@query("""WITH p AS (SELECT p_partkey, p_retailprice - 1000 AS px, p_size AS py FROM part), t AS (SELECT *, greatest(0.0, least(1.0, (px * 1000 + py * 20) / (1000.0 * 1000 + 20 * 20))) AS t FROM p)
SELECT p_partkey, round(sqrt(pow(px - t * 1000, 2) + pow(py - t * 20, 2)), 6) AS cross_track, sqrt(pow(px - t * 1000, 2) + pow(py - t * 20, 2)) > 15 AS off_route FROM t""")
def p13_off_route(spark, d):
    p = table(spark, d, "part").withColumn("near", geodesy.point_segment(F.col("p_retailprice") - 1000, F.col("p_size").cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(20.0)))
    return p.select("p_partkey", F.round("near.distance", 6).alias("cross_track"), (F.col("near.distance") > 15).alias("off_route"))


@query("""WITH $EV, x AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) SELECT count(*) FILTER (p > t) AS regressions, count(*) FILTER (p = t) AS repeats FROM x""")
def p17_c1_order_contracts(spark, d):
    df = stream(spark, d)
    df = df.withColumn("p", F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id")))
    return df.agg(F.count_if(F.col("p") > F.col("t")).alias("regressions"), F.count_if(F.col("p") == F.col("t")).alias("repeats"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT count(*) AS journeys, count(*) FILTER (n < 2) AS too_short FROM n), u AS (SELECT count(*) AS repeated FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) SELECT journeys, too_short, repeated FROM c, u""")
def c1_c6_contract_report(spark, d):
    o = table(spark, d, "orders")
    journeys = o.agg(F.countDistinct("o_custkey").alias("journeys"))
    short = schemas.at_least(o, ["o_custkey"], 2).agg(F.count("*").alias("too_short"))
    twice = schemas.unique(o, ["o_orderkey"]).agg(F.count("*").alias("repeated"))
    return journeys.crossJoin(short).crossJoin(twice)  # single rows


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, CASE WHEN l_linestatus = 'F' THEN l_quantity + 1 ELSE l_quantity END AS b FROM lineitem) SELECT l_orderkey, count(*) AS n, round(avg(a - b), 6) AS bias FROM s GROUP BY 1""")
def j4_j14_aligned_predictions(spark, d):
    """Predictions of two models on equal keys, joined one to one."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    l = table(spark, d, "lineitem")
    one = l.groupBy(*keys).agg(F.sum("l_quantity").alias("a"), F.count("*").alias("rows"))
    two = l.groupBy(*keys).agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).alias("b"))
    return one.join(two, keys).groupBy("l_orderkey").agg(F.sum("rows").alias("n"), F.round(F.sum(F.col("a") - F.col("b")) / F.sum("rows"), 6).alias("bias"))


@query("""WITH $EV, w AS (SELECT event_id, row_number() OVER x AS i, list(value - 50) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(list_avg(v), 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / 10), 5) AS rms, round(quantile_cont_list[2] - quantile_cont_list[1], 5) AS iqr,
 round(len(list_filter(range(1, 10), lambda j: (v[j] >= 0) <> (v[j + 1] >= 0))) / 9.0, 6) AS crossings FROM (SELECT *, (SELECT quantile_cont(u, [0.25, 0.75]) FROM unnest(v) AS q(u)) AS quantile_cont_list FROM w WHERE i >= 10)""")
def a30_shape_features(spark, d):
    df = ts.count_windows(stream(spark, d).withColumn("v", F.col("value") - 50), KEY, ORDER, ["v"], 10)
    df = df.withColumn("f", features.shape_features(F.col("v_window")))
    return df.select("event_id", F.round("f.mean", 6).alias("mean"), F.round("f.rms", 5).alias("rms"), F.round("f.iqr", 5).alias("iqr"), F.round("f.crossings", 6).alias("crossings"))


@query()
def a30_low_frequency_share(spark, d):
    df = ts.count_windows(stream(spark, d), KEY, ORDER, ["value"], 16, 4)
    return df.select("event_id", F.round(features.low_frequency_share(F.col("value_window"), 10.0, 3.0), 9).alias("share"))


@query("""WITH $EV, q AS (SELECT user_id, k, t, event_id, cos(value / 400) AS w, sin(value / 400) AS z FROM ev), f AS (SELECT user_id, min_by(w, (t, event_id)) AS w0, min_by(z, (t, event_id)) AS z0 FROM q GROUP BY 1),
s AS (SELECT user_id, sum(CASE WHEN w * w0 + z * z0 < 0 THEN -k ELSE k END * w) AS w, sum(CASE WHEN w * w0 + z * z0 < 0 THEN -k ELSE k END * z) AS z FROM q JOIN f USING (user_id) GROUP BY 1) SELECT user_id, round(w / sqrt(w * w + z * z), 6) AS w, round(z / sqrt(w * w + z * z), 6) AS z FROM s""")
def a32_mean_rotation(spark, d):
    zero = F.lit(0.0)
    df = stream(spark, d).withColumn("q", quaternions.quaternion(F.cos(F.col("value") / 400), zero, zero, F.sin(F.col("value") / 400)))
    m = features.mean_rotation(df, KEY, "q", "k", ["t", "event_id"])
    return m.select("user_id", F.round("q.w", 6).alias("w"), F.round("q.z", 6).alias("z"))


@query("""WITH p AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice / 1000 AS y, row_number() OVER w AS i, lead(l_quantity) OVER w AS x1, lead(l_extendedprice / 1000) OVER w AS y1, lead(l_quantity, 2) OVER w AS x2, lead(l_extendedprice / 1000, 2) OVER w AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
c AS (SELECT l_orderkey, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) + sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) AS len, atan2(y2 - y1, x2 - x1) - atan2(y1 - y, x1 - x) AS d FROM p WHERE x2 IS NOT NULL), k AS (SELECT l_orderkey, len, abs((d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi()) / nullif(len, 0) AS k FROM c)
SELECT l_orderkey, round(sum(k * len) / sum(len), 6) AS curvature, round(quantile_cont(k, 0.95), 6) AS p95 FROM k GROUP BY 1""")
def a37_edge_curvature(spark, d):
    """Length-weighted mean and 95th percentile of turning per length along a line."""
    from kinetra.functions.angles import separation

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "x", "y")
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    p = p.withColumns({f"{c}{n}": F.lead(c, n).over(w) for c in "xy" for n in (1, 2)}).filter("x2 is not null")
    leg = lambda a, b: F.sqrt(F.pow(F.col(f"x{b}") - F.col(f"x{a}"), 2) + F.pow(F.col(f"y{b}") - F.col(f"y{a}"), 2))
    p = p.withColumn("len", leg("1", "2") + leg("", "1"))
    turn = separation(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.atan2(F.col("y1") - F.col("y"), F.col("x1") - F.col("x")))
    p = p.withColumn("k", turn / F.nullif(F.col("len"), F.lit(0.0)))
    return p.groupBy("l_orderkey").agg(F.round(F.sum(F.col("k") * F.col("len")) / F.sum("len"), 6).alias("curvature"), F.round(F.percentile("k", 0.95), 6).alias("p95"))


@query("""WITH $EV, f AS (SELECT user_id, t, value AS speed, k, lag(value) OVER w AS v0, lag(t) OVER w AS t0 FROM ev WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, t, round((speed - v0) / ((t - t0) / CAST($HOUR AS DOUBLE)), 5) AS rate, round(least(1.0, abs(speed - v0) / 50) * (k / 100.0), 6) AS confidence FROM f WHERE v0 IS NOT NULL AND t > t0""")
def w12_interval_evidence(spark, d):
    """Evidence from each pair of neighbouring fixes, with its confidence."""
    f = stream(spark, d).filter("event_type = 'view'").withColumns({"v0": F.lag("value").over(_w()), "t0": F.lag("t").over(_w())}).filter("v0 is not null and t > t0")
    return f.select("user_id", "t", F.round((F.col("value") - F.col("v0")) / ((F.col("t") - F.col("t0")) / float(HOUR)), 5).alias("rate"), F.round(F.least(F.lit(1.0), F.abs(F.col("value") - F.col("v0")) / 50) * (F.col("k") / 100), 6).alias("confidence"))


@query("""WITH $EV, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev), l AS (SELECT unnest(range(-3, 4)) AS lag), r AS (SELECT a.user_id, CAST(lag AS INT) AS lag, round(corr(a.value, b.k), 9) AS r FROM i a, l JOIN i b ON a.user_id = b.user_id AND b.i = a.i + lag GROUP BY a.user_id, lag)
SELECT user_id, arg_max(lag, (abs(r), -lag)) AS lag FROM r WHERE r IS NOT NULL GROUP BY 1""")
def w11_best_lag(spark, d):
    r = ts.lagged_correlation(stream(spark, d), KEY, ORDER, "value", "k", list(range(-3, 4))).withColumn("r", F.round("r", 9)).filter("r is not null")
    return r.groupBy("user_id").agg((-F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("l")))["l"]).alias("lag"))


@query("""WITH $EV, c AS (SELECT user_id, t, max(event_id) AS edge FROM ev WHERE event_type <> 'error' GROUP BY 1, 2) SELECT e.event_id, c.edge FROM ev e LEFT JOIN c USING (user_id, t)""")
def w20_delayed_decoration(spark, d):
    df = stream(spark, d)
    c = df.filter("event_type <> 'error'").groupBy("user_id", "t").agg(F.max("event_id").alias("edge"))
    return df.join(c, ["user_id", "t"], "left").select("event_id", "edge")


@query("""SELECT p_brand, CASE WHEN sum(p_size) / 3000.0 >= 0.85 THEN 'critical' WHEN sum(p_size) / 3000.0 >= 0.7 THEN 'high' ELSE 'normal' END AS pressure FROM part GROUP BY 1""")
def w31_memory_pressure(spark, d):
    r = F.sum("p_size") / 3000.0
    return table(spark, d, "part").groupBy("p_brand").agg(F.when(r >= 0.85, "critical").when(r >= 0.7, "high").otherwise("normal").alias("pressure"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders""")
def k6_stable_order_within_fold(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).alias("place"))


@query("""SELECT p_partkey, round((p_retailprice - 1500) * CASE WHEN abs(p_retailprice - 1500) <= 350 AND cos(p_size / 10.0) > 0 THEN 0.5 * cos(p_size / 10.0) * (1 - abs(p_retailprice - 1500) / 350) ELSE 0.0 END, 6) + CAST(0 AS DOUBLE) AS moved FROM part""")
def r10_soft_road_pull(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.round(features.soft_pull(F.col("p_retailprice") - 1500, F.col("p_size") / 10, 0.5, 350.0), 6) + F.lit(0.0)).alias("moved"))


@query("""SELECT event_type, count(DISTINCT user_id) AS streams, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1""")
def x4_inventory(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("streams"), F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"))


@query("""WITH $EV, m AS (SELECT *, value > 30 AS moving FROM ev), n AS (SELECT user_id, count(*) FILTER (moving) AS m FROM m GROUP BY 1), u AS (SELECT m.* FROM m JOIN n USING (user_id) WHERE CASE WHEN n.m >= 30 THEN moving ELSE value > 10 END)
SELECT user_id, count(*) AS n, round(corr(value, k), 6) AS r, round(avg(CAST((value > 50) = (k > 50) AS INT)), 6) AS agreement, round(avg(k) / avg(value), 6) AS ratio FROM u GROUP BY 1""")
def x7_channel_calibration(spark, d):
    """Correlation, sign agreement and ratio on moving rows; where those are few, on a relaxed choice."""
    df = stream(spark, d).withColumn("moving", F.col("value") > 30)
    many = F.count_if("moving").over(Window.partitionBy("user_id")) >= 30
    df = df.withColumn("many", many).filter(F.when(F.col("many"), F.col("moving")).otherwise(F.col("value") > 10))
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.corr("value", "k"), 6).alias("r"), F.round(F.avg(((F.col("value") > 50) == (F.col("k") > 50)).cast("int")), 6).alias("agreement"), F.round(F.avg("k") / F.avg("value"), 6).alias("ratio"))


@query("""WITH c AS (SELECT unnest([0.5, 1.0, 2.0]) AS gain), x AS (SELECT l_returnflag, CAST(gain AS DOUBLE) AS gain, abs(l_extendedprice - 50000 * gain) AS v FROM lineitem, c), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, gain ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, gain) AS n FROM x)
SELECT l_returnflag, gain, count(*) AS n, max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95 FROM r GROUP BY 1, 2""")
def x9_ablation_table(spark, d):
    """Sessions by configurations, each row scored under each of a fixed list of configurations."""
    l = table(spark, d, "lineitem").withColumn("gain", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    return ag.nearest_rank(l.withColumn("v", F.abs(F.col("l_extendedprice") - 50000 * F.col("gain"))), ["l_returnflag", "gain"], "v", [0.5, 0.95])


@query("""WITH s AS (SELECT l_orderkey AS way, l_linenumber AS place, l_partkey AS node FROM lineitem WHERE l_linestatus = 'F'), w AS (SELECT way FROM s GROUP BY 1 HAVING count(DISTINCT node) > 1)
SELECT node, CAST(count(DISTINCT way) AS BIGINT) AS ways, count(DISTINCT way) > 1 AS is_intersection FROM s JOIN w USING (way) GROUP BY 1""")
def x10_way_nodes(spark, d):
    """Nodes merged over the ways that pass a filter (by status, and with two nodes at least), with their distinct ways."""
    s = table(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("way")).agg(F.collect_set("l_partkey").alias("nodes")).filter(F.size("nodes") > 1)
    return s.select("way", F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("ways")).withColumn("is_intersection", F.col("ways") > 1)


@query("""WITH $EV, t AS (SELECT concat_ws('_', CAST(floor((52 + value / 1000) * 100) AS BIGINT), CAST(floor((-1.5 + k / 1000.0) * 100) AS BIGINT)) AS tile, event_id FROM ev) SELECT tile, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM t GROUP BY 1""")
def x11_tile_files(spark, d):
    """Rows written in a folder for each tile, and the manifest read back from those folders."""
    df = stream(spark, d).withColumn("tile", F.concat_ws("_", F.floor((52 + F.col("value") / 1000) * 100), F.floor((F.lit(-1.5) + F.col("k") / 1000.0) * 100)))
    return roads.tile_manifest(roads.write_tiles(df.select("tile", "event_id"), "tile"), "tile", "event_id")


@query("""WITH a AS (SELECT l_orderkey AS id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), t AS (SELECT unnest(range(0, CAST((SELECT max(hi) FROM a) AS BIGINT) + 10, 10)) AS t0) SELECT t0 AS tile, count(*) AS members, count(*) FILTER (lo >= t0 AND hi < t0 + 10) AS only_here FROM a, t WHERE lo < t0 + 10 AND hi >= t0 GROUP BY 1""")
def x12_overlap_membership(spark, d):
    """Which tiles an interval overlaps: the tiles are generated for each interval, not joined with all."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    a = a.withColumn("i", F.explode(F.sequence(F.floor(F.col("lo") / 10), F.floor(F.col("hi") / 10))))
    return a.groupBy((F.col("i") * 10).alias("tile")).agg(F.count("*").alias("members"), F.count_if((F.col("lo") >= F.col("i") * 10) & (F.col("hi") < F.col("i") * 10 + 10)).alias("only_here"))


@query("""WITH $EV, s AS (SELECT *, value > 50 AS hi FROM ev), n AS (SELECT *, count(*) OVER (PARTITION BY hi) AS c FROM s), u AS (SELECT user_id, avg(1.0 / c) AS w FROM n WHERE event_type <> 'error' GROUP BY 1), a AS (SELECT DISTINCT user_id FROM ev), j AS (SELECT user_id, coalesce(w, 1.0) AS w FROM a LEFT JOIN u USING (user_id))
SELECT user_id, round(greatest(0.25, least(4.0, w / (SELECT avg(w) FROM j))), 6) AS weight FROM j""")
def x15_two_level_weights(spark, d):
    df = stream(spark, d).withColumn("hi", F.col("value") > 50)
    strata = df.groupBy("hi").agg(F.count("*").alias("c"))
    u = df.join(F.broadcast(strata), "hi").filter("event_type <> 'error'").groupBy("user_id").agg(F.avg(1 / F.col("c")).alias("w"))  # two strata
    j = df.select("user_id").distinct().join(u, "user_id", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    mean = j.agg(F.avg("w").alias("m"))
    return j.join(F.broadcast(mean)).select("user_id", F.round(F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("w") / F.col("m"))), 6).alias("weight"))


@query()
def x20_low_pass(spark, d):
    out = features.filtered(stream(spark, d), "user_id", ORDER, "value", 10.0, 2.0, "event_id")
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""SELECT event_id, sha256(props) AS digest, to_json({'k': CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 'type': event_type}) AS record FROM events""")
def f_hash_and_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.sha2("props", 256).alias("digest"), F.to_json(F.struct(F.from_json("props", "k bigint")["k"].alias("k"), F.col("event_type").alias("type"))).alias("record"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages""")
def f_html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(scalars.strip_tags(F.col("html"))).cast("long").alias("n"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1""")
def f_ordered_session_summary(spark, d):
    c = table(spark, d, "conversations")
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.sum(F.length("text")).alias("characters"))
