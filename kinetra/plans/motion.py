"""Time-series queries: quality flags, alignment, resampling, windows, outages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra.functions import geodesy, scalars
from kinetra.operators import timeseries as ts
from kinetra.operators.aggregates import first_match, regression_metrics
from kinetra.plans.registry import DAY, HOUR, KEY, ORDER, query, stream

def W():  # noqa: N802
    """A stream in its order."""
    return Window.partitionBy("user_id").orderBy("t", "event_id")
_O = "PARTITION BY user_id ORDER BY t, event_id"


@query("""WITH $EV,
f AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ev),
g AS (SELECT *, latest IS NOT NULL AND t - latest > 12 * $HOUR AS gap, value > 150 AS spike FROM f),
s AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM g),
u AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT spike) AS usable, count(DISTINCT segment) AS segments, count(*) FILTER (gap) AS gaps FROM s GROUP BY user_id),
a AS (SELECT user_id, segment, first(value ORDER BY t, event_id) AS anchor FROM s WHERE NOT spike GROUP BY user_id, segment),
e AS (SELECT s.user_id, avg(abs(s.value - a.anchor)) AS mae FROM s JOIN a USING (user_id, segment) WHERE NOT spike GROUP BY s.user_id)
SELECT u.user_id, n, usable, segments, gaps, round(mae, 4) AS anchor_mae FROM u LEFT JOIN e USING (user_id)""")
def stream_usability(spark, d):
    """How much of each stream survives quality gating, and how far the first value of a segment misses the rest."""
    df = ts.step_flags(stream(spark, d), KEY, ORDER, "t", 12 * HOUR).withColumn("spike", F.col("value") > 150)
    df = ts.segments(df, KEY, ORDER, F.col("gap"))
    anchor = F.first(F.when(~F.col("spike"), F.col("value")), ignorenulls=True).over(Window.partitionBy("user_id", "segment").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("miss", F.when(~F.col("spike"), F.abs(F.col("value") - anchor)))
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("spike")).alias("usable"), F.countDistinct("segment").alias("segments"), F.count_if("gap").alias("gaps"), F.round(F.avg("miss"), 4).alias("anchor_mae"))


@query("""WITH $EV, f AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ev)
SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN t - latest > 12 * $HOUR THEN 'gap' END, CASE WHEN value > 150 THEN 'out_of_range' END, CASE WHEN latest IS NULL THEN 'first' END, CASE WHEN event_type = 'error' THEN 'device_error' END], lambda x: x IS NOT NULL)), ',') AS flags,
  CASE WHEN value > 150 OR event_type = 'error' THEN 0.0 ELSE round(k / 100.0, 4) END AS score,
  NOT (coalesce(t - latest > 12 * $HOUR, false) OR value > 150 OR latest IS NULL OR event_type = 'error') AS acceptable FROM f""")
def p2_imu_quality_flags(spark, d):
    df = ts.step_flags(stream(spark, d), KEY, ORDER, "t", 12 * HOUR)
    flags = ts.flag_list({"gap": F.col("gap"), "out_of_range": F.col("value") > 150, "first": F.col("is_first"), "device_error": F.col("event_type") == "error"})
    hard = (F.col("value") > 150) | (F.col("event_type") == "error")
    return df.select("event_id", F.array_join(flags, ",").alias("flags"), F.when(hard, F.lit(0.0)).otherwise(F.round(F.col("k") / 100, 4)).alias("score"), (F.size(flags) == 0).alias("acceptable"))


@query("""WITH $EV, f AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT (value > 150 OR k < 5)) AS position_usable, count(*) FILTER (NOT (value > 150 OR k > 95)) AS speed_usable,
 count(*) FILTER (NOT (value > 150 OR k > 95 OR value < 3)) AS course_usable, count(*) FILTER (coalesce(t - p > 12 * $HOUR, false)) AS gaps FROM f GROUP BY event_type""")
def p3_gnss_usability(spark, d):
    """Flags of a fix decide position, speed and course apart; a gap alone rejects none of them."""
    df = ts.step_flags(stream(spark, d), KEY, ORDER, "t", 12 * HOUR)
    df = df.withColumn("flags", ts.flag_list({"invalid": F.col("value") > 150, "no_position_accuracy": F.col("k") < 5, "no_speed": F.col("k") > 95, "slow": F.col("value") < 3, "gap": F.col("gap")}))
    use = lambda *bad: F.count_if(~F.arrays_overlap("flags", F.array(*map(F.lit, bad))))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), use("invalid", "no_position_accuracy").alias("position_usable"), use("invalid", "no_speed").alias("speed_usable"), use("invalid", "no_speed", "slow").alias("course_usable"), F.count_if(F.array_contains("flags", "gap")).alias("gaps"))


@query("""WITH $EV SELECT coalesce(r, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'no_context' WHEN value > 150 THEN 'too_fast' WHEN event_type = 'error' THEN 'bad_source' WHEN k < 5 THEN 'low_quality' END AS r FROM ev) GROUP BY 1""")
def p5_first_match_rejection(spark, d):
    reason = first_match([("no_context", F.col("k").isNull()), ("too_fast", F.col("value") > 150), ("bad_source", F.col("event_type") == "error"), ("low_quality", F.col("k") < 5)], "accepted")
    return stream(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH $EV, x AS (SELECT *, CASE WHEN event_type = 'view' THEN 'g' WHEN event_type = 'click' THEN 'deg/s' WHEN event_type = 'error' THEN 'rad/s' ELSE 'm/s^2' END AS unit FROM ev)
SELECT event_id, round(CASE unit WHEN 'g' THEN value * 9.80665 WHEN 'deg/s' THEN radians(value) ELSE value END, 4) AS si FROM x""")
def p1_unit_normalisation(spark, d):
    from kinetra.operators.sensors import to_si

    unit = F.when(F.col("event_type") == "view", "g").when(F.col("event_type") == "click", "deg/s").when(F.col("event_type") == "error", "rad/s").otherwise("m/s^2")
    kind = F.when(F.col("event_type").isin("click", "error"), "gyroscope").otherwise("accelerometer")
    return stream(spark, d).select("event_id", F.round(to_si(F.col("value"), kind, unit), 4).alias("si"))


@query("""WITH $EV, w AS (SELECT event_id, user_id, count(*) OVER x AS n, avg(value) OVER x AS m, var_pop(value) OVER x AS v, max(abs(value)) OVER x AS top FROM ev
 WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, n, n >= 3 AND m BETWEEN 7 AND 40 AND v < 800 AND top < 100 AS still FROM w""")
def p14_zero_velocity(spark, d):
    from kinetra.operators.sensors import stationary

    return stationary(stream(spark, d), KEY, ORDER, "value", rows=10, least=3, mean=(7, 40), variance=800, top=100).select("event_id", "n", "still")


@query("""WITH $EV, m AS (SELECT event_id, value, (CASE WHEN k < 20 THEN 1.5 ELSE 1 END) * (CASE WHEN event_type = 'error' THEN 2.0 ELSE 1 END) * (CASE WHEN value > 100 THEN 1.8 ELSE 1 END) AS x, k FROM ev)
SELECT event_id, CASE WHEN k IS NULL OR value > 300 THEN NULL ELSE round(value * least(x, 4.0), 6) END AS variance,
 array_to_string(list_sort(list_filter([CASE WHEN k < 20 THEN 'low_confidence' END, CASE WHEN value > 100 THEN 'extrapolated' END, CASE WHEN x > 4.0 THEN 'capped' END], lambda y: y IS NOT NULL)), ',') AS notes FROM m""")
def p15_rule_widening(spark, d):
    """Rules only widen a variance, their product is capped, and some rules omit the row's estimate."""
    c = {n: F.col(n) for n in ("k", "value", "event_type")}
    factor = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(1.0))
    x = factor(c["k"] < 20, 1.5) * factor(c["event_type"] == "error", 2.0) * factor(c["value"] > 100, 1.8)
    notes = ts.flag_list({"low_confidence": c["k"] < 20, "extrapolated": c["value"] > 100, "capped": x > 4.0})
    omit = c["k"].isNull() | (c["value"] > 300)
    return stream(spark, d).select("event_id", F.when(~omit, F.round(c["value"] * F.least(x, F.lit(4.0)), 6)).alias("variance"), F.array_join(notes, ",").alias("notes"))


_SIDES = "l AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click'), r AS (SELECT user_id, t, min_by(value, event_id) AS value FROM ev WHERE event_type = 'view' GROUP BY user_id, t)"


def _clicks(spark, d):
    df = stream(spark, d)
    views = ts.keep_first(df.filter("event_type = 'view'"), ["user_id", "t"], ["event_id"]).select("user_id", "t", "value")
    return df.filter("event_type = 'click'").select("event_id", "user_id", "t"), views


@query(f"""WITH $EV, {_SIDES},
b AS (SELECT l.*, r.t AS tb, r.value AS vb FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
f AS (SELECT b.*, r.t AS tf, r.value AS vf FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.t),
n AS (SELECT *, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR t - tb <= tf - t) THEN tb ELSE tf END AS rt, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR t - tb <= tf - t) THEN vb ELSE vf END AS rv FROM f)
SELECT event_id, CASE WHEN abs(rt - t) <= 24 * $HOUR THEN rt END AS right_t, CASE WHEN abs(rt - t) <= 24 * $HOUR THEN rv END AS value FROM n""")
def j1_asof_nearest(spark, d):
    left, right = _clicks(spark, d)
    return ts.asof(left, right, KEY, "t", ["value"], "nearest", 24 * HOUR).select("event_id", "right_t", "value")


@query(f"""WITH $EV, {_SIDES},
b AS (SELECT l.*, r.t AS right_t, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
o AS (SELECT *, coalesce(right_t IS NOT NULL AND t - right_t <= 48 * $HOUR, false) AS ok FROM b)
SELECT event_id, right_t, ok AND row_number() OVER (PARTITION BY user_id, right_t, ok ORDER BY t) = 1 AS consumes FROM o""")
def j3_asof_backward_consumed_once(spark, d):
    left, right = _clicks(spark, d)
    matched = ts.asof(left, right, KEY, "t", ["value"], "backward")
    return ts.consumed_once(matched, KEY, "t", F.col("t") - F.col("right_t") <= 48 * HOUR).select("event_id", "right_t", "consumes")


@query(f"""WITH $EV, {_SIDES},
b AS (SELECT l.*, r.t AS t0, r.value AS v0 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
f AS (SELECT b.*, r.t AS t1, r.value AS v1 FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.t)
SELECT event_id, round(coalesce(v0 + (v1 - v0) * ((t - t0) / nullif(t1 - t0, 0)), v0, v1), 6) AS value FROM f""")
def j15_interpolated_lookup(spark, d):
    left, right = _clicks(spark, d)
    return ts.interpolate(left, right, KEY, "t", "value").select("event_id", F.round("value", 6).alias("value"))


@query("""WITH $EV, x AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS dt FROM ev)
SELECT user_id, count(*) AS n, round((max(t) - min(t)) / 1e9, 3) AS seconds, round((count(*) - 1) / ((max(t) - min(t)) / 1e9), 9) AS rate, count(*) FILTER (dt < 0) AS regressions, count(*) FILTER (dt = 0) AS duplicates,
 round(avg(dt) / 1e9, 3) AS dt_mean, round(stddev_pop(dt / 1e9), 3) AS dt_std, min(dt) AS dt_min, max(dt) AS dt_max FROM x GROUP BY user_id""")
def x1_stream_profile(spark, d):
    df = stream(spark, d).withColumn("dt", F.col("t") - F.lag("t").over(W()))
    span = (F.max("t") - F.min("t")) / 1e9
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(span, 3).alias("seconds"), F.round((F.count("*") - 1) / span, 9).alias("rate"), F.count_if(F.col("dt") < 0).alias("regressions"), F.count_if(F.col("dt") == 0).alias("duplicates"), F.round(F.avg("dt") / 1e9, 3).alias("dt_mean"), F.round(F.stddev_pop(F.col("dt") / 1e9), 3).alias("dt_std"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"))


_OUTAGES = """e AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS tail FROM ev),
g AS (SELECT user_id, t, event_id, event_type, tail, lead(event_type) OVER w AS nxt, lead(t) OVER w AS nt FROM e WHERE event_type IN ('error', 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
o AS (SELECT user_id, t AS start, coalesce(nt, tail) AS "end" FROM g WHERE event_type = 'error' AND nxt IS DISTINCT FROM 'error')"""


@query(f"""WITH $EV, {_OUTAGES} SELECT user_id, start, "end" FROM o""")
def x2_outage_intervals(spark, d):
    return ts.toggles(stream(spark, d), KEY, ORDER, "t", F.col("event_type") == "error", F.col("event_type") == "signup")


@query(f"""WITH $EV, {_OUTAGES} SELECT o.user_id, o.start, count(ev.event_id) AS events, count(*) FILTER (ev.value <= 150) AS valid, count(*) FILTER (ev.value > 150) AS blocked
FROM o LEFT JOIN ev ON o.user_id = ev.user_id AND ev.t BETWEEN o.start AND o."end" GROUP BY o.user_id, o.start""")
def x3_interval_range_join(spark, d):
    """Rows inside each outage, both ends closed. Intervals of a key are disjoint, so each row joins one: an as-of join."""
    df = stream(spark, d)
    outages = x2_outage_intervals(spark, d)
    spans = outages.select("user_id", F.col("start").alias("t"), F.col("end").alias("until"))
    inside = ts.asof(df, spans, KEY, "t", ["until"], "backward").filter(F.col("t") <= F.col("until"))
    # A row at the very end of one interval that starts the next belongs to both; ends are closing rows, starts are not.
    counts = inside.groupBy("user_id", F.col("right_t").alias("start")).agg(F.count("*").alias("events"), F.count_if(F.col("value") <= 150).alias("valid"), F.count_if(F.col("value") > 150).alias("blocked"))
    return outages.select("user_id", "start").join(counts, ["user_id", "start"], "left").na.fill(0, ["events", "valid", "blocked"])


@query(f"""WITH $EV, {_OUTAGES}, s AS (SELECT ev.*, o.start FROM ev LEFT JOIN o ON ev.user_id = o.user_id AND ev.t BETWEEN o.start AND o."end")
SELECT user_id, count(*) FILTER (start IS NULL) AS passed, count(*) FILTER (start IS NOT NULL) AS blocked FROM s GROUP BY user_id""")
def x27_stream_gate(spark, d):
    spans = x2_outage_intervals(spark, d).select("user_id", F.col("start").alias("t"), F.col("end").alias("until"))
    gated = ts.asof(stream(spark, d), spans, KEY, "t", ["until"], "backward")
    blocked = F.coalesce(F.col("t") <= F.col("until"), F.lit(False))
    return gated.groupBy("user_id").agg(F.count_if(~blocked).alias("passed"), F.count_if(blocked).alias("blocked"))


_GRID = """c AS (SELECT *, lag(value <= 150, 1, false) OVER w AS pok, lag(t) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(CAST(coalesce(NOT pok OR t - pt > 24 * $HOUR, true) OR value > 150 AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM c),
n AS (SELECT *, lead(t) OVER w AS t1, lead(value) OVER w AS v1, first(t) OVER w AS t0 FROM s WHERE value <= 150 WINDOW w AS (PARTITION BY user_id, segment ORDER BY t, event_id)),
g AS (SELECT *, unnest(range((t - t0 + $HOUR - 1) // $HOUR, CASE WHEN t1 IS NULL THEN (t - t0) // $HOUR ELSE (t1 - t0 - 1) // $HOUR END + 1)) AS i FROM n)"""


@query(f"""WITH $EV, {_GRID} SELECT user_id, segment, t0 + i * $HOUR AS t, round(coalesce(value + (v1 - value) * ((t0 + i * $HOUR - t) / nullif(t1 - t, 0)), value), 5) AS value FROM g""")
def w1_resample_with_gap_reset(spark, d):
    df = ts.resample(stream(spark, d), KEY, ORDER, "t", "value", HOUR, 24 * HOUR, F.col("value") <= 150)
    return df.select("user_id", F.col("segment").cast("long").alias("segment"), "t", F.round("value", 5).alias("value"))


@query("""WITH $EV, s AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 24 * $HOUR, false) AS brk FROM ev)),
w AS (SELECT event_id, row_number() OVER x AS n, list(value) OVER (PARTITION BY user_id, segment ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM s WINDOW x AS (PARTITION BY user_id, segment ORDER BY t, event_id))
SELECT event_id, round(list_sum(v), 4) AS total, v[1] AS oldest, v[5] AS newest FROM w WHERE n >= 5""")
def w2_causal_count_windows(spark, d):
    df = ts.discontinuities(stream(spark, d), KEY, ORDER, "t", 24 * HOUR)
    df = ts.count_windows(df, ["user_id", "segment"], ORDER, ["value"], 5)
    return df.select("event_id", F.round(F.aggregate("value_window", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("value_window", 1).alias("oldest"), F.element_at("value_window", 5).alias("newest"))


@query("""WITH $EV, w AS (SELECT event_id, user_id, row_number() OVER x AS n, avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(m, 4) AS mean FROM w WHERE n >= 10 AND (n - 10) % 5 = 0""")
def w4_strided_windows(spark, d):
    df = ts.count_windows(stream(spark, d), KEY, ORDER, ["value"], 10, 5)
    return df.select("event_id", F.round(F.aggregate("value_window", F.lit(0.0), lambda a, x: a + x) / 10, 4).alias("mean"))


@query("""WITH $EV, s AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 12 * $HOUR, false) AS brk FROM ev))
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id, segment""")
def w5_segments(spark, d):
    return ts.discontinuities(stream(spark, d), KEY, ORDER, "t", 12 * HOUR).groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


_PREFIX = """p AS (SELECT *, row_number() OVER w AS i, sum(value) OVER w AS s, sum(k) OVER w AS sk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


@query(f"""WITH $EV, {_PREFIX}, h AS (SELECT unnest([5, 10, 20]) AS horizon)
SELECT a.event_id, h.horizon, b.t - a.t AS elapsed, round(b.s - a.s, 4) AS travelled, round((b.sk - a.sk) / horizon, 4) AS confidence, round(abs(b.value - a.value), 4) AS error
FROM p a, h JOIN p b ON a.user_id = b.user_id AND b.i = a.i + h.horizon WHERE (a.i - 1) % 10 = 0""")
def w6_blackout_examples(spark, d):
    """Anchors every tenth row; integral and mean to each horizon from prefix sums, by an equi-join on row number."""
    p = stream(spark, d).withColumns({"i": F.row_number().over(W()), "s": F.sum("value").over(W()), "sk": F.sum("k").over(W())})
    a = p.filter("(i - 1) % 10 = 0").withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).select("event_id", "user_id", "horizon", (F.col("i") + F.col("horizon")).alias("i"), F.col("t").alias("ta"), F.col("s").alias("sa"), F.col("sk").alias("ka"), F.col("value").alias("va"))
    return a.join(p.select("user_id", "i", "t", "s", "sk", "value"), ["user_id", "i"]).select("event_id", "horizon", (F.col("t") - F.col("ta")).alias("elapsed"), F.round(F.col("s") - F.col("sa"), 4).alias("travelled"), F.round((F.col("sk") - F.col("ka")) / F.col("horizon"), 4).alias("confidence"), F.round(F.abs(F.col("value") - F.col("va")), 4).alias("error"))


@query("""WITH $EV, x AS (SELECT *, (value - 50) AS a, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
z AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE (a + lag(a) OVER w) / 2 * ((t - lag(t) OVER w) / CAST($DAY AS DOUBLE)) END AS st FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, 10 + sum(st) OVER w AS s FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY t, event_id)), 4) AS speed FROM s""")
def w7_clamped_speed_integral(spark, d):
    df = stream(spark, d).withColumns({"a": F.col("value") - 50, "start": F.lit(10.0), "days": F.col("t") / DAY})
    area = (F.col("a") + F.lag("a").over(W())) / 2 * ((F.col("t") - F.lag("t").over(W())) / float(DAY))
    df = df.withColumn("area", area)
    return ts.clamped_integral(df, KEY, ORDER, "start", F.col("area"), "speed").select("event_id", F.round("speed", 4).alias("speed"))


@query("""WITH $EV SELECT event_id, round(avg(k) OVER w, 6) AS mean_confidence, min(k) OVER w AS least_confidence FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def w8_running_confidence(spark, d):
    return stream(spark, d).select("event_id", F.round(F.avg("k").over(W()), 6).alias("mean_confidence"), F.min("k").over(W()).alias("least_confidence"))


@query("""WITH x AS (SELECT p_partkey, p_brand, p_size, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
SELECT p_partkey, p_brand, p_size FROM x WHERE s <= 300 OR n <= 2""")
def w9_budget_eviction(spark, d):
    from kinetra.session import table

    return ts.within_budget(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], "p_size", 300, 2).select("p_partkey", "p_brand", "p_size")


@query("""WITH $EV, s AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM ev)
SELECT event_id, round(smooth, 5) AS smooth, round((smooth - lag(smooth, 3) OVER w) / ((t - lag(t, 3) OVER w) / CAST($HOUR AS DOUBLE)), 5) AS slope FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def w10_smoothed_difference(spark, d):
    df = stream(spark, d).withColumn("smooth", F.avg("value").over(W().rowsBetween(-4, 0)))
    slope = (F.col("smooth") - F.lag("smooth", 3).over(W())) / ((F.col("t") - F.lag("t", 3).over(W())) / float(HOUR))
    return df.select("event_id", F.round("smooth", 5).alias("smooth"), F.round(slope, 5).alias("slope"))


@query("""WITH $EV, x AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS el FROM ev)
SELECT user_id, min_by(value, (el, event_id)) FILTER (el >= 1 * $DAY) AS day_1, min_by(value, (el, event_id)) FILTER (el >= 5 * $DAY) AS day_5, min_by(value, (el, event_id)) FILTER (el >= 20 * $DAY) AS day_20, min(el) FILTER (value < 5) AS first_below_5 FROM x GROUP BY user_id""")
def w22_outage_milestones(spark, d):
    df = stream(spark, d).withColumn("el", F.col("t") - F.min("t").over(Window.partitionBy("user_id")))
    at = lambda n: F.min(F.when(F.col("el") >= n * DAY, F.struct("el", "event_id", "value")))["value"].alias(f"day_{n}")
    return df.groupBy("user_id").agg(at(1), at(5), at(20), F.min(F.when(F.col("value") < 5, F.col("el"))).alias("first_below_5"))


_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))"


@query(f"""WITH $EV, p AS (SELECT *, 52 + value / 1000 AS lat, -1.5 + k / 1000.0 AS lon FROM ev),
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(sum(coalesce({_HAV}, 0)) OVER (PARTITION BY user_id ORDER BY t, event_id), 2) AS metres FROM l""")
def w23_cumulative_distance(spark, d):
    df = stream(spark, d).withColumns({"lat": 52 + F.col("value") / 1000, "lon": F.lit(-1.5) + F.col("k") / 1000.0})
    leg = geodesy.haversine(F.lag("lat").over(W()), F.lag("lon").over(W()), F.col("lat"), F.col("lon"))
    df = df.withColumn("leg", F.coalesce(leg, F.lit(0.0)))
    return df.select("event_id", F.round(F.sum("leg").over(W()), 2).alias("metres"))


@query("""WITH $EV, h AS (SELECT *, value > 50 AS hi FROM ev), i AS (SELECT *, sum(CAST(NOT hi AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM h)
SELECT event_id, CAST(sum(CAST(hi AS INT)) OVER (PARTITION BY user_id, g ORDER BY t, event_id) AS BIGINT) AS streak FROM i""")
def w24_late_streaks(spark, d):
    return ts.streaks(stream(spark, d), KEY, ORDER, F.col("value") > 50).select("event_id", "streak")


@query("""WITH $EV, x AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id)) / CAST($HOUR AS DOUBLE) AS el FROM ev), h AS (SELECT unnest([24.0, 120.0, 480.0]) AS horizon),
n AS (SELECT user_id, horizon, event_id, row_number() OVER (PARTITION BY user_id, horizon ORDER BY abs(el - horizon), t, event_id) AS r FROM x, h WHERE abs(el - horizon) <= 12)
SELECT user_id, CAST(horizon AS DOUBLE) AS horizon, event_id FROM n WHERE r = 1""")
def w25_horizon_selection(spark, d):
    df = stream(spark, d).withColumn("el", (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / float(HOUR))
    return ts.nearest_per_horizon(df, KEY, "el", [24, 120, 480], 12, ORDER).select("user_id", "horizon", "event_id")


@query("""WITH $EV, b AS (SELECT user_id, min(t) AS a, max(t) AS z FROM ev GROUP BY user_id), g AS (SELECT user_id, unnest(range(a, z, 5 * $DAY)) AS t FROM b),
r AS (SELECT user_id, t, min(event_id) AS event_id FROM ev GROUP BY user_id, t)
SELECT DISTINCT r.user_id, r.event_id AS anchor FROM g ASOF JOIN r ON g.user_id = r.user_id AND g.t <= r.t""")
def w26_anchor_selection(spark, d):
    df = stream(spark, d)
    grid = df.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("z")).select("user_id", F.explode(F.sequence("a", F.col("z") - 1, F.lit(5 * DAY))).alias("t"))
    right = ts.keep_first(df, ["user_id", "t"], ["event_id"]).select("user_id", "t", F.col("event_id").alias("anchor"))
    return ts.asof(grid, right, KEY, "t", ["anchor"], "forward").filter("anchor is not null").select("user_id", "anchor").distinct()


@query("""WITH $EV, w AS (SELECT user_id, list({'e': event_id, 't': t, 'v': value}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS win FROM ev),
x AS (SELECT user_id, unnest(win) AS s FROM w), y AS (SELECT DISTINCT user_id, s.e AS event_id, s.t AS t, s.v AS v FROM x)
SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 24 * $HOUR, false) AS continuous FROM y""")
def w27_sequence_from_overlapping_windows(spark, d):
    df = stream(spark, d).withColumn("s", F.struct("event_id", "t"))
    windows = df.withColumn("win", F.collect_list("s").over(W().rowsBetween(-4, 0))).select("user_id", F.explode("win").alias("s"))
    rows = windows.select("user_id", "s.*").distinct()
    return rows.select("event_id", F.coalesce(F.col("t") - F.lag("t").over(W()) <= 24 * HOUR, F.lit(False)).alias("continuous"))


@query("""WITH $EV, x AS (SELECT *, count(*) OVER w AS n, max(t) OVER w AS newest, min(t) OVER w AS oldest FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n < 2 OR newest = oldest THEN 0.0 ELSE round((n - 1) / ((newest - oldest) / CAST($DAY AS DOUBLE)), 6) END AS per_day FROM x""")
def x25_update_frequency(spark, d):
    w = W().rowsBetween(-9, 0)
    n, span = F.count("*").over(w), F.max("t").over(w) - F.min("t").over(w)
    return stream(spark, d).select("event_id", F.when((n < 2) | (span == 0), F.lit(0.0)).otherwise(F.round((n - 1) / (span / float(DAY)), 6)).alias("per_day"))


@query("""WITH $EV, f AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS fix FROM ev)
SELECT event_id, CASE WHEN fix IS NULL OR t - fix > 72 * $HOUR THEN 'filter' ELSE 'last_fix' END AS source, CASE WHEN fix IS NULL OR t - fix > 72 * $HOUR THEN round(least(1.0, greatest(0.1, 5 / value)), 6) ELSE 1.0 END AS confidence FROM f""")
def x23_source_selection(spark, d):
    fix = F.max(F.when(F.col("event_type") == "view", F.col("t"))).over(W())
    df = stream(spark, d).withColumn("stale", F.coalesce(F.col("t") - fix > 72 * HOUR, F.lit(True)))
    return df.select("event_id", F.when(F.col("stale"), "filter").otherwise("last_fix").alias("source"), F.when(F.col("stale"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), scalars.quotient(F.lit(5.0), F.col("value")))), 6)).otherwise(F.lit(1.0)).alias("confidence"))


@query("""WITH $EV, x AS (SELECT event_id, t, user_id, first(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS t0 FROM ev) SELECT event_id, t - t0 AS relative_ns, (t - t0) // 1000000 + 1700000000000 AS wall_ms FROM x""")
def x30_clock_translation(spark, d):
    rel = F.col("t") - F.first("t").over(W())
    return stream(spark, d).select("event_id", rel.alias("relative_ns"), (F.floor(rel / 1_000_000) + 1_700_000_000_000).cast("long").alias("wall_ms"))


@query("""WITH $EV, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev), l AS (SELECT unnest(range(-3, 4)) AS lag)
SELECT a.user_id, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(a.value, b.k), 6) AS r FROM i a, l JOIN i b ON a.user_id = b.user_id AND b.i = a.i + lag GROUP BY a.user_id, lag""")
def j17_lag_search(spark, d):
    return ts.lagged_correlation(stream(spark, d), KEY, ORDER, "value", "k", list(range(-3, 4))).select("user_id", "lag", "n", F.round("r", 6).alias("r"))


@query("""WITH $EV, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM ev) SELECT event_type, count(*) AS n, round(avg(abs(value - prev)), 5) AS mae, round(sqrt(avg(pow(value - prev, 2))), 5) AS rmse,
 round(1 - sum(pow(value - prev, 2)) / (var_pop(value) * count(value)), 5) AS r2, round(max(abs(value - prev)), 5) AS worst FROM p WHERE prev IS NOT NULL GROUP BY event_type""")
def a17_regression_metrics(spark, d):
    df = stream(spark, d).withColumn("prev", F.lag("value").over(W())).filter("prev is not null")
    out = regression_metrics(df, ["event_type"], "value", "prev")
    return out.select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2", "worst")])
