"""Ordered analytics within a stream: every operator takes the stream's key and a total order.

All are window expressions over one hash partitioning by key and one sort, so operators on the same key and order share
a shuffle. Streams that are much longer than others can be cut where state resets (segments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def step_flags(df: DataFrame, key: list[str], order: list[str], t: str, max_gap: int) -> DataFrame:
    """latest (greatest time before), is_first, duplicate, regressed, gap of each row; a regression moves no time."""
    before = _w(key, order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("latest", F.max(t).over(before))
    step = F.col(t) - F.col("latest")
    has = F.col("latest").isNotNull()
    return df.withColumns({"is_first": ~has, "duplicate": has & (step == 0), "regressed": has & (step < 0), "gap": has & (step > max_gap)})


def flag_list(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, sorted."""
    return F.sort_array(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))


def segments(df: DataFrame, key: list[str], order: list[str], breaks: Column, name: str = "segment") -> DataFrame:
    """Numbers stretches of rows from 0; a row where breaks holds begins a new one."""
    return df.withColumn(name, F.sum(F.coalesce(breaks.cast("int"), F.lit(0))).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def discontinuities(df: DataFrame, key: list[str], order: list[str], t: str, max_gap: int, name: str = "segment") -> DataFrame:
    step = F.col(t) - F.lag(t).over(_w(key, order))
    df = df.withColumn("_break", step > max_gap)
    return segments(df, key, order, F.col("_break"), name).drop("_break")


def streaks(df: DataFrame, key: list[str], order: list[str], holds: Column) -> DataFrame:
    """streak: how many rows up to this one the condition has held without a break (0 where it does not)."""
    df = df.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    df = segments(df, key, order, ~F.col("_holds"), "_island")
    run = F.sum(F.col("_holds").cast("int")).over(_w([*key, "_island"], order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("streak", run.cast("long")).drop("_holds", "_island")


def asof(left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str], direction: str = "nearest", tolerance: int | None = None) -> DataFrame:
    """left with the values (and matched time, as right_t) of the right row that is nearest in time, or null.

    direction: backward, forward or nearest; ties of nearest go backward; exact matches count; of right rows of equal
    time the least values match (keep_first chooses others). A union and two window scans over one partitioning by key, linear in the
    rows of a key, where a range join would compare all pairs.
    """
    held = F.struct(F.col(t).alias("t"), *[F.col(v) for v in values])
    kinds = {c: k for c, k in left.dtypes}
    a = left.select(*left.columns, F.lit(0).alias("_side"), F.lit(None).cast(right.select(held.alias("r")).schema[0].dataType).alias("_right"))
    b = right.select(*key, F.col(t), *[F.lit(None).cast(kinds[c]).alias(c) for c in left.columns if c not in (*key, t)], F.lit(1).alias("_side"), held.alias("_right"))
    both = a.unionByName(b)
    # Right rows sort before left rows of the same time backward, and after them forward.
    back = Window.partitionBy(*key).orderBy(F.col(t), F.desc("_side"), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.col(t), F.asc("_side"), F.asc("_right")).rowsBetween(0, Window.unboundedFollowing)
    none = F.lit(None).cast(b.schema["_right"].dataType)
    both = both.withColumn("_back", F.last("_right", ignorenulls=True).over(back) if direction != "forward" else none)
    both = both.withColumn("_ahead", F.first("_right", ignorenulls=True).over(ahead) if direction != "backward" else none)
    nearer = F.col("_ahead").isNull() | (F.col(t) - F.col("_back.t") <= F.col("_ahead.t") - F.col(t))
    both = both.filter("_side = 0").withColumn("_hit", F.when(F.col("_back").isNotNull() & nearer, F.col("_back")).otherwise(F.col("_ahead")))
    if tolerance is not None:
        both = both.withColumn("_hit", F.when(F.abs(F.col("_hit.t") - F.col(t)) <= tolerance, F.col("_hit")))
    return both.select(*left.columns, F.col("_hit.t").alias("right_t"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def consumed_once(matched: DataFrame, key: list[str], t: str, accepted: Column) -> DataFrame:
    """Of the accepted rows matched to one right row, only the first keeps it; rejected rows do not consume."""
    df = matched.withColumn("_ok", F.coalesce(accepted, F.lit(False)) & F.col("right_t").isNotNull())
    first = F.row_number().over(Window.partitionBy(*key, "right_t", "_ok").orderBy(t))
    return df.withColumn("consumes", F.col("_ok") & (first == 1)).drop("_ok")


def interpolate(left: DataFrame, right: DataFrame, key: list[str], t: str, value: str) -> DataFrame:
    """left with value linearly interpolated between the right rows around it, and held flat beyond the ends."""
    back = asof(left, right, key, t, [value], "backward").withColumnsRenamed({"right_t": "_t0", value: "_v0"})
    both = asof(back, right, key, t, [value], "forward").withColumnsRenamed({"right_t": "_t1", value: "_v1"})
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * ((F.col(t) - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0)))
    return both.withColumn(value, F.coalesce(between, F.col("_v0"), F.col("_v1"))).select(*left.columns, value)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; dropDuplicates would keep any."""
    return df.withColumn("_n", F.row_number().over(_w(key, order))).filter("_n = 1").drop("_n")


def resample(df: DataFrame, key: list[str], order: list[str], t: str, value: str, period: int, max_gap: int, accepted: Column | None = None) -> DataFrame:
    """key, segment, t, value on a grid of fixed period anchored at each segment's first accepted row.

    Values are interpolated between neighbours; rejected rows and gaps above max_gap end a segment. Grid points are
    generated per interval by sequence(), so there is no state and no UDF.
    """
    df = df.withColumn("_ok", F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False)))
    w = _w(key, order)
    cut = ~F.lag("_ok", 1, False).over(w) | (F.col(t) - F.lag(t).over(w) > max_gap) | ~F.col("_ok")
    df = df.withColumn("_cut", cut)
    df = segments(df, key, order, F.col("_cut")).filter("_ok")
    inner = _w([*key, "segment"], order)
    df = df.withColumns({"_t1": F.lead(t).over(inner), "_v1": F.lead(value).over(inner), "_t0": F.first(t).over(inner), "_n": F.row_number().over(inner)})
    # Integer grid indices: an interval owns points in [its start, its end), the last row only its own point.
    first = F.expr(f"(`{t}` - _t0 + {period - 1}) div {period}")
    last = F.when(F.col("_t1").isNotNull(), F.expr(f"(_t1 - _t0 - 1) div {period}")).otherwise(F.expr(f"(`{t}` - _t0) div {period}"))
    df = df.withColumns({"_a": first, "_b": last}).filter("_a <= _b").withColumn("_g", F.explode(F.sequence("_a", "_b")))
    at = F.col("_t0") + F.col("_g") * period
    moved = F.col(value) + (F.col("_v1") - F.col(value)) * ((at - F.col(t)) / F.nullif(F.col("_t1") - F.col(t), F.lit(0)))
    return df.select(*key, "segment", at.alias(t), F.coalesce(moved, F.col(value)).alias(value))


def count_windows(df: DataFrame, key: list[str], order: list[str], columns: list[str], size: int, stride: int = 1) -> DataFrame:
    """The last size rows up to each row as arrays, where there are so many; every stride-th window, label at the end."""
    w = _w(key, order)
    df = df.withColumn("_n", F.row_number().over(w))
    df = df.withColumns({f"{c}_window": F.collect_list(c).over(w.rowsBetween(-(size - 1), 0)) for c in columns})
    return df.filter((F.col("_n") >= size) & ((F.col("_n") - size) % stride == 0)).drop("_n")


def clamped_integral(df: DataFrame, key: list[str], order: list[str], start: str, step: Column, name: str = "integral") -> DataFrame:
    """v_k = max(0, v_(k-1) + step_k) from start: S_k - min(0, running min S), with S the plain running sum."""
    w = _w(key, order)
    df = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    df = df.withColumn("_s", F.first(start).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn(name, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return df.drop("_step", "_s")


def trapezoid(df: DataFrame, key: list[str], order: list[str], t: str, value: str) -> Column:
    """The area between a row and the one before (null for the first)."""
    w = _w(key, order)
    return (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))


def within_budget(df: DataFrame, key: list[str], order: list[Column | str], size: str, budget: int, least: int = 0) -> DataFrame:
    """Rows in order while their running size is within budget, and at least the first `least` rows of a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = df.withColumns({"_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    return df.filter((F.col("_sum") <= budget) | (F.col("_n") <= least)).drop("_sum", "_n")


def nearest_per_horizon(df: DataFrame, key: list[str], elapsed: str, horizons: list[float], slack: float, order: list[str]) -> DataFrame:
    """For each horizon the row of a key whose elapsed time is nearest, within slack; the first on ties."""
    grid = F.explode(F.array(*[F.lit(float(h)) for h in horizons]))
    df = df.withColumn("horizon", grid).withColumn("_off", F.abs(F.col(elapsed) - F.col("horizon"))).filter(F.col("_off") <= slack)
    return keep_first(df, [*key, "horizon"], ["_off", *order]).drop("_off")


def toggles(df: DataFrame, key: list[str], order: list[str], t: str, opens: Column, closes: Column) -> DataFrame:
    """key, start, end of intervals: an opening row begins one (a repeated one begins it anew), a closing row ends it.

    One that is open at the end ends at the key's last time.
    """
    w = _w(key, order)
    df = df.withColumns({"_open": F.coalesce(opens, F.lit(False)), "_close": F.coalesce(closes, F.lit(False))})
    df = df.withColumn("_end", F.max(t).over(Window.partitionBy(*key))).filter("_open or _close")
    df = df.withColumn("_last", F.lead("_open").over(w)).withColumn("_next", F.lead(t).over(w))
    # After a repeated opening only the last one counts, so an interval is an opening whose next toggle closes it.
    kept = df.filter(F.col("_open") & ~F.coalesce(F.col("_last"), F.lit(False)))
    return kept.select(*key, F.col(t).alias("start"), F.coalesce("_next", "_end").alias("end"))


def lagged_correlation(df: DataFrame, key: list[str], order: list[str], a: str, b: str, lags: list[int]) -> DataFrame:
    """Correlation of a with b shifted by each lag, by row number within a key: an equi-join for each lag, not a range join."""
    df = df.withColumn("_i", F.row_number().over(_w(key, order)))
    left = df.select(*key, "_i", F.col(a).alias("_a")).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn("_j", F.col("_i") + F.col("lag"))
    right = df.select(*key, F.col("_i").alias("_j"), F.col(b).alias("_b"))
    return left.join(right, [*key, "_j"]).groupBy(*key, "lag").agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))
