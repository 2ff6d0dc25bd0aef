"""Hydrological features of level readings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import holds
from gaugeflow.operators.ordered import (
    KEY, LEVEL, SEQ, TIME, US, HotKeys, Lane, Step, as_before, attach, fold_until, numbered, per_station, previous_level,
    find_hot, running, slice_in_order, slices_for, time_order, timed,
)
from gaugeflow.operators.stations import one_per_station
from gaugeflow.session import use_checkpoints

HOUR_US = 3_600_000_000


def with_station_columns(obs: DataFrame, stations: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Left join the station dimension; columns the readings already have are kept from them."""
    wanted = [c for c in (columns or stations.columns) if c not in obs.columns]
    side = one_per_station(stations.select(KEY, *wanted))
    return attach(obs, side, KEY, sized_by=stations)


def distances(df: DataFrame) -> DataFrame:
    level = F.col(LEVEL)
    return df.withColumns({
        "distance_to_warning": F.col("warning_level") - level,
        "distance_to_danger": F.col("danger_level") - level,
    })


# --- rate of rise: backward as-of lookup -----------------------------------------
def _rate_step(df: DataFrame, lane: Lane, hours: int, seq: str) -> DataFrame:
    dated = F.struct(F.col(US).alias("u"), F.col(seq).alias("s"), F.col(LEVEL).alias("v"))
    if lane.sliced:
        rows = fold_until(df, df, lane, F.col(US) - hours * HOUR_US, {"_old": (dated, F.max)})
        old = F.col("_old")
    else:
        rows = df
        upto = (
            Window.partitionBy(lane.key).orderBy(F.col(US).asc_nulls_last())
            .rangeBetween(Window.unboundedPreceding, -hours * HOUR_US)
        )
        old = F.when(F.col(US).isNotNull(), F.max(dated).over(upto))
    rate = F.greatest(F.lit(0.0), (F.col(LEVEL) - old["v"]) / float(hours))
    return rows.withColumn(f"rate_of_rise_{hours}h", F.coalesce(rate, F.lit(0.0))).drop("_old")


def rate_of_rise(
    df: DataFrame, hours: int = V.RATE_WINDOW_HOURS, seq: str = SEQ, hot: HotKeys | None = None
) -> DataFrame:
    """Rise per hour against the newest reading that is at least `hours` old; never negative."""
    return as_before(per_station(timed(df), [Step(_rate_step, {"hours": hours, "seq": seq})], hot=hot), df)


# --- rising hours ------------------------------------------------------------------
def rising_hours(trend: Column) -> Column:
    """Rising hours as read off the trend word."""
    out = F.lit(V.RISING_HOURS_OTHER)
    for word, hours in V.RISING_HOURS.items():
        out = F.when(trend == word, hours).otherwise(out)
    return out


def _run_step(df: DataFrame, lane: Lane, seq: str) -> DataFrame:
    rows = previous_level(df, lane, LEVEL, seq, "_prev")
    rows, by = lane.arrange(rows, *time_order(seq))
    rows = numbered(rows, lane, by, time_order(seq))
    broke = F.when(~holds(F.col(LEVEL) > F.col("_prev")), F.col("_pos"))
    rows = rows.withColumn("_broke", broke)
    latest = F.max("_broke").over(running(by, *time_order(seq)))
    if lane.sliced:
        rows = lane.carry(rows, "_earlier", F.max("_broke"), F.max)
        latest = F.coalesce(latest, F.col("_earlier"))
    return rows.withColumn("rising_run", (F.col("_pos") - latest).cast("int")).drop("_prev", "_pos", "_broke", "_earlier")


def rising_run(df: DataFrame, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Length of the current run of consecutive rises."""
    return as_before(per_station(timed(df), [Step(_run_step, {"seq": seq})], hot=hot), df)


# --- percentile within the station ----------------------------------------------------
def _percentile_step(df: DataFrame, lane: Lane, seq: str) -> DataFrame:
    by_level = [F.col(LEVEL).asc_nulls_last(), F.col(seq)]
    rows, by = lane.arrange(df, *by_level)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(LEVEL).asc_nulls_last())) - 1
    if not lane.sliced:
        below, total = rank, F.count(F.lit(1)).over(Window.partitionBy(*by))
    else:
        # Slices are in level order. Only a slice's first value can also occur in
        # earlier slices, so for it the rows below are those before its first slice.
        # The summary has one row per slice and hot key.
        key = lane.key
        slices = (
            rows.withColumn("_top", F.max(LEVEL).over(Window.partitionBy(*by)))
            .groupBy(F.col(key).alias("_k"), F.col("_slice").alias("_s"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(LEVEL).alias("_low"), F.max(LEVEL).alias("_top"),
                 F.count_if(F.col(LEVEL) < F.col("_top")).alias("_under_top"))
        )
        whole, ahead = Window.partitionBy("_k"), Window.partitionBy("_k").orderBy("_s")
        before = F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
        slices = slices.withColumns({"_offset": F.coalesce(before, F.lit(0)), "_total": F.sum("_n").over(whole)})
        first = F.min(F.col("_offset") + F.col("_under_top")).over(Window.partitionBy("_k", "_top").orderBy("_s"))
        slices = slices.withColumn("_below_top", first)
        continued = F.lag("_top").over(ahead) == F.col("_low")
        slices = slices.withColumn("_below_low", F.when(continued, F.lag("_below_top").over(ahead)).otherwise(F.col("_offset")))
        slices = slices.select("_k", "_s", "_low", "_offset", "_total", "_below_low")
        rows = rows.join(F.broadcast(slices), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
        below = F.when(F.col(LEVEL) == F.col("_low"), F.col("_below_low")).otherwise(F.col("_offset") + rank)
        total = F.col("_total")
    share = F.when(total < 2, V.LONE_ROW_PERCENTILE).when(F.col(LEVEL).isNull(), 0.0).otherwise(below / total * 100.0)
    return rows.withColumn("historical_percentile", share).drop("_k", "_s", "_low", "_offset", "_total", "_below_low")


def historical_percentile(df: DataFrame, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Share of the station's rows with a strictly lower level, in percent."""
    return per_station(df, [Step(_percentile_step, {"seq": seq})], hot=hot)


def _prefix_counts(rows: DataFrame, lane: Lane, behind: int) -> DataFrame:
    """_now and _old: how many rows of the station are not later than the row, and not later than `behind` before it."""
    if lane.sliced:
        facts, one = rows.select(lane.key, US), (F.lit(1).cast("long"), F.sum)
        rows = fold_until(rows, facts, lane, F.col(US), {"_now": one})
        rows = fold_until(rows, facts, lane, F.col(US) - behind, {"_old": one})
        size = rows.groupBy(F.col(lane.key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))  # one row per hot key
        rows = rows.join(F.broadcast(size), F.col(lane.key).eqNullSafe(F.col("_k"))).drop("_k")
    else:
        base = Window.partitionBy(lane.key).orderBy(F.col(US).asc_nulls_last())
        rows = rows.withColumns({
            "_now": F.count(US).over(base.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "_old": F.count(US).over(base.rangeBetween(Window.unboundedPreceding, -behind)),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(lane.key)),
        })
    untimed = F.col(US).isNull()
    return rows.withColumns({c: F.when(untimed, 0).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in ("_now", "_old")})


def _trailing_step(df: DataFrame, lane: Lane, days: int, seq: str) -> DataFrame:
    """Rows below within a moving time range, in n log n.

    The range is the difference of two prefixes of the station's time order. A
    prefix splits into blocks of 1, 2, 4, ... rows, one per set bit of its length,
    so every reading is filed in the blocks it belongs to and every question is
    put to the blocks of its prefix; within a block one pass in level order
    answers all questions. No pairs of rows are formed.
    """
    order = time_order(seq)
    rows, by = lane.arrange(df, *order)
    rows = numbered(rows, lane, by, order)
    rows = _prefix_counts(rows, lane, days * 24 * HOUR_US + 1)
    valued = rows.filter(F.col(LEVEL).isNotNull() & F.col(US).isNotNull())
    filed = valued.select(
        lane.key, F.col(LEVEL).alias("_v"), F.lit(1).alias("_data"), F.lit(None).cast("long").alias("_id"), F.lit(0).alias("_sign"),
        (F.col("_pos") - 1).alias("_p"),
        F.explode(F.expr("filter(sequence(0, cast(floor(log2(_n)) as int)), k -> (shiftright(_pos - 1, k) & 1) = 0)")).alias("_bit"),
    ).withColumn("_block", F.expr("shiftright(_p, _bit)"))
    prefixes = F.explode(F.array(
        F.struct(F.col("_now").alias("p"), F.lit(1).alias("sign")), F.struct(F.col("_old").alias("p"), F.lit(-1).alias("sign"))
    ))
    asked = valued.select(lane.key, F.col(LEVEL).alias("_v"), F.col(seq).cast("long").alias("_id"), prefixes.alias("_q")).filter("_q.p > 0")
    asked = asked.select(
        lane.key, "_v", F.lit(0).alias("_data"), "_id", F.col("_q.sign").alias("_sign"), F.col("_q.p").alias("_p"),
        F.explode(F.expr("filter(sequence(0, cast(floor(log2(_q.p)) as int)), k -> (shiftright(_q.p, k) & 1) = 1)")).alias("_bit"),
    ).withColumn("_block", F.expr("shiftright(_p, _bit + 1) * 2"))
    both = filed.unionByName(asked).select(F.struct(lane.key, "_bit", "_block").alias("_group"), "_v", "_data", "_id", "_sign")
    # A row of a station of any size is filed in, and asks, about half of 32 sizes: once as data, twice as a question.
    wanted = slices_for(df.sparkSession, 48 * lane.rows) if lane.rows else 32 * lane.parts
    blocks = Lane("_group", min(32 * lane.parts, wanted) if lane.sliced else 0)
    by_level = [F.col("_v").asc(), F.col("_data").asc()]
    both, group = blocks.arrange(both, *by_level)
    below = F.sum("_data").over(running(group, *by_level))
    if blocks.sliced:
        both = blocks.carry(both, "_c", F.sum("_data"), F.sum)
        below = below + F.coalesce(F.col("_c"), F.lit(0))
    answers = both.withColumn("_below", below).filter("_data = 0").groupBy("_id").agg(F.sum(F.col("_sign") * F.col("_below")).alias("_below"))
    inside = F.col("_now") - F.col("_old")
    share = (
        F.when(inside < 2, V.LONE_ROW_PERCENTILE).when(F.col(LEVEL).isNull(), 0.0)
        .otherwise(F.coalesce(F.col("_below"), F.lit(0)) / inside * 100.0)
    )
    out = rows.join(answers, F.col(seq) == F.col("_id"), "left").withColumn("trailing_percentile", share)
    return out.drop("_pos", "_now", "_old", "_n", "_id", "_below")


def trailing_percentile(df: DataFrame, days: int = V.HISTORY_DAYS, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Share of the station's rows of the trailing days with a strictly lower level, in percent."""
    return as_before(per_station(timed(df), [Step(_trailing_step, {"days": days, "seq": seq})], hot=hot), df)


# --- volatility -------------------------------------------------------------------------
def _volatility_step(df: DataFrame, lane: Lane) -> DataFrame:
    if not lane.sliced:
        spread = F.stddev_samp(LEVEL).over(Window.partitionBy(lane.key))
        return df.withColumn("station_volatility", F.coalesce(spread, F.lit(0.0)))
    # One row per hot key; their number is bounded by total rows / row limit.
    spread = df.groupBy(F.col(lane.key).alias("_k")).agg(F.coalesce(F.stddev_samp(LEVEL), F.lit(0.0)).alias("station_volatility"))
    return df.join(F.broadcast(spread), F.col(lane.key).eqNullSafe(F.col("_k")), "left").drop("_k")


def station_volatility(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Sample standard deviation of all levels of the station."""
    return per_station(df, [Step(_volatility_step)], hot=hot)


def _change_step(df: DataFrame, lane: Lane, hours: int, seq: str) -> DataFrame:
    """Spread of level changes from differences of prefix sums.

    A sliding frame would be summed anew for every row; two running frames are
    linear. Sums are exact decimals, so subtracting them loses nothing.
    """
    rows = previous_level(df, lane, LEVEL, seq, "_prev")
    rows = rows.withColumn("_change", (F.col(LEVEL) - F.col("_prev")).cast("decimal(18,9)"))
    parts = {
        "n": (F.when(F.col("_change").isNotNull(), F.lit(1).cast("decimal(18,0)")), F.sum),
        "s": (F.col("_change"), F.sum),
        "q": ((F.col("_change") * F.col("_change")).cast("decimal(28,18)"), F.sum),
    }
    behind = hours * HOUR_US + 1
    if lane.sliced:
        facts = rows.select(lane.key, US, "_change")
        rows = fold_until(rows, facts, lane, F.col(US), {f"_now_{k}": p for k, p in parts.items()})
        rows = fold_until(rows, facts, lane, F.col(US) - behind, {f"_old_{k}": p for k, p in parts.items()})
    else:
        base = Window.partitionBy(lane.key).orderBy(F.col(US).asc_nulls_last())
        now = base.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        old = base.rangeBetween(Window.unboundedPreceding, -behind)
        rows = rows.withColumns({f"_now_{k}": F.sum(v).over(now) for k, (v, _) in parts.items()})
        rows = rows.withColumns({f"_old_{k}": F.sum(v).over(old) for k, (v, _) in parts.items()})

    def inside(name: str) -> Column:
        return F.coalesce(F.col(f"_now_{name}") - F.col(f"_old_{name}"), F.col(f"_now_{name}")).cast("double")

    n, s, q = inside("n"), inside("s"), inside("q")
    variance = F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1.0))
    spread = F.when(F.col(US).isNotNull() & (n >= 2), F.sqrt(variance)).otherwise(0.0)
    extra = [f"_{w}_{k}" for w in ("now", "old") for k in parts]
    return rows.withColumn("change_volatility", spread).drop("_prev", "_change", *extra)


def change_volatility(
    df: DataFrame, hours: int = V.LOOKBACK_HOURS, seq: str = SEQ, hot: HotKeys | None = None
) -> DataFrame:
    """Sample standard deviation of level changes within the trailing hours."""
    return as_before(per_station(timed(df), [Step(_change_step, {"hours": hours, "seq": seq})], hot=hot), df)


# --- averages ------------------------------------------------------------------------------
def basin_average(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Mean level of the basin on every row; rows without a basin get none.

    Levels are summed per basin before anything moves, and only the small result
    is joined back; a basin never has to fit into one task. With the station
    table at hand basins are counted there and not on the readings.
    """
    means = df.filter(F.col("basin").isNotNull()).groupBy("basin").agg(F.avg(LEVEL).alias("basin_avg_level"))
    named = stations.select("basin").distinct() if stations is not None else None
    return attach(df.drop("basin_avg_level"), means, "basin", sized_by=named)


def _two_before(df: DataFrame, lane: Lane, seq: str) -> DataFrame:
    """_p1, _p2: the levels one and two rows back in the station, in structs, so that a missing level is told from no row."""
    rows = df.withColumn("_v", F.struct(F.col(LEVEL).alias("v")))
    rows = previous_level(rows, lane, "_v", seq, "_p1")
    return previous_level(rows, lane, "_p1", seq, "_p2").drop("_v")


def _before_station(rows: DataFrame, seq: str) -> DataFrame:
    """For each station the levels of the two rows before its first in table order: _q1, _q2.

    Works on the last two rows of each station only, in slices with their borders carried over."""
    place = F.struct(F.col(US).isNull().alias("n"), F.col(US).alias("u"), F.col(seq).alias("s"), F.struct(F.col(LEVEL).alias("v")).alias("_v"), F.col("_p1"))
    last = rows.groupBy(KEY).agg(F.max(place).alias("_l")).select(KEY, F.col("_l._v").alias("_e1"), F.col("_l._p1").alias("_e2")).checkpoint()
    sliced = slice_in_order(last, slices_for(rows.sparkSession, last.count()), F.col(KEY).asc_nulls_last())
    # The last two stations of a slice stand for all that a later station can need of it.
    newest = Window.partitionBy("_slice").orderBy(F.col(KEY).desc_nulls_first())
    ends = sliced.withColumn("_back", F.row_number().over(newest)).filter("_back <= 2")
    numbered_ends = ends.withColumn("_no", F.row_number().over(Window.orderBy(F.col("_slice"), F.col("_back").desc())))  # two rows per slice
    first = numbered_ends.groupBy("_slice").agg(F.min("_no").alias("_first"))
    wanted = first.select("_slice", F.explode(F.sequence(F.col("_first") - 2, F.col("_first") - 1)).alias("_no"))
    ghosts = wanted.join(F.broadcast(numbered_ends.select("_no", "_e1", "_e2")), "_no").withColumnRenamed("_no", "_ghost")
    both = sliced.withColumn("_ghost", F.lit(None).cast("int")).unionByName(ghosts, allowMissingColumns=True)
    order = Window.partitionBy("_slice").orderBy(F.col("_ghost").asc_nulls_last(), F.col(KEY).asc_nulls_last())
    one, two = (F.lag(F.struct("_e1", "_e2"), i).over(order) for i in (1, 2))
    both = both.withColumns({"_q1": one["_e1"], "_q2": F.when(one["_e2"].isNotNull(), one["_e2"]).otherwise(two["_e1"])})
    return both.filter(F.col("_ghost").isNull()).select(F.col(KEY).alias("_k"), "_q1", "_q2")


def rolling_average(df: DataFrame, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Mean of the last three rows in table order (station, time), across station borders.

    Rows look two rows back in their station; a station's first two rows also see the last rows of
    the stations before it, which come from a table of one row per station. Readings are never
    sorted across stations.
    """
    use_checkpoints(df.sparkSession)
    rows = per_station(timed(df), [Step(_two_before, {"seq": seq})], hot=hot)
    borders = _before_station(rows, seq)
    rows = rows.join(borders, F.col(KEY).eqNullSafe(F.col("_k")), "left").drop("_k")
    back1 = F.coalesce(F.col("_p1"), F.col("_q1"))
    back2 = F.when(F.col("_p2").isNotNull(), F.col("_p2")).when(F.col("_p1").isNotNull(), F.col("_q1")).otherwise(F.col("_q2"))
    levels = [back2["v"], back1["v"], F.col(LEVEL)]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in levels[1:]), F.coalesce(levels[0], F.lit(0.0)))
    known = sum((x.isNotNull().cast("int") for x in levels[1:]), levels[0].isNotNull().cast("int"))
    mean = F.when(known > 0, total / known)
    return rows.withColumn("basin_avg_level", mean).drop("_p1", "_p2", "_q1", "_q2", US)


# --- time ------------------------------------------------------------------------------------
def hours_since_update(time: Column, as_of: Column | None) -> Column:
    """Age of the reading in hours; with no reference moment the constant 0 of the compatible form."""
    if as_of is None:
        return F.lit(0.0)
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / float(HOUR_US)
    return F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0)))


def seasonal_factor(time: Column) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * F.month(time) / 12.0)


# --- composite --------------------------------------------------------------------------------
def hydro_features(
    obs: DataFrame,
    stations: DataFrame | None = None,
    as_of: Column | None = None,
    rate_hours: int = V.RATE_WINDOW_HOURS,
    seq: str = SEQ,
    hot: HotKeys | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Ids plus the hydrological features in their fixed order.

    The station steps run over one exchange. Without a basin anywhere the basin
    average is the rolling mean in table order.
    """
    hot = find_hot(obs) if hot is None else hot
    steps = [Step(_rate_step, {"hours": rate_hours, "seq": seq}), Step(_percentile_step, {"seq": seq}), Step(_volatility_step)]
    rows = per_station(timed(distances(obs)), steps, hot=hot).drop(US)
    dimension = stations if stations is not None and "basin" in stations.columns else None
    if dimension is not None:
        rows = with_station_columns(rows, dimension, ["basin"])
    rows = basin_average(rows, dimension) if "basin" in rows.columns else rolling_average(rows, seq, hot)
    trend = F.col("trend") if "trend" in rows.columns else F.lit("unknown")
    if f"rate_of_rise_{rate_hours}h" != "rate_of_rise_3h":
        rows = rows.withColumnRenamed(f"rate_of_rise_{rate_hours}h", "rate_of_rise_3h")
    rows = rows.withColumns({
        "consecutive_rising_hours": rising_hours(trend),
        "hours_since_last_update": hours_since_update(F.col(TIME), as_of),
        "seasonal_factor": seasonal_factor(F.col(TIME)),
    })
    ids = [c for c in (seq, KEY, TIME) if c in rows.columns]
    return rows.select(*ids, *V.HYDRO_FEATURES, *carried)
