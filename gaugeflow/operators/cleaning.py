"""Validation, repair and unit handling of level readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import holds, with_totals
from gaugeflow.operators.order_stats import exact_quantiles
from gaugeflow.operators.ordered import (
    LEVEL, SEQ, TIME, US, HotKeys, Lane, Step, as_before, find_hot, numbered, per_station, previous_level, running, time_order, timed,
)
from gaugeflow.schemas import LEVEL_COLUMNS

REPAIRED = ("current_level", "warning_level", "danger_level")


def coerce_time(df: DataFrame, source: str, target: str = TIME) -> DataFrame:
    """Text to UTC timestamp; text that is no timestamp becomes NULL, a zone is applied and dropped."""
    if dict(df.dtypes)[source] == "string":
        parsed = F.try_to_timestamp(F.col(source))
    else:
        parsed = F.col(source).cast("timestamp")
    return df.withColumn(target, parsed)


def is_missing(level: Column) -> Column:
    return level.isNull()


def is_out_of_range(level: Column) -> Column:
    return holds((level < V.LEVEL_MIN) | (level > V.LEVEL_MAX))


def _jump_step(df: DataFrame, lane: Lane, seq: str) -> DataFrame:
    rows = previous_level(df, lane, LEVEL, seq, "_before_level")
    jump = holds(F.abs(F.col(LEVEL) - F.col("_before_level")) > V.JUMP_MAX)
    return rows.withColumn("is_jump", jump).drop("_before_level")


def flag_jumps(df: DataFrame, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Mark readings that differ by more than the allowed jump from the one before."""
    return as_before(per_station(timed(df), [Step(_jump_step, {"seq": seq})], hot=hot), df)


def validate_levels(df: DataFrame, seq: str = SEQ, hot: HotKeys | None = None) -> DataFrame:
    """Add is_valid and the ordered flag text."""
    rows = flag_jumps(df, seq, hot)
    level = F.col(LEVEL)
    checks = ((is_missing(level), V.FLAG_MISSING), (is_out_of_range(level), V.FLAG_RANGE), (F.col("is_jump"), V.FLAG_JUMP))
    flags = F.concat(*[F.when(test, text).otherwise("") for test, text in checks])
    return rows.withColumn("validation_flags", flags).withColumn("is_valid", F.col("validation_flags") == "").drop("is_jump")


def validation_report(validated: DataFrame) -> DataFrame:
    flags = F.col("validation_flags")
    return validated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(flags.contains(V.FLAG_RANGE)).alias("invalid_levels"),
        F.count_if(flags.contains(V.FLAG_MISSING)).alias("missing_values"),
        F.count_if(flags.contains(V.FLAG_JUMP)).alias("sensor_errors"),
        F.count_if(~F.col("is_valid")).alias("flagged_records"),
    )


def quality_counts(cleaned: DataFrame) -> DataFrame:
    """Valid, invalid and outlier counts of a cleaned table."""
    return cleaned.agg(
        F.count_if(F.col("is_valid")).alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
        F.count_if(F.col("is_outlier")).alias("outliers"),
    )


def _interpolate_step(df: DataFrame, lane: Lane, columns: tuple[str, ...], seq: str) -> DataFrame:
    rows, by = lane.arrange(df, *time_order(seq))
    rows = numbered(rows, lane, by, time_order(seq))
    # Looking ahead is a running frame over the reversed order: a frame that ends
    # at UNBOUNDED FOLLOWING would be evaluated anew for every row.
    behind = running(by, *time_order(seq))
    ahead = running(by, F.col("_pos").desc())
    for c in columns:
        mark = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("at"), F.col(c).alias("v")))
        rows = rows.withColumn(f"_m_{c}", mark)
        if lane.sliced:
            rows = lane.carry(rows, f"_lo_{c}", F.max(f"_m_{c}"), F.max)
            rows = lane.carry(rows, f"_hi_{c}", F.min(f"_m_{c}"), F.min, following=True)
    for c in columns:
        low = F.last(f"_m_{c}", ignorenulls=True).over(behind)
        rows = rows.withColumn(f"_l_{c}", F.coalesce(low, f"_lo_{c}") if lane.sliced else low)
    for c in columns:
        high = F.last(f"_m_{c}", ignorenulls=True).over(ahead)
        rows = rows.withColumn(f"_h_{c}", F.coalesce(high, f"_hi_{c}") if lane.sliced else high)
    for c in columns:
        low, high = F.col(f"_l_{c}"), F.col(f"_h_{c}")
        share = (F.col("_pos") - low["at"]) / (high["at"] - low["at"])
        between = low["v"] + (high["v"] - low["v"]) * share
        rows = rows.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(low.isNotNull() & high.isNotNull(), between)
            .otherwise(F.coalesce(low["v"], high["v"])),
        )
    extra = [f"_{p}_{c}" for c in columns for p in ("m", "l", "h", "lo", "hi")]
    return rows.drop("_pos", *extra)


def _forward_step(df: DataFrame, lane: Lane, columns: tuple[str, ...], seq: str) -> DataFrame:
    rows, by = lane.arrange(df, *time_order(seq))
    for c in columns:
        filled = F.last(c, ignorenulls=True).over(running(by, *time_order(seq)))
        if lane.sliced:
            dated = F.struct(F.col(US).isNull().alias("n"), F.col(US).alias("u"), F.col(seq).alias("s"), F.col(c).alias("v"))
            rows = lane.carry(rows, f"_lo_{c}", F.max(F.when(F.col(c).isNotNull(), dated)), F.max)
            filled = F.coalesce(filled, F.col(f"_lo_{c}")["v"])
        rows = rows.withColumn(c, filled)
    return rows.drop(*[f"_lo_{c}" for c in columns])


def fill_gaps(
    df: DataFrame,
    strategy: str = "interpolate",
    columns: tuple[str, ...] = REPAIRED,
    seq: str = SEQ,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Repair missing levels: 'interpolate' (by row position), 'forward_fill' or 'drop'."""
    present = tuple(c for c in columns if c in df.columns)
    if strategy == "drop":
        return df.na.drop(subset=list(present)) if present else df
    steps = {"interpolate": _interpolate_step, "forward_fill": _forward_step}
    if strategy not in steps or not present:
        return df
    step = Step(steps[strategy], {"columns": present, "seq": seq})
    return as_before(per_station(timed(df), [step], hot=hot), df)


def normalize_units(df: DataFrame) -> DataFrame:
    """Divide a whole level column by 100 when any of its values looks like centimetres."""
    present = [c for c in LEVEL_COLUMNS if c in df.columns]
    if not present:
        return df
    rows = with_totals(df, "_top", **{c: F.max(c) for c in present})
    return rows.withColumns({
        c: F.when(F.col(f"_top.{c}") > V.CENTIMETRE_HINT, F.col(c) / V.CENTIMETRES_PER_METRE).otherwise(F.col(c))
        for c in present
    }).drop("_top")


def detect_outliers(df: DataFrame, column: str = LEVEL) -> DataFrame:
    """Mark values outside 1.5 interquartile ranges; unchanged when the column is absent."""
    if column not in df.columns:
        return df
    lower, upper = exact_quantiles(df, column, [0.25, 0.75])
    if lower is None:
        return df.withColumn("is_outlier", F.lit(False))
    reach = V.OUTLIER_IQR_FACTOR * (upper - lower)
    if math.isnan(reach) or math.isnan(lower - reach) or math.isnan(upper + reach):
        return df.withColumn("is_outlier", F.lit(False))  # both quartiles are infinite: there is no fence
    outside = (F.col(column) < lower - reach) | (F.col(column) > upper + reach)
    return df.withColumn("is_outlier", holds(outside))


def clean(
    df: DataFrame,
    validate: bool = True,
    normalize: bool = True,
    handle_missing: bool = True,
    outliers: bool = True,
    seq: str = SEQ,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Validate, convert units, repair gaps and mark outliers, in this order.

    The range check sees values before unit conversion, so centimetre data is
    flagged as out of range.
    """
    given = df
    if validate or handle_missing:
        hot = find_hot(df) if hot is None else hot
        df = timed(df)
    if validate:
        df = validate_levels(df, seq, hot)
    if normalize:
        df = normalize_units(df)
    if handle_missing:
        df = fill_gaps(df, seq=seq, hot=hot)
    return as_before(detect_outliers(df) if outliers else df, given)
