"""Alert severity, texts, filters, rankings and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import holds, with_totals
from gaugeflow.functions.text import fill, iso, known, percent
from gaugeflow.operators.ordered import KEY, SEQ, attach
from gaugeflow.operators.stations import one_per_station


def _or_default(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def severity(score: Column, warning: Column, tier: Column) -> Column:
    """First matching band; comparisons with missing values do not match."""
    return (
        F.when(holds((score > 0.8) & (warning > 0.7)), "CRITICAL")
        .when(holds(tier == "high") | holds(warning > 0.7), "HIGH")
        .when(holds(tier == "medium") | holds(warning > 0.5), "MEDIUM")
        .when(holds(warning > 0.3), "LOW")
        .otherwise("NONE")
    )


def severity_rank(level: Column) -> Column:
    out = F.lit(0)
    for i, word in enumerate(V.SEVERITIES):
        out = F.when(level == word, i).otherwise(out)
    return out


def alert_message(level: Column, station: Column, score: Column, warning: Column) -> Column:
    parts = {"station": station, "risk": percent(score, 0), "warning": percent(warning, 0)}
    out = fill(V.ALERT_TEXT["NONE"], **parts)
    for word in V.SEVERITIES[1:]:
        out = F.when(level == word, fill(V.ALERT_TEXT[word], **parts)).otherwise(out)
    return out


def assess(predictions: DataFrame) -> DataFrame:
    """Add severity and whether it triggers, for every prediction."""
    level = severity(
        _or_default(predictions, "risk_score", 0.0),
        _or_default(predictions, "warning_probability", 0.0),
        _or_default(predictions, "risk_tier_name", "low"),
    )
    rows = predictions.withColumn("alert_severity", level)
    return rows.withColumn("alert_triggered", F.col("alert_severity").isin(*V.TRIGGERING))


def with_messages(assessed: DataFrame) -> DataFrame:
    station = F.coalesce(F.col("station_name"), F.lit("nan")) if "station_name" in assessed.columns else F.lit(V.UNKNOWN_STATION)
    text = alert_message(
        F.col("alert_severity"), station, _or_default(assessed, "risk_score", 0.0), _or_default(assessed, "warning_probability", 0.0)
    )
    return assessed.withColumn("alert_message", text)


def generate_alerts(
    predictions: DataFrame, stations: DataFrame | None = None, at: Column | None = None, name_first: bool = False
) -> DataFrame:
    """Triggered alerts with message, moment and station columns.

    Messages are written before the station join, so they carry a name only if
    the predictions do; `name_first` joins before writing them.
    """
    rows = assess(predictions).filter(F.col("alert_triggered"))
    if stations is None:
        rows = with_messages(rows)
    else:
        wanted = [c for c in ("station_name", "river_name", "state") if c not in predictions.columns]
        side = one_per_station(stations.select(KEY, *wanted))
        rows = with_messages(attach(rows, side, KEY, sized_by=stations)) if name_first else attach(with_messages(rows), side, KEY, sized_by=stations)
    return rows if at is None else rows.withColumn("alert_timestamp", iso(at))


def filter_by_severity(alerts: DataFrame, least: str = "MEDIUM") -> DataFrame:
    floor = V.SEVERITIES.index(least) if least in V.SEVERITIES else 0
    return alerts.filter(severity_rank(F.col("alert_severity")) >= floor)


def filter_by_states(alerts: DataFrame, states: Sequence[str]) -> DataFrame:
    return alerts.filter(F.col("state").isin(*states))


def prioritize(alerts: DataFrame, top: int = 10, seq: str = SEQ) -> DataFrame:
    """The top alerts by severity, then score; ties go to the smaller seq."""
    ranked = alerts.withColumn("severity_rank", severity_rank(F.col("alert_severity")))
    return ranked.orderBy(F.col("severity_rank").desc(), F.col("risk_score").desc_nulls_last(), F.col(seq)).limit(top)


def alert_summary(alerts: DataFrame) -> DataFrame:
    level = F.col("alert_severity")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(level == w).alias(f"{w.lower()}_count") for w in ("CRITICAL", "HIGH", "MEDIUM")],
        F.avg("risk_score").alias("avg_risk_score") if "risk_score" in alerts.columns else F.lit(0.0).alias("avg_risk_score"),
        F.avg("warning_probability").alias("avg_warning_prob") if "warning_probability" in alerts.columns else F.lit(0.0).alias("avg_warning_prob"),
    )


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_severity").agg(F.count(F.lit(1)).alias("alerts"))


def alert_history(history: DataFrame, last: int = 100, time: str = "alert_timestamp", seq: str = SEQ) -> DataFrame:
    """The newest rows of the alert table."""
    return history.orderBy(F.col(time).desc(), F.col(seq).desc()).limit(last)


def high_tier_alerts(predictions: DataFrame, stations: DataFrame | None, at: Column) -> DataFrame:
    """One record per high-tier prediction (any letter case), with district and message."""
    rows = predictions.filter(F.lower("risk_tier_name") == "high")
    if stations is not None:
        side = one_per_station(stations.select(KEY, F.col("district").alias("_district")))
        rows = attach(rows, side, KEY, sized_by=stations)
        district = F.coalesce(known(F.col("_district"), V.BLANK_WORDS + ("none",)), F.lit("Unknown"))
    else:
        district = F.lit("Unknown")
    name = F.col("station_name") if "station_name" in predictions.columns else F.lit(V.UNKNOWN_STATION)
    moment = iso(at)
    rows = rows.withColumns({"_name": name, "_where": district})
    text = fill(V.HIGH_TIER_ALERT_TEXT, station=F.col("_name"), district=F.col("_where"), risk=percent(F.col("risk_score"), 1), time=moment)
    ids = [c for c in (SEQ, KEY) if c in predictions.columns]
    return rows.select(
        *ids, F.col("_name").alias("station_name"), F.col("_where").alias("district"), "risk_score",
        F.lit(V.HIGH_TIER_ALERT_TYPE).alias("alert_type"), F.concat(moment, F.lit("Z")).alias("timestamp"), text.alias("message"),
    )


def predictive_flag(predictions: DataFrame, at: Column) -> DataFrame:
    """Add alerts: one entry when a later horizon is HIGH, else none."""
    soon, late = F.col("risk_tier_6h") == "HIGH", F.col("risk_tier_24h") == "HIGH"
    entry = F.struct(
        F.lit(V.PREDICTIVE_ALERT_TYPE).alias("type"), F.lit("HIGH").alias("severity"),
        F.lit(V.PREDICTIVE_ALERT_TEXT).alias("description"), F.when(holds(soon), 6).otherwise(24).alias("horizon_hours"),
        F.concat(iso(at), F.lit("Z")).alias("timestamp"),
    )
    return predictions.withColumn("alerts", F.when(holds(soon) | holds(late), F.array(entry)))


def force_demo_alerts(predictions: DataFrame, seq: str = SEQ) -> DataFrame:
    """With no medium or high row at all, raise the top row to high and the next two to medium.

    Original values are kept in real_* columns. The three rows come from a
    top-3 selection (ties to the smaller seq) that is joined back by seq.
    """
    tier = F.lower("risk_tier_name")
    raised = with_totals(predictions, "_all", rows=F.count_if(tier.isin("medium", "high")))
    top = predictions.orderBy(F.col("risk_score").desc_nulls_last(), F.col(seq)).limit(3).select(seq, "risk_score")
    place = F.row_number().over(Window.orderBy(F.col("risk_score").desc_nulls_last(), F.col(seq)))  # three rows
    top = top.select(F.col(seq).alias("_seq"), place.alias("_place"))
    rows = raised.join(F.broadcast(top), F.col(seq) == F.col("_seq"), "left").withColumn("_quiet", F.col("_all.rows") == 0)
    first, next_two, on = F.col("_place") == 1, F.col("_place") > 1, F.col("_quiet")
    real = {
        "real_risk_score": "risk_score", "real_risk_level": "risk_tier_name", "real_distance_to_danger": "distance_to_danger",
        "real_rate_of_rise": "rate_of_rise_3h", "real_current_level": "current_level",
    }
    rows = rows.withColumns({new: F.when(on, F.col(old)) for new, old in real.items()})
    return rows.withColumns({
        "risk_score": F.when(on & first, V.FORCED_HIGH_SCORE).when(on & next_two, V.FORCED_MEDIUM_SCORE).otherwise(F.col("risk_score")),
        "risk_tier": F.when(on & first, 2).when(on & next_two, 1).otherwise(F.col("risk_tier")),
        "risk_tier_name": F.when(on & first, "high").when(on & next_two, "medium").otherwise(F.col("risk_tier_name")),
        "demo_mode": F.coalesce(on & F.col("_place").isNotNull(), F.lit(False)),
        "alert_mode": F.when(on & first, "forced_high").when(on & next_two, "forced_medium").when(~on, "natural"),
    }).drop("_seq", "_place", "_quiet", "_all")


def cycle_statistics(predictions: DataFrame, by: str | None = None) -> DataFrame:
    """Tier counts, documents written and alerts of one cycle (or per value of `by`)."""
    tier = F.lower("risk_tier_name")
    rows = predictions.groupBy(by) if by else predictions
    counted = rows.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        *[F.count_if(tier == t).alias(f"{t}_risk_count") for t in ("high", "medium", "low")],
    )
    low = F.least(F.lit(V.LOWEST_DOCUMENTS), F.col("low_risk_count"))
    return counted.withColumns({
        "low_risk_documents": low, "documents": F.col("high_risk_count") + F.col("medium_risk_count") + low,
        "alerts_triggered": F.col("high_risk_count"),
    })
