"""Feature contributions and the sentences that explain a prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import holds
from gaugeflow.functions.text import fill, fixed, percent, rounded
from gaugeflow.operators.ordered import KEY, SEQ, TIME
from gaugeflow.operators.scoring import risk_level
from gaugeflow.operators.stations import first_per_station


def top_factors(weights: Mapping[str, float], top: int = V.TOP_FACTORS) -> Column:
    """The features whose value times importance is largest in size.

    Computed inside the row: the weights are literals, nothing is joined or shuffled.
    """
    entries = F.array(*[
        F.struct(
            F.abs(F.col(f) * F.lit(w)).alias("size"), F.lit(-i).alias("tie"), F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"), (F.col(f) * F.lit(w)).alias("contribution"), F.lit(round(float(w), 3)).alias("importance"),
        )
        for i, (f, w) in enumerate(weights.items())
    ])
    best = F.slice(F.sort_array(entries, asc=False), 1, top)
    return F.transform(best, lambda e: F.struct(
        e["feature"].alias("feature"), rounded(e["value"], 3).alias("value"),
        rounded(e["contribution"], 3).alias("contribution"), e["importance"].alias("importance"),
    ))


def score_summary(score: Column, to_danger: Column, rise: Column) -> Column:
    return F.concat(
        fill(V.SCORE_SUMMARY, risk=percent(score, 1), level=F.upper(risk_level(score))),
        F.when(to_danger < 0.5, V.SCORE_SUMMARY_CLOSE).when(to_danger < 1.0, V.SCORE_SUMMARY_NEAR).otherwise(""),
        F.when(rise > 0.1, fill(V.SCORE_SUMMARY_RISE, rise=fixed(rise, 2))).otherwise(""),
    )


def warning_summary(warning: Column, rise: Column) -> Column:
    likelihood = F.when(warning > 0.7, "HIGH").when(warning > 0.5, "MODERATE").otherwise("LOW")
    return F.concat(
        fill(V.WARNING_SUMMARY, warning=percent(warning, 1), likelihood=likelihood),
        F.when(rise > 0.15, V.WARNING_SUMMARY_RISE).otherwise(""),
    )


def tier_summary(tier: Column, to_warning: Column) -> Column:
    text = F.lit(V.TIER_SUMMARY_OTHER)
    for word, sentence in V.TIER_SUMMARY.items():
        text = F.when(tier == word, sentence).otherwise(text)
    return F.concat(text, F.when(to_warning < 0.5, V.TIER_SUMMARY_NEAR).otherwise(""))


def explain_score(weights: Mapping[str, float], top: int = V.TOP_FACTORS) -> Column:
    score = F.col("risk_score")
    return F.struct(
        rounded(score, 3).alias("risk_score"), risk_level(score).alias("risk_level"), top_factors(weights, top).alias("top_factors"),
        score_summary(score, F.col("distance_to_danger"), F.col("rate_of_rise_3h")).alias("summary"),
    )


def explain_warning(weights: Mapping[str, float], top: int = V.TOP_FACTORS) -> Column:
    p = F.col("warning_probability")
    return F.struct(
        rounded(p, 3).alias("warning_probability"), holds(p > 0.5).alias("warning_triggered"),
        top_factors(weights, top).alias("top_factors"), warning_summary(p, F.col("rate_of_rise_3h")).alias("summary"),
    )


def explain_tier(weights: Mapping[str, float], top: int = V.TOP_FACTORS) -> Column:
    tier = F.col("risk_tier_name")
    return F.struct(
        tier.alias("risk_tier"), top_factors(weights, top).alias("top_factors"),
        tier_summary(tier, F.col("distance_to_warning")).alias("summary"),
    )


def explain_predictions(df: DataFrame, weights: Mapping[str, Mapping[str, float]], top: int = V.TOP_FACTORS) -> DataFrame:
    """All three explanations for every row; a model without weights gives no column."""
    makers = {"risk_regressor": ("risk_score_explained", explain_score), "warning_classifier": ("warning_explained", explain_warning),
              "risk_tier_classifier": ("risk_tier_explained", explain_tier)}
    return df.withColumns({name: make(weights[m], top) for m, (name, make) in makers.items() if m in weights})


def risk_factors() -> Column:
    """Bullet lines of the critical factors, or the line that says there are none."""
    rise, danger = F.col("rate_of_rise_3h"), F.col("distance_to_danger")
    hours, place = F.col("consecutive_rising_hours"), F.col("historical_percentile")
    lines = F.array_compact(F.array(
        F.when(rise > 0.1, fill(V.FACTOR_RISE, value=fixed(rise, 3))),
        F.when(danger < 1.0, fill(V.FACTOR_DANGER, value=fixed(danger, 2))),
        F.when(hours > 6, fill(V.FACTOR_SUSTAINED, value=fixed(hours.cast("double"), 0))),
        F.when(place > 80, fill(V.FACTOR_HISTORY, value=fixed(place, 0))),
    ))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(V.FACTOR_NONE)


def recommendation(tier: Column, warning: Column) -> Column:
    return (
        F.when(holds(tier == "high") | holds(warning > 0.7), V.ADVICE_URGENT)
        .when(holds(tier == "medium") | holds(warning > 0.5), V.ADVICE_CAUTION)
        .otherwise(V.ADVICE_NORMAL)
    )


def bulletin(station_id: Column, station: Column) -> Column:
    """The full alert text of a row that has predictions and features."""
    score, warning, tier = F.col("risk_score"), F.col("warning_probability"), F.col("risk_tier_name")
    rise = F.col("rate_of_rise_3h")
    return fill(
        V.BULLETIN, station=station, id=station_id.cast("string"), risk=percent(score, 1), level=F.upper(risk_level(score)),
        tier=F.upper(tier), warning=percent(warning, 1), water=fixed(F.col("current_level"), 2),
        to_warning=fixed(F.col("distance_to_warning"), 2), to_danger=fixed(F.col("distance_to_danger"), 2), rise=fixed(rise, 3),
        trend=F.when(rise > 0, "RISING").otherwise("FALLING"), factors=risk_factors(), advice=recommendation(tier, warning),
    )


def explanation_lines(df: DataFrame, level: Column) -> Column:
    """The explanation list of a document; forced demo rows are explained with their real values."""
    def shown(name: str, real: str) -> Column:
        value = F.col(name)
        if "demo_mode" in df.columns and real in df.columns:
            return F.when(holds(F.col("demo_mode")), F.coalesce(F.col(real), value)).otherwise(value)
        return value

    danger, rise = shown("distance_to_danger", "real_distance_to_danger"), shown("rate_of_rise_3h", "real_rate_of_rise")
    water, score = shown("current_level", "real_current_level"), F.col("risk_score")
    risk = percent(score, 1)
    head = fill(V.LEVEL_LINE["LOW"], risk=risk)
    for word in ("MEDIUM", "HIGH"):
        head = F.when(level == word, fill(V.LEVEL_LINE[word], risk=risk)).otherwise(head)
    near = fill(V.DANGER_LINE_FAR, value=fixed(danger, 2))
    for end, text in reversed(V.DANGER_LINES):
        near = F.when(danger < end, fill(text, value=fixed(danger, 2))).otherwise(near)
    near = F.when(danger > 0, near).otherwise(fill(V.DANGER_LINE_OVER, value=fixed(danger, 2)))
    rising = fill(V.RISE_LINE_FLAT, value=fixed(rise, 3))
    for above, text in reversed(V.RISE_LINES):
        rising = F.when(rise > above, fill(text, value=fixed(rise, 3))).otherwise(rising)
    return F.array_compact(F.array(head, near, rising, F.when(water > 0, fill(V.LEVEL_NOW_LINE, value=fixed(water, 2)))))


def weather_sentence() -> Column:
    """Rainfall sentence of a row; empty without rain in the forecast."""
    last, soon, day = (F.col(c) for c in V.RAIN_COLUMNS)
    amount = (
        F.when(day > 50, fill(V.RAIN_HEAVY, value=fixed(day, 1)))
        .when(day > 25, fill(V.RAIN_MODERATE, value=fixed(day, 1)))
        .when(soon > 10, fill(V.RAIN_SOON, value=fixed(soon, 1)))
    )
    growing = F.when(soon > last, fill(V.RAIN_INCREASING, before=fixed(last, 1), after=fixed(soon, 1)))
    return F.when(holds(soon > 0) | holds(day > 0), F.concat_ws(" ", amount, growing)).otherwise("")


def importance_table(df: DataFrame, weights: Mapping[str, Mapping[str, float]], top: int | None = V.TOP_FACTORS) -> DataFrame:
    """model, feature, importance, share in percent; the largest first, `top` per model."""
    rows = []
    for model, values in weights.items():
        total = sum(values.values())
        ranked = sorted(values.items(), key=lambda item: -item[1])
        for feature, weight in ranked[: top or len(ranked)]:
            rows.append((model, feature, float(weight), round(weight / total * 100, 2) if total else None))
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double, importance_pct double")


def station_importance(features: DataFrame, weights: Mapping[str, float], order: Sequence[str] = (TIME, SEQ)) -> DataFrame:
    """Importance of each feature next to the value in the station's first row."""
    first = first_per_station(features.select(KEY, *order, *weights), *order)
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("importance"), F.col(f).cast("double").alias("value"))
        for f, w in weights.items()
    ])
    return first.select(KEY, F.explode(entries).alias("e")).select(KEY, "e.*")
