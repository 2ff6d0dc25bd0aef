"""Columns derived from model outputs, and applying models to features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import clip, tier_word
from gaugeflow.operators.labels import fill_features
from gaugeflow.operators.ordered import KEY, SEQ, TIME, attach
from gaugeflow.operators.stations import one_per_station

CARRIED = ("distance_to_danger", "rate_of_rise_3h", "current_level", "distance_to_warning")


def risk_level(score: Column) -> Column:
    return tier_word(score, ("low", "medium", "high"), V.TIER_LOW_END, V.TIER_MEDIUM_END)


def horizon_tier(score: Column) -> Column:
    return tier_word(score, ("LOW", "MEDIUM", "HIGH"), V.TIER_LOW_END, V.TIER_MEDIUM_END)


def tier_name(tier: Column) -> Column:
    out = F.lit("unknown")
    for i, word in enumerate(V.TIER_NAMES):
        out = F.when(tier == i, word).otherwise(out)
    return out


def score_all(features: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """Score a feature table with whichever of the three models are given.

    Partitions are the batches; columns of a missing model are left out. The tiers come first: their
    vote is not compiled, so that Spark compiles what comes before and after it as two methods,
    each small enough for the JVM to optimize.
    """
    ids = [c for c in (SEQ, KEY, TIME) if c in features.columns]
    kept = [c for c in (*CARRIED, *V.WEATHER_FEATURES) if c in features.columns]
    rows = fill_features(features.select("*", F.struct(*[F.col(c) for c in kept]).alias("_kept")))
    out = list(ids)
    if "risk_tier_classifier" in models:
        rows = models["risk_tier_classifier"].transform(rows).withColumn("risk_tier", F.col("prediction").cast("int"))
        rows = rows.drop("features", "raw_features", "prediction", "probability", "rawPrediction")
    if "risk_regressor" in models:
        rows = models["risk_regressor"].transform(rows).withColumn("risk_score", clip(F.col("prediction"), 0.0, 1.0))
        rows = rows.withColumn("risk_level", risk_level(F.col("risk_score"))).drop("features", "raw_features", "prediction")
        out += ["risk_score", "risk_level"]
    if "warning_classifier" in models:
        rows = models["warning_classifier"].transform(rows).withColumns({
            "warning_prediction": F.col("prediction").cast("int"),
            "warning_probability": vector_to_array("probability")[1],
        }).drop("features", "raw_features", "prediction", "probability", "rawPrediction")
        out += ["warning_prediction", "warning_probability"]
    if "risk_tier_classifier" in models:
        rows = rows.withColumn("risk_tier_name", tier_name(F.col("risk_tier")))
        out += ["risk_tier", "risk_tier_name"]
    return rows.select(*out, "_kept.*") if kept else rows.select(*out)


def add_weather_context(predictions: DataFrame, weather: DataFrame) -> DataFrame:
    """Rainfall in millimetres on the predictions; it replaces same-named columns, missing is 0."""
    side = one_per_station(weather.select(KEY, *V.RAIN_COLUMNS))
    joined = attach(predictions.drop(*V.RAIN_COLUMNS), side, KEY, sized_by=weather)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in V.RAIN_COLUMNS})


def _raised(score: Column, rain: Column, divisor: float, most: float) -> Column:
    return clip(score + F.when(rain.isNotNull(), F.least(rain / divisor, F.lit(most))), 0.0, 1.0)


def add_horizons(
    predictions: DataFrame,
    rain_6h: str = "rainfall_forecast_next_6h_mm",
    rain_24h: str = "rainfall_forecast_next_24h_mm",
) -> DataFrame:
    """Scores and tiers for now, +6 h and +24 h; an absent rain column leaves the score as it is."""
    score = F.col("risk_score")
    later = {
        "6h": _raised(score, F.col(rain_6h), *V.HORIZON_6H) if rain_6h in predictions.columns else score,
        "24h": _raised(score, F.col(rain_24h), *V.HORIZON_24H) if rain_24h in predictions.columns else score,
    }
    rows = predictions.withColumns({"risk_score_now": score, "risk_tier_now": F.col("risk_tier_name")})
    rows = rows.withColumns({f"risk_score_{h}": s for h, s in later.items()})
    return rows.withColumns({f"risk_tier_{h}": horizon_tier(F.col(f"risk_score_{h}")) for h in later})


def add_mode(predictions: DataFrame, weather_used: bool) -> DataFrame:
    return predictions.withColumns({
        "prediction_mode": F.lit(V.MODE_WEATHER if weather_used else V.MODE_HYDRO), "weather_data_used": F.lit(weather_used),
    })


def predict_with_weather(features: DataFrame, models: Mapping[str, object], weather: DataFrame | None) -> DataFrame:
    rows = score_all(features, models)
    if weather is not None:
        rows = add_weather_context(rows, weather)
    return add_mode(add_horizons(rows), weather is not None)
