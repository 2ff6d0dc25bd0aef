"""Training labels, splits, scaling and noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import clip, gaussian, hashed_digits, holds, with_totals
from gaugeflow.operators.order_stats import exact_quantiles, rows_at_ranks, select_ranks
from gaugeflow.operators.ordered import KEY, SEQ, TIME, US, as_before, timed


def risk_score(distance: Column) -> Column:
    return clip(1.0 - distance / V.DANGER_SPAN, 0.0, 1.0)


def risk_tier(score: Column) -> Column:
    """Right-closed bands; a score of exactly 0 belongs to the lowest tier."""
    return F.when(score <= V.TIER_LOW_END, 0).when(score <= V.TIER_MEDIUM_END, 1).when(score.isNotNull(), 2)


def create_labels(features: DataFrame) -> DataFrame:
    """Add risk_score, warning_label (closest fifth) and risk_tier."""
    distance = F.col("distance_to_danger")
    (threshold,) = exact_quantiles(features, "distance_to_danger", [V.WARNING_QUANTILE])
    close = holds(distance < F.lit(threshold).cast("double"))
    labelled = features.withColumns({"risk_score": risk_score(distance), "warning_label": close.cast("int")})
    return labelled.withColumn("risk_tier", risk_tier(F.col("risk_score")))


def label_summary(labelled: DataFrame) -> DataFrame:
    tier = F.col("risk_tier")
    return labelled.agg(
        F.min("risk_score").alias("min_score"), F.max("risk_score").alias("max_score"),
        F.sum("warning_label").alias("positives"), F.avg("warning_label").alias("positive_share"),
        *[F.count_if(tier == i).alias(f"tier_{i}") for i in range(3)],
    )


def random_split(df: DataFrame, percent: int = V.TRAIN_PERCENT, seed: int = V.SEED, identity: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """Add split = train / test by a hash of the row's identity, the same on every run."""
    bucket = hashed_digits(seed, tuple(F.col(c) for c in identity), 8) % 100
    return df.withColumn("split", F.when(bucket < percent, "train").otherwise("test"))


def temporal_split(df: DataFrame, time: str = TIME, seq: str = SEQ) -> DataFrame:
    """Add split = train / validation / test by position in time order.

    Only the two border rows are looked up; rows are then labelled by comparing
    with them, so the table is neither sorted nor shuffled.
    """
    rows = timed(df, time)
    untimed_last = F.col(US).isNull()
    total = df.count()
    places = [int(total * share) for share in (V.TEMPORAL_TRAIN, V.TEMPORAL_VALIDATION)]
    with_time, borders = rows_at_ranks(rows, US, seq, places)

    def reached(place: int) -> Column:
        """True for rows at or after a position."""
        if place >= total:
            return F.lit(False)
        if place >= with_time:  # the border lies among the rows without a time, which are ordered by seq
            late = select_ranks(rows.filter(untimed_last), seq, lambda _: [place - with_time])[1][place - with_time]
            return untimed_last & (F.col(seq) >= late.value)
        u, s = borders[place]
        same = holds(F.col(US) == F.lit(u)) if s is None else holds((F.col(US) == F.lit(u)) & (F.col(seq) >= F.lit(s)))
        return untimed_last | holds(F.col(US) > F.lit(u)) | same

    train_end, validation_end = places
    split = F.when(reached(validation_end), "test").when(reached(train_end), "validation").otherwise("train")
    return as_before(rows.withColumn("split", split), df)


def fill_features(df: DataFrame, columns: Sequence[str] = V.HYDRO_FEATURES) -> DataFrame:
    return df.na.fill(0.0, subset=[c for c in columns if c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by training rows only (population deviation; constant columns are only centred)."""
    train = F.col("split") == "train"
    moments = {f"m_{c}": F.avg(F.when(train, F.col(c))) for c in columns}
    moments |= {f"s_{c}": F.stddev_pop(F.when(train, F.col(c))) for c in columns}
    rows = with_totals(df, "_fit", **moments)
    return rows.withColumns({
        c: (F.col(c) - F.col(f"_fit.m_{c}")) / F.when(F.col(f"_fit.s_{c}") > 0, F.col(f"_fit.s_{c}")).otherwise(1.0)
        for c in columns
    }).drop("_fit")


def feature_noise(df: DataFrame, columns: Sequence[str], sigma: float = V.NOISE_SIGMA, seed: int = V.SEED, identity: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """Gaussian noise on training rows, a function of row, column and seed."""
    who = [F.col(c) for c in identity]
    train = F.col("split") == "train"
    return df.withColumns({
        c: F.when(train, F.col(c) + sigma * gaussian(seed, *who, F.lit(c))).otherwise(F.col(c)) for c in columns
    })


def label_noise(df: DataFrame, columns: Sequence[str] = ("risk_score",), sigma: float = V.NOISE_SIGMA, seed: int = V.SEED, identity: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """Gaussian noise on real-valued training labels, kept within [0, 1]."""
    who = [F.col(c) for c in identity]
    train = F.col("split") == "train"
    soft = {c: clip(F.col(c) + sigma * gaussian(seed + 1, *who, F.lit(c)), 0.0, 1.0) for c in columns}
    return df.withColumns({c: F.when(train, v).otherwise(F.col(c)) for c, v in soft.items()})
