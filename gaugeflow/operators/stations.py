"""The station dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.ordered import KEY


def one_per_station(stations: DataFrame) -> DataFrame:
    """One row per station; of several variants the smallest in column order wins.

    A minimum over a struct is combined map-side and does not depend on arrival order.
    """
    rest = [c for c in stations.columns if c != KEY]
    if not rest:
        return stations.distinct()
    return stations.groupBy(KEY).agg(F.min(F.struct(*rest)).alias("_row")).select(KEY, "_row.*")


def first_per_station(rows: DataFrame, *order: str) -> DataFrame:
    """Each station's first row by the given columns (missing values last)."""
    rank = F.struct(*[p for c in order for p in (F.col(c).isNull().alias(f"n_{c}"), F.col(c))])
    return rows.groupBy(KEY).agg(F.min_by(F.struct(*[c for c in rows.columns if c != KEY]), rank).alias("_row")).select(KEY, "_row.*")


def latest_per_station(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """Each station's newest row."""
    rank = F.struct(time, *ties)
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c != KEY]), rank).alias("_row")).select(KEY, "_row.*")
