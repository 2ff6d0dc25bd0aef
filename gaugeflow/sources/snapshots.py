"""Weather snapshots with a limited life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.operators.stations import latest_per_station

TTL_HOURS = {"forecast": V.FORECAST_TTL_HOURS, "observed": V.OBSERVED_TTL_HOURS}


def _age_hours(fetched: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(fetched)) / 3.6e9


def live_snapshot(log: DataFrame, as_of: Column, kind: str | None = None, ttl_hours: float | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest row per station that is not older than the time to live at `as_of`."""
    limit = ttl_hours if ttl_hours is not None else TTL_HOURS[kind or "forecast"]
    rows = log if kind is None else log.filter(F.col("kind") == kind)
    oldest = as_of - F.make_interval(hours=F.lit(int(limit)), mins=F.lit(int(round(limit % 1 * 60))))
    fresh = rows.filter((F.col("fetched_at") >= oldest) & (F.col("fetched_at") <= as_of))
    return latest_per_station(fresh, "fetched_at", *ties)


def snapshot_status(log: DataFrame, as_of: Column) -> DataFrame:
    """Per kind: newest fetch as age in hours, and whether it is still valid (strictly younger)."""
    limit = F.when(F.col("kind") == "observed", float(V.OBSERVED_TTL_HOURS)).otherwise(float(V.FORECAST_TTL_HOURS))
    newest = log.groupBy("kind").agg(F.max("fetched_at").alias("_at"))
    return newest.select(
        "kind", F.lit(True).alias("cached"), _age_hours(F.col("_at"), as_of).alias("age_hours"),
        (_age_hours(F.col("_at"), as_of) < limit).alias("valid"),
    )
