"""Table layouts; every reader applies one of these instead of inferring types."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


STATION_COLUMNS = ("station_id", "station_name", "river_name", "basin", "state", "district", "latitude", "longitude")
LEVEL_COLUMNS = ("current_level", "warning_level", "danger_level", "highest_flood_level")

OBSERVATION_TEXT = _struct(
    ("station_id", S), ("station_name", S), ("river_name", S), ("basin", S),
    ("state", S), ("district", S), ("latitude", D), ("longitude", D),
    ("division", S), ("site_type", S), ("current_level", D), ("warning_level", D),
    ("danger_level", D), ("highest_flood_level", D), ("trend", S),
    ("timestamp", S), ("source_url", S),
)

FORECAST = _struct(
    ("station_id", S), ("forecast_level", D), ("forecast_time", S), ("confidence", D),
)

WEATHER = _struct(
    ("station_id", S), ("latitude", D), ("longitude", D),
    ("rainfall_last_6h_mm", D), ("rainfall_forecast_next_6h_mm", D),
    ("rainfall_forecast_next_24h_mm", D), ("forecast_timestamp", TS),
    ("forecast_valid_until", TS), ("fetched_at", TS),
)
