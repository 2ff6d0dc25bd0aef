"""Named queries over the given tables and the SQL each of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.ordered import HotKeys, find_hot
from gaugeflow.registry.fixtures import table, view, with_views
from gaugeflow.session import tune
from gaugeflow.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
WORK: dict[str, Callable[[Tables], DataFrame]] = {}
MOMENT = "2024-01-31 00:00:00"

_hot: dict[tuple[str, str], HotKeys] = {}


def at() -> Column:
    """The reference moment of all registered queries."""
    return F.lit(MOMENT).cast("timestamp")


class Tables:
    """Views over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def busy(self, name: str) -> DataFrame:
        """A view for work that is heavy per row: small inputs are shared by all cores."""
        return spread(getattr(self, name))

    def given(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def hot(self) -> HotKeys:
        """Hot stations, counted once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _hot:
            events = self.given("events").select(F.col("user_id").alias("station_id"))
            _hot[key] = find_hot(events)
        return _hot[key]


class CrowdedTables(Tables):
    """The same tables with a limit low enough for about half the stations to be hot."""

    LIMIT, SLICE_ROWS = 66, 2000

    @property
    def hot(self) -> HotKeys:
        return find_hot(self.given("events").select(F.col("user_id").alias("station_id")), limit=self.LIMIT, slice_rows=self.SLICE_ROWS)


def rounded_doubles(df: DataFrame) -> DataFrame:
    """Six decimals for computed doubles: summation order differs between engines."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in doubles}) if doubles else df


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = (), doubles: str = ""):
    """Register a query; `doubles` names the columns rounded on the SQL side."""

    def register(work: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded_doubles(work(Tables(spark, folder)))

        run.__name__, run.__doc__ = name, work.__doc__
        assert name not in QUERIES, name
        QUERIES[name], WORK[name] = run, work
        if sql is not None:
            text = with_views(sql, *views) if views else sql.strip()
            if doubles:
                swaps = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in doubles.split())
                text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n) AS answer"
            CHECKS[name] = text
        return work

    return register


def register_crowded(*names: str) -> None:
    """Each query once more as hot_<name>: the same rows, with half the stations in the sliced lane."""
    for name in names:
        def run(spark: SparkSession, folder: str, work=WORK[name]) -> DataFrame:
            return rounded_doubles(work(CrowdedTables(spark, folder)))

        QUERIES[f"hot_{name}"], CHECKS[f"hot_{name}"] = run, CHECKS[name]


def load_all() -> None:
    from gaugeflow.registry import (  # noqa: F401
        alert_queries, cleaning_queries, document_queries, feature_queries, label_queries, model_queries, round_trip_queries,
        source_queries, weather_queries,
    )
    register_crowded(
        "sensor_jumps", "interpolated_levels", "forward_filled_levels", "rate_of_rise", "rising_run_length", "historical_percentile",
        "ten_day_percentile", "station_volatility", "change_volatility", "rolling_level_average",
    )
