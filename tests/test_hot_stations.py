"""Every order-dependent operator gives the same rows in the sliced lane."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import cleaning, hydro_features as hydro
from gaugeflow.operators.ordered import Lane, find_hot

BASE = "obs_seq bigint, station_id bigint, observation_time timestamp, current_level double, warning_level double, danger_level double, trend string"


@pytest.fixture(scope="module")
def skewed(spark):
    """Station 1 holds most rows; ties, NULL times, NULL levels and a stuck sensor included."""
    rows = spark.range(900).select(
        F.col("id").alias("obs_seq"),
        F.when(F.col("id") % 6 == 0, 2 + F.col("id") % 5).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(1).cast("bigint").alias("station_id"),
        F.when(F.col("id") % 41 == 7, F.lit(None)).otherwise(
            F.timestamp_seconds(1704067200 + (F.col("id") * 7919 % 900) * 1300 - (F.col("id") % 3 == 0).cast("int") * 1300)
        ).alias("observation_time"),
        F.when(F.col("id") % 7 == 3, F.lit(None)).when(F.col("id") % 4 == 1, 5.5)
        .otherwise((F.col("id") * 31 % 113) / 10.0).alias("current_level"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(8.0).alias("warning_level"),
        F.lit(10.0).alias("danger_level"), F.lit("rising").alias("trend"),
    )
    return rows.cache()


CASES = {
    "jumps": lambda df, hot: cleaning.flag_jumps(df, hot=hot),
    "validate": lambda df, hot: cleaning.validate_levels(df, hot=hot),
    "interpolate": lambda df, hot: cleaning.fill_gaps(df, "interpolate", hot=hot),
    "forward": lambda df, hot: cleaning.fill_gaps(df, "forward_fill", hot=hot),
    "rate": lambda df, hot: hydro.rate_of_rise(df, hot=hot),
    "run": lambda df, hot: hydro.rising_run(df, hot=hot),
    "percentile": lambda df, hot: hydro.historical_percentile(df, hot=hot),
    "volatility": lambda df, hot: hydro.station_volatility(df, hot=hot),
    "trailing": lambda df, hot: hydro.trailing_percentile(df, days=5, hot=hot),
    "change": lambda df, hot: hydro.change_volatility(df, hot=hot),
}


def collected(df):
    cols = sorted(df.columns)
    return cols, sorted(
        (tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr
    )


@pytest.mark.parametrize("name", CASES)
def test_sliced_lane_equals_whole_lane(spark, skewed, name):
    usual = CASES[name](skewed, find_hot(skewed, limit=10_000))
    hot = find_hot(skewed, limit=60)
    assert 0 < hot.count < 7
    assert collected(CASES[name](skewed, hot)) == collected(usual)


def test_rolling_average_equals_one_window(spark, skewed):
    """Also over stations of one and two rows, which leave a place to the station before them."""
    small = spark.range(30).select(
        (F.col("id") + 5000).alias("obs_seq"), (F.col("id") * F.col("id") % 19 + 10).cast("bigint").alias("station_id"), F.timestamp_seconds("id").alias("observation_time"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 3.0).alias("current_level"))
    rows = skewed.unionByName(small, allowMissingColumns=True).cache()
    held = sorted(rows.collect(), key=lambda r: (r.station_id is None, r.station_id, r.observation_time is None, r.observation_time, r.obs_seq))
    want = {}
    for i, r in enumerate(held):
        levels = [x.current_level for x in held[max(0, i - 2): i + 1] if x.current_level is not None]
        want[r.obs_seq] = round(sum(levels) / len(levels), 7) if levels else None
    for limit in (10_000, 60):
        got = hydro.rolling_average(rows, hot=find_hot(rows, limit=limit)).collect()
        assert {r.obs_seq: None if r.basin_avg_level is None else round(r.basin_avg_level, 7) for r in got} == want and len(got) == len(held)
    assert "rangepartitioning(station_id" not in hydro.rolling_average(rows, hot=find_hot(rows, limit=10_000))._jdf.queryExecution().executedPlan().toString()


def test_carried_rows_are_at_most_one_for_a_slice(spark):
    """However many keys there are: only a slice's first key can have begun earlier."""
    keys = spark.range(3000).select((F.col("id") % 700).alias("k"), "id", F.lit(1).alias("one")).unionByName(
        spark.range(5000).select(F.lit(350).cast("bigint").alias("k"), "id", F.lit(1).alias("one")))
    lane = Lane("k", 24)
    sliced, _ = lane.arrange(keys, F.col("id"))
    for following in (False, True):
        carried = lane.carried(sliced, "n", F.sum("one"), F.sum, following).collect()
        assert 0 < len(carried) <= 24 and max(r.n for r in carried) > 3000


def test_composite_features_hot_equals_usual(spark, skewed):
    stations = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "station_id bigint, basin string")
    usual = hydro.hydro_features(skewed, stations, hot=find_hot(skewed, limit=10_000))
    hot = hydro.hydro_features(skewed, stations, hot=find_hot(skewed, limit=60))
    assert collected(hot) == collected(usual)


def test_no_more_slices_than_the_rows_need(skewed, monkeypatch):
    """A low limit makes stations hot, but doesn't cut them into a slice for every few rows."""
    from gaugeflow.operators import ordered

    given, plain = [], ordered.slice_in_order
    monkeypatch.setattr(ordered, "slice_in_order", lambda df, parts, *order: given.append(parts) or plain(df, parts, *order))
    hot = find_hot(skewed, limit=100, slice_rows=10)
    assert hot.count
    hydro.trailing_percentile(skewed, days=5, hot=hot).count()
    assert given and max(given) <= ordered.slices_for(skewed.sparkSession, 48 * hot.rows)
