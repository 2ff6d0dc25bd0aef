"""Cleaning against hand-made expectations and brute force."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import cleaning as C
from gaugeflow.operators.order_stats import exact_quantiles, select_ranks
from gaugeflow.operators.ordered import find_hot

SCHEMA = "obs_seq bigint, station_id string, observation_time timestamp, current_level double, warning_level double, danger_level double, highest_flood_level double"
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """(station, hour or None, level) rows."""
    data = [
        (i, s, None if h is None else T0 + dt.timedelta(hours=h), v, 8.0, 10.0, 12.0) for i, (s, h, v) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def by_seq(df, column):
    return {r.obs_seq: r[column] for r in df.select("obs_seq", column).collect()}


def test_flags_in_order_and_report(spark):
    df = frame(spark, [("a", 0, 5.0), ("a", 1, 120.0), ("a", 2, None), ("b", 0, -11.0), ("b", None, 5.0), ("c", 0, 7.0), ("c", 0, 9.5)])
    out = C.validate_levels(df).cache()
    assert by_seq(out, "validation_flags") == {
        0: "", 1: "OUT_OF_RANGE;SENSOR_ERROR;", 2: "MISSING_VALUE;", 3: "OUT_OF_RANGE;", 4: "SENSOR_ERROR;", 5: "", 6: "SENSOR_ERROR;",
    }
    assert all(r.is_valid == (r.validation_flags == "") for r in out.collect())
    assert C.validation_report(out).first().asDict() == {
        "total_records": 7, "invalid_levels": 2, "missing_values": 1, "sensor_errors": 3, "flagged_records": 5,
    }


def test_interpolation_equals_pandas(spark):
    rows = [("a", h, None if h % 3 else float(h * h % 17)) for h in range(40)] + [("b", h, None) for h in range(4)] + [("c", 0, 1.5)]
    rows += [("d", h, v) for h, v in enumerate([None, None, 2.0, None, 8.0, None])]
    df = frame(spark, rows)
    want = pd.DataFrame(rows, columns=["s", "h", "v"]).groupby("s")["v"].transform(lambda x: x.interpolate(method="linear", limit_direction="both"))
    got = by_seq(C.fill_gaps(df), "current_level")
    for i, v in enumerate(want):
        assert (got[i] is None) if math.isnan(v) else got[i] == pytest.approx(v, abs=1e-12)


def test_forward_fill_and_drop(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, 3.0), ("a", 2, None), ("b", 0, None)])
    assert by_seq(C.fill_gaps(df, "forward_fill"), "current_level") == {0: None, 1: 3.0, 2: 3.0, 3: None}
    assert by_seq(C.fill_gaps(df, "drop"), "current_level") == {1: 3.0}
    assert C.fill_gaps(df, "no such strategy").count() == 4


def test_units_change_whole_columns_only_on_a_hint(spark):
    df = frame(spark, [("a", 0, 1500.0), ("a", 1, 900.0), ("a", 2, None)])
    out = C.normalize_units(df)
    assert by_seq(out, "current_level") == {0: 15.0, 1: 9.0, 2: None}
    assert by_seq(out, "danger_level") == {0: 10.0, 1: 10.0, 2: 10.0}


def test_outliers(spark):
    df = frame(spark, [("a", h, float(h % 5)) for h in range(40)] + [("a", 41, 50.0), ("a", 42, None)])
    flags = by_seq(C.detect_outliers(df), "is_outlier")
    assert [k for k, v in flags.items() if v] == [40]
    assert "is_outlier" not in C.detect_outliers(df, "absent").columns
    assert C.detect_outliers(frame(spark, [("a", 0, None)])).first().is_outlier is False


def test_order_statistics_equal_numpy(spark):
    import numpy as np

    values = [((i * 7919) % 1009) / 7.0 for i in range(2500)] + [5.0] * 1500 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    shares = [0.0, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert exact_quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    count, at = select_ranks(df, "v", lambda n: [0, 1700, n - 1])
    assert count == len(values) and [at[r].value for r in (0, 1700, count - 1)] == [sorted(values)[r] for r in (0, 1700, count - 1)]


def test_clean_keeps_rows_and_toggles(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, 3.0), ("b", 0, 2.0)])
    out = C.clean(df)
    assert out.count() == 3 and {"is_valid", "validation_flags", "is_outlier"} <= set(out.columns)
    bare = C.clean(df, validate=False, normalize=False, handle_missing=False, outliers=False)
    assert bare.columns == df.columns
    assert C.clean(df.limit(0)).count() == 0


def test_bad_times_become_null(spark):
    df = spark.createDataFrame([(1, "2024-01-01T05:00:00Z"), (2, "2024-01-01T05:00:00+05:30"), (3, "soon"), (4, None)], "i int, t string")
    got = {r.i: r.observation_time for r in C.coerce_time(df, "t").collect()}
    assert got == {1: dt.datetime(2024, 1, 1, 5), 2: dt.datetime(2023, 12, 31, 23, 30), 3: None, 4: None}


def test_hot_keys_are_those_above_the_limit(spark):
    df = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("station_id"))
    hot = find_hot(df, limit=10)
    assert [r[0] for r in hot.table.collect()] == [1] and (hot.count, hot.rows) == (1, 60)
