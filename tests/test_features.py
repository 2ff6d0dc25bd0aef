"""Feature edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.numbers import gaussian, uniform
from gaugeflow.functions.text import fixed, percent, rounded
from gaugeflow.operators import hydro_features as H, labels as L, metrics as M, spatial, stations as S, weather_features as W
from tests.test_cleaning import T0, by_seq, frame


def test_rate_of_rise_edges(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 2, 4.0), ("a", 3, 2.5), ("a", 9, 1.0), ("a", None, 9.0), ("b", 0, None), ("b", 3, 6.0), ("b", 6, None)])
    got = by_seq(H.rate_of_rise(df), "rate_of_rise_3h")
    assert got == {0: 0.0, 1: 0.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}


def test_equal_times_take_the_later_row(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 0, 4.0), ("a", 3, 10.0)])
    assert by_seq(H.rate_of_rise(df), "rate_of_rise_3h")[2] == 2.0


def test_percentile_edges(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, None), ("b", 0, 7.0)])
    assert by_seq(H.historical_percentile(df), "historical_percentile") == {0: 0.0, 1: 25.0, 2: 25.0, 3: 0.0, 4: 50.0}


def test_volatility_and_runs(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 4.0), ("a", 3, 4.0), ("a", 4, None), ("a", 5, 5.0), ("b", 0, 2.0)])
    assert by_seq(H.station_volatility(df), "station_volatility")[6] == 0.0
    assert by_seq(H.rising_run(df), "rising_run") == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}
    change = by_seq(H.change_volatility(df), "change_volatility")
    assert change[2] == pytest.approx(2 ** -0.5) and change[0] == 0.0 and change[1] == 0.0


def test_year_percentile_equals_brute_force(spark):
    rows = [("a", h * 31, float(h * 37 % 23)) for h in range(120)] + [("b", 1, 3.0), ("b", 1, 2.0), ("c", None, 1.0), ("c", 2, None)]
    df = frame(spark, rows)
    got = by_seq(H.trailing_percentile(df, days=20), "trailing_percentile")
    for i, (s, h, v) in enumerate(rows):
        if h is None:
            assert got[i] == 50.0
            continue
        seen = [y for t, x, y in rows if t == s and x is not None and h - 480 <= x <= h]
        want = 50.0 if len(seen) < 2 else 0.0 if v is None else 100.0 * sum(y is not None and y < v for y in seen) / len(seen)
        assert got[i] == pytest.approx(want), (i, s, h)


def test_basin_average_ignores_missing_basin(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 3.0), (3, None, 9.0), (4, "y", None)], "obs_seq int, basin string, current_level double")
    assert by_seq(H.basin_average(df), "basin_avg_level") == {1: 2.0, 2: 2.0, 3: None, 4: None}


def test_station_variants_do_not_multiply_rows(spark):
    obs = frame(spark, [("a", 0, 1.0), ("z", 0, 2.0)])
    dim = spark.createDataFrame([("a", "n1", "B"), ("a", "n2", "A")], "station_id string, station_name string, basin string")
    out = H.with_station_columns(obs, dim).orderBy("obs_seq").collect()
    assert [(r.station_name, r.basin) for r in out] == [("n1", "B"), (None, None)]
    assert S.one_per_station(dim).count() == 1


def test_age_and_season(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 30, 1.0), ("a", None, 1.0)])
    as_of = F.lit(T0 + dt.timedelta(hours=24))
    ages = by_seq(df.withColumn("x", H.hours_since_update(F.col("observation_time"), as_of)), "x")
    assert ages == {0: 24.0, 1: 0.0, 2: 0.0}
    assert by_seq(df.withColumn("x", H.seasonal_factor(F.col("observation_time"))), "x")[0] == pytest.approx(0.5)


def test_features_without_stations_use_rolling_mean(spark):
    df = frame(spark, [("a", 0, 1.0), ("b", 0, 3.0), ("c", 0, 8.0), ("c", 1, 1.0)])
    assert by_seq(H.hydro_features(df), "basin_avg_level") == {0: 1.0, 1: 2.0, 2: 4.0, 3: 4.0}


@pytest.mark.parametrize("values,want", [
    ([0.0, 5.0, 10.0], [0.0, 0.5, 1.0]), ([4.0, 4.0, 4.0], [1.0, 1.0, 1.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0]),
    ([-3.0, -3.0, None], [0.0, 0.0, 0.0]), ([None, None, None], [0.0, 0.0, 0.0]), ([1.0, None, 3.0], [0.0, None, 1.0]),
])
def test_normalisation_cases(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "obs_seq int, saturation_proxy double")
    got = by_seq(W.normalize_columns(df), "saturation_proxy")
    assert [got[i] for i in range(3)] == want


def test_compound_risk_without_positive_distance(spark):
    df = spark.createDataFrame([(1, 10.0, -1.0), (2, 20.0, -2.0)], "obs_seq int, rainfall_forecast_next_24h_mm double, distance_to_danger double")
    assert by_seq(W.compound_risk(df), "compound_risk_index") == {1: 5.0, 2: 10.0}
    assert by_seq(W.compound_risk(df.drop("distance_to_danger")), "compound_risk_index") == {1: 5.0, 2: 10.0}


def test_nearest_cell_equals_brute_force(spark):
    cells = [(i, (i * 37 % 101) / 9.0, (i * 53 % 97) / 7.0, float(i)) for i in range(300)] + [(900, 60.0, 60.0, 1.0), (5, 60.0, 60.0, 2.0)]
    spots = [(f"s{i}", (i * 29 % 89) / 8.0 + 0.01, (i * 31 % 83) / 6.0 + 0.02) for i in range(60)] + [("far", -80.0, 170.0), ("none", None, 1.0)]
    grid = spark.createDataFrame(cells, "cell_id int, lat double, lon double, rain_mm double")
    stations = spark.createDataFrame(spots, "station_id string, latitude double, longitude double")
    got = {r.station_id: r.cell_id for r in spatial.nearest_cell(stations, grid).collect()}
    assert len(got) == len(spots) and got["none"] is None
    for name, lat, lon in spots:
        if lat is not None:
            want = min(cells, key=lambda c: ((c[1] - lat) ** 2 + (c[2] - lon) ** 2, c[0]))[0]
            assert got[name] == want
    assert spatial.nearest_cell(stations, grid.limit(0)).count() == len(spots)


def test_label_borders(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([9.0, 5.0, 3.35, 1.65, 0.0, -3.0, None])], "obs_seq int, distance_to_danger double")
    got = {r.obs_seq: (r.risk_score, r.risk_tier, r.warning_label) for r in L.create_labels(df).collect()}
    assert got[0][:2] == (0.0, 0) and got[1][:2] == (0.0, 0) and got[4][:2] == (1.0, 2) and got[5] == (1.0, 2, 1)
    assert got[6] == (None, None, 0)
    tiers = spark.createDataFrame([(0.33,), (0.3300001,), (0.67,), (0.6700001,), (1.0,)], "s double").select(L.risk_tier(F.col("s"))).collect()
    assert [r[0] for r in tiers] == [0, 1, 1, 2, 2]


def test_temporal_split_sizes_with_ties_and_missing_times(spark):
    df = frame(spark, [("a", h // 7 if h % 5 else None, 1.0) for h in range(101)])
    rows = L.temporal_split(df).collect()
    ordered = sorted(rows, key=lambda r: (r.observation_time is None, r.observation_time or T0, r.obs_seq))
    want = ["train"] * 70 + ["validation"] * 15 + ["test"] * 16
    assert [r.split for r in ordered] == want


def test_split_and_noise_repeat(spark):
    df = spark.range(5000).select(F.col("id").alias("obs_seq"), F.lit(0.5).alias("risk_score"), F.lit(2.0).alias("x"))
    once = L.feature_noise(L.label_noise(L.random_split(df, identity=["obs_seq"]), identity=["obs_seq"]), ["x"], identity=["obs_seq"])
    again = L.feature_noise(L.label_noise(L.random_split(df.repartition(7), identity=["obs_seq"]), identity=["obs_seq"]), ["x"], identity=["obs_seq"])
    assert once.exceptAll(again).isEmpty()
    share = once.filter("split = 'train'").count() / 5000
    spread = once.filter("split = 'train'").agg(F.stddev("x"), F.avg("x"), F.stddev("risk_score")).first()
    assert 0.77 < share < 0.83 and spread[0] == pytest.approx(0.05, rel=0.1) and spread[1] == pytest.approx(2.0, abs=0.01)
    assert spread[2] == pytest.approx(0.05, rel=0.1)
    assert once.filter("split = 'test' AND x <> 2.0").isEmpty()
    ends = spark.range(20000).agg(F.min(uniform(1, F.col("id"))), F.max(uniform(1, F.col("id"))), F.avg(gaussian(1, F.col("id")))).first()
    assert 0 < ends[0] < 0.001 and 0.999 < ends[1] < 1 and abs(ends[2]) < 0.03


def test_metrics_degenerate(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.4)], "y int, p int, s double")
    row = M.binary_metrics(df, "y", "p").first()
    assert (row.recall, row.precision, row.f1, row.precision_compat) == (0.0, 0.0, 0.0, 2.0)
    assert M.roc_auc(df, "y", "s").first().roc_auc == 0.0
    mixed = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert M.roc_auc(mixed, "y", "s").first().roc_auc == pytest.approx(0.625)
    assert M.roc_auc(mixed, "y", "s", parts=1).first().roc_auc == pytest.approx(0.625)
    report = {r["class"]: r for r in M.class_report(spark.createDataFrame([(0, 1), (0, 0), (2, 1)], "y int, p int"), "y", "p").collect()}
    assert report[1].support == 0 and report[1].f1 == 0.0 and report[2].precision == 0.0


def test_text_rounds_like_exact_binary_half_even(spark):
    values = [0.125, 0.375, 2.5, 3.5, 0.0005, 1.0005, 2.675, 1e6 + 0.5, -0.001, 0.285, 12345.6785, 35.65, 0.05, 0.15, 0.25]
    values += [((i * 7919) % 100003) / 1e5 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.select(fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]
        assert [r[0] for r in df.select(rounded(F.col("v"), digits)).collect()] == [round(v, digits) for v in values]
    for digits in (0, 1):
        assert [r[0] for r in df.select(percent(F.col("v"), digits)).collect()] == [f"{v:.{digits}%}" for v in values]


def test_scaling_reads_one_row_of_ends(spark):
    rows = [(1, -1.0, 3.0, 0.0, None), (2, 1.0, 3.001, -2.0, None), (3, None, float("nan"), -2.0, None)]
    scaled = W.normalize_columns(spark.createDataFrame(rows, "id int, a double, b double, c double, d double"), ["a", "b", "c", "d", "none"])
    found = {r.id: tuple(r)[1:] for r in scaled.select("id", "a", "c", "d").collect()}
    assert found == {1: (0.0, 1.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (None, 0.0, 0.0)}
    flat = W.normalize_columns(spark.createDataFrame([(4.0,), (4.005,)], "a double"), ["a"])
    assert sorted(r.a for r in flat.collect()) == [4.0 / 4.005, 1.0]
    assert "subquery" not in scaled._jdf.queryExecution().toString().lower()
