"""Rank search against sorting, for values that end a search by intervals only late or never."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.cleaning import detect_outliers
from gaugeflow.operators.labels import create_labels, temporal_split
from gaugeflow.operators.order_stats import SHIFTS, exact_quantiles, select_ranks

INF = math.inf
TINY = 5e-324


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)


CASES = {
    "infinities": [1.0, INF, -INF, 2.5, INF, 0.0],
    "whole range": [1.7e308, -1.7e308, 0.0, 1e-308, -1e-308, 5.0],
    "neighbours": [math.nextafter(1.0, 2.0), 1.0, math.nextafter(1.0, 0.0), 1.0, math.nextafter(1.0, 2.0)],
    "denormal": [TINY, -TINY, 0.0, 2 * TINY, -0.0, -2 * TINY],
    "with gaps": [None, float("nan"), 3.0, None, -3.0],
    "one": [7.25],
}


@pytest.mark.parametrize("name", CASES)
def test_every_rank_is_found(spark, name):
    held = sorted(v + 0.0 for v in CASES[name] if v is not None and not math.isnan(v))
    count, found = select_ranks(column(spark, CASES[name]), "v", lambda n: list(range(n)))
    assert count == len(held)
    for rank, hit in found.items():
        assert hit.value == held[rank] and hit.below == held.index(hit.value) and hit.ties == held.count(hit.value)
    assert sorted(found) == list(range(count))


def test_large_ids_stay_apart(spark):
    ids = [2**53 + i for i in range(6)] + [-(2**63), 2**63 - 1, 0, -1]
    count, found = select_ranks(column(spark, ids, "bigint"), "v", lambda n: list(range(n)))
    assert [found[r].value for r in range(count)] == sorted(ids)


def test_nothing_to_rank(spark):
    assert select_ranks(column(spark, [None, float("nan")]), "v", lambda n: [0, 5, -1]) == (0, {})
    assert exact_quantiles(column(spark, []), "v", [0.5]) == [None]


def test_passes_do_not_depend_on_the_values(spark):
    jobs = []
    for values in ([float(i) for i in range(50)], [INF] * 3 + [1.0], [1e308 * (-1) ** i / (i + 1) for i in range(50)]):
        df, tracker = column(spark, values), spark.sparkContext
        tracker.setJobGroup(f"ranks-{len(jobs)}", "count passes")
        select_ranks(df, "v", lambda n: [n // 2])
        jobs.append(len(tracker.statusTracker().getJobIdsForGroup(f"ranks-{len(jobs)}")))
    tracker.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(jobs)) == 1 and max(jobs) <= 3 * (len(SHIFTS) + 1)


def test_quantiles_over_the_whole_range(spark):
    assert exact_quantiles(column(spark, [-1.6e308, 1.6e308]), "v", [0.25, 0.5]) == pytest.approx([-0.8e308, 0.0])
    assert exact_quantiles(column(spark, [1.0, INF, 2.0]), "v", [0.0, 0.5, 1.0]) == [1.0, 2.0, INF]
    rng = random.Random(4)
    values = [rng.gauss(0, 10.0 ** rng.randint(-200, 200)) for _ in range(400)]
    held = sorted(values)
    got = exact_quantiles(column(spark, values), "v", [0.2, 0.75])
    for share, value in zip((0.2, 0.75), got):
        place = share * 399
        low, high = held[int(place)], held[int(place) + 1]
        assert value == low + (high - low) * (place - int(place))


def test_operators_accept_infinite_levels(spark):
    rows = column(spark, [1.0, 2.0, 3.0, 4.0, 100.0, INF, None]).withColumnRenamed("v", "current_level")
    flags = {r.current_level: r.is_outlier for r in detect_outliers(rows).collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 100.0: False, INF: True, None: False}
    assert detect_outliers(column(spark, [INF] * 4 + [1.0]).withColumnRenamed("v", "current_level")).filter("is_outlier").isEmpty()
    labels = create_labels(column(spark, [-INF, 0.5, 2.0, 9.0, INF]).withColumnRenamed("v", "distance_to_danger"))
    assert {r.distance_to_danger: r.warning_label for r in labels.collect()}[-INF] == 1


def test_split_by_ids_above_2_53(spark):
    rows = [(2**53 + i, 0 if i < 8 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "obs_seq bigint, s int").select("obs_seq", F.timestamp_seconds("s").alias("observation_time")).repartition(3)
    got = [r.split for r in temporal_split(df).orderBy("obs_seq").collect()]
    assert got == ["train"] * 7 + ["validation"] + ["test"] * 2
