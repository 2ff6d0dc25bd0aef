"""Nearest cells against comparing all, on grids that defeat fixed bucket widths."""

import random

import pytest

from gaugeflow.operators.spatial import nearest_cell

CELLS, STATIONS = "cell_id int, lat double, lon double, rain_mm double", "station_id string, latitude double, longitude double"


def spread(rng, n, width):
    return [(rng.uniform(-width, width), rng.uniform(-width, width)) for _ in range(n)]


def grids():
    rng = random.Random(7)
    dense = [(40.0 + i * 2e-9, 90.0 + j * 2e-9) for i in range(20) for j in range(20)]
    return {
        "two dense spots": dense + [(-60.0 + i * 1e-12, 5.0) for i in range(150)],
        "dense in sparse": dense + spread(rng, 200, 80.0),
        "one column": [(i / 7.0, 12.5) for i in range(300)],
        "diagonal": [(i * 0.1, i * 0.1) for i in range(300)],
        "powers": [(2.0**i, 3.0**-i) for i in range(-40, 40)],
        "circle of equals": [(3.0, 4.0), (4.0, 3.0), (-3.0, 4.0), (5.0, 0.0), (0.0, -5.0), (-5.0, 0.0)],
        "one cell": [(1.0, 2.0)],
        "repeated": [(1.0, 2.0)] * 70 + [(1.0, 2.5)] * 70,
        "huge": [(1e200, 1e200), (-1e200, 0.0), (1e-200, 0.0)],
        "uniform": spread(rng, 700, 30.0),
    }


@pytest.mark.parametrize("name", grids())
def test_equals_comparing_all(spark, name):
    rng = random.Random(name)
    cells = [(1000 - 3 * i, lat, lon, float(i)) for i, (lat, lon) in enumerate(grids()[name])]
    near = [(c[1] + rng.choice((0.0, 1e-9, 0.3)), c[2]) for c in rng.sample(cells, min(10, len(cells)))]
    spots = spread(rng, 15, 90.0) + near + [(0.0, 0.0), (-0.0, 0.0), (40.0, 90.0), (39.0, 91.0), (1e6, -1e6), (-89.0, 170.0)]
    stations = [(f"s{i}", *p) for i, p in enumerate(spots)] + [("same", *spots[0]), ("none", None, 1.0), ("nan", 1.0, float("nan")), ("inf", float("inf"), 1.0)]
    got = {r.station_id: r for r in nearest_cell(spark.createDataFrame(stations, STATIONS), spark.createDataFrame(cells, CELLS)).collect()}
    assert len(got) == len(stations)
    for id_, lat, lon in stations:
        if id_ in ("none", "nan", "inf"):
            assert got[id_].cell_id is None and got[id_].distance is None
            continue
        d, cell, rain = min(((c[1] - lat) * (c[1] - lat) + (c[2] - lon) * (c[2] - lon), c[0], c[3]) for c in cells)
        assert (got[id_].cell_id, got[id_].rain_mm, got[id_].distance) == (cell, rain, d**0.5), id_


def test_without_usable_cells(spark):
    stations = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], STATIONS)
    for cells in ([], [(1, None, 2.0, 3.0), (2, float("nan"), 2.0, 3.0), (3, 1.0, float("inf"), 3.0)]):
        rows = nearest_cell(stations, spark.createDataFrame(cells, CELLS)).collect()
        assert sorted((r.station_id, r.cell_id, r.distance) for r in rows) == [("a", None, None), ("b", None, None)]
    assert nearest_cell(stations.limit(0), spark.createDataFrame([(1, 1.0, 1.0, 1.0)], CELLS)).collect() == []
