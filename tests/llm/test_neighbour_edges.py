"""Nearest neighbours of extreme, equal and missing vectors against comparing all."""

import math

from gaugeflow.llm.neighbours import nearest

VECTORS = "vec_id bigint, embedding array<double>, shard string, rank int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "x") for i, v in rows], VECTORS)


def cosine(a, b):
    scale = [2.0 ** -math.frexp(max(map(abs, v)))[1] for v in (a, b)]
    a, b = ([x * s for x in v] for v, s in zip((a, b), scale))
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [-1e308, 1e308]), (5, [3.0, 1.0]), (6, [1e200, 1e-200])]
    got = nearest(vectors(spark, rows), vectors(spark, rows), k=3).collect()
    by = dict(rows)
    for id_, v in rows:
        found = sorted((r for r in got if r.query_id == id_), key=lambda r: r["rank"])
        best = sorted(((-cosine(v, w), i) for i, w in rows if i != id_))[:3]
        assert [r["rank"] for r in found] == [1, 2, 3]
        assert all(abs(r.score - cosine(v, by[r.vec_id])) < 1e-12 for r in found)
        assert all(abs(r.score + b) < 1e-12 for r, (b, _) in zip(found, best))


def test_ties_go_to_the_smaller_id_and_copies_stay(spark):
    rows = [(i, [1.0, 0.0]) for i in (9, 3, 7, 5, 1, 8)] + [(20, [2.0, 0.0]), (30, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = nearest(vectors(spark, rows), vectors(spark, [(7, [1.0, 0.0])]), k=4).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 3), (3, 5), (4, 8)]


def test_rows_without_direction_and_empty_tables(spark):
    bad = [(50, None), (51, []), (52, [0.0, 0.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = nearest(vectors(spark, rows + bad), vectors(spark, rows + bad), k=5).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 2), (2, 1)]
    assert nearest(vectors(spark, []), vectors(spark, rows), k=5).collect() == []
    assert nearest(vectors(spark, rows), vectors(spark, []), k=5).collect() == []
