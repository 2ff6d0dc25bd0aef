"""Connected components of links: union-find inside tasks, then alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.packed import parts, staged

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class UnionFind:
    """Sets of numbers, each known by its smallest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _joined_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for rows in batches:
        for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
            sets.join(a, b)
    nodes = [x for x in sets.parent if sets.find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], schema=_PAIRS)


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b) that isn't the smallest of its component.

    Rows with a null end say nothing. Each round gives every neighbour of a node that is larger
    than it to the smallest neighbour (large star), then every smaller one (small star); rounds
    end when no link changes. Smallest neighbours are aggregated before they are joined, so a
    node with very many links costs a row for each and no task of its own.
    """
    parts(links.sparkSession)
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    links = staged(links.mapInArrow(_joined_locally, "a long, b long").distinct(), "links")  # a > b
    before = _sum(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _sum(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
