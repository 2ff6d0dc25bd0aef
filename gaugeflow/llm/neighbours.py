"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

A shard holds a bounded number of different vectors. Its graph is a set of flat arrays of
neighbour numbers, one row for each node and level, and is written as one table row. The
neighbours of a level are chosen for diversity from the nearest nodes of that level, which
are found by blocks of exact products inside the shard. Queries travel in blocks to all shards,
descend the levels greedily, search the lowest with a beam, and the shards' results are merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.packed import batch, deal, mix, parts, staged

SHARD = 8192  # different vectors of a graph
LINKS, NEAREST, BEAM = 16, 48, 128
BLOCK = 256  # queries that are searched together


def _levels(n: int) -> np.ndarray:
    u = (mix(np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS)).astype(np.int64)


def _chosen(x: np.ndarray, nodes: np.ndarray, links: int) -> np.ndarray:
    """Neighbours (len(nodes), links) among `nodes`, by number in the shard; -1 where there are fewer."""
    own, n = x[nodes], len(nodes)
    near = min(NEAREST, n - 1)
    if near < 1:
        return np.full((n, links), -1, np.int32)
    source, target, weight = [], [], []
    for a in range(0, n, BLOCK):
        like = own[a : a + BLOCK] @ own.T
        rows = np.arange(len(like))
        like[rows, rows + a] = -np.inf
        at = np.argpartition(-like, near - 1, axis=1)[:, :near]
        s = np.take_along_axis(like, at, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        at, s = np.take_along_axis(at, order, 1), np.take_along_axis(s, order, 1)
        between = own[at] @ own[at].transpose(0, 2, 1)
        kept = np.zeros(at.shape, bool)
        for j in range(near):  # kept if nearer to the node than to any that is kept already
            close = np.where(kept, between[:, j, :], -np.inf).max(1)
            kept[:, j] = (close < s[:, j]) & (kept.sum(1) < links)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :links]  # then the nearest of the others
        source.append(np.repeat(rows + a, rank.shape[1]))
        target.append(np.take_along_axis(at, rank, 1).ravel())
        weight.append((np.take_along_axis(s, rank, 1) + 4 * np.take_along_axis(kept, rank, 1)).ravel())
    source, target, weight = map(np.concatenate, (source, target, weight))
    ends = np.concatenate([source, target]), np.concatenate([target, source])
    weight = np.concatenate([weight, weight])
    order = np.lexsort((ends[1], -weight, ends[0]))
    a, b = ends[0][order], ends[1][order]
    pair = a * n + b
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    a, b = a[first], b[first]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, links), -1, np.int32)
    fit = place < links
    out[a[fit], place[fit]] = nodes[b[fit]]
    return out


class Graph:
    """x: vectors of length 1; levels: (node numbers, neighbours) from the lowest up."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels
        self.place = [np.full(len(x), -1, np.int64) for _ in levels]
        for place, (nodes, _) in zip(self.place, levels):
            place[nodes] = np.arange(len(nodes))

    @classmethod
    def built(cls, x: np.ndarray) -> Graph:
        top, levels = _levels(len(x)), []
        for level in range(int(top.max(initial=0)) + 1):
            nodes = np.flatnonzero(top >= level)
            levels.append((nodes.astype(np.int32), _chosen(x, nodes, 2 * LINKS if level == 0 else LINKS)))
        return cls(x, levels)

    def _alike(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.where(nodes >= 0, np.einsum("qd,qmd->qm", q, self.x[nodes]), -np.inf)

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Nodes near each query, nearest first; -1 where fewer were met."""
        rows = np.arange(len(q))
        here = np.full(len(q), self.levels[-1][0][0], np.int64)
        best = self._alike(q, here[:, None])[:, 0]
        for level in range(len(self.levels) - 1, 0, -1):
            while True:
                near = self.levels[level][1][self.place[level][here]]
                like = self._alike(q, near)
                k = like.argmax(1)
                better = like[rows, k] > best
                if not better.any():
                    break
                here, best = np.where(better, near[rows, k], here), np.where(better, like[rows, k], best)
        pool, like, done = here[:, None], best[:, None], np.zeros((len(q), 1), bool)
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[rows, here] = True
        while True:
            open_ = np.where(done, -np.inf, like)
            k = open_.argmax(1)
            live = open_[rows, k] > -np.inf
            if not live.any():
                return np.take_along_axis(np.where(np.isfinite(like), pool, -1), np.argsort(-like, axis=1, kind="stable"), 1)
            done[rows, k] = True
            near = np.where(live[:, None], self.levels[0][1][pool[rows, k]], -1)
            near = np.where(seen[rows[:, None], near], -1, near)
            seen[np.repeat(rows, near.shape[1]), near.ravel()] = True
            seen[:, -1] = False
            more = self._alike(q, near)
            pool, like = np.concatenate([pool, near], 1), np.concatenate([like, more], 1)
            done = np.concatenate([done, ~np.isfinite(more)], 1)
            if pool.shape[1] > beam:
                keep = np.argpartition(-like, beam - 1, axis=1)[:, :beam]
                pool, like, done = (np.take_along_axis(v, keep, 1) for v in (pool, like, done))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two of their largest component: no square overflows or vanishes, and cosines keep their bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


_GRAPH = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("blob", pa.binary())])


def _saved(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "dim", "embedding", "ids")))]
    for shard, dim in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == (shard, dim)]
        x = np.array([r[2] for r in own], np.float64)
        graph = Graph.built(_unit(x))
        flat = {f"{kind}{i}": v for i, level in enumerate(graph.levels) for kind, v in zip(("nodes", "links"), level)}
        ends = np.cumsum([0, *(len(r[3]) for r in own)])
        blob = _saved(x=x, ids=np.array([i for r in own for i in r[3]], np.int64), ends=ends, **flat)
        yield batch(_GRAPH, [shard], [0], [dim], [blob])


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("vec_id", "embedding")))]
    for dim in sorted({len(r[1]) for r in rows}):
        own = [r for r in rows if len(r[1]) == dim]
        for a in range(0, len(own), BLOCK):
            part = own[a : a + BLOCK]
            yield batch(_GRAPH, [-1], [1], [dim], [_saved(id=np.array([r[0] for r in part], np.int64), q=np.array([r[1] for r in part], np.float64))])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found_of(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[tuple[int, int], tuple] = {}
        for rows in batches:
            for shard, kind, dim, blob in zip(*(rows.column(c).to_pylist() for c in _GRAPH.names)):
                held = np.load(io.BytesIO(blob))
                if kind == 0:
                    graphs = {key: g for key, g in graphs.items() if key[0] == shard}
                    levels = [(held[f"nodes{i}"], held[f"links{i}"]) for i in range(sum(n.startswith("nodes") for n in held.files))]
                    graphs[shard, dim] = Graph(_unit(held["x"]), levels), held["x"], held["ids"], held["ends"]
                elif (shard, dim) in graphs:
                    yield _scored(held["id"], held["q"], k, *graphs[shard, dim])

    return work


def _scored(own, q, k, graph, x, ids, ends) -> pa.RecordBatch:
    met = graph.search(_unit(q))
    x, q = _scaled(x), _scaled(q)
    out: list[tuple[int, int, float]] = []
    length = np.sqrt((x * x).sum(1))
    for i, nodes in zip(range(len(q)), met):
        nodes = nodes[nodes >= 0]
        score = (x[nodes] * q[i]).sum(1) / (length[nodes] * np.sqrt((q[i] * q[i]).sum()))
        top = []
        for j in np.argsort(-score, kind="stable"):
            if len(top) > k and score[j] < top[k][0]:
                break  # ties with the last place go on
            top += [(float(score[j]), int(v)) for v in ids[ends[nodes[j]] : ends[nodes[j] + 1]] if v != own[i]]
            top.sort(key=lambda t: (-t[0], t[1]))
            top = top[: k + 1]
        out += [(int(own[i]), v, s) for s, v in top[:k]]
    return batch(_FOUND, *(zip(*out) if out else ([], [], [])))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest rows found for each query, by cosine.

    Both sides have vec_id and embedding. A query's own vec_id is no candidate; ties go to the
    smaller vec_id. Rows without vec_id and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Vectors of another length are no candidates. Equal
    vectors are one node of a graph, with their k + 1 smallest ids: no other of them can be
    among k results. Rows that repeat count once; an id with several vectors is found by its
    nearest. Other columns are left behind; without vectors or queries there are no rows.
    """
    n = parts(vectors.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
        fit = df.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return fit.where(F.exists("embedding", lambda x: x != 0.0))

    same = Window.partitionBy("embedding").orderBy("vec_id")
    ids = valid(vectors).distinct().withColumn("at", F.row_number().over(same)).where(f"at <= {k + 1}")
    nodes = staged(ids.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), "embedding", "ids")
    kinds = "shard int, kind int, dim int, blob binary"
    graphs = staged(deal(dealt, shards, "shard").mapInArrow(_graphs, kinds), "graphs")
    asked = valid(queries).distinct().mapInArrow(_query_blocks, kinds)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*graphs.columns)
    met = deal(graphs.unionByName(asked), shards, "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_found_of(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
