"""Embedding whitening by an incremental eigendecomposition.

A task keeps the spectrum of the scatter of the vectors it has seen. Each further vector is a
centred rank-one update: the secular equation gives the new eigenvalues, its poles and roots the
eigenvectors, and what cannot move is deflated. Spectra of tasks are combined by applying one's
eigenpairs to the other as further rank-one updates. A last pass over all vectors projects them on
the eigenvectors found and solves the small projected problem (Rayleigh-Ritz), so that the result
no longer carries the rounding of long chains of updates.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.packed import batch, deal, parts, staged

SCALE, SHIFT = 64, 1_000_000
_EPS = np.finfo(float).eps
_BLOB = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("blob", pa.binary())])


def secular_roots(poles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Roots of 1 + sum(weight / (poles - s)), one behind each of the rising poles, as the matrix
    poles[i] - s[j], whose entries near a pole stay exact: a root is sought from its nearer pole."""
    n = len(poles)
    ends = np.append(poles[1:], poles[-1] + weight.sum())
    at_half = 1 + (weight / (poles - ((poles + ends) / 2)[:, None])).sum(1)
    behind = at_half < 0  # the root lies in the upper half
    behind[-1] = False
    base = np.arange(n) + behind
    gap = poles - poles[base][:, None]  # poles as seen from each root's base
    width = ends - poles
    low, high = np.where(behind, -width / 2, 0.0), np.where(behind, 0.0, width / 2)
    low[-1], high[-1] = 0.0, width[-1]
    before = np.tri(n, dtype=bool)
    lower_pole, upper_pole = poles - poles[base], ends - poles[base]
    x = (low + high) / 2
    for _ in range(100):
        away = gap - x[:, None]
        share = weight / away
        value = 1 + share.sum(1)
        done = np.abs(value) <= 8 * _EPS * (1 + np.abs(share).sum(1))
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        slope = share / away
        one = np.where(before, slope, 0.0).sum(1)
        two = slope.sum(1) - one
        a1, a2 = lower_pole - x, upper_pole - x
        c = value - a1 * one - a2 * two
        a = (a1 + a2) * value - a1 * a2 * (one + two)
        b = a1 * a2 * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        next_ = x + step
        inside = (next_ >= low) & (next_ <= high)  # false also where the step is not a number
        next_ = np.where(done, x, np.where(inside, next_, (low + high) / 2))
        if (next_ == x).all():
            break
        x = next_
    return gap - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of vectors * values * vectors' + added * added'."""
    z = vectors.T @ added
    tiny = 8 * _EPS * max(abs(values[-1]), float(z @ z))
    values, vectors = values.copy(), vectors
    live = np.flatnonzero(np.abs(z) * math.sqrt(float(z @ z)) > tiny)  # the others cannot move
    if len(live) > 1:
        near = np.flatnonzero(np.diff(values[live]) <= tiny)
        if len(near):
            vectors = vectors.copy()
            for i in near:  # of two equal eigenvalues one takes the whole share: the other stays
                a, b = live[i], live[i + 1]
                r = math.hypot(z[a], z[b])
                c, s = z[b] / r, z[a] / r
                vectors[:, a], vectors[:, b] = c * vectors[:, a] - s * vectors[:, b], s * vectors[:, a] + c * vectors[:, b]
                z[a], z[b] = 0.0, r
            live = live[np.abs(z[live]) * math.sqrt(float(z @ z)) > tiny]
    if not len(live):
        return values, vectors
    poles, weight = values[live], z[live] ** 2
    away = secular_roots(poles, weight)  # [root, pole]
    # The shares for which the computed roots are exact, so that eigenvectors come out orthogonal.
    apart = poles - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    share = np.sqrt(np.abs((-away / -apart.T).prod(0))) * np.sign(z[live])
    turned = share / away
    turned /= np.sqrt((turned * turned).sum(1))[:, None]
    new = vectors[:, live] @ turned.T
    nearest = np.abs(away).argmin(1)
    values[live] = poles[nearest] - away[np.arange(len(live)), nearest]
    vectors = vectors.copy()
    vectors[:, live] = new
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums and the eigenpairs of the centred scatter of vectors of whole numbers."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.mean, self.values, self.vectors = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, rows: np.ndarray) -> None:
        for row in rows:
            move = row - self.mean
            if self.n:
                self.values, self.vectors = rank_one(self.values, self.vectors, move * math.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + move / self.n
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.astype(object).sum(0) if len(rows) else [0] * len(self.sums))]

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * math.sqrt(value))
        if self.n and other.n:
            move = (other.mean - self.mean) * math.sqrt(self.n * other.n / (self.n + other.n))
            self.values, self.vectors = rank_one(self.values, self.vectors, move)
        self.mean = self.mean + (other.mean - self.mean) * (other.n / max(1, self.n + other.n))
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, n=np.array([self.n]), sums=np.array([str(x) for x in self.sums]), mean=self.mean, values=self.values, vectors=self.vectors)
        return out.getvalue()

    @classmethod
    def loaded(cls, blob: bytes) -> Spectrum:
        held = np.load(io.BytesIO(blob))
        out = cls(len(held["mean"]))
        out.n, out.sums = int(held["n"][0]), [int(x) for x in held["sums"]]
        out.mean, out.values, out.vectors = held["mean"], held["values"], held["vectors"]
        return out


def _matrices(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length: length, row numbers and the vectors as a matrix."""
    column = rows.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield dim, own, flat[starts[own][:, None] + np.arange(dim)]


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Spectrum] = {}
    for rows in batches:
        for dim, _, x in _matrices(rows):
            held.setdefault(dim, Spectrum(dim)).add(x)
    if held:
        yield batch(_BLOB, [0] * len(held), list(held), [s.saved() for s in held.values()])


def _merged_spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Spectrum] = {}
    for rows in batches:
        for dim, blob in zip(rows.column("dim").to_pylist(), rows.column("blob").to_pylist()):
            own = Spectrum.loaded(blob)
            if dim in held:
                held[dim].merge(own)
            else:
                held[dim] = own
    if held:
        yield batch(_BLOB, [0] * len(held), list(held), [s.saved() for s in held.values()])


def _merged_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for rows in batches:
        for dim, blob in zip(rows.column("dim").to_pylist(), rows.column("blob").to_pylist()):
            held[dim] = held.get(dim, 0.0) + np.frombuffer(blob)
    if held:
        yield batch(_BLOB, [0] * len(held), list(held), [m.tobytes() for m in held.values()])


_KIND = "part int, dim int, blob binary"


def _combined(each: DataFrame, work) -> list[tuple[int, bytes]]:
    """What `work` makes of the blobs of all tasks: by groups of tasks, then by length of vector."""
    n = max(1, math.isqrt(parts(each.sparkSession)))
    middle = deal(each.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(n))), n).mapInArrow(work, _KIND)
    last = deal(middle.withColumn("part", F.pmod(F.col("dim"), F.lit(n))), n).mapInArrow(work, _KIND)
    return [(r.dim, r.blob) for r in last.collect()]


class Whitener:
    """The components of vectors of one length; x0 stands for x - SHIFT."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray):
        self.n, self.sums, self.axes = n, sums, axes
        self.values, self.trace, self.error = np.zeros(axes.shape[1]), 0.0, 0.0

    def centred(self, x0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums as exact whole numbers, and the same over n."""
        wide = self.n * (int(np.abs(x0).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        exact = x0 * self.n - np.array(self.sums, np.int64) if wide < 1 << 62 else x0.astype(object) * self.n - np.array(self.sums, object)
        return exact, exact.astype(np.float64) / self.n

    def projected(self, x0: np.ndarray) -> np.ndarray:
        return self.centred(x0)[1] @ self.axes

    @property
    def noise(self) -> float:
        """Eigenvalues up to this one are rounding: their components have no spread to divide by."""
        return self.axes.shape[0] * _EPS * max(self.values[:1].max(initial=0.0), 0.0)


def _projections(models: dict[int, Whitener], whitened: bool):
    """Sums of outer products of projections, to unit variance if asked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for rows in batches:
            for dim, _, x0 in _matrices(rows):
                if dim in models:
                    y = models[dim].projected(x0)
                    if whitened:
                        y = y / np.sqrt(models[dim].values[: y.shape[1]])
                    held[dim] = held.get(dim, 0.0) + y.T @ y
        if held:
            yield batch(_BLOB, [0] * len(held), list(held), [m.tobytes() for m in held.values()])

    return work


def fit(distinct: DataFrame, components: int = 16) -> dict[int, Whitener]:
    """A whitener for each length of the vectors `x`, which must be distinct; reads them three times."""
    parts(distinct.sparkSession)
    models = {}
    for dim, blob in _combined(distinct.mapInArrow(_spectra, _KIND), _merged_spectra):
        found = Spectrum.loaded(blob)
        models[dim] = Whitener(found.n, found.sums, np.linalg.qr(found.vectors[:, ::-1])[0])
    for dim, blob in _combined(distinct.mapInArrow(_projections(models, False), _KIND), _merged_matrices):
        m = models[dim]
        ritz = np.frombuffer(blob).reshape(m.axes.shape[1], -1) / m.n
        m.trace = float(np.trace(ritz))
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        m.values = values[::-1].copy()
        m.axes = np.ascontiguousarray((m.axes @ turn[:, ::-1])[:, : min(components, dim)])
    spread = {}
    for dim, m in models.items():
        some = int((m.values[: m.axes.shape[1]] > m.noise).sum())
        if some:
            spread[dim] = Whitener(m.n, m.sums, m.axes[:, :some])
            spread[dim].values = m.values
    for dim, blob in _combined(distinct.mapInArrow(_projections(spread, True), _KIND), _merged_matrices):
        own = np.frombuffer(blob).reshape(spread[dim].axes.shape[1], -1) / models[dim].n
        models[dim].error = float(np.abs(own - np.eye(len(own))).max())
    return models


_WHITE = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
])


def _whitened_of(models: dict[int, Whitener]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for dim, own, x0 in _matrices(rows):
                m = models[dim]
                exact, centred = m.centred(x0)
                largest = max(-int(exact.min()), int(exact.max()))
                squares = exact * exact if dim * largest * largest < 1 << 63 else exact.astype(object) ** 2
                far = [d if d < 1 << 63 else None for d in squares.sum(1).tolist()]
                k = m.axes.shape[1]
                some = m.values[:k] > m.noise
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = centred @ m.axes / np.sqrt(m.values[:k])
                share = np.maximum(m.values[:k], 0.0) / m.trace if m.trace > 0 else np.zeros(k)
                total = len(own) * k
                yield batch(
                    _WHITE, rows.column("vec_id").take(pa.array(np.repeat(own, k))), np.tile(np.arange(1, k + 1), len(own)),
                    np.full(total, m.n), pa.array([d for d in far for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), mask=np.tile(~some, len(own))), np.tile(share, len(own)), np.full(total, m.error),
                )

    return work


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row.

    Entries c become the whole numbers floor(64 c) + 1000000. Components are fitted on the distinct
    vectors, with divisor n; vectors of different lengths are fitted apart, so a table should have
    few lengths. Rows without vector, with null or non-finite entries, or with one beyond 2^46 in
    size (whose whole number a double does not tell from its neighbours') are dropped; empty vectors
    have no components. Repeated rows and ids are all kept; a null vec_id stays null; other columns
    are left behind. A component without spread (n = 1, constant or dependent columns) has null as
    whitened, explains 0 and takes no part in identity_error. deviation is null beyond a long.
    """
    n = parts(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")
    usable = given.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 46))))
    whole = usable.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))
    distinct = staged(whole.select("x").distinct().repartition(n), "distinct-vectors")
    models = fit(distinct, components)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return whole.mapInArrow(_whitened_of(models), kind)
