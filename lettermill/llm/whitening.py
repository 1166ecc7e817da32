"""Whitening of embeddings by a blockwise QR and a bidiagonal qd solver.

Components become whole numbers, and equal vectors count once in the fit. Tasks reduce their centred
rows to a triangle each, stacked block upon block; triangles are stacked again, a few dozen at a time,
until one of ``dim`` rows is left. Only that one is worked on in the driver: Householder reflections
make it bidiagonal, dqds finds the singular values of the bidiagonal matrix, and twisted
factorisations give the directions of the largest. A second pass over the fit list measures how far
the whitened covariance is from the identity, a third projects all rows.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do those
whose length isn't the commonest one (of equally common lengths the longer counts); entries times
``scale`` beyond 63 bits are held at its ends; repeated rows are returned each; null ids are kept;
directions whose singular value is below 1e-12 of the largest have no component, so rows that are
all alike give none; a deviation beyond 63 bits is null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written

SCALE, COMPONENTS, FAN, NO_DIRECTION = 256, 4, 32, 1e-12
EPS = float(np.finfo(float).eps)


# --- small matrices: one triangle of dim rows ---------------------------------------------

def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of a bidiagonal matrix with the singular values of square ``a``, and its right rotation."""
    a, n = a.astype(float).copy(), len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        v[0] += math.copysign(size, x[0])
        length = np.linalg.norm(v)
        return v / length if length else v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with a shift; the least of its differences is below 0 if the shift was too large."""
    d = least = q[0] - shift
    new_q, new_e = [], []
    for i, link in enumerate(e):
        top = d + link
        ratio = q[i + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(link * ratio)
        d = d * ratio - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """By dqds, largest first. A failed shift is taken back, so each value keeps its relative accuracy."""
    top = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if top == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    pending = [([float(x) ** 2 for x in diagonal / top], [float(x) ** 2 for x in above / top], 0.0)]
    while pending:
        q, e, moved = pending.pop()
        while len(q) > 1:
            # Links that have vanished split the matrix.
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (q[i] + q[i + 1] + moved)), None)
            if cut is not None:
                pending.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            # The smaller value of the last two rows is close to the least of all.
            total, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
            shift = product / (total / 2 + math.sqrt(max(total * total / 4 - product, 0.0))) if total else 0.0
            if q[0] < q[-1]:
                q, e = _turned(q, e)
                shift = 0.0
            for _ in range(4):
                new_q, new_e, least = _step(q, e, shift)
                if least >= 0 or shift == 0:
                    break
                shift = shift / 4 if shift > EPS * moved else 0.0
            else:
                shift = 0.0
                new_q, new_e, least = _step(q, e, 0.0)
            q, e, moved = new_q, new_e, moved + shift
        found += [x + moved for x in q]
    return np.sort(np.array(found))[::-1] * top * top


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same values of the matrix read from its other end."""
    return q[::-1], e[::-1]


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """A vector of the tridiagonal B'B to one of its values: factorised from both ends, which meet where the rest is least."""
    n = len(diagonal)
    a = diagonal ** 2
    a[1:] += above ** 2
    b = diagonal[:-1] * above
    tiny = EPS * EPS * (float(np.abs(a).max()) or 1.0)
    down, up = np.empty(n), np.empty(n)
    down[0], up[-1] = a[0] - value, a[-1] - value
    for i in range(n - 1):
        down[i] = down[i] or tiny
        down[i + 1] = a[i + 1] - value - b[i] ** 2 / down[i]
    for i in range(n - 1, 0, -1):
        up[i] = up[i] or tiny
        up[i - 1] = a[i - 1] - value - b[i - 1] ** 2 / up[i]
    z = np.zeros(n)
    r = int(np.argmin(np.abs(down + up - (a - value))))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -b[i] * z[i + 1] / down[i]
    for i in range(r + 1, n):
        z[i] = -b[i - 1] * z[i - 1] / up[i]
    return z / np.linalg.norm(z)


def directions(triangle: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, largest first and at most ``k``, and their right vectors as columns."""
    diagonal, above, right = bidiagonal(triangle)
    values = squared_singular_values(diagonal, above)
    values = values[values > NO_DIRECTION ** 2 * values.max(initial=0)][:k]
    vectors: list[np.ndarray] = []
    full = np.diag(diagonal) + np.diag(above, 1)
    square, random = full.T @ full, np.random.default_rng(1)
    for i, value in enumerate(values):
        z = twisted_vector(diagonal, above, float(value))
        close = [v for v, other in zip(vectors, values, strict=False) if other - value <= 1e-6 * values[0]]
        rest = z - sum((v * (v @ z) for v in close), np.zeros(len(z)))
        if np.linalg.norm(rest) < 0.9:
            # Values that coincide share a plane: inverse iteration, kept at right angles to the earlier ones.
            rest = random.standard_normal(len(z))
            moved = square - (value + 4 * EPS * values[0] * (i + 1)) * np.eye(len(z))
            for _ in range(4):
                rest -= sum((v * (v @ rest) for v in close), np.zeros(len(z)))
                rest = np.linalg.solve(moved, rest / np.linalg.norm(rest))
            rest -= sum((v * (v @ rest) for v in close), np.zeros(len(z)))
        vectors.append(rest / np.linalg.norm(rest))
    return values, right @ np.array(vectors).reshape(len(values), len(diagonal)).T


# --- rows ---------------------------------------------------------------------------------

def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, x): usable vectors with their components times ``scale``, rounded down."""
    parts = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return usable.select(F.col(key).alias("id"), F.transform(parts, lambda c: F.floor(c * scale).cast("bigint")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """One row per vector; all vectors have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Centre:
    """The number of vectors in the fit list and their sums, exact."""
    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they and the sum of their squares fit, else Python's."""
        largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums))
        if largest ** 2 * len(self.sums) >= 2 ** 63:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, high, low, n): sums of a task's components, in halves that can't overflow."""
    high = low = None
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            parts = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            high, low = parts if high is None else (high + parts[0], low + parts[1])
            n += len(x)
    if n:
        yield pa.RecordBatch.from_pydict({
            "place": np.arange(len(high), dtype=np.int32), "high": high, "low": low, "n": np.full(len(high), n)})


def _centre(fit: DataFrame) -> Centre | None:
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    # One row per dimension.
    rows = fit.select("x").mapInArrow(_sums, "place int, high long, low long, n long").groupBy("place").agg(*exact).orderBy("place").collect()
    return Centre(int(rows[0]["n"]), tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows)) if rows else None


def _triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle of the centred fit list's QR, square."""
    dim = len(centre.sums)

    def stacked(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = None
        for block in blocks:
            r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stacked(centre.centred(_matrix(b.column(0))) for b in batches if b.num_rows)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stacked(np.frombuffer(r.as_py()).reshape(-1, dim) for b in batches for r in b.column(0))

    triangles = written(fit.select("x").mapInArrow(of_rows, "r binary"))
    while (n := triangles.count()) > FAN:
        triangles = written(triangles.repartition(-(-n // FAN)).sortWithinPartitions(F.xxhash64("r")).mapInArrow(of_triangles, "r binary"))
    # At most FAN triangles of dim rows come to the driver.
    parts = [np.frombuffer(r["r"]).reshape(-1, dim) for r in triangles.orderBy(F.xxhash64("r")).collect()]
    square = np.zeros((dim, dim))
    r = np.linalg.qr(np.vstack(parts), mode="r")
    square[:len(r)] = r
    return square


def _identity_error(fit: DataFrame, centre: Centre, whitener: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = whitener.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = centre.centred(_matrix(batch.column(0))) @ whitener
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({"place": np.arange(k + k * k, dtype=np.int32), "part": np.concatenate((first, second.ravel()))})

    rows = fit.select("x").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).orderBy("place").collect()
    sums = np.array([r["s"] for r in rows]) / centre.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: eigenvalues of the covariance, directions as columns, shares of the trace."""
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitener(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """From a written table of distinct vectors ``x``; none without vectors."""
    centre = _centre(fit)
    if centre is None:
        return None
    triangle = _triangle(fit, centre)
    squares, vectors = directions(triangle, k)
    trace = float((triangle ** 2).sum())
    values = squares / centre.n
    found = Whitening(centre, values, vectors, squares / trace if len(squares) else squares, 0.0)
    error = _identity_error(fit, centre, found.whitener()) if len(values) else 0.0
    return Whitening(centre, values, vectors, found.explained, error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows = whole_vectors(df, key, vector, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.filter(F.size("x") == (common["dim"] if common else 0))
    model = fit_whitening(written(rows.select("x").distinct()), k) if common else None
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    centre, whitener, explained, error = model.centre, model.whitener(), model.explained, model.identity_error
    count = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            off = centre.deviations(_matrix(batch.column(1)))
            deviation = [int(d) if d < 2 ** 63 else None for d in (off * off).sum(axis=1)]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, centre.n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), count))),
                pa.array((off.astype(np.float64) / centre.n @ whitener).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)
