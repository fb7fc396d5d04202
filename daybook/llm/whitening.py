"""Embedding whitening: principal components by QDWH spectral divide-and-conquer, then a broadcast projection.

Vectors become whole numbers, floor(256 * c). Each distinct one counts once in the covariance V. A shifted V - s*I is taken apart by a polar
decomposition (dynamically weighted Halley steps); its orthogonal factor U gives (I + U) / 2, the projector on the components with eigenvalues
above s. Bases of both subspaces make two smaller problems, and so on down to single components; a subspace that cannot hold a wanted component
is not split. Executors sum moments of their rows; the driver holds matrices of the dimension, never rows.

Rows whose vector is null or holds a null, infinite or not-a-number entry are left out, as are rows whose vector has another length than most
(of equally common lengths the longest counts), for no covariance with the others exists. Only components whose eigenvalue stands above
rounding are given, so a table of equal vectors, an empty one, and vectors without entries give no rows. Ids may be null or repeat. Entries
beyond the range of a long are held at its ends; a deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.runtime import scratch

COMPONENTS, SCALE = 4, 256
#: Bytes of numbers that a task takes apart at once.
BLOCK_BYTES = 32 << 20
EPS = float(np.finfo(float).eps)


# -- spectral divide-and-conquer on one symmetric matrix ------------------------------------------


def orthogonal_factor(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix, by dynamically weighted Halley steps.

    `low` bounds the smallest singular value from below; with it each step's weights are the best ones, and six or seven steps do. While the
    weights are large a step goes through a QR decomposition, later through a Cholesky one.
    """
    n = len(a)
    x, eye, low = a / np.linalg.norm(a), np.eye(n), EPS
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            half = np.linalg.solve(np.linalg.cholesky(eye + wc * (x.T @ x)), x.T)
            inner = np.linalg.solve(np.linalg.cholesky(eye + wc * (x.T @ x)).T, half).T
            new = wb / wc * x + (wa - wb / wc) * inner
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces with eigenvalues above and below `shift`; None if it does not part them cleanly."""
    n = len(a)
    shifted = a - shift * np.eye(n)
    if not np.linalg.norm(shifted) > 0:
        return None
    above = (np.eye(n) + orthogonal_factor(shifted)) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < n or np.linalg.norm(above @ above - above) > 1e-10 * n:
        return None
    high = np.linalg.qr(above @ np.linalg.qr(above @ rng.standard_normal((n, k)))[0])[0]
    # The complement comes from a complete QR decomposition, so both bases together are orthogonal to rounding.
    whole = np.linalg.qr(np.hstack([high, rng.standard_normal((n, n - k))]))[0]
    high, low = whole[:, :k], whole[:, k:]
    if np.linalg.norm(low.T @ a @ high) > 1e-12 * n * np.linalg.norm(a):
        return None
    return high, low


def spectrum(a: np.ndarray, wanted: int, scale: float | None = None, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a symmetric matrix in falling order and unit eigenvectors as columns: at least `wanted` of them, or all."""
    a, n = (a + a.T) / 2, len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    rng = np.random.default_rng(0) if rng is None else rng
    rest = a - np.diag(np.diag(a))
    if n < 2 or np.linalg.norm(rest) <= EPS * scale:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(n)[:, order]
    # The median of the diagonal halves most spectra; the mean always lies between two different eigenvalues. A shift that meets an eigenvalue moves on.
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    for shift in [float(np.median(np.diag(a))), mean, *(mean + t * spread for t in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.7, -0.7))]:
        if bases := split(a, shift, rng):
            break
    else:  # eigenvalues that rounding cannot tell apart: any basis of their subspace serves
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(n)[:, order]
    high, low = bases
    values, inner = spectrum(high.T @ a @ high, wanted, scale, rng)
    vectors = high @ inner
    if len(values) < wanted:
        more, inner = spectrum(low.T @ a @ low, wanted - len(values), scale, rng)
        values, vectors = np.concatenate([values, more]), np.hstack([vectors, low @ inner])
    return values, vectors


# -- moments over a table ---------------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of each entry as long; null if an entry is null or not finite, or the vector is null."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")))


def _matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Rows of a list column as whole-number matrices of bounded size."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    rows = max(1, BLOCK_BYTES // (8 * width))
    for at in range(0, len(flat), rows):
        yield flat[at : at + rows]


def _sums(width: int):
    """Per task: (place, sum, rows) with sums as decimal text, exact whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, object), 0
        for batch in batches:
            for x in _matrices(batch.column(0), width):
                fits = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62
                total += x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"place": np.arange(width, dtype=np.int32), "part": [str(v) for v in total], "rows": np.full(width, n)})

    return run


def _products(width: int, centre: np.ndarray, axes: np.ndarray | None = None):
    """Per task: (i, j, sum of products) of the centred vectors, or of their projections on `axes`, for i <= j; j = -1 holds plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = plain = None
        for batch in batches:
            for x in _matrices(batch.column(0), width):
                y = x - centre
                y = y if axes is None else y @ axes
                total = y.T @ y if total is None else total + y.T @ y
                plain = y.sum(axis=0) if plain is None else plain + y.sum(axis=0)
        if total is not None:
            i, j = (x.astype(np.int32) for x in np.triu_indices(len(total)))
            at = np.arange(len(plain), dtype=np.int32)
            yield pa.RecordBatch.from_pydict(
                {"i": np.concatenate([i, at]), "j": np.concatenate([j, np.full_like(at, -1)]), "part": np.concatenate([total[i, j], plain])}
            )

    return run


@dataclass
class Whitening:
    """n distinct vectors with sums per place; unit axes as columns, their eigenvalues, the trace, and the measured distance from the identity."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def covariance(fit: DataFrame, n: int, centre: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the vectors in `fit.x` around `centre`, or of their projections on `axes`."""
    parts = fit.select("x").mapInArrow(_products(len(centre), centre, axes), "i int, j int, part double")
    size = len(centre) if axes is None else axes.shape[1]
    v, left = np.zeros((size, size)), np.zeros(size)
    # One number per pair of places; the table of vectors itself stays where it is.
    for i, j, s in parts.groupBy("i", "j").agg(F.sum("part")).collect():
        if j < 0:
            left[i] = s / n
        else:
            v[i, j] = v[j, i] = s / n
    return v - np.outer(left, left)  # what rounding of the centre left over


def fit_whitening(rows: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """The first `count` components of the distinct vectors in `rows.x`, all of one length. None if there is none."""
    path = scratch(rows.sparkSession, "fit")
    rows.select("x").distinct().write.parquet(path)
    fit = rows.sparkSession.read.schema("x array<long>").parquet(path)
    first = fit.select(F.size("x")).first()
    if first is None or first[0] == 0:
        return None
    parts = fit.mapInArrow(_sums(first[0]), "place int, part string, rows long")
    sums = parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")), F.sum("rows")).orderBy("place").collect()
    n = sums[0][2]
    model = Whitening(n, [int(r[1]) for r in sums], np.zeros((first[0], 0)), np.zeros(0), 0.0)
    v = covariance(fit, n, model.centre)
    values, vectors = spectrum(v, count)
    model.trace = float(np.trace(v))
    real = values[:count] > len(v) * EPS * max(model.trace, 0.0)
    model.values, model.axes = values[:count][real], vectors[:, :count][:, real]
    if not len(model.values):
        return None
    seen = covariance(fit, n, model.centre, model.axes / np.sqrt(model.values))
    model.identity_error = float(np.abs(seen - np.eye(len(seen))).max())
    return model


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over places of (n * x - S)**2 per row, exact; None beyond a long."""
    largest = model.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, model.sums))
    if len(model.sums) * largest**2 < 1 << 63:
        return ((x * model.n - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * model.n - np.array(model.sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _whitened(model: Whitening):
    count = len(model.values)
    centre, axes = model.centre, model.axes / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x in _matrices(batch.column(1), len(centre)):
                z = (x - centre) @ axes
                rows = pa.array(np.repeat(np.arange(done, done + len(x)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), model.n)), pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count))),
                        pa.array(z.ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(rows), model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                done += len(x)

    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    model = None
    if usual is not None:
        rows = rows.where(F.size("x") == usual.width)
        model = fit_whitening(rows, count)
    if model is None:
        return spark.createDataFrame([], out)
    return rows.mapInArrow(_whitened(model), out)
