"""Whitening of embeddings by their leading components, from Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.vectors import BLOCK_ROWS, block_rows, narrow, opened, whole_numbers, widen
from gridwright.session import settle

#: Vectors of the subspace besides the wanted ones, degree of the filter, largest residual of a wanted
#: pair against the largest eigenvalue, and rounds after which this counts as not settled.
GUARD, DEGREE, TOLERANCE, ROUNDS = 28, 12, 1e-12, 200
#: Partial sums come to the driver in this many rows at most: those of more tasks are added up in Spark first.
SUMS = 64
#: Eigenvalues below this share of the largest are taken for zero.
NOTHING = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_list(vectors: DataFrame, scale: int, embedding: str) -> DataFrame:
    """Each distinct vector of whole numbers once, in blocks of rows (see ``vectors.blocks``)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, flat = whole_numbers(batch.column(0), scale)
            ends = np.cumsum(sizes)
            out = [narrow(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            some = sizes > 0
            yield pa.record_batch([pa.array(sizes[some].astype(np.int32)), pa.array([d for d, s in zip(out, some, strict=True) if s], pa.binary())], names=["dim", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            dims, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), BLOCK_ROWS):
                    x = np.concatenate([widen(data[k], 1, dim) for k in own[at : at + BLOCK_ROWS]])
                    yield block_rows(number, dim, [], x)
                    number += 1

    kind = "block long, dim int, count int, ids array<long>, data binary, square double"
    return vectors.select(F.col(embedding).alias("embedding")).mapInArrow(lines, "dim int, data binary").distinct().mapInArrow(pack, kind)


def summed(table: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``work(x)`` over all blocks of vectors: by task, for many tasks by group of tasks in
    Spark, and the few sums here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, _, x in opened(batches):
            total += work(x)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                total += np.frombuffer(data).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = table.mapInArrow(each, "part int, total binary")
    if table.rdd.getNumPartitions() > SUMS:
        parts = parts.repartition(SUMS, "part").mapInArrow(together, "total binary")
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in parts.select("total").collect()), np.zeros(shape))  # SUMS rows


@dataclass
class Moments:
    """Exact figures of the fit list."""

    n: int
    dim: int
    sums: list[int]
    squares: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        """Of the covariance with divisor n."""
        return (self.n * self.squares - sum(s * s for s in self.sums)) / (self.n * self.n)


def moments(table: DataFrame) -> Moments | None:
    """Whole sums by dimension and of all squares; None without vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for _, _, x in opened(batches):
            n, s, q = by_dim.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object), 0])
            by_dim[x.shape[1]] = [n + len(x), s + x.sum(axis=0).astype(object), q + sum((x.astype(object) ** 2).ravel()) if np.abs(x).max() >= 1 << 25 else q + int((x * x).sum())]
        # whole numbers beyond 64 bits travel as text
        cols = [[d for d in by_dim], [v[0] for v in by_dim.values()], [[str(int(t)) for t in v[1]] for v in by_dim.values()], [str(int(v[2])) for v in by_dim.values()]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["dim", "n", "sums", "squares"])

    rows = table.mapInArrow(sums, "dim int, n long, sums array<string>, squares string")
    dims = [r["dim"] for r in rows.select("dim").distinct().limit(2).collect()]
    if not dims:
        return None
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(dims)}")
    whole = lambda c: c.cast("decimal(38,0)")
    added = rows.groupBy("dim").agg(F.sum("n").alias("n"), F.array(*[F.sum(whole(F.get("sums", F.lit(j)))) for j in range(dims[0])]).alias("sums"), F.sum(whole(F.col("squares"))).alias("squares")).first()
    return Moments(int(added["n"]), dims[0], [int(t) for t in added["sums"]], int(added["squares"]))


def leading(table: DataFrame, fit: Moments, wanted: int, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance, the ``wanted`` largest.

    A block of vectors goes through a Chebyshev polynomial of the covariance that is small between 0
    and the largest unwanted Ritz value and grows fast above it; then QR and a Rayleigh-Ritz step. Each
    product with the covariance is a pass over the fit list, V Q = sum((x - mean)ᵀ ((x - mean) Q)) / n.
    It ends when the residual |V u - e u| of every wanted pair is certified at ``TOLERANCE`` of the
    largest value, or no longer falls and is within a thousand times that.
    """
    mean, d = fit.mean, fit.dim
    size = min(d, wanted + guard)

    def product(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return summed(table, work, q.shape) / fit.n

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, size)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        vq = product(q)
        h = q.T @ vq
        e, y = np.linalg.eigh((h + h.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        u, vu = q @ y, vq @ y
        worst = float(np.linalg.norm(vu[:, :wanted] - u[:, :wanted] * e[:wanted], axis=0).max())
        good = TOLERANCE * max(e[0], 0.0)
        if size == d or e[0] <= 0 or worst <= good or (worst >= before / 2 and worst <= 1000 * good):
            break
        before = worst
        top = max(e[-1], NOTHING * e[0])
        half = top / 2  # of the interval from 0 to the largest unwanted value, and its middle
        sigma = first = half / (half - e[0])
        last, now = u, (vu - half * u) * (first / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            last, now = now, (product(now) - half * now) * (2 * following / half) - sigma * following * last
            sigma = following
        q = np.linalg.qr(now)[0]
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    e, u = e[:wanted], u[:, :wanted]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row that has a
    vector without null or non-finite entries, and every component up to ``components``.

    Entries c count as ``floor(scale * c)``. The mean and the covariance are those of the distinct
    vectors, which are written once to the shared folder; each pass over them moves a small matrix a
    task. ``deviation`` is the whole number sum((n x - S)^2), null where it takes more than 63 bits.

    Rows with a null id and rows that share an id are rows like others; copies of a vector count once
    in the fit, and all get the same figures. Vectors without entries give no rows. There are no more
    components than dimensions; where an eigenvalue is zero (fewer distinct vectors than components),
    ``whitened`` is null and ``explained`` 0, and if all are, ``explained`` is null. An empty table
    gives no rows; other columns are ignored, whatever their names. Vectors of different lengths
    raise ``ValueError``.
    """
    spark = vectors.sparkSession
    table = settle(fit_list(vectors, scale, embedding))
    fit = moments(table)
    if fit is None:
        return spark.createDataFrame([], RESULT)
    wanted = min(components, fit.dim)
    e, u = leading(table, fit, wanted)
    real = e > NOTHING * max(e[0], 0.0)
    mean, root = fit.mean, np.sqrt(np.where(real, e, 1.0))

    def crossed(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([np.ones((len(x), 1)), (x - mean) @ u / root], axis=1)
        return w.T @ w

    total = summed(table, crossed, (wanted + 1, wanted + 1)) / fit.n
    covariance = (total[1:, 1:] - np.outer(total[1:, 0], total[1:, 0]))[np.ix_(real, real)]
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if len(covariance) else None
    share = [float(x / fit.trace) if r else 0.0 for x, r in zip(e, real, strict=True)] if fit.trace > 0 else [None] * wanted
    n, sums = fit.n, np.array(fit.sums, dtype=object)
    most = max(abs(s) for s in fit.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, flat = whole_numbers(batch.column(1), scale)
            kept = kept[sizes > 0]
            if not len(kept):
                continue
            x = flat.reshape(len(kept), fit.dim)
            if fit.dim * (n * int(np.abs(x).max()) + most) ** 2 < 1 << 63:
                away = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                away = [int(v) if v < 1 << 63 else None for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
            white = ((x - mean) @ u / root).ravel()
            rows = len(kept)
            again = lambda values, kind: pa.array([v for v in values for _ in range(wanted)], kind)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(np.repeat(kept, wanted))), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), rows)), pa.array(np.full(rows * wanted, n)), again(away, pa.int64()),
                    pa.array(white, mask=np.tile(~real, rows)), pa.array(share * rows, pa.float64()), pa.array([error] * (rows * wanted), pa.float64()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    lean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return lean.mapInArrow(project, RESULT)
