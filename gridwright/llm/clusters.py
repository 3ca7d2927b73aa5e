"""Centroid clustering with exact distances from bit planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.vectors import blocks, opened
from gridwright.session import settle

#: Components of a vector: one bit each of a 64-bit plane.
WIDTH = 64


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Two's complement planes of vectors (rows of 64 whole numbers): plane p holds bit p of all 64
    components of a vector in one word; the last plane counts as ``-2**p``."""
    most = int(max(x.max(initial=0), ~x.min(initial=0)))
    bits = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
    u = x.astype(np.int64).view(np.uint64)
    return np.array([(((u >> np.uint64(p)) & np.uint64(1)) * bits).sum(axis=1, dtype=np.uint64) for p in range(most.bit_length() + 1)])


def plane_weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def components(planes: np.ndarray) -> np.ndarray:
    """The vectors of ``bit_planes`` again."""
    place = np.arange(WIDTH, dtype=np.uint64)
    return sum(w * ((p[:, None] >> place) & np.uint64(1)).astype(np.int64) for w, p in zip(plane_weights(len(planes)), planes, strict=True))


def dots(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Inner products of vectors with one centroid: weighted counts of bits that both planes have."""
    a, b = plane_weights(len(planes)), plane_weights(len(centroid))
    if len(a) + len(b) > 56:
        raise OverflowError("a distance is beyond 64 bits")
    out = np.zeros(planes.shape[1], np.int64)
    for p, w in zip(centroid, b, strict=True):
        shared = np.bitwise_count(planes & p[0])
        out += int(w) * (a @ shared.astype(np.int64))
    return out


def nearest(planes: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector; equal distances go to the smaller number."""
    cluster, least = np.zeros(len(squares), np.int64), np.zeros(len(squares), np.int64)
    for k, c in enumerate(centroids):
        d = squares - 2 * dots(planes, bit_planes(c[None])) + int((c * c).sum())
        better = np.ones(len(d), bool) if k == 0 else d < least
        cluster[better], least[better] = k, d[better]
    return cluster, least


PLANES = "ids array<long>, count int, planes binary, squares binary"


def plane_table(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """Vectors of exactly 64 components as planes, with their squared lengths, in blocks of rows."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x in opened(batches):
            if np.abs(x).max(initial=0) >= 1 << 27:
                raise OverflowError("a distance is beyond 64 bits")
            cols = [[ids], [len(x)], [bit_planes(x).tobytes()], [(x * x).sum(axis=1).tobytes()]]
            kinds = [pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["ids", "count", "planes", "squares"])

    return blocks(vectors, scale, vec_id, embedding).where(F.col("dim") == WIDTH).mapInArrow(cut_up, PLANES)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, count, planes, squares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield ids, np.frombuffer(planes, np.uint64).reshape(-1, count), np.frombuffer(squares, np.int64)


def first_centroids(table: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id``, in that order; null ids come last, and
    equal ids are in the order of their components."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for ids, planes, _ in _opened(batches):
            named = [("~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), k) for k, i in enumerate(ids)]
            if named:
                edge = sorted(named)[min(count, len(named)) - 1][0]
                some = [(h, k) for h, k in named if h <= edge]
                x = components(planes[:, [k for _, k in some]])
                kept = sorted(kept + [(h, row) for (h, _), row in zip(some, x.tolist(), strict=True)])[:count]
        yield pa.record_batch([pa.array([h for h, _ in kept], pa.string()), pa.array([x for _, x in kept], pa.list_(pa.int64()))], names=["hash", "x"])

    rows = table.mapInArrow(smallest, "hash string, x array<long>").orderBy("hash", "x").limit(count).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), WIDTH)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of the mean of the vectors nearest to it; one without any stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for _, planes, squares in _opened(batches):
            cluster, _ = nearest(planes, squares, centroids)
            x = components(planes)
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            total[own] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(cluster, minlength=len(centroids))
        own = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(own), pa.array(counts[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    each = table.mapInArrow(sums, "cluster long, n long, total array<long>")
    added = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(WIDTH)]).alias("total"))
    out = centroids.copy()
    for r in added.collect():  # a row a centroid
        out[r["cluster"]] = [t // r["n"] for t in r["total"]]
    return out


def cluster(vectors: DataFrame, count: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that has
    exactly 64 components, none null or non-finite; components c count as ``floor(scale * c)``.

    The planes of all vectors are written once to the shared folder and read in each round. A task
    gives one row a centroid (its count and sums), so a cluster with a third of all vectors moves no
    more than others; the driver holds ``count`` centroids. All figures are exact whole numbers.

    A row with a null id is clustered like any other and gives a first centroid only if there are
    fewer than ``count`` others; rows that share an id are rows of their own. Fewer vectors than
    ``count`` give as many centroids as there are vectors. An empty table gives no rows; other
    columns are ignored, whatever their names. Components of 2**27 and more (after scaling) raise
    ``OverflowError``.
    """
    table = settle(plane_table(vectors, scale, vec_id, embedding))
    centroids = first_centroids(table, count, seed)
    for _ in range(rounds):
        centroids = moved(table, centroids) if len(centroids) else centroids
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, planes, squares in _opened(batches):
            own, least = nearest(planes, squares, centroids)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    rows = settle(table.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    facts = vectors.sparkSession.createDataFrame([(k, inertia[k], sum(inertia.values()), names[k]) for k in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most ``count`` rows
