"""Tables of vectors as blocks of whole numbers, a few thousand vectors a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at most.
BLOCK_ROWS = 4096
#: Components must stay below this, so that no figure of the operators leaves 64 bits unseen.
LARGEST = 1 << 52
_KINDS = {2: "<i2", 4: "<i4", 8: "<i8"}


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, components of a row, all their ``floor(scale * c)`` in order as int64).

    Rows that are null, or that hold a null or non-finite component, are left out.
    """
    n = len(column)
    offs = np.asarray(column.offsets.to_numpy(), dtype=np.int64)
    flat = column.values.slice(offs[0], offs[-1] - offs[0])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offs = offs - offs[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    keep = valid & (bad[offs[1:]] == bad[offs[:-1]])
    sizes = np.diff(offs)
    values = values[np.repeat(keep, sizes)]
    whole = np.floor(values * scale)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}")
    return np.flatnonzero(keep), sizes[keep], whole.astype(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 2, 4 or 8 bytes that hold them all."""
    most = int(np.abs(x).max()) if x.size else 0
    return np.ascontiguousarray(x, dtype=_KINDS[2 if most < 1 << 15 else 4 if most < 1 << 31 else 8]).tobytes()


def widen(data: bytes, count: int, dim: int) -> np.ndarray:
    """The ``count`` vectors of ``narrow`` as rows of int64."""
    if not count * dim:
        return np.zeros((count, dim), np.int64)
    return np.frombuffer(data, _KINDS[len(data) // (count * dim)]).astype(np.int64).reshape(count, dim)


BLOCK = "block long, dim int, count int, ids array<long>, data binary, square double"


def block_rows(block: int, dim: int, ids: list, x: np.ndarray) -> pa.RecordBatch:
    square = float((x.astype(np.float64) ** 2).sum(axis=1).max()) if x.size else 0.0
    return pa.record_batch(
        [pa.array([block], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([narrow(x)], pa.binary()), pa.array([square])],
        names=["block", "dim", "count", "ids", "data", "square"],
    )


def blocks(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors as whole numbers, up to ``rows`` of one length a row: the block's number, ``dim``,
    ``count``, ids, components, and the largest square of a length.

    Null vectors and those with a null or non-finite component are left out. Numbers of blocks are
    unique in one run: write the table before they are used.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            kept, sizes, flat = whole_numbers(batch.column(1), scale)
            ids, ends = batch.column(0), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), rows):
                    some = own[at : at + rows]
                    x = flat[(ends[some] - dim)[:, None] + np.arange(dim)]
                    yield block_rows(number, dim, ids.take(pa.array(kept[some])).to_pylist(), x)
                    number += 1

    lean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return lean.mapInArrow(pack, BLOCK)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray]]:
    """(number, ids, components) of every block."""
    for batch in batches:
        for block, dim, count, ids, data in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "count", "ids", "data")), strict=True):
            yield block, ids, widen(data, count, dim)
