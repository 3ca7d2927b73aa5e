"""Exact top-k search by inner product: histograms of all scores locate each query's kth value."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.vectors import BLOCK, blocks, opened
from gridwright.operators.ranking import number_rows
from gridwright.session import fresh_path, settle

#: Queries that one pass over the vectors answers, and the bytes that they may take.
QUERY_ROWS, QUERY_BYTES = 4096, 16 << 20
#: Cells of a histogram of one query.
CELLS = 512
#: Scores that are worked on at once, and found rows that a task gathers before it thins them out.
TILE, GATHERED = 4 << 20, 200_000
RESULT = "query_id long, rank int, vec_id long, score long"


class Queries:
    """A bounded block of queries of one length: where they lie, their ids and components."""

    def __init__(self, rows: list, dim: int):
        self.place = {}
        for k, r in enumerate(rows):
            self.place.setdefault(r["block"], []).append((k, r["pos"]))
        self.ids = [r["ids"][0] for r in rows]
        self.x = np.array([np.frombuffer(r["data"], "<i8") for r in rows], np.int64).reshape(len(rows), dim)
        self.square = int((self.x.astype(object) ** 2).sum(axis=1).max()) if self.x.size else 0

    def scores(self, block: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of queries against some rows); a query's own row scores -2**63."""
        bound = x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(self.x).max(initial=0))
        if bound >= 1 << 62:
            raise OverflowError("a score is beyond 64 bits")
        kind = np.float64 if bound < 1 << 53 else np.int64  # the first is exact there, and quicker
        q, own = self.x.astype(kind), self.place.get(block, [])
        step = max(1, TILE // max(1, len(q)))
        for at in range(0, len(x), step):
            found = (q @ x[at : at + step].astype(kind).T).astype(np.int64)
            for k, pos in own:
                if at <= pos < at + step:
                    found[k, pos - at] = -(1 << 63)
            yield at, found


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each query: high scores first, then small ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def _histograms(found: DataFrame, queries: Queries, low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray) -> DataFrame:
    """``q, cell, n, need``: scores from ``low`` to ``high`` in cells counted from the top, of each task.

    A task leaves out what lies below the cell in which its own count reaches ``need``: the wanted
    value of all tasks can't be lower.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.ids)
        total = np.zeros((n, CELLS), np.int64)
        base = np.arange(n)[:, None] * CELLS
        for block, _, x in opened(batches):
            for _, s in queries.scores(block, x):
                inside = (s >= low[:, None]) & (s <= high[:, None])
                cell = (high[:, None] - np.where(inside, s, high[:, None])) // width[:, None]
                total += np.bincount((cell + base)[inside], minlength=n * CELLS).reshape(n, CELLS)
        above = np.cumsum(total, axis=1) - total
        q, cell = np.nonzero((total > 0) & (above < need[:, None]))
        yield pa.record_batch([pa.array(q.astype(np.int64)), pa.array(cell.astype(np.int64)), pa.array(total[q, cell]), pa.array(need[q])], names=["q", "cell", "n", "need"])

    return found.mapInArrow(count, "q long, cell long, n long, need long")


def thresholds(found: DataFrame, queries: Queries, k: int, square: float, few: int) -> np.ndarray:
    """For each query a value that at least ``k`` scores reach (or all, if there are fewer), and
    either at most ``few`` do or it is the kth score itself."""
    n = len(queries.ids)
    most = math.isqrt(queries.square * math.ceil(square)) + 1
    if most >= 1 << 61:
        raise OverflowError("a score is beyond 64 bits")
    low, high = np.full(n, -most, np.int64), np.full(n, most, np.int64)
    need, out = np.full(n, k, np.int64), np.full(n, -most, np.int64)
    going = np.ones(n, bool)
    while going.any():
        width = np.maximum(1, -(-(high - low + 1) // CELLS))
        # queries that are done look at nothing
        cells = _histograms(found, queries, np.where(going, low, 1), np.where(going, high, 0), width, need)
        w = Window.partitionBy("q").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = cells.groupBy("q", "cell", "need").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        hit = sums.where("upto >= need AND upto - n < need").collect()  # one row a query of the block
        found_cells = {r["q"]: r for r in hit}
        for q in np.flatnonzero(going).tolist():
            r = found_cells.get(q)
            if r is None:  # fewer than k scores: all are wanted
                going[q] = False
                continue
            high[q] -= r["cell"] * width[q]
            low[q] = max(low[q], high[q] - width[q] + 1)
            out[q], need[q] = low[q], need[q] - (r["upto"] - r["n"])
            going[q] = low[q] < high[q] and k - need[q] + r["n"] > few
    return out


def _at_least(found: DataFrame, queries: Queries, limit: np.ndarray, k: int) -> DataFrame:
    """``q, query_id, vec_id, score`` at or above each query's limit, the ``k`` best of each task."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.iinfo(np.int64).max  # stands for a null id among equal scores, after all others
        parts, size = [], 0

        def thin() -> list:
            q, s, i, null = (np.concatenate(c) for c in zip(*parts, strict=True))
            keep = best(q, s, np.where(null, last, i), k)
            return [(q[keep], s[keep], i[keep], null[keep])]

        for block, ids, x in opened(batches):
            null = np.array([i is None for i in ids], bool)
            number = np.array([0 if i is None else i for i in ids], np.int64)
            for at, s in queries.scores(block, x):
                q, c = np.nonzero((s >= limit[:, None]) & (s > -(1 << 63)))
                parts.append((q, s[q, c], number[c + at], null[c + at]))
                size += len(q)
                if size > GATHERED:
                    parts = thin()
                    size = len(parts[0][0])
                    if size > GATHERED // 2:  # as much as a block of queries can have: let it go
                        yield batch_of(parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(thin()[0])

    def batch_of(part: tuple) -> pa.RecordBatch:
        q, s, i, null = part
        own = pa.array(queries.ids, pa.int64()).take(pa.array(q))
        return pa.record_batch([pa.array(q.astype(np.int64)), own, pa.array(i, mask=null), pa.array(s)], names=["q", "query_id", "vec_id", "score"])

    return found.mapInArrow(pick, "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", query_rows: int = QUERY_ROWS, few: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k``
    other rows with the highest integer inner product, equal ones by smaller id.

    Components c count as ``floor(scale * c)``. The vectors are packed into blocks of rows once, in
    the shared folder. Queries are taken in blocks of a bounded size (``query_rows``, and 16 MB);
    for each block of queries all vectors are scored, and histograms of the scores are added up over
    the tasks and refined, cell by cell, until a query's kth score, or a value that few scores reach
    (``few``), is known; then the rows at or above it are ranked. Scores are exact whole numbers;
    nothing but histograms and results is shuffled, and a task adds at most ``k`` cells and rows of
    a query.

    Null vectors and those with a null or non-finite component take no part. A row with a null id is
    no query and comes last among equal scores. Rows that share an id are rows of their own: each is
    a query (so its ranks come once for each) and each is found. Vectors of different lengths are not
    compared; a vector without components scores 0 against others like it. An empty table gives no
    rows; other columns are ignored, whatever their names. Vectors whose scores may
    be beyond 61 bits raise ``OverflowError``.
    """
    spark = vectors.sparkSession
    table = settle(blocks(vectors, scale, vec_id, embedding))
    few = 16 * k if few is None else few

    def queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, x in opened(batches):
            mine = [p for p, i in enumerate(ids) if i is not None and i % every == 0]
            cols = [[block] * len(mine), mine, [[ids[p]] for p in mine], [x[p].astype("<i8").tobytes() for p in mine], [x.shape[1]] * len(mine)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "pos", "ids", "data", "dim"])

    asked = number_rows(table.select(*[c.split()[0] for c in BLOCK.split(", ")]).mapInArrow(queries_of, "block long, pos long, ids array<long>, data binary, dim int"), [F.col("dim"), F.col("block"), F.col("pos")], "number")
    asked = settle(asked)
    spans = asked.groupBy("dim").agg(F.min("number").alias("first"), F.max("number").alias("last")).collect()  # one row a length
    squares = {r["dim"]: r["square"] for r in table.groupBy("dim").agg(F.max("square").alias("square")).collect()}
    path = fresh_path(spark, "topk")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for span in sorted(spans, key=lambda r: r["dim"]):
        dim, found = span["dim"], table.where(F.col("dim") == span["dim"])
        step = max(1, min(query_rows, QUERY_BYTES // (8 * max(1, dim))))
        for at in range(span["first"], span["last"] + 1, step):
            some = Queries(asked.where(F.col("number").between(at, min(at + step - 1, span["last"]))).sort("number").collect(), dim)  # bounded by step
            limit = thresholds(found, some, k, squares[dim], few)
            rows = _at_least(found, some, limit, k)
            w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
