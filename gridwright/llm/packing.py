"""Harmonic packing of token sequences into bins of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.bpe import CACHE_PIECES, encoded
from gridwright.session import cut

CAPACITY = 1024
#: Tokens of a full bin that may stay empty before a piece is cut to the size of a class.
SLACK = 16
#: Independent workers that fill bins: at least so many, and one for so many documents; a bin of one piece
#: leaves no rest to whoever fills it, so these are dealt to many more. Workers whose rests come together.
GROUPS, DOCS_A_GROUP, SINGLE_GROUPS, JOINED = 64, 200_000, 1 << 20, 64


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole bins first, then what remains.

    A piece of l tokens is of the class k of lengths in (capacity / (k + 1), capacity / k], of which
    k fill a bin. A remainder stays whole if k of its length leave at most ``slack`` tokens of a bin
    empty; else a piece of the largest class size below it, capacity // k, is cut off first.
    """
    out, at = [(k * capacity, capacity) for k in range(length // capacity)], length // capacity * capacity
    while at < length:
        rest = length - at
        k = capacity // rest
        if capacity - k * rest > slack:
            rest = capacity // (k + 1)
        out.append((at, rest))
        at += rest
    return out


def piece_rows(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) for each piece of each text.

    A null text is empty and has ``end_id`` alone. Only figures leave the worker unless
    ``with_ids`` is set.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:5]) + ", ids array<int>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, offs in encoded(batches, vocabulary, "text", most=cache_pieces):
            cols: list[list] = [[] for _ in names]
            for k, key in enumerate(rows.column(0).to_pylist()):
                own = np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id)).astype("<u4")
                for at, size in cuts(len(own), capacity):
                    part = own[at : at + size]
                    for col, value in zip(cols, (key, at, size, zlib.crc32(part), len(own), part), strict=False):
                        col.append(value)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]
            yield pa.record_batch(arrays, names=names)

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(cut_up, schema)


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and places of a few pieces of all classes, the longest first."""
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first", kind="stable")
    free: list[int] = []
    number, offset = [], []
    for size in rows["length"].tolist():
        at = next((b for b, f in enumerate(free) if f >= size), len(free))
        if at == len(free):
            free.append(capacity)
        number.append(at)
        offset.append(capacity - free[at])
        free[at] -= size
    return rows.assign(sequence_id=np.array(number, dtype=np.int64) * 4 + 3, offset=np.array(offset, dtype=np.int64))


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id, offset``: the bin of each piece and its place there.

    Pieces are of classes k by their length, in (capacity / (k + 1), capacity / k]. They are dealt to
    ``groups`` independent workers by a hash of document, start and ids, so that a hot class, a hot or a
    null id is spread evenly; only rows equal in all three share a worker. Each worker numbers the
    pieces of a class in order of document and start and puts every k of them into one bin. The fewer
    than k that it is left with come together with those of 63 other workers and fill bins of their class
    in the same way, and so on until one worker is left: none ever takes more than 64 (k - 1) pieces of
    a class. The fewer than k that then remain of each class (together fewer than the sum of all k,
    whatever the input) go into bins of mixed classes by first fit. Class 1 leaves no rest, so its
    pieces, among them all whole bins of long texts, are dealt to a million workers.

    Bin numbers are unique and depend on ``groups``, not on how Spark partitions the rows; more
    groups make smaller partitions. Repeated rows are packed like any others, rows with a null id
    first; an empty table gives no rows; columns of ``pieces`` besides the five of ``piece_rows`` are
    carried along and must not be named ``sequence_id``, ``offset`` or begin with ``_pack``.
    """
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    k = F.col("_pack_class")
    single, dealt = k == 1, F.xxhash64("doc_id", "start", "ids_crc32")
    d = pieces.withColumn("_pack_class", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    d = d.withColumn("_pack_group", F.when(single, F.pmod(dealt, F.lit(SINGLE_GROUPS))).otherwise(F.pmod(dealt, F.lit(groups))))

    def fill(rows: DataFrame, workers: int, level: int) -> DataFrame:
        """``sequence_id`` (null for what does not fill a bin) and the offset inside."""
        by = ["_pack_group", "_pack_class"]
        w = Window.partitionBy(*by).orderBy(*order)
        rows = rows.withColumn("_pack_n", F.row_number().over(w).cast("long") - 1).withColumn("_pack_total", F.count("*").over(Window.partitionBy(*by)))
        rows = rows.withColumn("_pack_before", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
        number = F.floor(F.col("_pack_n") / k).cast("long")
        begins = F.max(F.when(F.col("_pack_n") % k == 0, F.col("_pack_before"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("offset", (F.col("_pack_before") - begins).cast("long"))
        full = number < F.floor(F.col("_pack_total") / k)
        place = lambda n: (number * (capacity + 1) + k) * n + F.col("_pack_group")
        name = place(workers) * 4 + 1 if level == 0 else (place(workers) * 16 + level) * 4 + 2
        return rows.withColumn("sequence_id", F.when(full, F.when(single, place(SINGLE_GROUPS) * 4).otherwise(name)).cast("long"))

    names, carried = [*pieces.columns, "sequence_id", "offset"], ["_pack_class", "_pack_group"]
    filled, level = [cut(fill(d, groups, 0).select(*names, *carried))], 0
    while groups > 1:
        groups, level = -(-groups // JOINED), level + 1
        left = filled[-1].where("sequence_id IS NULL").select(*pieces.columns, "_pack_class", F.pmod("_pack_group", F.lit(groups)).alias("_pack_group"))
        filled.append(cut(fill(left, groups, level).select(*names, *carried)))
    third = filled[-1].where("sequence_id IS NULL").select(*pieces.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    mixed = third.withColumn("_pack_all", F.lit(0)).groupBy("_pack_all").applyInPandas(lambda p: _first_fit(p.drop(columns="_pack_all"), capacity)[names], schema)
    return reduce(DataFrame.unionByName, [*[f.where("sequence_id IS NOT NULL").select(*names) for f in filled], mixed])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, groups: int | None = None, with_ids: bool = False, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Encodes, cuts and packs every row of ``docs``; one row per piece (see ``harmonic_pack``).

    A null or empty text is ``end_id`` alone; a row with a null id, or an id that comes more than
    once, is packed like any other; a very long text is encoded in one piece and leaves in pieces
    of at most ``capacity`` ids; other columns are ignored, whatever their names.
    ``cache_pieces`` bounds a worker's table of encoded words: more memory, less CPU time. ``groups``
    follows from the number of documents where it is not given (a text has few pieces below a whole bin).
    """
    groups = groups or max(GROUPS, -(-docs.count() // DOCS_A_GROUP))
    return harmonic_pack(piece_rows(docs, vocabulary, end_id, capacity, with_ids, cache_pieces), capacity, groups)
