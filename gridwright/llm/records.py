"""Token ids in length-delimited binary records with masked checksums and an offset index.

File layout, repeated for each document: length of the payload (8 bytes, little endian), masked
CRC-32 of those 8 bytes (4 bytes), payload, masked CRC-32 of the payload (4 bytes). The payload
is the document's id (8 bytes), then its token ids as unsigned 16-bit integers where the
vocabulary allows it, else 32-bit. A checksum is masked by rotating it right by 15 bits and
adding 0xa282ead8. Beside the files an index table (Parquet) has one row per record.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.llm.bpe import encoded
from gridwright.session import fresh_path

#: Fixed values of the masking step.
MASK_DELTA, MASK_ROTATE = 0xA282EAD8, 15
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
INDEX = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32())])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_ROTATE) | (c << (32 - MASK_ROTATE))) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """(payload, position after the record); raises on a broken checksum."""
    length, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"broken length at byte {at}")
    payload = bytes(data[at + HEAD.size : at + HEAD.size + length])
    if len(payload) != length or masked(payload) != TAIL.unpack_from(data, at + HEAD.size + length)[0]:
        raise ValueError(f"broken record at byte {at}")
    return payload, at + HEAD.size + length + TAIL.size


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, wide: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes every text and writes the record files and their index; returns the index.

    Rows are range-partitioned and sorted by id, so files in order of ``part`` hold ids in
    ascending order. A task writes under a name of its own attempt and moves the finished file;
    the index names only files of attempts that ended well, so lost or repeated tasks leave at
    most unread files. A null text has no tokens but ``end_id``; repeated ids give repeated
    records; rows with a null id come first, with the id stored as the smallest 64-bit integer;
    an empty table gives an empty index. Other columns are ignored. A task keeps about 8 MB of
    text and its ids in memory.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = lean.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        end = b"" if end_id is None else struct.pack("<I", end_id)
        position, out = 0, None
        for rows, ids, offs in encoded(batches, vocabulary, "text"):
            if out is None:
                out = fs.open_output_stream(f"{root}/.{name}")
            positions, sizes, tokens = [], [], []
            keys = rows.column(0).fill_null(-(2**63)).to_pylist()
            for k, key in enumerate(keys):
                own = ids[offs[k] : offs[k + 1]]
                if end:
                    own = np.append(own, np.uint32(end_id))
                if not wide and len(own) and own.max() > 0xFFFF:
                    raise ValueError("ids above 65 535 need wide=True")
                record = frame(struct.pack("<q", key) + own.astype("<u4" if wide else "<u2").tobytes())
                out.write(record)
                positions.append(position)
                sizes.append(len(record))
                tokens.append(len(own))
                position += len(record)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([name] * len(keys)), pa.array(positions, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([part] * len(keys), pa.int32())], schema=INDEX)
        if out is not None:
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")

    ordered.mapInArrow(write, "doc_id long, file string, position long, size long, n_tokens long, part int").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: tokens of all records before, in the order of the files.

    File totals (one row a file) are summed over ``part``; within a file records are summed in
    order of position.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("position")) - F.col("n_tokens")
    return index.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_records(index: DataFrame, folder: str, wide: bool = False, digest_only: bool = False) -> DataFrame:
    """The records that ``index`` names, in any order: ``doc_id, ids, start`` from the files.

    Rows are dealt by file and read in file order, neighbours in one request of up to 8 MB, so a
    shuffled or filtered index reads only its own byte ranges. Checksums are verified.
    ``digest_only`` returns ``n_tokens, ids_crc32`` (over 32-bit ids) in place of ``ids``.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" if digest_only else "doc_id long, start long, ids array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        source, opened = None, None
        for batch in batches:
            rows = batch.to_pydict()
            at = 0
            while at < batch.num_rows:
                name, low = rows["file"][at], rows["position"][at]
                to, high = at, low
                while to < batch.num_rows and rows["file"][to] == name and rows["position"][to] == high and (to == at or high - low < 8 << 20):
                    high += rows["size"][to]
                    to += 1
                if opened != name:
                    source, opened = fs.open_input_file(f"{root}/{name}"), name
                data = memoryview(source.read_at(high - low, low))
                place, keys, lists, counts, checks = 0, [], [], [], []
                for _ in range(at, to):
                    payload, place = unframe(data, place)
                    ids = np.frombuffer(payload, "<u4" if wide else "<u2", offset=8)
                    keys.append(struct.unpack_from("<q", payload)[0])
                    if digest_only:
                        counts.append(len(ids))
                        checks.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    else:
                        lists.append(ids.astype(np.int64))
                starts = pa.array(rows["start"][at:to], pa.int64())
                if digest_only:
                    yield pa.record_batch([pa.array(keys, pa.int64()), starts, pa.array(counts, pa.int64()), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.record_batch([pa.array(keys, pa.int64()), starts, pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])
                at = to

    lean = index.select("file", "position", "size", "start")
    return lean.repartition("file").sortWithinPartitions("file", "position").mapInArrow(read, schema)


def token_records(docs: DataFrame, vocabulary: str, end_id: int, wide: bool = False) -> DataFrame:
    """Writes ``docs`` as records in the shared folder and reads the files back.

    ``doc_id, start, n_tokens, ids_crc32`` for each row: see ``write_records`` for nulls,
    repeated rows and empty tables.
    """
    folder = fresh_path(docs.sparkSession, "records")
    if "://" not in folder and not os.path.isabs(folder):
        raise ValueError("spark.checkpoint.dir must be a URI or an absolute path")
    index = write_records(docs, folder, vocabulary, end_id, wide)
    return read_records(with_starts(index), folder, wide, digest_only=True)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder that ``write_records`` filled."""
    return with_starts(spark.read.parquet(f"{folder}/index"))
