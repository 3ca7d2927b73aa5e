"""Session helpers: the shared folder of a cluster and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent and the session is local, as in tests, a temporary
    folder is set. On a cluster without the setting this raises: a folder of one
    machine would lose data with that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that a job of several stages has taken since its last call of ``reclaim``; None outside of such jobs.
_taken: list[str] | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _taken is not None:
        _taken.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, wherever that folder is; a path that is not there is fine."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def reclaim(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """For jobs whose stages are written one by one: called when a stage begins, it deletes what the
    stages before it have left in the shared folder. The first stage calls it without ``docs``.

    Nothing is deleted unless ``docs`` is read from files that no stage has left there, that is,
    unless the result of the stage before has been written elsewhere. From then on ``cut`` writes
    tables, which can be deleted in this way, in place of checkpoints. ``release`` ends this.
    """
    global _taken
    if docs is None or _taken is None:
        _taken = []
        return
    read = docs.inputFiles()
    names = [path.rsplit("/", 1)[-1] for path in _taken]
    if not read or any(f"/{name}/" in f for name in names for f in read):
        return
    for path in _taken:
        remove(spark, path)
    _taken = []


def release() -> None:
    """Ends the job that called ``reclaim``: later paths are not noted any more."""
    global _taken
    _taken = None


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint() if _taken is None else settle(df)


def settle(df: DataFrame, tight: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: as ``cut``, but the optimizer starts anew. ``tight``
    tables take less room and more time to write.

    A checkpoint keeps what the optimizer has inferred of its rows; in a loop of many rounds that
    grows with every round.
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd" if tight else "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
