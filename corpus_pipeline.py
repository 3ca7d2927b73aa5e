"""A corpus pipeline: five operators in a row, each on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.exact_dedup import exact_dedup
from gridwright.llm.minhash import near_duplicates
from gridwright.llm.packing import pack_documents
from gridwright.llm.quality import score, train
from gridwright.llm.queries import tokenizer_path
from gridwright.llm.substring_dedup import substring_dedup
from gridwright.session import fresh_path, reclaim, release, remove, shared_folder, table


def _with_key(docs: DataFrame, nulls_last: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a column that no two rows share and that sorts as ``doc_id`` does, and its name.

    Where no id is null or repeated it is the id. Else the rows are sorted by id and a hash of the
    text, numbered and written to the shared folder once, so that every use sees the same numbers.
    """
    key, own = f"_row_{uuid.uuid4().hex}", F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("id")).count().where("id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(key, own), key
    path = fresh_path(docs.sparkSession, "keyed")
    rows = docs.sort(own.asc_nulls_last() if nulls_last else own.asc_nulls_first(), F.xxhash64("text"))
    rows.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path), key


def _keep(rows: DataFrame, key: str, verdict: DataFrame) -> DataFrame:
    """The ``rows`` that ``verdict`` (its ``doc_id`` is their ``key``) keeps, without the key."""
    kept = verdict.where("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each row by its own score.

    So rows with a null or repeated id are judged like others; a null or empty text is scored as an
    empty one; without labels of both classes every row stays; an empty table gives no rows; other
    columns are carried along, whatever their names.
    """
    reclaim(spark)
    rows, key = _with_key(docs)
    return _keep(rows, key, score(rows.withColumn("doc_id", F.col(key)), train(docs, table(spark, sf_dir, "labels"))))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the largest id stays; a null id is below every other.

    A null text is equal to an empty one. Of rows with equal texts and ids one stays; an empty table
    gives no rows; other columns are carried along, whatever their names.
    """
    reclaim(spark, docs)
    rows, key = _with_key(docs, nulls_last=False)
    return _keep(rows, key, exact_dedup(rows, doc_id=key))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.

    The smallest id stays; rows with a null id are compared like others and come after all ids. Texts
    without words stay; an empty table gives no rows; other columns are carried along, whatever their
    names.
    """
    reclaim(spark, docs)
    rows, key = _with_key(docs)
    return _keep(rows, key, near_duplicates(rows, words=5, percent=80, doc_id=key))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go; documents with nothing left go.

    A text without a repeat stays as it is; else its kept words are joined by one space, and
    ``n_chars`` follows. Texts without words had nothing to lose and stay. Rows are taken in the
    order of their ids, rows with a null id after all others; each row comes back once. An empty
    table gives no rows; other columns are carried along, whatever their names.
    """
    reclaim(spark, docs)
    keyed, key = _with_key(docs)
    others = [name for name in docs.columns if name != "text"]
    cut = substring_dedup(keyed, window=20, doc_id=key, with_text=True, carry=others, as_is=True)
    rows = cut.where("n_removed = 0 OR n_removed < n_words")
    carried = {name: F.col(f"carry_{k}") for k, name in enumerate(others)}
    own = {name: carried.get(name, F.col("text")) for name in docs.columns}
    changed = F.col("n_removed") > 0
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[column.alias(name) for name, column in own.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece with its ``ids`` and its place.

    Every row is packed, also with a null or repeated id; a null or empty text is the end id alone;
    an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
    """
    reclaim(spark, docs)
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024, with_ids=True, cache_pieces=300_000)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

#: Classifier, MinHash and tokenizer cannot be written as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage is written to the shared folder and read again, and what
    it was made from is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    reclaim(spark, docs)
    release()
    return docs
