"""Exact duplicate removal against a persistent digest index (DataFrame operations only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridwright.session import cut, fresh_path


#: Fewest buckets of an index, and distinct texts of the first run that a bucket takes.
BUCKETS, BUCKET_ROWS = 48, 2_000_000


class DigestIndex:
    """SHA-256 digests in a Parquet table bucketed and sorted by digest.

    ``digest, keep_id, group_size, run``: one or a few rows per distinct text, to be added up
    (``read``). Rows are only ever appended. The folder outlives sessions; ``DigestIndex(spark, path)``
    on an existing folder reads it under the same bucketing, so a sort-merge join with it moves only
    the new digests.

    What a run appends counts once the run is finished: ``begin`` notes its id beside the table, and
    ``finish`` notes its end. A run that broke off between appends leaves rows that nobody reads, so
    the same call can be made again. The number of buckets follows from the size of the first run and
    is noted with it; an existing table keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = f"{self.path}-runs"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        noted = self._noted()
        if noted is not None:
            self.buckets = noted.select("buckets").first()[0]
            self._declare()

    def _noted(self) -> DataFrame | None:
        """The notes of all runs: ``run, buckets, finished``."""
        try:
            return self.spark.read.schema("run STRING, buckets INT, finished BOOLEAN").parquet(self.log)
        except AnalysisException:
            return None

    def _note(self, run: str, finished: bool) -> None:
        row = self.spark.range(1).select(F.lit(run).alias("run"), F.lit(self.buckets).alias("buckets"), F.lit(finished).alias("finished"))
        row.coalesce(1).write.mode("append").parquet(self.log)

    def _declare(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id LONG, group_size LONG, run STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def begin(self, texts: int) -> str:
        """The id of a new run; ``texts``: how many distinct texts it may bring."""
        if self.buckets is None:
            self.buckets = max(BUCKETS, -(-texts // BUCKET_ROWS))
        run = uuid.uuid4().hex
        self._note(run, False)
        self._declare()
        return run

    def finish(self, run: str) -> None:
        self._note(run, True)

    def rows(self, run: str | None = None) -> DataFrame | None:
        """The table as it is stored, bucketed and sorted by digest: rows of finished runs and of ``run``."""
        noted = self._noted()
        if noted is None or not self.spark.catalog.tableExists(self.name):
            return None
        # runs that broke off: a handful, however many have finished
        broken = [r["run"] for r in noted.groupBy("run").agg(F.bool_or("finished").alias("done")).where("NOT done").collect() if r["run"] != run]
        return self.spark.table(self.name).where(~F.col("run").isin(broken)) if broken else self.spark.table(self.name)

    def read(self, run: str | None = None) -> DataFrame | None:
        """One row per digest: its largest id and the sum of its sizes, without a shuffle."""
        rows = self.rows(run)
        return rows and rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, groups: DataFrame, run: str) -> None:
        (
            groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "group_size", F.lit(run).alias("run"))
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.name)
        )

    def add(self, groups: DataFrame, run: str) -> DataFrame:
        """Appends the groups (``digest, keep_id, group_size``) whose digest is not there yet, by a
        sort-merge anti-join, and returns those whose digest is."""
        known = self.rows(run).select("digest").hint("merge")
        # settled before the index grows, so that it does not see its own append
        again = cut(groups.join(known, "digest", "left_semi"))
        self.append(groups.join(known, "digest", "left_anti"), run)
        return again

    def forget(self) -> None:
        """Takes the table out of the session's catalog; its folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest`` of every row; a null text counts as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", parts: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their texts are identical byte for byte; of equal rows the one with the
    largest ``doc_id`` stays. Digests already in ``index`` before the call drop all their new rows
    and keep the id and size noted there. Without an index a new one is made in the shared folder.

    The rows come to the index in ``parts``, by a hash of the id: new digests of a part are told by
    an anti-join with the index and appended; of digests that an earlier part has brought, the
    larger id and the sum of the sizes count. A call that fails leaves the index as it was for every
    reader, and can be repeated.

    Nulls: a null text is the empty text; a null id is below every other, so such a row stays
    only if all of its group have none. Repeated rows of the id that stays are all marked kept
    (``group_size`` counts each). Empty input gives no rows and adds nothing. Very long texts are
    hashed whole. Other columns are ignored, whatever their names. Only digests and ids are
    shuffled, never texts; the largest id is found by partial aggregation, and the join back is
    split by adaptive skew handling when one text has very many copies.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, f"{fresh_path(spark, 'digests')}/index")
    rows = digests(docs, text, doc_id)
    known = index.rows()
    old = None if known is None else cut(known.select("digest").distinct())
    found, run = None, None
    for part in range(parts):
        batch = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        groups = cut(batch.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"), F.count("*").alias("group_size")))
        run = run or index.begin(parts * groups.count())
        again = index.add(groups, run)
        found = again if found is None else found.unionByName(again)
    fresh = F.lit(True)
    if old is not None:
        found = found.join(old, "digest", "left_anti")
    # what an earlier part of this call has brought: a second row of the digest, added up by readers
    index.append(found, run)
    index.finish(run)
    resolved = index.read()
    if old is not None:
        resolved = resolved.join(old.withColumn("old", F.lit(True)), "digest", "left")
        fresh = F.col("old").isNull()
    # cut: the join below then has a shuffle on both sides, which Spark can split
    resolved = cut(resolved.select("digest", "keep_id", "group_size", fresh.alias("fresh")))
    if own:
        index.forget()
    return rows.join(resolved, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
