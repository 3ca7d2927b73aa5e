"""Document quality rules and host-level verdicts (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.session import cut

_WHITE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def base_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Everything is computed inside the row from the whole text: no row is exploded and nothing is
    shuffled. Eight-word windows are compared by 64-bit hashes within one document. A null text
    has no words; a repeated row gives a repeated result; other columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("words", F.filter(F.split("t", _WHITE), lambda w: w != ""))
    d = d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hw"),
    )
    positions = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("windows", F.transform(positions, lambda i: F.xxhash64(*[F.get("hw", i + k) for k in range(WINDOW)])))
    d = d.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"),
    )
    # the few documents with a repeated window: sort (hash, position), keep what equals a neighbour
    d = d.withColumn("tagged", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    near = lambda x, k: F.coalesce(F.get("tagged", k)["h"] == x["h"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("tagged", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        hits,
        start,
        lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total")),
        lambda s: s["total"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("tagged", "windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def host_rates(rows: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, rate`` with rates shrunk by an empirical beta prior.

    The prior's mean is the corpus failure rate; its weight follows from the spread of host
    rates by the method of moments (between 1 and 1 000 000 documents). Hosts of few documents
    move to the corpus rate. Rows without a host form no host.
    """
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    # one row: totals for the prior
    t = hosts.agg(
        F.count("*").alias("k"),
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"),
    ).first()
    alpha, beta = beta_prior(t["k"], t["n"] or 0, t["f"] or 0, t["q"] or 0.0)
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))


def beta_prior(hosts: int, docs: int, failed: int, square_sum: float) -> tuple[float, float]:
    """(alpha, beta) from the number of hosts, documents, failures and sum(f * f / n)."""
    if not docs:
        return 0.5, 0.5
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    spread = square_sum / docs - mean * mean  # document-weighted variance of host rates
    noise = hosts * mean * (1 - mean) / docs  # what sampling alone gives
    real = max(spread - noise, mean * (1 - mean) / 1e6)
    weight = min(max(mean * (1 - mean) / real - 1, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def host_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``base_rules`` and ``host_rate, host_rejected, kept`` for every row of ``docs``.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at
    most ``max_rate``. A document without a host is judged by the base rules alone. Empty input
    gives no rows. The per-document figures are cut once in the shared folder (a few numbers a
    document); failures are pre-aggregated by host, and the join back is a broadcast only when
    Spark measures the host table to be small, else a sort-merge join with adaptive skew splits.
    """
    rows = cut(base_rules(docs, text, doc_id, host))
    rates = host_rates(rows).select("host", F.col("rate").alias("host_rate"))
    out = rows.join(rates, "host", "left")
    rejected = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        "host",
        "host_rate",
    )
