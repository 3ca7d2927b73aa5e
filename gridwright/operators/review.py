"""Summaries, histories and reviews of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.values import queue_rank, rounded
from gridwright.operators.layer_rules import MANHOLE, PIPE


def qa_summary(issues: DataFrame, *sets: list[str]) -> DataFrame:
    """Issue counts and affected objects for each grouping and in total, in one pass."""
    names = list(dict.fromkeys(n for s in sets for n in s))
    on = lambda layer: F.countDistinct(F.when(F.col("source_layer") == layer, F.col("source_objectid")))
    return issues.groupingSets([[F.col(n) for n in s] for s in [*sets, []]], *[F.col(n) for n in names]).agg(
        F.count("*").alias("issues"), on(PIPE).alias("pipes"), on(MANHOLE).alias("manholes")
    )


def merge_history(state: DataFrame, batch: DataFrame, run_id: str) -> DataFrame:
    """The review table after a run: ``fingerprint, first_run, latest_run, occurrences, present``.

    A fingerprint seen for the first time starts at 1; one seen before counts up unless it was
    last seen in this very run; one that is absent stays with ``present`` false. Merging the
    same run twice changes nothing.
    """
    seen = batch.select("fingerprint").distinct().withColumn("_seen", F.lit(True))
    d = state.join(seen, "fingerprint", "full_outer")
    now = F.coalesce("_seen", F.lit(False))
    return d.select(
        "fingerprint",
        F.coalesce("first_run", F.lit(run_id)).alias("first_run"),
        F.when(now, F.lit(run_id)).otherwise(F.col("latest_run")).alias("latest_run"),
        F.when(F.col("occurrences").isNull(), F.lit(1).cast("long")).when(now & (F.col("latest_run") != run_id), F.col("occurrences") + 1).otherwise(F.col("occurrences")).alias("occurrences"),
        now.alias("present"),
    )


def run_history(findings: DataFrame) -> DataFrame:
    """The review table after all runs at once: what repeated ``merge_history`` ends with."""
    last = findings.agg(F.max("run_id").alias("_last"))
    d = findings.groupBy("fingerprint").agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("latest_run"), F.countDistinct("run_id").alias("occurrences"))
    return d.join(F.broadcast(last)).select("fingerprint", "first_run", "latest_run", "occurrences", (F.col("latest_run") == F.col("_last")).alias("present"))


def enrich(issues: DataFrame, reviews: DataFrame, priority: Column, kind: Column, dependency: Column) -> DataFrame:
    """Issues with their review, or the defaults of one that nobody has looked at."""
    d = issues.withColumns({"_priority": priority, "finding_class": kind, "missing_layer": dependency}).join(reviews, "fingerprint", "left")
    return d.withColumns({"disposition": F.coalesce("disposition", F.lit("unreviewed")), "review_priority": F.coalesce("review_priority", "_priority"), "occurrences": F.coalesce("occurrences", F.lit(1).cast("long"))}).drop("_priority")


def calibration(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: findings, reviewed, confirmed, false positives and their rates; rules without
    findings stay with zeros."""
    is_ = lambda v: F.count_if(F.col("disposition") == v)
    reviewed = ~F.coalesce(F.col("disposition"), F.lit("")).isin("", "unreviewed", "under_review")
    n = issues.groupBy("rule_code").agg(F.count("*").alias("total"), F.count_if(reviewed).alias("reviewed"), is_("confirmed_defect").alias("confirmed"), is_("likely_defect").alias("likely"), is_("false_positive").alias("false_positives"))
    d = rules.select("rule_code").join(n, "rule_code", "left").fillna(0)
    rate = lambda a, b: F.when(F.col(b) > 0, rounded(a / F.col(b), 4)).otherwise(0.0)
    return d.select(
        "rule_code", "total", "reviewed", "confirmed", "likely", "false_positives", (F.col("total") - F.col("reviewed")).alias("unresolved"),
        rate(F.col("confirmed") + F.col("likely"), "reviewed").alias("confirmation_rate"), rate(F.col("false_positives"), "reviewed").alias("false_positive_rate"), rate(F.col("reviewed"), "total").alias("coverage"),
    )


def review_sample(issues: DataFrame, seed: int, per_rule: dict[str, int], whole: list[list[str]]) -> DataFrame:
    """A repeatable sample: all high findings, so many of each medium or low rule that has enough,
    and all findings of some rules; a finding drawn twice keeps its first reason.

    Draws are the smallest seeded hashes of the fingerprint within rule and severity.
    """
    draw = F.sha2(F.concat_ws("|", "fingerprint", F.lit(str(seed))), 256)
    w = Window.partitionBy("severity", "rule_code")
    d = issues.dropDuplicates(["fingerprint"]).withColumn("_draw", draw)
    d = d.withColumn("_k", F.row_number().over(w.orderBy("_draw"))).withColumn("_n", F.count("*").over(w))
    reason = F.when(F.col("severity") == "high", "all high")
    for severity, n in per_rule.items():
        reason = reason.when((F.col("severity") == severity) & (F.col("_n") >= n) & (F.col("_k") <= n), f"{n} {severity}")
    for codes in whole:
        reason = reason.when(F.col("rule_code").isin(codes), "all of " + "/".join(codes))
    return d.withColumn("reason", reason).where("reason IS NOT NULL").drop("_draw", "_k", "_n")


def review_queue(issues: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the queue: by rank, then by id. Spark keeps only the top rows of each task."""
    rank = queue_rank(F.col("rule_code"), F.col("severity"), F.col("confidence"), F.col("category"))
    return issues.withColumn("queue_rank", rank).orderBy("queue_rank", "issue_id").offset(offset).limit(limit)


def apply_updates(state: DataFrame, updates: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, one history row per changed field, ids that are not in the state).

    ``updates`` has the key ``issue_id`` and the fields; a null leaves a field as it is.
    """
    new = updates.select("issue_id", *[F.col(f).alias("_new_" + f) for f in fields])
    d = state.join(new, "issue_id", "left")
    changed = lambda f: F.col("_new_" + f).isNotNull() & ~F.col("_new_" + f).eqNullSafe(F.col(f))
    after = d.select(*[F.coalesce("_new_" + c, c).alias(c) if c in fields else F.col(c) for c in state.columns])
    entry = lambda f: F.when(changed(f), F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("old_value"), F.col("_new_" + f).cast("string").alias("new_value")))
    history = d.select("issue_id", F.explode(F.array_compact(F.array(*[entry(f) for f in fields]))).alias("h")).select("issue_id", "h.*")
    missing = updates.select("issue_id").join(state, "issue_id", "left_anti")
    return after, history, missing


def standard_mapping(schema: DataFrame, mapping: DataFrame) -> DataFrame:
    """State of each target field: mapped, unconfirmed (a unit or code list is open) or missing.

    ``schema``: ``target, role, needs_unit, needs_codes``; ``mapping``: ``role, field, confidence``.
    """
    d = schema.join(mapping, "role", "left")
    have = F.coalesce(F.col("confidence") != "unavailable", F.lit(False))
    state = F.when(~have, "missing").when(F.col("needs_unit") | F.col("needs_codes"), "unconfirmed").otherwise("mapped")
    return d.select("target", "role", F.when(have, F.col("field")).alias("field"), state.alias("state"))
