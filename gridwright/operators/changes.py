"""Proposed changes and work orders as table comparisons, many proposals at once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.connectivity import ASSET_RULES
from gridwright.operators.connectivity import _codes as broken
from gridwright.operators.grouping import CRITICAL, ERRORS, latest

#: What the operations set, and the fields that may be set.
FIELDS = ["diameter", "material", "owner_candidate", "lifecycle_status", "operational_status", "feeder_id", "circuit_id"]
DONE = ["satisfied", "satisfied_with_conditions", "waived", "not_applicable"]
PASSED = ["passed", "passed_with_warnings"]
BLOCKING = [*CRITICAL, *ERRORS]


def field_changes(ops: DataFrame) -> DataFrame:
    """``proposal_id, asset_id, field, value``: the last value of each field of each asset."""
    field = F.when(F.col("operation_type") == "retire_asset", "lifecycle_status").otherwise(F.col("field_name"))
    value = F.when(F.col("operation_type") == "retire_asset", "retired").otherwise(F.col("proposed_value"))
    d = ops.where(F.col("operation_type").isin("update_asset_field", "retire_asset")).select("proposal_id", F.col("target_asset_id").alias("asset_id"), field.alias("field"), value.alias("value"), "sequence", "tie")
    return d.groupBy("proposal_id", "asset_id", "field").agg(F.max_by("value", F.struct("sequence", "tie", "value")).alias("value"))


def overlay(assets: DataFrame, ops: DataFrame, fields: list[str]) -> DataFrame:
    """The changed assets of each proposal: baseline columns with the proposed values on top.

    Only assets that an operation touches appear; the others are as in the baseline. The
    baseline itself is never changed.
    """
    c = field_changes(ops)
    wide = c.groupBy("proposal_id", "asset_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias("_" + f) for f in fields])
    d = wide.join(assets, "asset_id")
    changed = F.exists(F.array(*[F.col("_" + f).isNotNull() & ~F.col("_" + f).eqNullSafe(F.col(f)) for f in fields]), lambda x: x)
    return d.select("proposal_id", "asset_id", *[F.coalesce("_" + f, f).alias(f) for f in fields], F.when(changed, "modified").otherwise("unchanged").alias("change_state"))


def overlay_assets(assets: DataFrame, ops: DataFrame, fields: list[str]) -> DataFrame:
    """All columns of the assets that each proposal touches, with the proposed values, and
    ``proposal_id``. The work grows with the changes, not with proposals times the network."""
    changed = overlay(assets, ops, fields).drop("change_state")
    rest = [c for c in assets.columns if c not in fields]
    return changed.join(assets.select(*rest), "asset_id").select("proposal_id", *assets.columns)


def proposed_qa(assets: DataFrame, ops: DataFrame, fields: list[str]) -> DataFrame:
    """Rule findings of the touched assets before and after each proposal, compared per proposal.

    ``proposal_id`` with the counts and status of ``qa_difference``; a finding's severity is its
    rule's rank, and errors block. ``assets`` has a row an id. Rules that name none of ``fields`` are
    evaluated once an asset, the others before and after in the row of the touched asset, so an
    operation goes through one exchange by asset, and findings through none.
    """
    kind = F.col("operation_type")
    o = ops.where(kind.isin("update_asset_field", "retire_asset")).select(
        "proposal_id", F.col("target_asset_id").alias("asset_id"), F.when(kind == "retire_asset", "lifecycle_status").otherwise(F.col("field_name")).alias("field"),
        F.when(kind == "retire_asset", "retired").otherwise(F.col("proposed_value")).alias("value"), "sequence", "tie",
    )
    last = lambda f: F.max_by("value", F.when(F.col("field") == f, F.struct("sequence", "tie", "value"))).alias("_" + f)
    touched = o.groupBy("proposal_id", "asset_id").agg(*[last(f) for f in fields])
    named = lambda rule: "vertical" in fields and rule[1] is not None or any(re.search(rf"\b{f}\b", rule[2]) for f in fields)
    moving, still = [r for r in ASSET_RULES if named(r)], [r for r in ASSET_RULES if not named(r)]
    blocking = [r for r in still if r[0] in BLOCKING]
    read = [c for c in assets.columns if c in [*fields, "vertical"] or any(re.search(rf"\b{c}\b", r[2]) for r in moving)]
    number = lambda rules: F.size(broken(rules)) if rules else F.lit(0)
    base = assets.select("asset_id", *[c for c in read if c != "asset_id"], number(still).alias("_still"), number(blocking).alias("_still_blocking"), broken(moving).alias("_was"))
    d = touched.join(base, "asset_id").withColumns({f: F.coalesce("_" + f, f) for f in fields}).withColumn("_now", broken(moving))
    blocks = lambda c: F.size(F.filter(c, lambda x: x.isin(BLOCKING)))
    d = d.select(
        "proposal_id", F.size(F.array_except("_was", "_now")).alias("r"), F.size(F.array_except("_now", "_was")).alias("n"), (F.size(F.array_intersect("_was", "_now")) + F.col("_still")).alias("u"),
        (blocks("_was") + F.col("_still_blocking")).alias("b"), (blocks("_now") + F.col("_still_blocking")).alias("a"),
    ).where("r + n + u > 0")
    none = F.lit(0).cast("long")
    out = d.groupBy("proposal_id").agg(F.sum("r").alias("resolved"), F.sum("n").alias("new"), F.sum("u").alias("unchanged"), F.sum("b").alias("blockers_before"), F.sum("a").alias("blockers_after"))
    return _with_status(out.select("proposal_id", "resolved", "new", none.alias("worsened"), none.alias("improved"), "unchanged", "blockers_before", "blockers_after"))


def operation_errors(ops: DataFrame, assets: DataFrame, allowed: list[str]) -> DataFrame:
    """``proposal_id, sequence, tie, error`` for missing targets, fields outside the allow-list,
    repeated field updates, and updates of an asset that the same proposal retires."""
    known = assets.select(F.col("asset_id").alias("target_asset_id"), F.lit(True).alias("_known"), F.col("lifecycle_status").alias("_state"))
    d = ops.join(known, "target_asset_id", "left")
    update = F.col("operation_type") == "update_asset_field"
    per = d.groupBy("proposal_id", "target_asset_id").agg(F.bool_or(F.col("operation_type") == "retire_asset").alias("_retires"))
    twice = d.where(update).groupBy("proposal_id", "target_asset_id", "field_name").agg(F.count("*").alias("_times"))
    d = d.join(per, ["proposal_id", "target_asset_id"]).join(twice, ["proposal_id", "target_asset_id", "field_name"], "left")
    errors = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "missing_target"),
        F.when(update & ~F.col("field_name").isin(allowed), "field_not_allowed"),
        F.when(update & (F.col("_times") > 1), "duplicate_operation"),
        F.when(update & F.col("_retires"), "contradiction"),
        F.when((F.col("operation_type") == "retire_asset") & F.col("_state").isin("retired", "removed", "abandoned"), "invalid_transition"),
    ))
    return d.select("proposal_id", "sequence", "tie", F.explode(errors).alias("error"))


def proposal_fingerprints(ops: DataFrame) -> DataFrame:
    """A hash of the ordered operations of each proposal."""
    entry = F.struct("sequence", "tie", F.concat_ws(":", "operation_type", "target_asset_id", "field_name", "proposed_value").alias("t"))
    d = ops.groupBy("proposal_id").agg(F.array_sort(F.collect_list(entry)).alias("o"))
    return d.select("proposal_id", F.sha2(F.array_join(F.transform("o", lambda x: x["t"]), "|"), 256).alias("fingerprint"))


def stale_baselines(proposals: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Proposals whose noted baseline fingerprint is no longer the current one."""
    return proposals.join(current.withColumnRenamed("fingerprint", "_now"), key, "left").withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.col("_now"))).drop("_now")


def qa_difference(before: DataFrame, after: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Groups resolved, new, worsened, improved and unchanged, per ``group``, with a status.

    Both sides: ``keys, severity (a number), blocking``, a row a key. The sides are put together by one
    aggregate; as in a join, rows that lack a key are met by none of the other side.
    """
    lacking = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    side = lambda d, name: d.select(*keys, F.when(lacking, F.lit(name)).alias("_only"), F.lit(name).alias("_side"), "severity", "blocking")
    of = lambda c, name: F.max(F.when(F.col("_side") == name, F.col(c)))
    d = side(before, "b").unionByName(side(after, "a")).groupBy(*keys, "_only").agg(*[of(c, s).alias(f"{s}_{c}") for s in "ba" for c in ("severity", "blocking")])
    n = lambda c: F.count_if(c)
    bs, as_ = F.col("b_severity"), F.col("a_severity")
    out = d.groupBy(*group).agg(
        n(as_.isNull()).alias("resolved"), n(bs.isNull()).alias("new"), n(as_ > bs).alias("worsened"), n(as_ < bs).alias("improved"), n(as_ == bs).alias("unchanged"),
        n(F.col("b_blocking")).alias("blockers_before"), n(F.col("a_blocking")).alias("blockers_after"),
    )
    return _with_status(out)


def _with_status(out: DataFrame) -> DataFrame:
    more = F.col("blockers_after") > F.col("blockers_before")
    status = F.when((F.col("new") > 0) & more, "worsened").when((F.col("resolved") > 0) & ~more, "improved").when((F.col("resolved") == 0) & (F.col("new") == 0), "unchanged").otherwise("mixed")
    return out.withColumn("status", status)


def trace_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per trace: outcome change and what became reachable or unreachable.

    Both sides: ``key, outcome, reachable ARRAY``.
    """
    #: Outcomes from worst to best.
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for k, v in {"no_path": 0, "blocked": 1, "partial": 2, "ambiguous": 3, "complete_with_warnings": 4, "complete": 5}.items() for x in (k, v)]), c)
    d = before.select(key, F.col("outcome").alias("b_outcome"), F.col("reachable").alias("b")).join(after.select(key, F.col("outcome").alias("a_outcome"), F.col("reachable").alias("a")), key, "full_outer")
    gained, lost = F.size(F.array_except("a", "b")), F.size(F.array_except("b", "a"))
    up, down = rank(F.col("a_outcome")) > rank(F.col("b_outcome")), rank(F.col("a_outcome")) < rank(F.col("b_outcome"))
    status = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "incomparable")
        .when((up | (gained > 0)) & (down | (lost > 0)), "mixed")
        .when(up | (gained > 0), "improved")
        .when(down | (lost > 0), "worsened")
        .otherwise("unchanged")
    )
    return d.select(key, "b_outcome", "a_outcome", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), gained).alias("gained"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), lost).alias("lost"), status.alias("status"))


def impact_summary(ops: DataFrame, errors: DataFrame) -> DataFrame:
    """Per proposal: operations, assets, kinds of operation, errors, and whether it is ready."""
    o = ops.groupBy("proposal_id").agg(F.count("*").alias("operations"), F.countDistinct("target_asset_id").alias("assets"), F.array_join(F.array_sort(F.collect_set("operation_type")), ";").alias("kinds"))
    e = errors.groupBy("proposal_id").agg(F.count("*").alias("errors"))
    d = o.join(e, "proposal_id", "left").fillna(0, ["errors"])
    return d.withColumn("ready", F.col("errors") == 0)


def latest_versions(versions: DataFrame, ops: DataFrame, key: str = "proposal_id") -> DataFrame:
    n = ops.groupBy(key).agg(F.count("*").alias("operations"))
    return latest(versions, [key], ["version"]).join(n, key, "left").fillna(0, ["operations"])


def _blockers(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for c, t in pairs]))


def work_order_readiness(orders: DataFrame, roles: DataFrame, prerequisites: DataFrame, steps: DataFrame) -> DataFrame:
    """``work_order_id, state, blockers``. Tables: orders (``kind, approved, baseline_current,
    released, review_status``), roles (``role``), prerequisites (``required, status``), steps."""
    r = roles.groupBy("work_order_id").agg(F.bool_or(F.col("role") == "technical_reviewer").alias("_tr"), F.bool_or(F.col("role") == "final_approver").alias("_fa"))
    p = prerequisites.groupBy("work_order_id").agg(F.count_if(F.col("required") & ~F.col("status").isin(DONE)).alias("_open"))
    s = steps.groupBy("work_order_id").agg(F.count("*").alias("_steps"))
    d = orders.join(r, "work_order_id", "left").join(p, "work_order_id", "left").join(s, "work_order_id", "left")
    work = F.col("kind") != "manual_investigation"
    b = _blockers(
        (work & ~F.coalesce("approved", F.lit(False)), "proposal"), (work & ~F.coalesce("baseline_current", F.lit(False)), "baseline"),
        (~F.coalesce("_tr", F.lit(False)), "technical_reviewer"), (~F.coalesce("_fa", F.lit(False)), "final_approver"),
        (F.coalesce("_open", F.lit(0)) > 0, "prerequisite"), (work & (F.coalesce("_steps", F.lit(0)) == 0), "steps"),
    )
    state = F.when(F.size(b) > 0, "blocked").when(F.col("released"), "released").when(F.col("review_status") == "approved", "ready_for_release").otherwise("ready_for_review")
    return d.select("work_order_id", state.alias("state"), F.array_join(b, ";").alias("blockers"))


def closeout_readiness(orders: DataFrame, steps: DataFrame, inspections: DataFrame, conformance_rows: DataFrame, qa: DataFrame, traces: DataFrame) -> DataFrame:
    """``work_order_id, state, blockers`` for closing: every part must be there and have passed."""
    bad = lambda d, c, n: d.groupBy("work_order_id").agg(F.count_if(c).alias(n))
    s = bad(steps, ~F.col("completion_status").isin("completed", "completed_with_exception", "skipped"), "_steps")
    i = bad(inspections, F.col("required") & ~F.col("result").isin("pass", "pass_with_conditions", "not_applicable"), "_inspections")
    t = bad(traces, ~F.col("status").isin(PASSED), "_traces")
    d = orders.join(s, "work_order_id", "left").join(i, "work_order_id", "left").join(t, "work_order_id", "left")
    d = d.join(conformance_rows.select("work_order_id", F.col("status").alias("_c")), "work_order_id", "left").join(qa.select("work_order_id", F.col("status").alias("_q")), "work_order_id", "left")
    b = _blockers(
        (F.coalesce("_steps", F.lit(0)) > 0, "steps"), (F.coalesce("_inspections", F.lit(0)) > 0, "inspections"),
        (~F.coalesce(F.col("_c").isin("conformant", "conformant_with_conditions"), F.lit(False)), "conformance"),
        (~F.coalesce(F.col("_q").isin(PASSED), F.lit(False)), "qa"), (F.coalesce(F.col("_traces") > 0, F.lit(True)), "traces"), (F.coalesce("final_approver", F.lit("")) == "", "final_approver"),
    )
    state = F.when(F.size(b) > 0, "blocked").when(F.col("closeout_status").isin("approved", "closed"), "approved").otherwise("ready")
    return d.select("work_order_id", state.alias("state"), F.array_join(b, ";").alias("blockers"))


def conformance(ops: DataFrame, done: DataFrame) -> DataFrame:
    """Per work order: compliant, missing, unexpected and mismatched operations, and a status.

    ``ops``: ``work_order_id, operation_id``; ``done``: ``work_order_id, operation_id, outcome``
    (completed, skipped or exception; an operation may have several).
    """
    is_ = lambda v: F.bool_or(F.col("outcome") == v)
    o = ops.select("work_order_id", "operation_id", F.lit(True).alias("_expected")).distinct()
    w = done.groupBy("work_order_id", "operation_id").agg(is_("completed").alias("c"), F.bool_or(F.col("outcome").isin("skipped", "exception")).alias("x"))
    d = o.join(w, ["work_order_id", "operation_id"], "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = d.groupBy("work_order_id").agg(
        F.count_if(yes("_expected") & yes("c")).alias("compliant"), F.count_if(yes("_expected") & ~yes("c") & ~yes("x")).alias("missing"),
        F.count_if(~yes("_expected") & yes("c")).alias("unexpected"), F.count_if(yes("_expected") & yes("x")).alias("mismatched"),
    )
    status = F.when((F.col("missing") > 0) | (F.col("unexpected") > 0), "nonconformant").when(F.col("mismatched") > 0, "conformant_with_conditions").otherwise("conformant")
    return n.withColumn("status", status)


def post_work_status(differences: DataFrame, key: str) -> DataFrame:
    """Status of the checks after work, from the difference to the baseline."""
    status = F.when(F.col("blockers_after") > F.col("blockers_before"), "failed").when(F.col("new") > 0, "passed_with_warnings").otherwise("passed")
    return differences.select(key, status.alias("status"))


def three_states(runs: DataFrame, key: str) -> DataFrame:
    """Blockers and warnings of the newest run of each state, side by side."""
    newest = latest(runs, [key, "state"], ["run"])
    states = ["baseline", "approved", "implemented"]
    return newest.groupBy(key).agg(*[F.max(F.when(F.col("state") == s, F.col(c))).alias(f"{s}_{c}") for s in states for c in ("blockers", "warnings")])
