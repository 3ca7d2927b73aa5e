"""Queries over the derived reviews, proposals and work orders and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.functions import values as V
from gridwright.operators import changes as E
from gridwright.operators import proposals as P
from gridwright.operators import review as R
from gridwright.operators.connectivity import ASSET_RULES
from gridwright.operators.grouping import severity_sql
from gridwright.plans.bridge import derive, sql_of

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql_of(name, sql)
        return f

    return add


def reviews(s, sf):
    return derive(s, sf, "reviews")


def current(s, sf):
    """The newest row of each fingerprint."""
    return E.latest(reviews(s, sf), ["fingerprint"], ["run_id", "event_id"]).withColumn("issue_id", F.col("fingerprint"))


CUR = "cu AS (SELECT * EXCLUDE n, fingerprint AS issue_id FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY run_id DESC, event_id DESC) AS n FROM reviews) WHERE n = 1)"


@query("run_history", """SELECT fingerprint, min(run_id) AS first_run, max(run_id) AS latest_run, count(DISTINCT run_id) AS occurrences, max(run_id) = (SELECT max(run_id) FROM reviews) AS present FROM reviews GROUP BY 1""")
def run_history(s, sf):
    return R.run_history(reviews(s, sf))


_RUN = "(SELECT max(run_id) FROM reviews)"


@query(
    "merge_history",
    f"""WITH a AS (SELECT fingerprint, min(run_id) AS first_run, max(run_id) AS latest_run, count(DISTINCT run_id) AS occurrences FROM reviews WHERE run_id < {_RUN} GROUP BY 1), b AS (SELECT DISTINCT fingerprint FROM reviews WHERE run_id = {_RUN})
        SELECT fingerprint, coalesce(first_run, {_RUN}) AS first_run, CASE WHEN b.fingerprint IS NOT NULL THEN {_RUN} ELSE latest_run END AS latest_run, coalesce(occurrences, 0) + (b.fingerprint IS NOT NULL)::BIGINT AS occurrences, b.fingerprint IS NOT NULL AS present FROM a FULL JOIN b USING (fingerprint)""",
)
def merge_history(s, sf):
    r = reviews(s, sf)
    last = r.agg(F.max("run_id")).first()[0]
    state = R.run_history(r.where(F.col("run_id") < last))
    return R.merge_history(R.merge_history(state, r.where(F.col("run_id") == last), last), r.where(F.col("run_id") == last), last)


@query(
    "enriched_issues",
    f"""WITH {CUR}, v AS (SELECT fingerprint, arg_max(disposition, event_id) AS disposition, count(*) AS occurrences FROM reviews WHERE event_id % 4 = 0 GROUP BY 1)
        SELECT cu.fingerprint, coalesce(v.disposition, 'unreviewed') AS disposition, coalesce(v.occurrences, 1) AS occurrences,
          CASE WHEN severity = 'high' THEN 'high' WHEN category IN ('Connectivity', 'Geometry') THEN 'medium' ELSE 'normal' END AS review_priority,
          CASE WHEN rule_code IN ('WW_ATTR_002', 'WW_ATTR_006', 'WW_FLOW_002', 'WW_FLOW_003') THEN 'attribute_completeness_gap' WHEN category = 'Geometry' THEN 'geometry_defect' WHEN category = 'Connectivity' THEN 'network_defect' ELSE 'record_defect' END AS finding_class,
          CASE rule_code WHEN 'WW_NET_001' THEN 'unknown' WHEN 'WW_NET_006' THEN 'force_main' WHEN 'WW_NET_007' THEN 'service_lateral' ELSE '' END AS missing_layer FROM cu LEFT JOIN v USING (fingerprint)""",
)
def enriched_issues(s, sf):
    done = reviews(s, sf).where("event_id % 4 = 0").groupBy("fingerprint").agg(F.max_by("disposition", "event_id").alias("disposition"), F.count("*").alias("occurrences"))
    done = done.withColumn("review_priority", F.lit(None).cast("string"))
    rule, severity, category = F.col("rule_code"), F.col("severity"), F.col("category")
    out = R.enrich(current(s, sf).drop("disposition"), done, V.review_priority(severity, category), V.finding_class(rule, category), V.missing_layer(rule))
    return out.select("fingerprint", "disposition", "occurrences", "review_priority", "finding_class", "missing_layer")


@query(
    "calibration",
    f"""WITH n AS (SELECT rule_code, count(*) AS total, count(*) FILTER (disposition NOT IN ('', 'unreviewed', 'under_review')) AS reviewed, count(*) FILTER (disposition = 'confirmed_defect') AS confirmed, count(*) FILTER (disposition = 'likely_defect') AS likely, count(*) FILTER (disposition = 'false_positive') AS false_positives FROM reviews GROUP BY 1),
         r AS (SELECT rule_code FROM n UNION ALL SELECT 'WW_NONE')
       SELECT rule_code, coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed, coalesce(confirmed, 0) AS confirmed, coalesce(likely, 0) AS likely, coalesce(false_positives, 0) AS false_positives, coalesce(total - reviewed, 0) AS unresolved,
         CASE WHEN reviewed > 0 THEN {V.rounded_sql("(confirmed + likely) / reviewed", 4)} ELSE 0 END AS confirmation_rate, CASE WHEN reviewed > 0 THEN {V.rounded_sql("false_positives / reviewed", 4)} ELSE 0 END AS false_positive_rate, CASE WHEN total > 0 THEN {V.rounded_sql("reviewed / total", 4)} ELSE 0 END AS coverage FROM r LEFT JOIN n USING (rule_code)""",
)
def calibration(s, sf):
    r = reviews(s, sf)
    rules = r.select("rule_code").distinct().unionByName(s.createDataFrame([("WW_NONE",)], "rule_code string"))
    return R.calibration(r, rules)


@query(
    "review_sample",
    f"""WITH {CUR}, k AS (SELECT *, row_number() OVER (PARTITION BY severity, rule_code ORDER BY sha256(concat(fingerprint, '|7'))) AS k, count(*) OVER (PARTITION BY severity, rule_code) AS n FROM cu),
          x AS (SELECT fingerprint, CASE WHEN severity = 'high' THEN 'all high' WHEN severity = 'medium' AND n >= 20 AND k <= 20 THEN '20 medium' WHEN severity = 'low' AND n >= 10 AND k <= 10 THEN '10 low'
          WHEN rule_code = 'WW_NET_006' THEN 'all of WW_NET_006' WHEN rule_code = 'WW_NET_007' THEN 'all of WW_NET_007' WHEN rule_code IN ('WW_NET_001', 'WW_NET_003') THEN 'all of WW_NET_001/WW_NET_003' END AS reason FROM k)
        SELECT * FROM x WHERE reason IS NOT NULL""",
)
def review_sample(s, sf):
    return R.review_sample(current(s, sf), 7, {"medium": 20, "low": 10}, [["WW_NET_006"], ["WW_NET_007"], ["WW_NET_001", "WW_NET_003"]]).select("fingerprint", "reason")


_RANK = """CASE WHEN severity = 'high' AND confidence = 'high' THEN 0 WHEN rule_code IN ('WW_NET_001', 'WW_NET_003') THEN 1 WHEN rule_code = 'WW_NET_006' THEN 2 WHEN rule_code = 'WW_NET_007' THEN 3
    WHEN category = 'Identity' THEN 4 WHEN category = 'Geometry' THEN 5 WHEN rule_code IN ('WW_ATTR_002', 'WW_ATTR_006', 'WW_FLOW_002', 'WW_FLOW_003') THEN 6 ELSE 7 END"""


@query("review_queue", f"WITH {CUR} SELECT issue_id, {_RANK} AS queue_rank FROM cu ORDER BY queue_rank, issue_id LIMIT 50 OFFSET 20")
def review_queue(s, sf):
    return R.review_queue(current(s, sf), 50, 20).select("issue_id", "queue_rank")


_UPD = "up AS (SELECT fingerprint AS issue_id, CASE WHEN user_id % 3 = 0 THEN 'resolved' END AS disposition, CASE WHEN user_id % 2 = 0 THEN 'low' END AS severity FROM (SELECT DISTINCT fingerprint, user_id FROM (SELECT fingerprint, CAST(split_part(fingerprint, '-', 2) AS BIGINT) AS user_id FROM reviews)) WHERE user_id % 5 < 3)"


def updates(s, sf):
    key = F.split_part("fingerprint", F.lit("-"), F.lit(2)).cast("long")
    d = reviews(s, sf).select("fingerprint").distinct().withColumn("k", key).where("k % 5 < 3")
    return d.select(F.col("fingerprint").alias("issue_id"), F.when(F.col("k") % 3 == 0, "resolved").alias("disposition"), F.when(F.col("k") % 2 == 0, "low").alias("severity"))


@query(
    "review_updates",
    f"""WITH {CUR}, {_UPD}, j AS (SELECT cu.issue_id, cu.disposition AS od, up.disposition AS nd, cu.severity AS os, up.severity AS ns FROM cu JOIN up USING (issue_id))
        SELECT issue_id, 'disposition' AS field_name, od AS old_value, nd AS new_value FROM j WHERE nd IS NOT NULL AND nd IS DISTINCT FROM od UNION ALL SELECT issue_id, 'severity', os, ns FROM j WHERE ns IS NOT NULL AND ns IS DISTINCT FROM os""",
)
def review_updates(s, sf):
    return R.apply_updates(current(s, sf), updates(s, sf), ["disposition", "severity"])[1]


@query(
    "standard_mapping",
    """WITH s(target, role, u, c) AS (VALUES ('asset_identifier', 'asset_id', false, false), ('diameter', 'diameter', true, false), ('material', 'material', false, true), ('basin', 'basin', false, false)),
         m AS (SELECT 'asset_id' AS role, CASE WHEN (SELECT count(*) FROM pipes WHERE trim(asset_id) <> '') > 0 THEN 'asset_id' END AS field UNION ALL SELECT 'diameter', 'diameter' UNION ALL SELECT 'material', 'material')
       SELECT target, role, field, CASE WHEN field IS NULL THEN 'missing' WHEN u OR c THEN 'unconfirmed' ELSE 'mapped' END AS state FROM s LEFT JOIN m USING (role)""",
)
def standard_mapping(s, sf):
    from gridwright.operators.profile import field_mapping, field_profile
    from gridwright.plans.layer_queries import pipes

    schema = s.createDataFrame([("asset_identifier", "asset_id", False, False), ("diameter", "diameter", True, False), ("material", "material", False, True), ("basin", "basin", False, False)], "target string, role string, needs_unit boolean, needs_codes boolean")
    roles = s.createDataFrame([(r, r, "high") for r in ("asset_id", "diameter", "material", "basin")], "role string, field string, confidence string")
    return R.standard_mapping(schema, field_mapping(roles, field_profile(pipes(s, sf), ["asset_id", "diameter", "material"])))


def ops(s, sf):
    return derive(s, sf, "operations")


_CH = """ch AS (SELECT proposal_id, target_asset_id AS asset_id, CASE WHEN operation_type = 'retire_asset' THEN 'lifecycle_status' ELSE field_name END AS field,
    arg_max(CASE WHEN operation_type = 'retire_asset' THEN 'retired' ELSE proposed_value END, {'s': sequence, 't': tie, 'v': CASE WHEN operation_type = 'retire_asset' THEN 'retired' ELSE proposed_value END}) AS value FROM operations WHERE operation_type IN ('update_asset_field', 'retire_asset') GROUP BY 1, 2, 3)"""


@query("field_changes", f"WITH {_CH} SELECT * FROM ch")
def field_changes(s, sf):
    return E.field_changes(ops(s, sf))


_OF = ["diameter", "owner_candidate", "lifecycle_status"]


@query(
    "overlay",
    f"WITH {_CH}, w AS (SELECT proposal_id, asset_id, " + ", ".join(f"max(value) FILTER (field = '{f}') AS n_{f}" for f in _OF) + " FROM ch GROUP BY 1, 2) SELECT proposal_id, asset_id, "
    + ", ".join(f"coalesce(n_{f}, {f}) AS {f}" for f in _OF) + ", CASE WHEN " + " OR ".join(f"(n_{f} IS NOT NULL AND n_{f} IS DISTINCT FROM {f})" for f in _OF) + " THEN 'modified' ELSE 'unchanged' END AS change_state FROM w JOIN assets USING (asset_id)",
)
def overlay(s, sf):
    return E.overlay(derive(s, sf, "assets"), ops(s, sf), _OF)


_TOUCHED = f"""{_CH}, w AS (SELECT proposal_id, asset_id, {", ".join(f"max(value) FILTER (field = '{f}') AS n_{f}" for f in _OF)} FROM ch GROUP BY 1, 2),
  ov AS MATERIALIZED (SELECT w.proposal_id, a.* REPLACE ({", ".join(f"coalesce(n_{f}, {f}) AS {f}" for f in _OF)}) FROM w JOIN assets a USING (asset_id)),
  bs AS MATERIALIZED (SELECT w.proposal_id, a.* FROM w JOIN assets a USING (asset_id))"""
_RULE_ROWS = lambda t: " UNION ALL ".join(f"SELECT proposal_id, asset_id, '{c}' AS rule_code FROM {t} WHERE ({w})" + (f" AND vertical = '{v}'" if v else "") for c, v, w in ASSET_RULES)


@query(
    "proposed_qa",
    f"""WITH {_TOUCHED}, b AS (SELECT * FROM ({_RULE_ROWS('bs')})), a AS (SELECT * FROM ({_RULE_ROWS('ov')})),
          j AS (SELECT coalesce(b.proposal_id, a.proposal_id) AS proposal_id, b.rule_code AS br, a.rule_code AS ar, {severity_sql('coalesce(b.rule_code, a.rule_code)')} AS sv FROM b FULL JOIN a ON b.proposal_id = a.proposal_id AND b.asset_id = a.asset_id AND b.rule_code = a.rule_code),
          d AS (SELECT proposal_id, count(*) FILTER (ar IS NULL) AS resolved, count(*) FILTER (br IS NULL) AS new, 0::BIGINT AS worsened, 0::BIGINT AS improved, count(*) FILTER (ar = br) AS unchanged, count(*) FILTER (br IS NOT NULL AND sv >= 2) AS blockers_before, count(*) FILTER (ar IS NOT NULL AND sv >= 2) AS blockers_after FROM j GROUP BY 1)
        SELECT *, CASE WHEN new > 0 AND blockers_after > blockers_before THEN 'worsened' WHEN resolved > 0 AND blockers_after <= blockers_before THEN 'improved' WHEN resolved = 0 AND new = 0 THEN 'unchanged' ELSE 'mixed' END AS status FROM d""",
)
def proposed_qa(s, sf):
    return E.proposed_qa(derive(s, sf, "assets"), ops(s, sf), _OF)


_ERR = """er AS (SELECT o.proposal_id, o.sequence, o.tie, unnest(list_filter([
      CASE WHEN a.asset_id IS NULL THEN 'missing_target' END, CASE WHEN operation_type = 'update_asset_field' AND field_name NOT IN ('diameter', 'owner_candidate', 'lifecycle_status') THEN 'field_not_allowed' END,
      CASE WHEN operation_type = 'update_asset_field' AND t > 1 THEN 'duplicate_operation' END, CASE WHEN operation_type = 'update_asset_field' AND r THEN 'contradiction' END,
      CASE WHEN operation_type = 'retire_asset' AND a.lifecycle_status IN ('retired', 'removed', 'abandoned') THEN 'invalid_transition' END], lambda x: x IS NOT NULL)) AS error
    FROM (SELECT *, count(*) FILTER (operation_type = 'update_asset_field') OVER (PARTITION BY proposal_id, target_asset_id, field_name) AS t, bool_or(operation_type = 'retire_asset') OVER (PARTITION BY proposal_id, target_asset_id) AS r FROM operations) o LEFT JOIN assets a ON a.asset_id = o.target_asset_id)"""


def errors(s, sf):
    return E.operation_errors(ops(s, sf), derive(s, sf, "assets").where("k % 19 <> 0"), _OF)


_ERR19 = _ERR.replace("LEFT JOIN assets a ON", "LEFT JOIN (SELECT * FROM assets WHERE k % 19 <> 0) a ON")
query("operation_errors", f"WITH {_ERR19} SELECT * FROM er")(errors)
query("proposal_fingerprints", "SELECT proposal_id, sha256(string_agg(concat_ws(':', operation_type, target_asset_id, field_name, proposed_value), '|' ORDER BY sequence, tie, concat_ws(':', operation_type, target_asset_id, field_name, proposed_value))) AS fingerprint FROM operations GROUP BY 1")(
    lambda s, sf: E.proposal_fingerprints(ops(s, sf))
)
query(
    "stale_baselines",
    "WITH p AS (SELECT DISTINCT proposal_id, concat('v', proposal_id % 5) AS f FROM operations) SELECT proposal_id, f AS fingerprint, NOT (proposal_id % 3 <> 0 AND proposal_id % 5 = proposal_id % 4) AS stale FROM p",
)(
    lambda s, sf: E.stale_baselines(
        ops(s, sf).select("proposal_id", F.concat(F.lit("v"), F.col("proposal_id") % 5).alias("fingerprint")).distinct(),
        ops(s, sf).where("proposal_id % 3 <> 0").select("proposal_id", F.concat(F.lit("v"), F.col("proposal_id") % 4).alias("fingerprint")).distinct(),
        "proposal_id",
    )
)


def _sides(s, sf):
    """Groups before and after: keyed by proposal and target, with a severity and a blocking mark."""
    o = ops(s, sf).groupBy("proposal_id", "target_key").agg(F.max("tie").alias("tie"))
    b = o.where("target_key % 3 <> 0").selectExpr("proposal_id", "target_key", "tie % 4 AS severity", "tie % 4 > 1 AS blocking")
    a = o.where("target_key % 4 <> 0").selectExpr("proposal_id", "target_key", "target_key % 4 AS severity", "target_key % 4 > 1 AS blocking")
    return b, a


_DIFF = """o AS (SELECT proposal_id, target_key, max(tie) AS tie FROM operations GROUP BY 1, 2), bb AS (SELECT *, tie % 4 AS s FROM o WHERE target_key % 3 <> 0), aa AS (SELECT *, target_key % 4 AS s FROM o WHERE target_key % 4 <> 0),
  j AS (SELECT coalesce(bb.proposal_id, aa.proposal_id) AS proposal_id, bb.s AS b, aa.s AS a FROM bb FULL JOIN aa ON bb.proposal_id = aa.proposal_id AND bb.target_key = aa.target_key),
  df AS (SELECT proposal_id, count(*) FILTER (a IS NULL) AS resolved, count(*) FILTER (b IS NULL) AS new, count(*) FILTER (a > b) AS worsened, count(*) FILTER (a < b) AS improved, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (b > 1) AS blockers_before, count(*) FILTER (a > 1) AS blockers_after FROM j GROUP BY 1)"""


@query("qa_difference", f"""WITH {_DIFF} SELECT *, CASE WHEN new > 0 AND blockers_after > blockers_before THEN 'worsened' WHEN resolved > 0 AND blockers_after <= blockers_before THEN 'improved' WHEN resolved = 0 AND new = 0 THEN 'unchanged' ELSE 'mixed' END AS status FROM df""")
def qa_difference(s, sf):
    return E.qa_difference(*_sides(s, sf), ["proposal_id", "target_key"], ["proposal_id"])


@query("post_work_status", f"WITH {_DIFF} SELECT proposal_id, CASE WHEN blockers_after > blockers_before THEN 'failed' WHEN new > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM df")
def post_work_status(s, sf):
    return E.post_work_status(qa_difference(s, sf), "proposal_id")


_OUT = ["no_path", "blocked", "partial", "ambiguous", "complete_with_warnings", "complete"]


@query(
    "trace_difference",
    f"""WITH b AS (SELECT proposal_id, {_OUT}[max(tie) % 6 + 1] AS outcome, max(tie) % 6 AS r, list(DISTINCT target_key) AS k FROM operations WHERE proposal_id % 11 <> 0 GROUP BY 1),
          a AS (SELECT proposal_id, {_OUT}[min(tie) % 6 + 1] AS outcome, min(tie) % 6 AS r, list(DISTINCT target_key) AS k FROM operations WHERE sequence < 3 AND proposal_id % 7 <> 0 GROUP BY 1),
          j AS (SELECT coalesce(b.proposal_id, a.proposal_id) AS proposal_id, b.outcome AS b_outcome, a.outcome AS a_outcome, a.r > b.r AS up, a.r < b.r AS down,
            len(list_filter(a.k, lambda x: NOT list_contains(b.k, x))) AS g, len(list_filter(b.k, lambda x: NOT list_contains(a.k, x))) AS l, a.k IS NOT NULL AND b.k IS NOT NULL AS bth FROM b FULL JOIN a ON a.proposal_id = b.proposal_id)
        SELECT proposal_id, b_outcome, a_outcome, CASE WHEN bth THEN g::INT END AS gained, CASE WHEN bth THEN l::INT END AS lost, CASE WHEN NOT bth THEN 'incomparable' WHEN (up OR g > 0) AND (down OR l > 0) THEN 'mixed' WHEN up OR g > 0 THEN 'improved' WHEN down OR l > 0 THEN 'worsened' ELSE 'unchanged' END AS status FROM j""",
)
def trace_difference(s, sf):
    outcome = lambda c: F.element_at(F.array(*[F.lit(x) for x in _OUT]), (c % 6 + 1).cast("int"))
    o = ops(s, sf)
    b = o.where("proposal_id % 11 <> 0").groupBy("proposal_id").agg(outcome(F.max("tie")).alias("outcome"), F.collect_set("target_key").alias("reachable"))
    a = o.where("sequence < 3 AND proposal_id % 7 <> 0").groupBy("proposal_id").agg(outcome(F.min("tie")).alias("outcome"), F.collect_set("target_key").alias("reachable"))
    return E.trace_difference(b, a, "proposal_id")


@query(
    "impact_summary",
    f"""WITH {_ERR19}, e AS (SELECT proposal_id, count(*) AS errors FROM er GROUP BY 1), o AS (SELECT proposal_id, count(*) AS operations, count(DISTINCT target_asset_id) AS assets, array_to_string(list_sort(list(DISTINCT operation_type)), ';') AS kinds FROM operations GROUP BY 1)
        SELECT o.*, coalesce(errors, 0) AS errors, coalesce(errors, 0) = 0 AS ready FROM o LEFT JOIN e USING (proposal_id)""",
)
def impact_summary(s, sf):
    return E.impact_summary(ops(s, sf), errors(s, sf))


@query("latest_versions", """WITH v AS (SELECT DISTINCT proposal_id, sequence AS version, concat('v', sequence) AS label FROM operations), n AS (SELECT proposal_id, count(*) AS operations FROM operations GROUP BY 1)
  SELECT v.proposal_id, version, label, operations FROM v JOIN n USING (proposal_id) QUALIFY row_number() OVER (PARTITION BY v.proposal_id ORDER BY version DESC) = 1""")
def latest_versions(s, sf):
    v = ops(s, sf).select("proposal_id", F.col("sequence").alias("version"), F.concat(F.lit("v"), "sequence").alias("label")).distinct()
    return E.latest_versions(v, ops(s, sf))


_WO = """wo AS (SELECT proposal_id AS work_order_id, CASE WHEN proposal_id % 9 = 0 THEN 'manual_investigation' ELSE 'repair' END AS kind, proposal_id % 5 <> 0 AS approved, proposal_id % 7 <> 0 AS baseline_current, proposal_id % 4 = 1 AS released, CASE WHEN proposal_id % 2 = 0 THEN 'approved' ELSE 'open' END AS review_status,
    CASE WHEN proposal_id % 6 <> 0 THEN 'someone' END AS final_approver, CASE WHEN proposal_id % 8 = 1 THEN 'closed' ELSE 'open' END AS closeout_status FROM (SELECT DISTINCT proposal_id FROM operations))"""


def orders(s, sf):
    return s.sql("SELECT " + _WO.split("SELECT ", 1)[1].rsplit(" FROM (SELECT", 1)[0] + " FROM {p}", p=ops(s, sf).select("proposal_id").distinct())


@query(
    "work_order_readiness",
    f"""WITH {_WO}, r AS (SELECT proposal_id, bool_or(sequence % 3 <> 1) AS tr, bool_or(sequence % 3 <> 2) AS fa, count(*) FILTER (tie % 2 = 0 AND target_key % 5 = 0) AS op, count(*) FILTER (sequence > 1) AS st FROM operations GROUP BY 1),
          b AS (SELECT *, list_filter([CASE WHEN kind <> 'manual_investigation' AND NOT approved THEN 'proposal' END, CASE WHEN kind <> 'manual_investigation' AND NOT baseline_current THEN 'baseline' END, CASE WHEN NOT tr THEN 'technical_reviewer' END, CASE WHEN NOT fa THEN 'final_approver' END,
            CASE WHEN op > 0 THEN 'prerequisite' END, CASE WHEN kind <> 'manual_investigation' AND st = 0 THEN 'steps' END], lambda x: x IS NOT NULL) AS bl FROM wo JOIN r ON r.proposal_id = wo.work_order_id)
        SELECT work_order_id, CASE WHEN len(bl) > 0 THEN 'blocked' WHEN released THEN 'released' WHEN review_status = 'approved' THEN 'ready_for_release' ELSE 'ready_for_review' END AS state, coalesce(array_to_string(bl, ';'), '') AS blockers FROM b""",
)
def work_order_readiness(s, sf):
    o = ops(s, sf).withColumnRenamed("proposal_id", "work_order_id")
    roles = o.where("sequence % 3 <> 1").selectExpr("work_order_id", "'technical_reviewer' AS role").unionByName(o.where("sequence % 3 <> 2").selectExpr("work_order_id", "'final_approver' AS role"))
    pre = o.selectExpr("work_order_id", "tie % 2 = 0 AS required", "CASE WHEN target_key % 5 = 0 THEN 'open' ELSE 'waived' END AS status")
    return E.work_order_readiness(orders(s, sf), roles, pre, o.where("sequence > 1"))


_CF = """dn AS (SELECT proposal_id AS w, target_key * 100 + sequence + CASE WHEN target_key % 23 = 0 THEN 50 ELSE 0 END AS op, target_key % 10 <> 0 AS c, target_key % 10 = 0 AND target_key % 20 <> 0 AS x FROM operations),
  ex AS (SELECT DISTINCT proposal_id AS w, target_key * 100 + sequence AS op FROM operations), d2 AS (SELECT w, op, bool_or(c) AS c, bool_or(x) AS x FROM dn WHERE c OR x GROUP BY 1, 2),
  cf AS (SELECT coalesce(ex.w, d2.w) AS work_order_id, count(*) FILTER (ex.w IS NOT NULL AND c) AS compliant, count(*) FILTER (ex.w IS NOT NULL AND NOT coalesce(c, false) AND NOT coalesce(x, false)) AS missing, count(*) FILTER (ex.w IS NULL AND c) AS unexpected, count(*) FILTER (ex.w IS NOT NULL AND x) AS mismatched
         FROM ex FULL JOIN d2 ON ex.w = d2.w AND ex.op = d2.op GROUP BY 1),
  cs AS (SELECT *, CASE WHEN missing > 0 OR unexpected > 0 THEN 'nonconformant' WHEN mismatched > 0 THEN 'conformant_with_conditions' ELSE 'conformant' END AS status FROM cf)"""


@query("conformance", f"WITH {_CF} SELECT * FROM cs")
def conformance(s, sf):
    o = ops(s, sf)
    expected = o.selectExpr("proposal_id AS work_order_id", "target_key * 100 + sequence AS operation_id")
    done = o.selectExpr("proposal_id AS work_order_id", "target_key * 100 + sequence + CASE WHEN target_key % 23 = 0 THEN 50 ELSE 0 END AS operation_id", "CASE WHEN target_key % 10 <> 0 THEN 'completed' WHEN target_key % 20 <> 0 THEN 'skipped' END AS outcome").where("outcome IS NOT NULL")
    return E.conformance(expected, done)


@query(
    "closeout_readiness",
    f"""WITH {_WO}, {_CF}, {_DIFF}, q AS (SELECT proposal_id, blockers_after <= blockers_before AS ok FROM df),
          p AS (SELECT proposal_id, count(*) FILTER (tie % 6 = 0) AS st, count(*) FILTER (tie % 2 = 0 AND target_key % 6 = 1) AS ins, count(*) FILTER (sequence = 2) AS nt, count(*) FILTER (sequence = 2 AND tie % 5 = 0) AS bt FROM operations GROUP BY 1),
          b AS (SELECT work_order_id, closeout_status, list_filter([CASE WHEN st > 0 THEN 'steps' END, CASE WHEN ins > 0 THEN 'inspections' END, CASE WHEN cs.status = 'nonconformant' THEN 'conformance' END, CASE WHEN NOT coalesce(ok, false) THEN 'qa' END, CASE WHEN nt = 0 OR bt > 0 THEN 'traces' END, CASE WHEN final_approver IS NULL THEN 'final_approver' END], lambda x: x IS NOT NULL) AS bl
            FROM wo JOIN p ON p.proposal_id = work_order_id JOIN cs USING (work_order_id) LEFT JOIN q ON q.proposal_id = work_order_id)
        SELECT work_order_id, CASE WHEN len(bl) > 0 THEN 'blocked' WHEN closeout_status = 'closed' THEN 'approved' ELSE 'ready' END AS state, coalesce(array_to_string(bl, ';'), '') AS blockers FROM b""",
)
def closeout_readiness(s, sf):
    o = ops(s, sf).withColumnRenamed("proposal_id", "work_order_id")
    steps = o.selectExpr("work_order_id", "CASE WHEN tie % 6 = 0 THEN 'open' ELSE 'completed' END AS completion_status")
    checks = o.selectExpr("work_order_id", "tie % 2 = 0 AS required", "CASE WHEN target_key % 6 = 1 THEN 'fail' ELSE 'pass' END AS result")
    traces = o.where("sequence = 2").selectExpr("work_order_id", "CASE WHEN tie % 5 = 0 THEN 'failed' ELSE 'passed' END AS status")
    return E.closeout_readiness(orders(s, sf), steps, checks, conformance(s, sf), post_work_status(s, sf).withColumnRenamed("proposal_id", "work_order_id"), traces)


@query(
    "three_states",
    "SELECT proposal_id, " + ", ".join(f"max({c}) FILTER (st = '{k}') AS {k}_{c}" for k in ("baseline", "approved", "implemented") for c in ("blockers", "warnings"))
    + """ FROM (SELECT proposal_id, st, arg_max(blockers, {'r': run}) AS blockers, arg_max(warnings, {'r': run}) AS warnings FROM (SELECT proposal_id, ['baseline', 'approved', 'implemented'][sequence % 3 + 1] AS st, target_key * 1000 + tie AS run, tie % 5 AS blockers, target_key % 7 AS warnings FROM operations) GROUP BY 1, 2) GROUP BY 1""",
)
def three_states(s, sf):
    state = F.element_at(F.array(F.lit("baseline"), F.lit("approved"), F.lit("implemented")), F.col("sequence") % 3 + 1)
    runs = ops(s, sf).select("proposal_id", state.alias("state"), (F.col("target_key") * 1000 + F.col("tie")).alias("run"), (F.col("tie") % 5).alias("blockers"), (F.col("target_key") % 7).alias("warnings"))
    return E.three_states(runs, "proposal_id")


_PF = ["lifecycle_status", "operational_status", "diameter", "material", "phase", "feeder_id", "circuit_id", "route_id", "zone_id", "owner_candidate", "strand_start", "slope"]
_CAST = {"strand_start": "BIGINT", "slope": "DOUBLE"}
_PUT = lambda f: f"CASE WHEN n_{f} IS NOT NULL THEN {'n_' + f + '.v' if f not in _CAST else f'TRY_CAST(n_{f}.v AS {_CAST[f]})'} WHEN added THEN {dict(lifecycle_status=chr(39) + 'proposed' + chr(39), operational_status=chr(39) + 'unknown' + chr(39)).get(f, 'NULL')} ELSE {f} END AS {f}"


@query(
    "proposal_assets",
    f"""WITH c AS (SELECT proposal_id, target_asset_id AS asset_id, CASE WHEN operation_type IN ('change_lifecycle_status', 'retire_asset') THEN 'lifecycle_status' WHEN operation_type = 'change_operational_status' THEN 'operational_status' ELSE field_name END AS field,
            CASE operation_type WHEN 'retire_asset' THEN 'retired' WHEN 'remove_membership' THEN '' ELSE proposed_value END AS value, sequence, tie FROM proposal_operations WHERE operation_type IN {P._in(P.SET_FIELD)}),
          w AS (SELECT proposal_id, asset_id, {", ".join(f"arg_max({{'v': value}}, {{'s': sequence, 't': tie, 'v': value}}) FILTER (field = '{f}') AS n_{f}" for f in _PF)} FROM c GROUP BY 1, 2),
          n AS (SELECT DISTINCT proposal_id, target_asset_id AS asset_id, true AS fresh FROM proposal_operations WHERE operation_type = 'add_asset'), g AS (SELECT DISTINCT proposal_id, target_asset_id AS asset_id, true AS gone FROM proposal_operations WHERE operation_type = 'replace_asset'),
          j AS (SELECT *, a.k IS NULL AS added FROM w FULL JOIN n USING (proposal_id, asset_id) FULL JOIN g USING (proposal_id, asset_id) LEFT JOIN assets a USING (asset_id) WHERE a.k IS NOT NULL OR fresh)
        SELECT proposal_id, asset_id, {", ".join(map(_PUT, _PF))}, CASE WHEN added THEN 'added' WHEN gone THEN 'replaced' ELSE 'modified' END AS change_state FROM j""",
)
def proposal_assets(s, sf):
    return P.asset_changes(derive(s, sf, "assets"), derive(s, sf, "proposal_operations")).select("proposal_id", "asset_id", *_PF, "change_state")


@query(
    "proposal_edges",
    f"""WITH o AS (SELECT *, {{'s': sequence, 't': tie, 'k': operation_type}} AS pl, CASE WHEN operation_type = 'confirm_provisional_relationship' THEN false WHEN operation_type = 'mark_relationship_provisional' THEN true WHEN operation_type = 'update_relationship' AND field_name = 'provisional' THEN TRY_CAST(proposed_value AS BOOLEAN) END AS flag,
            CASE WHEN operation_type = 'update_relationship' AND field_name = 'direction' THEN proposed_value END AS way FROM proposal_operations),
          d AS (SELECT proposal_id, target_relationship_id AS relationship_id, arg_max(CASE WHEN operation_type = 'replace_relationship' THEN 'replaced' ELSE 'removed' END, pl) FILTER (operation_type IN {P._in(P.DROP_EDGE)}) AS dropped, arg_max(flag, pl) FILTER (flag IS NOT NULL) AS flag, arg_max(way, pl) FILTER (way IS NOT NULL) AS way,
            arg_max(CASE operation_type WHEN 'confirm_provisional_relationship' THEN 'confirmed_in_proposal' WHEN 'mark_relationship_provisional' THEN 'provisional' ELSE 'modified' END, pl) FILTER (operation_type IN {P._in(P.SET_EDGE)}) AS st FROM o WHERE operation_type IN {P._in([*P.DROP_EDGE, *P.SET_EDGE])} GROUP BY 1, 2)
        SELECT proposal_id, d.relationship_id, from_asset_id, to_asset_id, relationship_type, coalesce(way, direction) AS direction, coalesce(flag, provisional) AS provisional, coalesce(dropped, st) AS change_state FROM d JOIN trace_edges USING (relationship_id)
        UNION ALL SELECT DISTINCT proposal_id, concat('proposal-relationship_', left(sha256(concat_ws('|', proposal_id::VARCHAR, sequence::VARCHAR, tie::VARCHAR, from_asset_id, to_asset_id, rt)), 20)), from_asset_id, to_asset_id, rt, direction, provisional, 'added'
        FROM (SELECT *, CASE operation_type WHEN 'associate_container' THEN 'routed_through' WHEN 'associate_structure' THEN 'mounted_on' ELSE relationship_type END AS rt FROM proposal_operations WHERE operation_type IN {P._in(P.ADD_EDGE)})""",
)
def proposal_edges(s, sf):
    return P.edge_changes(derive(s, sf, "trace_edges"), derive(s, sf, "proposal_operations"))


@query("proposal_findings")
def proposal_findings(s, sf):
    return P.finding_changes(derive(s, sf, "assets"), derive(s, sf, "trace_edges"), derive(s, sf, "proposal_operations"))


@query("proposal_groups")
def proposal_groups(s, sf):
    return P.group_changes(derive(s, sf, "assets"), derive(s, sf, "trace_edges"), derive(s, sf, "proposal_operations"))
