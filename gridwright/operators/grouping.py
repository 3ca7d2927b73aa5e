"""Root-cause groups of findings: keys, groups, roles, priorities, reviews of groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators.connectivity import with_identity

#: Rule -> (family, precedence, trace effect). Codes not listed are unsupported.
TRACE = ["not_evaluated", "no_trace_effect", "advisory", "introduces_ambiguity", "limits_trace", "stops_trace"]
SEVERITY = ["info", "warning", "error", "critical"]
RULES = {
    "SHARED-001": ("missing_endpoint", 1, "stops_trace"), "SHARED-002": ("invalid_relationship", 3, "stops_trace"), "SHARED-003": ("duplicate_relationship", 3, "advisory"),
    "SHARED-004": ("provisional_evidence", 9, "introduces_ambiguity"), "SHARED-005": ("lifecycle_conflict", 5, "stops_trace"), "SHARED-006": ("incompatible_vertical", 3, "stops_trace"),
    "SHARED-007": ("missing_identifier", 1, "limits_trace"), "SHARED-008": ("attribute_conflict", 7, "advisory"),
    "ELEC-001": ("conductor_connectivity", 2, "stops_trace"), "ELEC-002": ("conductor_connectivity", 2, "stops_trace"), "ELEC-003": ("feeder_assignment", 6, "limits_trace"),
    "ELEC-004": ("transformer_connectivity", 2, "stops_trace"), "ELEC-005": ("phase_compatibility", 7, "stops_trace"), "ELEC-006": ("voltage_compatibility", 7, "stops_trace"),
    "ELEC-007": ("containment_gap", 4, "limits_trace"), "ELEC-008": ("electric_structure", 4, "advisory"), "ELEC-009": ("membership_conflict", 6, "introduces_ambiguity"),
    "ELEC-010": ("membership_conflict", 6, "introduces_ambiguity"), "ELEC-011": ("invalid_relationship", 3, "introduces_ambiguity"), "ELEC-012": ("operational_state", 8, "no_trace_effect"),
    "ELEC-013": ("protective_device", 7, "limits_trace"), "ELEC-014": ("lifecycle_conflict", 5, "stops_trace"), "ELEC-015": ("electric_placement", 7, "advisory"),
    "TEL-001": ("cable_endpoint", 2, "stops_trace"), "TEL-002": ("cable_termination", 3, "stops_trace"), "TEL-003": ("strand_allocation", 7, "stops_trace"),
    "TEL-004": ("capacity_consistency", 7, "stops_trace"), "TEL-005": ("capacity_consistency", 7, "introduces_ambiguity"), "TEL-006": ("strand_allocation", 7, "stops_trace"),
    "TEL-007": ("splice_connectivity", 2, "stops_trace"), "TEL-008": ("terminal_connectivity", 2, "stops_trace"), "TEL-009": ("cabinet_connectivity", 6, "limits_trace"),
    "TEL-010": ("containment_gap", 4, "limits_trace"), "TEL-011": ("structure_support_gap", 4, "advisory"), "TEL-012": ("proposed_construction", 2, "limits_trace"),
    "TEL-013": ("lifecycle_conflict", 5, "stops_trace"), "TEL-014": ("provisional_evidence", 9, "introduces_ambiguity"), "TEL-015": ("capacity_consistency", 7, "stops_trace"),
    "TEL-016": ("telecom_placement", 7, "advisory"),
    **{c: ("disconnected_network", 2, "stops_trace") for c in ("WATER-009", "WATER-010", "WATER-011", "WATER-012", "WATER-017", "WW-006", "WW-014", "WW-015", "WW-016", "WW-017")},
    **{c: ("lifecycle_conflict", 5, "stops_trace") for c in ("WATER-016", "WW-018")},
    **{c: ("attribute_conflict", 7, "advisory") for c in (
        "WATER-001", "WATER-002", "WATER-003", "WATER-004", "WATER-005", "WATER-006", "WATER-007", "WATER-008", "WATER-013", "WATER-014", "WATER-015", "WATER-018",
        "WW-001", "WW-002", "WW-003", "WW-004", "WW-005", "WW-007", "WW-008", "WW-009", "WW-010", "WW-011", "WW-012", "WW-013", "WW-019", "WW-020",
    )},
}
#: Consequence -> the rules that it follows from.
DEPENDENCIES = {"ELEC-002": ["ELEC-001"], "ELEC-010": ["ELEC-009"], "ELEC-014": ["SHARED-005"], "TEL-002": ["TEL-001"], "TEL-005": ["TEL-004", "TEL-015"], "TEL-013": ["SHARED-005"], "TEL-014": ["SHARED-004"]}
#: Severities other than warning.
CRITICAL, INFO = ["SHARED-006"], ["ELEC-012"]
ERRORS = [
    "SHARED-001", "SHARED-002", "SHARED-005", "SHARED-007", "ELEC-001", "ELEC-002", "ELEC-003", "ELEC-004", "ELEC-005", "ELEC-006", "ELEC-009", "ELEC-014",
    "TEL-001", "TEL-002", "TEL-003", "TEL-004", "TEL-006", "TEL-007", "TEL-008", "TEL-013", "TEL-015", "WATER-001", "WATER-002", "WATER-003", "WATER-006", "WATER-009", "WATER-010", "WATER-016",
    "WW-001", "WW-002", "WW-003", "WW-006", "WW-007", "WW-008", "WW-012", "WW-014", "WW-015", "WW-016", "WW-017", "WW-018",
]
#: Warnings that block all the same; errors and critical findings always do.
BLOCKING_WARNINGS = ["WATER-004", "WW-004"]
#: Rules whose findings meet under one key: name -> (codes, by edge first).
SHARED_KEYS = [
    ("conductor_connectivity", ["ELEC-001", "ELEC-002"], False),
    ("membership_conflict", ["ELEC-009", "ELEC-010"], True),
    ("lifecycle_conflict", ["SHARED-005", "ELEC-014", "TEL-013"], True),
    ("provisional_evidence", ["SHARED-004", "TEL-014"], True),
    ("capacity_consistency", ["TEL-004", "TEL-005", "TEL-015"], False),
    ("strand_allocation", ["TEL-003", "TEL-006"], False),
]


#: Titles of families, names of rules, what the trace effects mean, and the kinds of action.
TITLES = {
    "conductor_connectivity": "Conductor connectivity and endpoints", "membership_conflict": "Feeder and circuit assignment conflict", "lifecycle_conflict": "Active and retired network conflict",
    "provisional_evidence": "Provisional relationship evidence", "cable_endpoint": "Cable endpoint and termination", "capacity_consistency": "Capacity values do not reconcile", "strand_allocation": "Fiber strand allocation conflict",
}
NAMES = {
    "SHARED-001": "Missing relationship endpoint", "SHARED-002": "Self-referential relationship", "SHARED-003": "Duplicate relationship", "SHARED-004": "Provisional relationship", "SHARED-005": "Retired asset linked to active asset",
    "SHARED-006": "Incompatible utility vertical relationship", "SHARED-007": "Missing canonical identifier", "SHARED-008": "Unknown lifecycle state",
    "ELEC-001": "Disconnected conductor", "ELEC-002": "Conductor endpoint missing", "ELEC-003": "Transformer missing feeder ID", "ELEC-004": "Transformer disconnected from primary", "ELEC-005": "Invalid or incompatible phase",
    "ELEC-006": "Voltage mismatch", "ELEC-007": "Underground conductor missing conduit", "ELEC-008": "Equipment missing structure association", "ELEC-009": "Feeder inconsistency across relationship", "ELEC-010": "Circuit inconsistency across relationship",
    "ELEC-011": "Invalid relationship direction", "ELEC-012": "Normally open device", "ELEC-013": "Protective device type missing", "ELEC-014": "Active-retired electric relationship", "ELEC-015": "Electric placement contradiction",
    "TEL-001": "Fiber cable endpoint missing", "TEL-002": "Invalid fiber termination", "TEL-003": "Overlapping strand range", "TEL-004": "Capacity exceeds total", "TEL-005": "Available capacity mismatch", "TEL-006": "Fiber count and strand range mismatch",
    "TEL-007": "Disconnected splice closure", "TEL-008": "Disconnected terminal", "TEL-009": "Cabinet missing route", "TEL-010": "Underground cable missing conduit", "TEL-011": "Aerial cable missing support", "TEL-012": "Proposed route gap",
    "TEL-013": "Retired cable linked to active terminal", "TEL-014": "Provisional splice relationship", "TEL-015": "Splitter capacity inconsistency", "TEL-016": "Telecom placement contradiction",
    "WATER-001": "Blank asset identifier", "WATER-002": "Duplicate asset identifier", "WATER-003": "Invalid or unsupported geometry", "WATER-004": "Unknown spatial reference", "WATER-005": "Suspicious extent", "WATER-006": "Invalid diameter",
    "WATER-007": "Invalid material", "WATER-008": "Invalid lifecycle status", "WATER-009": "Disconnected main endpoint", "WATER-010": "Isolated service line", "WATER-011": "Hydrant lacks plausible main relationship", "WATER-012": "Valve lacks main relationship",
    "WATER-013": "Invalid pressure-zone reference", "WATER-014": "Missing owner or jurisdiction", "WATER-015": "Invalid facility reference", "WATER-016": "Active asset connected only to retired assets", "WATER-017": "Service line lacks endpoint", "WATER-018": "Conflicting water-system identity",
    "WW-001": "Blank asset identifier", "WW-002": "Duplicate asset identifier", "WW-003": "Invalid geometry", "WW-004": "Unknown spatial reference", "WW-005": "Suspicious extent", "WW-006": "Gravity main lacks structures", "WW-007": "Gravity segment has identical endpoints",
    "WW-008": "Invalid or zero diameter", "WW-009": "Invalid material", "WW-010": "Suspicious slope", "WW-011": "Missing expected invert elevation", "WW-012": "Upstream/downstream invert contradiction", "WW-013": "Force main carries gravity-only attributes",
    "WW-014": "Gravity main attached to pressure equipment", "WW-015": "Lateral lacks receiving main", "WW-016": "Disconnected manhole", "WW-017": "Lift station lacks downstream force main", "WW-018": "Active asset connected only to retired assets",
    "WW-019": "Invalid basin or system reference", "WW-020": "Missing owner or jurisdiction",
}
EFFECTS = {
    "stops_trace": "The condition prevents a defensible future path through the affected evidence.", "limits_trace": "A future trace can only proceed to the confirmed evidence boundary.",
    "introduces_ambiguity": "A future trace may continue provisionally but must report ambiguous membership or relationships.", "advisory": "The condition remains visible for review but does not independently block continuity.",
    "no_trace_effect": "The condition is operational context that a future trace should honor without treating it as a defect.", "not_evaluated": "Trace impact has not been evaluated for this condition.",
}
ACTIONS = {
    "repair_connectivity": ["SHARED-001", "ELEC-001", "ELEC-002", "TEL-001", "TEL-002", "TEL-007", "TEL-008", "WATER-009", "WATER-010", "WATER-011", "WATER-012", "WATER-017", "WW-006", "WW-014", "WW-015", "WW-016", "WW-017"],
    "correct_relationship": ["SHARED-002"], "deduplicate_relationship": ["SHARED-003"], "confirm_relationship": ["SHARED-004", "TEL-014"], "confirm_lifecycle": ["SHARED-005", "SHARED-008", "ELEC-014", "TEL-013", "WATER-016", "WW-018"],
    "correct_taxonomy": ["SHARED-006"], "assign_identifier": ["SHARED-007"], "confirm_feeder": ["ELEC-003"], "repair_primary_connection": ["ELEC-004"], "confirm_phase": ["ELEC-005"], "confirm_voltage": ["ELEC-006"],
    "confirm_conduit": ["ELEC-007", "TEL-010"], "confirm_structure": ["ELEC-008"], "review_feeder_boundary": ["ELEC-009", "ELEC-010"], "confirm_direction": ["ELEC-011"], "retain_operational_context": ["ELEC-012"], "confirm_device_type": ["ELEC-013"],
    "confirm_placement": ["ELEC-015", "TEL-016"], "review_strand_allocation": ["TEL-003", "TEL-006"], "reconcile_capacity": ["TEL-004", "TEL-005", "TEL-015"], "confirm_route": ["TEL-009"], "confirm_support": ["TEL-011"], "complete_design": ["TEL-012"],
}


def _quoted(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def rank_sql(code: str) -> str:
    by = {}
    for rule, (_, p, _) in RULES.items():
        by.setdefault(p, []).append(rule)
    return "CASE " + " ".join(f"WHEN {code} IN {_quoted(r)} THEN {p}" for p, r in sorted(by.items())) + " ELSE 10 END"


def severity_sql(code: str) -> str:
    return f"CASE WHEN {code} IN {_quoted(CRITICAL)} THEN 3 WHEN {code} IN {_quoted(ERRORS)} THEN 2 WHEN {code} IN {_quoted(INFO)} THEN 0 ELSE 1 END"


def blocking_sql(code: str) -> str:
    return f"{code} IN {_quoted([*CRITICAL, *ERRORS, *BLOCKING_WARNINGS])}"


def trace_sql(code: str) -> str:
    by = {}
    for rule, (_, _, t) in RULES.items():
        by.setdefault(TRACE.index(t), []).append(rule)
    return "CASE " + " ".join(f"WHEN {code} IN {_quoted(r)} THEN {t}" for t, r in sorted(by.items())) + " ELSE 0 END"


def root_sql(t: str, own_class: str, other_class: str) -> str:
    """SQL of the root-cause key of a finding in table ``t``."""
    asset, edge = f"nullif(coalesce({t}.asset_id, ''), '')", f"nullif(coalesce({t}.relationship_id, ''), '')"
    out = ""
    for name, codes, by_edge in SHARED_KEYS:
        entity = f"coalesce({edge}, {asset}, '')" if by_edge else f"coalesce({asset}, '')"
        out += f" WHEN {t}.rule_code IN {_quoted(codes)} THEN concat('{name}:', {entity})"
    cable = f"CASE WHEN {own_class} = 'fiber_cable' THEN {t}.asset_id WHEN {other_class} = 'fiber_cable' THEN {t}.related_asset_id ELSE coalesce({asset}, {edge}, '') END"
    out += f" WHEN {t}.rule_code IN ('TEL-001', 'TEL-002') THEN concat('cable_endpoint:', {cable})"
    by: dict[str, list[str]] = {}
    for rule, (family, _, _) in RULES.items():
        by.setdefault(family, []).append(rule)
    family = "CASE " + " ".join(f"WHEN {t}.rule_code IN {_quoted(r)} THEN '{f}'" for f, r in sorted(by.items())) + " ELSE 'unsupported_condition' END"
    return f"CASE{out} ELSE concat({family}, ':', {t}.rule_code, ':', coalesce({asset}, {edge}, {t}.finding_id)) END"


ROOT_SQL = root_sql("f", "own_class", "other_class")


#: Rules whose key depends on the class of the assets.
CLASSED = ["TEL-001", "TEL-002"]


def with_root_keys(findings: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Findings with ``finding_id, root_key, precedence, severity, blocking, trace`` (ranks as numbers). Only those
    of ``CLASSED`` rules are joined with the assets; without ``assets`` there are none of these."""
    f = findings if "finding_id" in findings.columns else findings.withColumn("finding_id", F.col("finding_fingerprint"))
    none = F.lit(None).cast("string")
    parts = [f.withColumns({"own_class": none, "other_class": none})]
    if assets is not None:
        own = assets.where("asset_class = 'fiber_cable'").select("asset_id", F.col("asset_class").alias("own_class"))
        other = own.select(F.col("asset_id").alias("related_asset_id"), F.col("own_class").alias("other_class"))
        classed = F.coalesce(F.col("rule_code").isin(CLASSED), F.lit(False))
        parts = [parts[0].where(~classed), f.where(classed).join(own, "asset_id", "left").join(other, "related_asset_id", "left")]
    d = reduce(DataFrame.unionByName, parts).alias("f")
    return d.withColumns({"root_key": F.expr(ROOT_SQL), "precedence": F.expr(rank_sql("rule_code")), "severity": F.expr(severity_sql("rule_code")), "blocking": F.expr(blocking_sql("rule_code")), "trace": F.expr(trace_sql("rule_code"))}).drop("own_class", "other_class")


def pair_tallies(pairs: DataFrame, ids: bool = False) -> DataFrame:
    """Findings of ``connectivity.strand_findings`` by their first cable, as one row with their number ``n`` and,
    with ``ids``, the smallest ``finding_id``. All of a cable meet in one group and are of one rule."""
    mine = ["vertical", "rule_code", "asset_id"]
    least = F.min("finding_fingerprint") if ids else F.lit("")
    d = (with_identity(pairs) if ids else pairs).groupBy(*mine).agg(F.count("*").alias("n"), least.alias("finding_id"))
    return with_root_keys(d.withColumns({"related_asset_id": F.lit(None).cast("string"), "relationship_id": F.lit(None).cast("string")}))


def _order():
    return F.struct("precedence", F.col("rule_code").isin(sorted(DEPENDENCIES)).cast("int").alias("child"), (-F.col("severity")).alias("weight"), "rule_code", "finding_id")


def issue_groups(keyed: DataFrame) -> DataFrame:
    """One row per vertical and root key: first member, worst severity and trace effect, and the ids of
    all assets (related ones too) and relationships."""
    return keyed.groupBy("vertical", "root_key").agg(
        F.count("*").alias("members"),
        F.min(_order())["rule_code"].alias("primary_rule"),
        F.min(_order())["finding_id"].alias("primary_finding"),
        F.max("severity").alias("severity"),
        F.max("trace").alias("trace"),
        F.bool_or("blocking").alias("blocking"),
        F.array_sort(F.array_union(F.collect_set("asset_id"), F.collect_set("related_asset_id"))).alias("asset_ids"),
        F.array_sort(F.collect_set("relationship_id")).alias("relationship_ids"),
    )


def _members(d: DataFrame) -> Column:
    """How many findings the rows of a group are: a row is one, or ``n`` of them."""
    return F.sum("n") if "n" in d.columns else F.count("*")


def group_sizes(keyed: DataFrame, tallies: DataFrame) -> DataFrame:
    """``vertical, root_key, members, severity, trace, primary_rule, assets, edges`` (numbers of ids) of the groups
    of ``issue_groups``, of which those of ``tallies`` (``pair_tallies``) are never listed.

    What else is in a group of tallies is about its cable alone, so a group's assets are the larger number.
    """
    order = F.struct("precedence", "child", "weight", "rule_code")
    firsts = {"child": F.col("rule_code").isin(sorted(DEPENDENCIES)).cast("int"), "weight": -F.col("severity")}
    plain = issue_groups(keyed.withColumn("finding_id", F.lit("")))  # the first rule does not hang on ids
    rank = F.expr(rank_sql("primary_rule")), F.expr(severity_sql("primary_rule"))
    plain = plain.select("vertical", "root_key", "members", "severity", "trace", F.col("primary_rule").alias("rule_code"), F.size("asset_ids").cast("long").alias("assets"), F.size("relationship_ids").cast("long").alias("edges"), rank[0].alias("precedence"), (-rank[1]).alias("weight"))
    many = tallies.select("vertical", "root_key", F.col("n").alias("members"), "severity", "trace", "rule_code", (F.col("n") + 1).alias("assets"), F.lit(0).cast("long").alias("edges"), "precedence", firsts["weight"].alias("weight"))
    d = plain.unionByName(many).withColumn("child", firsts["child"])
    return d.groupBy("vertical", "root_key").agg(F.sum("members").alias("members"), F.max("severity").alias("severity"), F.max("trace").alias("trace"), F.min(order)["rule_code"].alias("primary_rule"), F.max("assets").alias("assets"), F.max("edges").alias("edges"))


def _firsts(keyed: DataFrame, tallies: DataFrame | None) -> DataFrame:
    """``vertical, root_key, members, primary_rule, primary_finding`` of each group."""
    names = ["vertical", "root_key", "rule_code", "finding_id", "precedence", "severity"]
    d = keyed.select(*names, F.lit(1).cast("long").alias("n"))
    d = d if tallies is None else d.unionByName(tallies.select(*names, "n"))
    return d.groupBy("vertical", "root_key").agg(F.sum("n").alias("members"), F.min(_order())["rule_code"].alias("primary_rule"), F.min(_order())["finding_id"].alias("primary_finding"))


def _role() -> Column:
    """What a finding is to the first member of its group."""
    pairs = [f"{k}<{v}" for k, vs in DEPENDENCIES.items() for v in vs]
    return (
        F.when(F.col("members") == 1, F.when(F.col("severity") == 0, "informational").otherwise("independent"))
        .when(F.col("finding_id") == F.col("primary_finding"), "primary")
        .when(F.concat_ws("<", "rule_code", "primary_rule").isin(pairs), "consequence")
        .when(F.col("rule_code") == F.col("primary_rule"), "corroborating")
        .otherwise("contributing")
    )


def member_roles(keyed: DataFrame, tallies: DataFrame | None = None) -> DataFrame:
    """Findings with ``finding_role``: what each is to the first member of its group, to which ``tallies``
    (``pair_tallies``, of findings that are not rows of ``keyed``) belong too."""
    return keyed.join(_firsts(keyed, tallies), ["vertical", "root_key"]).withColumn("finding_role", _role())


def pair_roles(keyed: DataFrame, tallies: DataFrame, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``finding_id, finding_role`` of the findings that ``tallies`` (with ids) count. ``pairs`` makes them with facts
    of their first cable: what a role follows from is put beside the cables, so no pair is joined."""
    group = _firsts(keyed.join(tallies.select("vertical", "root_key"), ["vertical", "root_key"], "left_semi"), tallies)
    facts = tallies.select("asset_id", "vertical", "root_key").join(group, ["vertical", "root_key"]).select("asset_id", "members", "primary_rule", "primary_finding")
    d = with_identity(pairs(facts)).withColumnRenamed("finding_fingerprint", "finding_id").withColumn("severity", F.expr(severity_sql("rule_code")))
    d = d.withColumn("finding_id", F.unhex("finding_id")) if tallies.schema["finding_id"].dataType.typeName() == "binary" else d
    return d.select("finding_id", _role().alias("finding_role"))


def rule_tallies(keyed: DataFrame, tallies: DataFrame | None = None) -> DataFrame:
    """Findings as one row a group and rule, with their number ``n``: no ids go through an exchange."""
    names = ["vertical", "root_key", "rule_code"]
    counts = keyed.groupBy(*names).agg(F.count("*").alias("n"))
    d = counts if tallies is None else counts.unionByName(tallies.select(*names, "n"))
    return d.withColumns({"finding_id": F.lit(""), "precedence": F.expr(rank_sql("rule_code")), "severity": F.expr(severity_sql("rule_code")), "blocking": F.expr(blocking_sql("rule_code")), "trace": F.expr(trace_sql("rule_code"))})


def role_tallies(counts: DataFrame) -> DataFrame:
    """``member_roles`` of ``rule_tallies``, as rows with ``n``, for all that only counts: of the rule that comes
    first in a group one is the first. A group has no more rows than there are rules."""
    w = Window.partitionBy("vertical", "root_key")
    d = counts.withColumns({"members": F.sum("n").over(w), "primary_rule": F.min(_order()).over(w)["rule_code"]})
    lead = (F.col("rule_code") == F.col("primary_rule")).cast("long")
    part = lambda first, k: F.struct(first.alias("finding_id"), k.alias("n"))
    d = d.withColumns({"part": F.explode(F.array(part(F.lit("first"), lead), part(F.lit("other"), F.col("n") - lead)))}).where("part.n > 0")
    return d.withColumns({"n": F.col("part.n"), "finding_id": F.col("part.finding_id"), "primary_finding": F.lit("first")}).withColumn("finding_role", _role()).drop("part", "members", "primary_rule", "primary_finding")


def _by(code: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code), otherwise)


def describe_groups(members: DataFrame) -> DataFrame:
    """One row per group of ``member_roles`` without its ids: ``vertical, root_key, family, title, action,
    confidence, trace_effect, trace_reason, related_rules, members, priority``.

    Ids of members are rows of ``members``; a group is never gathered in one row, and its other rules are
    at most as many as there are rules.
    """
    g = members.groupBy("vertical", "root_key").agg(
        _members(members).alias("members"), F.min(_order())["rule_code"].alias("primary_rule"), F.bool_or(F.col("finding_role") == "consequence").alias("c"), F.max("trace").alias("t"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("finding_role").isin("primary", "independent", "informational"), F.col("rule_code")))), ";").alias("related_rules"),
    )
    rule = F.col("primary_rule")
    family = _by(rule, {code: f for code, (f, _, _) in RULES.items()}, F.lit("unsupported_condition"))
    name = _by(rule, NAMES, rule)
    effect = F.element_at(F.array(*[F.lit(t) for t in TRACE]), F.col("t") + 1)
    action = _by(rule, {code: a for a, codes in ACTIONS.items() for code in codes}, F.lit("manual_review"))
    d = g.join(group_priorities(members), ["vertical", "root_key"])
    return d.select(
        "vertical", "root_key", family.alias("family"), _by(family, TITLES, name).alias("title"), action.alias("action"), F.when((F.col("members") == 1) | F.col("c"), "high").otherwise("medium").alias("confidence"),
        effect.alias("trace_effect"), F.concat(name, F.lit(": "), _by(effect, EFFECTS, F.lit(""))).alias("trace_reason"), "primary_rule", "related_rules", "members", "priority",
    )


def group_priorities(members: DataFrame) -> DataFrame:
    g = members.groupBy("vertical", "root_key").agg(F.max("severity").alias("s"), F.max("trace").alias("t"), F.bool_or("blocking").alias("b"), F.bool_and(F.col("finding_role") == "informational").alias("i"))
    s, t, b = F.col("s"), F.col("t"), F.col("b")
    priority = (
        F.when((t == 5) & b, F.when(s == 3, "immediate").otherwise("high"))
        .when(b | (t == 4), "high")
        .when(F.col("i"), "informational")
        .when(t.isin(1, 2), F.when(s < 2, "low").otherwise("normal"))
        .otherwise("normal")
    )
    return g.select("vertical", "root_key", priority.alias("priority"))


def calibrated_summary(members: DataFrame) -> DataFrame:
    """Findings and groups by vertical, by role and by severity in one pass."""
    v = F.col("vertical")
    if "n" in members.columns:  # a group's rows are few and stand together, so groups are counted without their keys
        once = lambda *more: (F.row_number().over(Window.partitionBy("vertical", "root_key", *more).orderBy("rule_code", "finding_id")) == 1).cast("int")
        d = members.withColumns({"g": once(), "by_role": once("finding_role"), "by_severity": once("severity")})
        one = F.when(F.grouping("finding_role") == 0, F.sum("by_role")).when(F.grouping("severity") == 0, F.sum("by_severity")).otherwise(F.sum("g"))
        return d.groupingSets([[v], [v, F.col("finding_role")], [v, F.col("severity")]], v, F.col("finding_role"), F.col("severity")).agg(_members(d).alias("findings"), one.alias("groups"))
    return members.groupingSets([[v], [v, F.col("finding_role")], [v, F.col("severity")]], v, F.col("finding_role"), F.col("severity")).agg(_members(members).alias("findings"), F.countDistinct("root_key").alias("groups"))


def review_rollup(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The one status of a group, or ``mixed``; minimum and maximum say it without distinct sets."""
    d = rows.groupBy(*keys).agg(F.min(status).alias("lo"), F.max(status).alias("hi"))
    return d.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("review_status"))


def prior_reviews(reviews: DataFrame, unreviewed: str = "unreviewed") -> DataFrame:
    """The newest human decision of each group, by run and then by event."""
    d = reviews.where(F.col("review_status") != unreviewed)
    return d.groupBy("issue_group_id").agg(F.max_by("review_status", F.struct("run_id", "event_id")).alias("review_status"))


def supersession(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier groups: ``superseded`` if they are gone, else ``recalibrated``."""
    now = current.select("issue_group_id").distinct().withColumn("_now", F.lit(True))
    d = previous.select("issue_group_id").distinct().join(now, "issue_group_id", "left")
    return d.select("issue_group_id", F.when(F.col("_now"), "recalibrated").otherwise("superseded").alias("label"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
