"""Attribute, identity, geometry and flow rules over pipe and manhole layers.

A layer is a table with ``objectid``, ``ordinal`` (input order), role columns (``asset_id``,
``diameter``, ...) and ``geometry``: ``struct<type, x, y, paths, length, is_empty, is_multipart>``.
Each rule returns findings: ``rule_code, source_layer, source_objectid, source_asset_id,
related_objectid, issue_key, description``. ``issues`` completes them to the issue table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.values import is_blank, issue_uuid, number_or_null, rounded

PIPE, MANHOLE = "wastewater_gravity_main", "wastewater_manhole"
GEOMETRY = "struct<type:string,x:double,y:double,paths:array<array<struct<x:double,y:double>>>,length:double,is_empty:boolean,is_multipart:boolean>"
#: Fixed values: (lifecycle, operational) pairs that contradict each other.
CONFLICTS = [("abandoned", "active"), ("retired", "active"), ("inactive", "active")]


def findings(rows: DataFrame, code: str, layer: str, key: Column | None = None, related: Column | None = None, what: Column | None = None) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    asset = F.when(is_blank(F.col("asset_id")), "").otherwise(F.col("asset_id")) if "asset_id" in rows.columns else F.lit("")
    what = F.lit("") if what is None else what
    return rows.select(
        F.lit(code).alias("rule_code"),
        F.lit(layer).alias("source_layer"),
        text(F.col("objectid")).alias("source_objectid"),
        asset.alias("source_asset_id"),
        text(F.lit("") if related is None else related).alias("related_objectid"),
        text(F.lit("") if key is None else key).alias("issue_key"),
        what.alias("description"),
    )


def missing_id(rows: DataFrame, code: str, layer: str) -> DataFrame:
    return findings(rows.where(is_blank(F.col("asset_id"))), code, layer)


def _others(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs more than once, with the other members' object ids in input order."""
    members = rows.groupBy(key).agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("ordinal", F.col("objectid").cast("string").alias("id")))).alias("_all"))
    several = members.where("members > 1")
    joined = rows.join(several, key)
    return joined.withColumn("related", F.array_join(F.transform(F.filter("_all", lambda m: m["id"] != F.col("objectid").cast("string")), lambda m: m["id"]), ",")).drop("_all")


def duplicate_id(rows: DataFrame, code: str, layer: str) -> DataFrame:
    """Every member of a group of equal, non-blank, stripped ids, with the other members."""
    named = rows.where(~is_blank(F.col("asset_id"))).withColumn("_id", F.btrim("asset_id", F.lit(" \t\n\r\x0b\x0c")))
    return findings(_others(named, "_id"), code, layer, F.col("_id"), F.col("related"))


def missing_field(rows: DataFrame, field: str, code: str, layer: str, zero_one_missing: bool = False) -> DataFrame:
    """Blank values; for a year field that uses them so, also ``0`` and ``1``."""
    missing = is_blank(F.col(field))
    if zero_one_missing:
        missing = missing | F.btrim(F.col(field).cast("string")).isin("0", "1")
    return findings(rows.where(missing), code, layer, F.lit(field))


def invalid_diameter(rows: DataFrame, low: float = 4, high: float = 240, code: str = "WW_ATTR_004") -> DataFrame:
    n = number_or_null(F.col("diameter"))
    return findings(rows.where(n.isNull() | (n < low) | (n > high)), code, PIPE, F.col("diameter"))


def invalid_domain(rows: DataFrame, domains: DataFrame, fields: list[str], layer: str, code: str = "WW_ATTR_007") -> DataFrame:
    """Non-blank values outside their field's code list; fields without a list are passed over."""
    cells = rows.select("objectid", "asset_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c"))
    cells = cells.select("objectid", "asset_id", "c.field", "c.value").where(~is_blank(F.col("value")))
    codes = domains.where(F.col("layer") == layer).select("field", F.col("code").alias("value")).distinct()
    bad = cells.join(codes.select("field").distinct(), "field", "left_semi").join(codes, ["field", "value"], "left_anti")
    return findings(bad, code, layer, F.concat_ws(":", "field", "value"))


def conflicting_status(rows: DataFrame, layer: str, code: str = "WW_ATTR_008") -> DataFrame:
    up = lambda c: F.lower(F.btrim(F.col(c)))
    clash = reduce(Column.__or__, [(up("lifecycle") == a) & (up("operational") == b) for a, b in CONFLICTS])
    return findings(rows.where(clash), code, layer, F.concat_ws(":", up("lifecycle"), up("operational")))


def null_geometry(rows: DataFrame, layer: str, code: str = "WW_GEOM_001") -> DataFrame:
    return findings(rows.where(F.col("geometry").isNull() | F.coalesce("geometry.is_empty", F.lit(False))), code, layer)


def first_path() -> Column:
    return F.coalesce(F.get("geometry.paths", F.lit(0)), F.array().cast("array<struct<x:double,y:double>>"))


def too_few_vertices(rows: DataFrame, layer: str, code: str = "WW_GEOM_002") -> DataFrame:
    return findings(rows.where((F.col("geometry.type") == "polyline") & (F.size(first_path()) < 2)), code, layer, F.lit("vertex_count"))


def short_pipe(rows: DataFrame, threshold: float, code: str = "WW_GEOM_003") -> DataFrame:
    return findings(rows.where(F.coalesce("geometry.length", F.lit(0.0)) < threshold), code, PIPE)


def _rounded(points: Column, digits: int) -> Column:
    return F.transform(points, lambda p: F.concat_ws(",", rounded(p["x"], digits).cast("string"), rounded(p["y"], digits).cast("string")))


def geometry_signature(digits: int = 3) -> Column:
    """Rounded vertices of the first path, or the rounded point; null without a geometry."""
    g = F.col("geometry")
    point = F.concat_ws(":", F.lit("point"), rounded(g["x"], digits).cast("string"), rounded(g["y"], digits).cast("string"))
    line = F.concat(F.lit("line:"), F.array_join(_rounded(first_path(), digits), ";"))
    return F.when(g["type"] == "point", point).when(F.size(first_path()) > 0, line)


def duplicate_geometry(rows: DataFrame, layer: str, code: str) -> DataFrame:
    signed = rows.withColumn("_signature", geometry_signature()).where(F.col("_signature").isNotNull())
    return findings(_others(signed, "_signature"), code, layer, F.col("_signature"), F.col("related"))


def multipart(rows: DataFrame, layer: str, code: str = "WW_GEOM_006") -> DataFrame:
    return findings(rows.where(F.coalesce("geometry.is_multipart", F.lit(False))), code, layer, F.lit("multipart"))


def line_anomaly(rows: DataFrame, code: str = "WW_GEOM_007") -> DataFrame:
    """Repeated vertices (to 4 digits) or a line that ends where it begins."""
    marks = _rounded(first_path(), 4)
    d = rows.where(F.size(first_path()) >= 2).withColumn("_m", marks)
    d = d.withColumn("_repeated", F.size("_m") != F.size(F.array_distinct("_m"))).withColumn("_closed", F.get("_m", F.lit(0)) == F.element_at("_m", -1))
    return findings(d.where("_repeated OR _closed"), code, PIPE, F.concat_ws(":", F.col("_repeated").cast("string"), F.col("_closed").cast("string")))


def _flow(rows: DataFrame) -> DataFrame:
    used = lambda c: F.when(number_or_null(F.col(c)) != 0, number_or_null(F.col(c)))
    d = rows.withColumn("_up", used("up")).withColumn("_down", used("down"))
    length = F.coalesce(F.when(F.col("length") != 0, F.col("length")), F.col("geometry.length")) if "length" in rows.columns else F.col("geometry.length")
    d = d.withColumn("_length", F.when(length != 0, length))
    return d.withColumn("_slope", (F.col("_up") - F.col("_down")) / F.col("_length") * 100)


def uphill(rows: DataFrame, code: str = "WW_FLOW_001") -> DataFrame:
    return findings(_flow(rows).where("_up < _down"), code, PIPE, F.concat_ws(":", "_up", "_down"))


def missing_invert(rows: DataFrame, field: str, code: str) -> DataFrame:
    n = number_or_null(F.col(field))
    return findings(rows.where(n.isNull() | (n == 0)), code, PIPE, F.lit(field))


def slope_range(rows: DataFrame, most: float = 25, code: str = "WW_FLOW_004") -> DataFrame:
    return findings(_flow(rows).where((F.col("_slope") <= 0) | (F.col("_slope") > most)), code, PIPE, F.format_string("%.4f", "_slope"))


def slope_conflict(rows: DataFrame, tolerance: float = 0.5, code: str = "WW_FLOW_005") -> DataFrame:
    d = _flow(rows).where(F.abs(number_or_null(F.col("slope")) - F.col("_slope")) > tolerance)
    return findings(d, code, PIPE, F.format_string("%.4f", "_slope"))


def rule_status(rules: DataFrame, mapping: DataFrame, has_domains: bool = True) -> DataFrame:
    """``rule_code, state, reason``: a rule runs only if it is enabled and each layer it applies
    to has every role it needs.

    ``rules``: ``rule_code, enabled, layers ARRAY, roles ARRAY``; ``mapping``: ``layer, role, field,
    confidence`` where a confidence of ``unavailable`` means the role has no field. The layer
    ``network`` and the role ``geometry`` need nothing; the role ``domain_fields`` needs a field with
    a domain on any layer. WW_ATTR_008 does not run where both statuses are read from one field. The
    first lack in the order of layers and roles is the reason.
    """
    need = rules.select("rule_code", F.posexplode("layers").alias("at", "layer"), "roles").where("layer <> 'network'")
    asked = need.select("rule_code", "at", "layer", F.posexplode("roles").alias("pos", "role")).where("role <> 'geometry'")
    have = mapping.where("confidence <> 'unavailable'").groupBy("layer", "role").agg(F.min("field").alias("field"))
    known = asked.join(have.select("layer", "role", F.lit(True).alias("there")), ["layer", "role"], "left")
    lacking = known.select("rule_code", "at", "pos", F.when(F.col("role") == "domain_fields", F.when(F.lit(not has_domains), "No ArcGIS domains are present on staged wastewater fields."))
        .when(F.col("there").isNull(), F.format_string("Required semantic field %s is unavailable for %s.", "role", "layer")).alias("why"))
    status = lambda role: have.where(F.col("role") == role).select("layer", F.col("field").alias(role))
    pair = need.where("rule_code = 'WW_ATTR_008'").join(status("lifecycle_status"), "layer", "left").join(status("operational_status"), "layer", "left")
    same = pair.where(F.col("lifecycle_status").eqNullSafe(F.col("operational_status"))).select("rule_code", "at", F.lit(1_000_000).alias("pos"), F.format_string("Lifecycle and operational status map to the same source field for %s.", "layer").alias("why"))
    first = lacking.where("why IS NOT NULL").unionByName(same).groupBy("rule_code").agg(F.min_by("why", F.struct("at", "pos")).alias("why"))
    out = rules.join(first, "rule_code", "left").withColumn("reason", F.when(~F.col("enabled"), "Rule is disabled in configuration.").otherwise(F.col("why")))
    return out.select("rule_code", F.when(F.col("reason").isNull(), "run").otherwise("skipped").alias("state"), F.coalesce("reason", F.lit("")).alias("reason"))


def issues(found: DataFrame, rules: DataFrame, run_id: str, created_at: str) -> DataFrame:
    """The full issue table, one row per issue id (of equal ids the first by object and description).

    ``rules``: ``rule_code, name, category, severity, description, detection_method,
    recommended_action``.
    """
    rules = rules.withColumnRenamed("description", "why_it_matters").dropDuplicates(["rule_code"])
    key = F.when(F.col("issue_key") != "", F.col("issue_key")).otherwise(F.col("description"))
    named = found.withColumn("issue_id", issue_uuid(F.lit(run_id), F.col("rule_code"), F.col("source_layer"), F.col("source_objectid"), F.col("related_objectid"), key)).drop("issue_key")
    named = named.join(F.broadcast(rules.select("rule_code")), "rule_code", "left_semi")  # a row a rule
    first = Window.partitionBy("issue_id").orderBy("source_layer", "source_objectid", "related_objectid", "description")
    out = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(F.broadcast(rules), "rule_code")
    kind = {PIPE: ("gravity_network", "pipe", "gravity_main"), MANHOLE: ("structures", "access_structure", "manhole")}
    part = lambda k, other: F.when(F.col("source_layer") == PIPE, kind[PIPE][k]).when(F.col("source_layer") == MANHOLE, kind[MANHOLE][k]).otherwise(other)
    return out.select(
        "issue_id", "rule_code", F.col("name").alias("rule_name"), "category", "severity", F.lit("wastewater").alias("utility_system"),
        part(0, "gravity_network").alias("network_group"), part(1, "network").alias("asset_category"), part(2, "proximity_component").alias("asset_subcategory"),
        "source_layer", "source_asset_id", "source_objectid", F.lit("").alias("related_asset_id"), "related_objectid", "description", "why_it_matters",
        "recommended_action", "detection_method", F.lit("open").alias("review_status"), F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"),
    )


def later_duplicates(rows: DataFrame, field: str) -> DataFrame:
    """Second and later rows of each non-blank value, in input order."""
    w = Window.partitionBy(field).orderBy("ordinal")
    return rows.where(~is_blank(F.col(field))).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def missing_required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``ordinal, missing``: rows in which any of the fields is null or empty (0 is a value)."""
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]))
    return rows.select("ordinal", lacking.alias("missing")).where(F.size("missing") > 0)


def run_rules(pipes: DataFrame, manholes: DataFrame) -> DataFrame:
    """All rules of both layers in one union; network rules are in ``operators.network``."""
    parts = [
        missing_id(manholes, "WW_ID_001", MANHOLE),
        duplicate_id(manholes, "WW_ID_002", MANHOLE),
        missing_id(pipes, "WW_ID_003", PIPE),
        duplicate_id(pipes, "WW_ID_004", PIPE),
        missing_field(pipes, "diameter", "WW_ATTR_001", PIPE),
        missing_field(pipes, "material", "WW_ATTR_002", PIPE),
        missing_field(pipes, "yr", "WW_ATTR_003", PIPE, True),
        invalid_diameter(pipes),
        missing_field(pipes, "lifecycle", "WW_ATTR_005", PIPE),
        missing_field(manholes, "project_id", "WW_ATTR_006", MANHOLE),
        conflicting_status(pipes, PIPE),
        null_geometry(pipes, PIPE),
        null_geometry(manholes, MANHOLE),
        too_few_vertices(pipes, PIPE),
        short_pipe(pipes, 5.0),
        duplicate_geometry(pipes, PIPE, "WW_GEOM_004"),
        duplicate_geometry(manholes, MANHOLE, "WW_GEOM_005"),
        multipart(pipes, PIPE),
        line_anomaly(pipes),
        uphill(pipes),
        missing_invert(pipes, "up", "WW_FLOW_002"),
        missing_invert(pipes, "down", "WW_FLOW_003"),
        slope_range(pipes),
        slope_conflict(pipes),
    ]
    return reduce(DataFrame.unionByName, parts)
