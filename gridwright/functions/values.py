"""Column functions for values of asset tables: blanks, numbers, units, names, ids, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped, and texts that mean "no value".
WHITE = " \t\n\r\x0b\x0c"
BLANKS = ["", "<null>", "null", "none", "-9999-"]
NUMBER = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Material aliases, statuses, units (metres each).
MATERIALS = {
    "cast iron": "cast_iron", "ci": "cast_iron", "ductile iron": "ductile_iron", "di": "ductile_iron",
    "pvc": "pvc", "polyvinyl chloride": "pvc", "hdpe": "hdpe", "high density polyethylene": "hdpe",
    "concrete": "concrete", "rcp": "reinforced_concrete", "reinforced concrete": "reinforced_concrete",
    "clay": "clay", "vcp": "clay", "steel": "steel", "copper": "copper",
    "ac": "asbestos_cement", "asbestos cement": "asbestos_cement", "unknown": "unknown",
}
LIFECYCLE = ["proposed", "planned", "approved", "under_construction", "installed", "active", "inactive", "abandoned", "retired", "removed", "unknown"]
OPERATIONAL = {
    "water": ["open", "closed", "active", "inactive", "in_service", "out_of_service", "available", "unavailable", "unknown"],
    "wastewater": ["active", "inactive", "in_service", "out_of_service", "gravity", "pressurized", "operating", "not_operating", "available", "unavailable", "unknown"],
}
STATUS_ALIASES = {"inservice": "in_service", "outofservice": "out_of_service", "construction": "under_construction", "abandon": "abandoned", "decommissioned": "retired"}
UNITS = {
    "inch": (0.0254, ["\"", "in", "inch", "inches"]),
    "millimeter": (0.001, ["mm", "millimeter", "millimeters"]),
    "foot": (0.3048, ["'", "ft", "foot", "feet"]),
    "meter": (1.0, ["m", "meter", "meters"]),
}
MISSING_LAYER = {
    "WW_NET_001": "unknown", "WW_NET_002": "service_lateral", "WW_NET_003": "external_jurisdiction_network", "WW_NET_004": "unknown",
    "WW_NET_005": "force_main", "WW_NET_006": "force_main", "WW_NET_007": "service_lateral", "WW_NET_008": "unknown",
}
GAP_RULES = ["WW_ATTR_002", "WW_ATTR_006", "WW_FLOW_002", "WW_FLOW_003"]


def choose(key: Column, table: dict[str, object], otherwise: Column | None = None) -> Column:
    """The value that a short fixed table gives for ``key``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def rounded(c: Column, digits: int) -> Column:
    """``c`` to ``digits`` decimals, decided by the exact binary value; true ties go to the even digit.

    ``F.round`` decides by the shortest decimal text of a number, which may look like a tie where the
    number itself is not one (320.775 is a little below it).
    """
    c, s = c.cast("double"), float(10**digits)
    p = c * s
    high = c * 134217729.0 - (c * 134217729.0 - c)  # the upper half of the digits of c
    lacks = (high * s - p) + (c - high) * s  # exactly what the product p has lost
    low = F.floor(p).cast("double")
    over = p - low
    odd = low - 2 * F.floor(low / 2) == 1
    up = (over > 0.5) | ((over == 0.5) & ((lacks > 0) | ((lacks == 0) & odd)))
    return F.when(F.abs(p) < 2.0**51, (low + up.cast("int")) / s).otherwise(c)


def rounded_sql(c: str, digits: int) -> str:
    """``rounded`` in DuckDB's SQL."""
    s = f"{10**digits}::DOUBLE"
    high = "(c * 134217729 - (c * 134217729 - c))"
    lacks = f"(({high} * {s} - c * {s}) + (c - {high}) * {s})"
    low = f"floor(c * {s})"
    up = f"(c * {s} - {low} > 0.5 OR (c * {s} - {low} = 0.5 AND ({lacks} > 0 OR ({lacks} = 0 AND {low} - 2 * floor({low} / 2) = 1))))"
    return f"list_transform([CAST({c} AS DOUBLE)], lambda c: CASE WHEN abs(c * {s}) < {2**51} THEN ({low} + {up}::INT) / {s} ELSE c END)[1]"


def fixed_sum(c: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows: of their nine-digit decimals."""
    return F.sum(c.cast("decimal(38,9)")).cast("double")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Null, or one of the texts that stand for no value, in any case and spacing."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(BLANKS), F.lit(True))


def number_or_null(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def material(c: Column) -> Column:
    """``(code, status)`` of a material text; unlisted texts are ``other`` and need review."""
    key = strip(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[_-]+", " "))
    code = choose(key, MATERIALS)
    blank = key == ""
    return F.struct(
        F.when(blank, "unknown").otherwise(F.coalesce(code, F.lit("other"))).alias("code"),
        F.when(code.isNotNull() & ~blank, "mapped").otherwise("needs_review").alias("status"),
    )


def unit_code(c: Column) -> Column:
    key = F.regexp_replace(F.lower(strip(c)), "[.]", "")
    return choose(key, {alias: unit for unit, (_, names) in UNITS.items() for alias in names})


def diameter(c: Column, target: str = "inch", source_unit: Column | None = None) -> Column:
    """``(value, unit, confidence)`` of a diameter text, converted to ``target`` when a unit is known."""
    pattern = "^[ \\t\\n\\r]*([-+]?[0-9]+(?:\\.[0-9]+)?)[ \\t\\n\\r]*([a-zA-Z\"']*)[ \\t\\n\\r]*$"
    text = F.coalesce(c.cast("string"), F.lit(""))
    size = F.regexp_extract(text, pattern, 1)
    value = F.when(size != "", size.try_cast("double"))
    unit = unit_code(F.regexp_extract(text, pattern, 2))
    if source_unit is not None:
        unit = F.when(F.coalesce(source_unit, F.lit("")) != "", unit_code(source_unit)).otherwise(unit)
    factor = choose(unit, {u: f for u, (f, _) in UNITS.items()})
    converted = F.when(unit == target, value).otherwise(rounded(value * factor / F.lit(UNITS[target][0]), 6))
    return F.struct(
        F.when(unit.isNull(), value).otherwise(converted).alias("value"),
        F.when(value.isNull() | unit.isNull(), F.coalesce(unit, F.lit("unknown"))).otherwise(F.lit(target)).alias("unit"),
        F.when(value.isNull(), "unavailable").when(unit.isNull(), "medium").otherwise("high").alias("confidence"),
    )


def status(c: Column, kind: str = "lifecycle", vertical: str = "wastewater") -> Column:
    """``(code, status)`` of a status text; spaces and signs are dropped before the aliases apply."""
    key = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", "")
    code = F.when(key == "", "unknown").otherwise(choose(key, STATUS_ALIASES, key))
    allowed = LIFECYCLE if kind == "lifecycle" else OPERATIONAL[vertical]
    known = code.isin(allowed)
    return F.struct(F.when(known, code).otherwise("unknown").alias("code"), F.when(known, "mapped").otherwise("needs_review").alias("status"))


def geometry_fits(asset_class: Column, geometry: Column, expected: dict[str, list[str]]) -> Column:
    """compatible, incompatible or requires_human_review, by the geometry words of each class."""
    words = F.lit(None).cast("array<string>")
    for name, kinds in expected.items():
        words = F.when(asset_class == name, F.array(*[F.lit(k) for k in kinds])).otherwise(words)
    have = F.regexp_replace(F.lower(F.coalesce(geometry, F.lit(""))), "multipoint", "point")
    return F.when(words.isNull(), "requires_human_review").when(F.exists(words, lambda w: have.contains(w)), "compatible").otherwise("incompatible")


def feet_to_units(feet: float, unit: str) -> float:
    """Feet in the linear unit of a layer; an unnamed unit counts as metres."""
    return feet if "foot" in unit.lower() or "feet" in unit.lower() else feet * 0.3048


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(strip(c), "(?i)[_-]?wgs84$", "")), "[^a-z0-9]+", "")


def value_pattern(c: Column) -> Column:
    """Letters as A, digits as 9."""
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "A"), "[0-9]", "9")


def lifecycle_signal(c: Column) -> Column:
    """What a layer name says about the state of its assets."""
    low = F.lower(c)
    return F.when(low.contains("proposed"), "proposed").when(low.contains("final"), "final_as_built").otherwise("existing")


def lifecycle_role(role: Column, signal: Column) -> Column:
    return F.when((signal == "proposed") & (role == "network_asset"), "proposed_design").otherwise(role)


def folded(value: Column) -> Column:
    """Lower-cased, without white space around and with single spaces inside; null is empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"\s+", " "))


def stable_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind + "_"), F.substring(F.sha2(F.concat_ws("|", *[folded(p) for p in parts]), 256), 1, 20))


def issue_uuid(*parts: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of the parts joined by ``|``."""
    # fixed value: ids of the same issue must be the same everywhere
    name = F.concat(F.lit("utilities-platform:wastewater:"), F.concat_ws("|", *[p.cast("string") for p in parts]))
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab" * 4]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def geometry_signature(geometry: Column) -> Column:
    """A point's place, or the ends and length of a line, to two digits."""
    text = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 2).cast("string")
    paths = geometry["paths"]
    first, last = F.element_at(F.element_at(paths, 1), 1), F.element_at(F.element_at(paths, -1), -1)
    empty = F.coalesce(F.size(paths) <= 0, F.lit(True)) | F.coalesce(F.size(F.get(paths, F.lit(0))) <= 0, F.lit(True))
    line = F.when(empty, "line:empty").otherwise(F.concat_ws(":", F.lit("line"), text(first["x"]), text(first["y"]), text(last["x"]), text(last["y"]), text(geometry["length"])))
    return F.when(geometry["type"] == "point", F.concat_ws(":", F.lit("pt"), text(geometry["x"]), text(geometry["y"]))).when(geometry["type"] == "polyline", line).otherwise("geom:none")


def issue_fingerprint(system: Column, layer: Column, asset: Column, rule: Column, related: Column, geometry: Column, threshold: Column) -> Column:
    """Hash of what an issue is about, without its run or id: folded texts and the signature of the
    geometry as JSON with sorted keys. ``asset`` and ``related`` are an asset's id or else its object id."""
    parts = {"asset_key": folded(asset), "geometry": geometry_signature(geometry), "related_key": folded(related), "rule_code": folded(rule), "source_layer": folded(layer), "threshold": folded(threshold), "utility_system": folded(system)}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), 256)


def finding_class(rule: Column, category: Column) -> Column:
    low = F.lower(category)
    return (
        F.when(rule.isin(GAP_RULES), "attribute_completeness_gap")
        .when(low == "geometry", "geometry_defect")
        .when(low == "connectivity", "network_defect")
        .when(low == "lineage", "lineage_gap")
        .otherwise("record_defect")
    )


def missing_layer(rule: Column) -> Column:
    """The layer whose absence could explain a finding, or an empty text."""
    return choose(rule, MISSING_LAYER, F.lit(""))


def review_priority(severity: Column, category: Column) -> Column:
    return F.when(severity == "high", "high").when(category.isin("Connectivity", "Geometry"), "medium").otherwise("normal")


def queue_rank(rule: Column, severity: Column, confidence: Column, category: Column) -> Column:
    """Place of a finding in the review queue, 0 first."""
    return (
        F.when((severity == "high") & (confidence == "high"), 0)
        .when(rule.isin("WW_NET_001", "WW_NET_003"), 1)
        .when(rule == "WW_NET_006", 2)
        .when(rule == "WW_NET_007", 3)
        .when(category == "Identity", 4)
        .when(category == "Geometry", 5)
        .when(finding_class(rule, category) == "attribute_completeness_gap", 6)
        .otherwise(7)
    )
