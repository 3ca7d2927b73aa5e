"""Rules over assets and their relationships, for all network kinds in one pass per rule family.

``assets``: ``asset_id, vertical, asset_class, lifecycle_status, ...`` with one column per known
attribute (null where the attribute is absent). ``edges``: ``relationship_id, from_asset_id,
to_asset_id, relationship_type, direction, provisional``. Findings are ``vertical, rule_code,
asset_id, related_asset_id, relationship_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.session import settle

#: States, classes and allow-lists of the rules.
RETIRED = ["retired", "removed", "abandoned"]
LIFECYCLE = ["proposed", "planned", "approved", "under_construction", "installed", "active", "inactive", "abandoned", "retired", "removed", "unknown"]
WATER_LINES = ["water_main", "transmission_main", "distribution_main", "service_line", "hydrant_lateral", "raw_water_main", "reclaimed_water_main", "abandoned_water_main", "unknown_water_line"]
SEWER_LINES = ["gravity_main", "force_main", "pressure_sewer", "service_lateral", "interceptor", "trunk_sewer", "outfall_pipe", "abandoned_sewer", "unknown_wastewater_line"]
AREAS = ["pressure_zone", "service_area", "treatment_area", "water_system_boundary", "sewer_basin", "collection_area", "treatment_service_area", "overflow_area", "wastewater_system_boundary", "easement", "facility_site"]
CONDUCTORS = ["overhead_conductor", "underground_conductor", "secondary_conductor"]
MEMBERS = ["substation", "feeder", "feeder_breaker", "switch", "fuse", "recloser", "transformer", *CONDUCTORS, "service_point", "junction"]
MEMBER_TYPES = ["connects_to", "upstream_of", "downstream_of", "protected_by", "feeds", "belongs_to_feeder", "belongs_to_circuit"]
CABLE_ENDS = ["network_hub", "fiber_cabinet", "pole", "handhole", "manhole", "splice_closure", "splitter", "terminal", "telecom_structure"]
STRUCTURES = ["manhole", "cleanout", "junction", "lift_station", "wet_well"]
ELECTRIC, FIBER, WATER, SEWER = "electric_distribution", "telecom_fiber", "water", "wastewater"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _number(c: str) -> str:
    return f"try_cast({c} AS DOUBLE)"


def _none(c: str) -> str:
    return f"coalesce({c}, '') = ''"


_bad_lifecycle = f"(lifecycle_status = 'unknown' OR coalesce(lifecycle_status NOT IN {listed(LIFECYCLE)}, true))"
_lines = lambda v: listed(WATER_LINES if v == WATER else SEWER_LINES)
_expected = lambda v: f"CASE WHEN asset_class IN {_lines(v)} THEN 'polyline' WHEN asset_class IN {listed(AREAS)} THEN 'polygon' ELSE 'point' END"

#: (rule, vertical or None for all, condition on the columns of one asset), in SQL.
ASSET_RULES: list[tuple[str, str | None, str]] = [
    ("SHARED-007", None, f"{_none('trim(canonical_name)')} AND {_none('trim(source_identifier)')}"),
    ("SHARED-008", None, _bad_lifecycle),
    ("ELEC-003", ELECTRIC, f"asset_class = 'transformer' AND {_none('feeder_id')}"),
    ("ELEC-005", ELECTRIC, "upper(coalesce(phase, '')) NOT IN ('A', 'B', 'C', 'AB', 'AC', 'BC', 'ABC', 'N', '')"),
    ("ELEC-006", ELECTRIC, f"abs({_number('nominal_voltage')} - {_number('operating_voltage')}) > 0.001"),
    ("ELEC-012", ELECTRIC, "operational_status = 'normally_open' OR coalesce(normally_open, false)"),
    ("ELEC-013", ELECTRIC, f"asset_class IN ('feeder_breaker', 'fuse', 'recloser') AND {_none('device_type')}"),
    ("ELEC-015", ELECTRIC, "(asset_class = 'overhead_conductor' AND placement = 'underground') OR (asset_class = 'underground_conductor' AND placement = 'overhead')"),
    ("TEL-001", FIBER, f"asset_class = 'fiber_cable' AND ({_none('from_structure')} OR {_none('to_structure')})"),
    ("TEL-004", FIBER, "asset_class IN ('fiber_cable', 'fiber_cabinet', 'splitter', 'terminal') AND used + reserved > total"),
    ("TEL-005", FIBER, "asset_class IN ('fiber_cable', 'fiber_cabinet', 'splitter', 'terminal') AND abs(available - (total - used - reserved)) > 0.001"),
    ("TEL-006", FIBER, "asset_class = 'fiber_cable' AND fiber_count IS NOT NULL AND strand_start IS NOT NULL AND strand_end IS NOT NULL AND (strand_start < 1 OR strand_end < strand_start OR strand_end > fiber_count)"),
    ("TEL-015", FIBER, "asset_class = 'splitter' AND used + reserved > total"),
    ("TEL-016", FIBER, "(asset_class = 'pole' AND placement = 'underground') OR (asset_class = 'conduit' AND placement = 'aerial')"),
    ("WATER-001", WATER, _none("trim(source_identifier)")),
    ("WW-001", SEWER, _none("trim(source_identifier)")),
    ("WATER-003", WATER, f"lower(coalesce(geometry_type, '')) <> {_expected(WATER)}"),
    ("WW-003", SEWER, f"lower(coalesce(geometry_type, '')) <> {_expected(SEWER)}"),
    *[(c, v, "lower(coalesce(spatial_reference, '')) IN ('', 'unknown')") for c, v in (("WATER-004", WATER), ("WW-004", SEWER))],
    *[(c, v, "suspicious_extent") for c, v in (("WATER-005", WATER), ("WW-005", SEWER))],
    *[(c, v, f"asset_class IN {_lines(v)} AND coalesce({_number('diameter')} <= 0, true)") for c, v in (("WATER-006", WATER), ("WW-008", SEWER))],
    *[(c, v, f"asset_class IN {_lines(v)} AND lower(trim(coalesce(material, ''))) IN ('', 'unknown', 'n/a', 'na', 'unsupported')") for c, v in (("WATER-007", WATER), ("WW-009", SEWER))],
    ("WATER-008", WATER, _bad_lifecycle),
    *[(c, v, f"{_none('trim(owner_candidate)')} AND {_none('trim(jurisdiction)')}") for c, v in (("WATER-014", WATER), ("WW-020", SEWER))],
    ("WW-007", SEWER, "asset_class = 'gravity_main' AND from_structure <> '' AND to_structure <> '' AND from_structure = to_structure"),
    ("WW-010", SEWER, "asset_class = 'gravity_main' AND (slope <= 0 OR abs(slope) > 1)"),
    ("WW-011", SEWER, "asset_class = 'gravity_main' AND (upstream_invert IS NULL OR downstream_invert IS NULL)"),
    ("WW-012", SEWER, "asset_class = 'gravity_main' AND upstream_invert <= downstream_invert"),
    ("WW-013", SEWER, "asset_class = 'force_main' AND (slope IS NOT NULL OR upstream_invert IS NOT NULL OR downstream_invert IS NOT NULL)"),
]

_both = "l_id IS NOT NULL AND r_id IS NOT NULL"
_state = lambda s, want: f"(coalesce({s}_state, '') {'' if want else 'NOT '}IN {listed(RETIRED)})"
_mixed = f"({_state('l', True)} <> {_state('r', True)})"
_pair = lambda a, b: f"((l_class = '{a}' AND r_class IN {listed(b)}) OR (r_class = '{a}' AND l_class IN {listed(b)}))"
_membership = lambda f: f"relationship_type IN {listed(MEMBER_TYPES)} AND l_class IN {listed(MEMBERS)} AND r_class IN {listed(MEMBERS)} AND {_state('l', False)} AND {_state('r', False)} AND l_{f} <> '' AND r_{f} <> '' AND l_{f} <> r_{f}"

#: (rule, vertical or None, condition on an edge joined to both of its assets), in SQL.
EDGE_RULES: list[tuple[str, str | None, str]] = [
    ("SHARED-002", None, "from_asset_id = to_asset_id"),
    ("SHARED-004", None, "provisional"),
    ("SHARED-005", None, f"{_both} AND {_mixed}"),
    ("SHARED-006", None, f"{_both} AND l_vertical <> r_vertical"),
    ("ELEC-009", ELECTRIC, f"{_both} AND {_membership('feeder')}"),
    ("ELEC-010", ELECTRIC, f"{_both} AND {_membership('circuit')}"),
    ("ELEC-011", ELECTRIC, "direction NOT IN ('forward', 'reverse', 'bidirectional', 'undirected')"),
    ("ELEC-014", ELECTRIC, f"{_both} AND {_mixed}"),
    ("TEL-002", FIBER, f"{_both} AND ((l_class = 'fiber_cable' AND r_class NOT IN {listed(CABLE_ENDS)}) OR (l_class <> 'fiber_cable' AND r_class = 'fiber_cable' AND l_class NOT IN {listed(CABLE_ENDS)}))"),
    ("TEL-013", FIBER, f"{_both} AND ((l_class = 'fiber_cable' AND r_class = 'terminal' AND {_state('l', True)} AND {_state('r', False)}) OR (r_class = 'fiber_cable' AND l_class = 'terminal' AND {_state('r', True)} AND {_state('l', False)}))"),
    ("TEL-014", FIBER, f"{_both} AND provisional AND (l_class = 'splice_closure' OR r_class = 'splice_closure')"),
    ("WATER-018", WATER, f"{_both} AND l_system <> '' AND r_system <> '' AND l_system <> r_system"),
    ("WW-014", SEWER, f"{_both} AND {_pair('gravity_main', ['lift_station', 'pump', 'air_release_valve'])}"),
]

_VALVES = ["valve", "isolation_valve", "control_valve", "pressure_reducing_valve", "air_release_valve"]
_mains = [c for c in WATER_LINES if c not in ("service_line", "hydrant_lateral")]
#: What the incident edges of an asset are counted for: name -> condition on other class and type.
AROUND = {
    "conductors": f"inside AND other_class IN {listed([*CONDUCTORS, 'feeder'])}",
    "conduits": "other_class = 'conduit' AND relationship_type = 'routed_through'",
    "mounts": "other_class IN ('pole', 'electric_structure') AND relationship_type = 'mounted_on'",
    "poles": "other_class = 'pole' AND relationship_type = 'mounted_on'",
    "routes": "other_class = 'fiber_route' AND relationship_type = 'belongs_to_route'",
    "water_lines": f"other_class IN {listed(WATER_LINES)}",
    "sewer_lines": f"other_class IN {listed(SEWER_LINES)}",
    "meters": "other_class IN ('meter', 'meter_vault', 'service_point')",
    "receiving": "other_class IN ('gravity_main', 'force_main', 'pressure_sewer', 'interceptor', 'trunk_sewer')",
    "pressure": "other_class IN ('force_main', 'pressure_sewer')",
}
#: (rule, vertical, condition on an asset with its counts), in SQL.
INCIDENT_RULES: list[tuple[str, str | None, str]] = [
    ("ELEC-001", ELECTRIC, f"asset_class IN {listed(CONDUCTORS)} AND edges = 0"),
    ("ELEC-002", ELECTRIC, f"asset_class IN {listed(CONDUCTORS)} AND degree < 2"),
    ("ELEC-004", ELECTRIC, "asset_class = 'transformer' AND conductors = 0"),
    ("ELEC-007", ELECTRIC, f"asset_class = 'underground_conductor' AND {_none('conduit_id')} AND conduits = 0"),
    ("ELEC-008", ELECTRIC, f"asset_class IN ('feeder_breaker', 'switch', 'fuse', 'recloser', 'transformer') AND {_none('structure_id')} AND mounts = 0"),
    ("TEL-007", FIBER, "asset_class = 'splice_closure' AND edges = 0"),
    ("TEL-008", FIBER, "asset_class = 'terminal' AND edges = 0"),
    ("TEL-009", FIBER, f"asset_class = 'fiber_cabinet' AND {_none('route_id')} AND routes = 0"),
    ("TEL-010", FIBER, f"asset_class = 'fiber_cable' AND placement = 'underground' AND {_none('conduit_id')} AND conduits = 0"),
    ("TEL-011", FIBER, "asset_class = 'fiber_cable' AND placement = 'aerial' AND poles = 0"),
    ("TEL-012", FIBER, f"asset_class = 'proposed_construction_segment' AND (degree < 2 OR {_none('from_structure')} OR {_none('to_structure')})"),
    ("WATER-009", WATER, f"asset_class IN {listed(_mains)} AND degree < 2"),
    ("WATER-010", WATER, "asset_class = 'service_line' AND edges = 0"),
    ("WATER-011", WATER, "asset_class = 'hydrant' AND water_lines = 0"),
    ("WATER-012", WATER, f"asset_class IN {listed(_VALVES)} AND water_lines = 0"),
    ("WATER-016", WATER, f"coalesce(lifecycle_status, '') NOT IN {listed(RETIRED)} AND degree > 0 AND live = 0"),
    ("WATER-017", WATER, "asset_class = 'service_line' AND meters = 0"),
    ("WW-006", SEWER, f"asset_class = 'gravity_main' AND structures < 2 AND NOT coalesce(from_structure <> '' AND to_structure <> '' AND from_structure <> to_structure, false)"),
    ("WW-015", SEWER, "asset_class = 'service_lateral' AND receiving = 0"),
    ("WW-016", SEWER, "asset_class = 'manhole' AND sewer_lines = 0"),
    ("WW-017", SEWER, "asset_class = 'lift_station' AND pressure = 0"),
    ("WW-018", SEWER, f"coalesce(lifecycle_status, '') NOT IN {listed(RETIRED)} AND degree > 0 AND live = 0"),
]


def _codes(rules: list[tuple[str, str | None, str]], vertical: str = "vertical") -> Column:
    """The codes of all rules that a row breaks, in one expression."""
    marks = [F.when(F.expr(f"({c})" + (f" AND {vertical} = '{v}'" if v else "")), F.lit(code)) for code, v, c in rules]
    return F.array_compact(F.array(*marks))


def asset_rules(assets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All rules that look at one asset: one scan, no shuffle. ``keys`` are carried along."""
    d = assets.select(*keys, "vertical", "asset_id", F.explode(_codes(ASSET_RULES)).alias("rule_code"))
    none = F.lit(None).cast("string")
    return d.select(*keys, "vertical", "rule_code", "asset_id", none.alias("related_asset_id"), none.alias("relationship_id"))


def graph_frame(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with what the rules need of both ends; an end that is not registered is null."""
    side = lambda p: assets.select(
        F.col("asset_id").alias(p + "_id"), F.col("vertical").alias(p + "_vertical"), F.col("asset_class").alias(p + "_class"),
        F.col("lifecycle_status").alias(p + "_state"), F.col("feeder_id").alias(p + "_feeder"), F.col("circuit_id").alias(p + "_circuit"), F.col("system_id").alias(p + "_system"),
    )
    left, right = side("l"), side("r")
    return edges.join(left, F.col("from_asset_id") == F.col("l_id"), "left").join(right, F.col("to_asset_id") == F.col("r_id"), "left")


#: Directions that an edge may have, and classes that the edge rules name.
DIRECTIONS = ["forward", "reverse", "bidirectional", "undirected"]
_NAMED = sorted({*MEMBERS, *CABLE_ENDS, "fiber_cable", "gravity_main", "lift_station", "pump", "air_release_valve"})


def edge_frame(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_frame`` with as much as ``edge_rules`` looks at, so that little goes through the two joins:
    values that no rule tells apart are one value, and an edge that lacks its first end goes on only
    where a rule speaks of the edge alone."""
    named, kind = F.col("asset_class"), F.col("relationship_type")
    member = named.isin(MEMBERS) & ~F.coalesce("lifecycle_status", F.lit("")).isin(RETIRED)
    text = lambda c, of=None: F.when((F.col(c) != "") & (F.lit(True) if of is None else of), F.col(c)).alias(c)
    small = assets.select(
        "asset_id", "vertical", F.when(named.isNull() | named.isin(_NAMED), named).otherwise("").alias("asset_class"), F.when(F.col("lifecycle_status").isin(RETIRED), RETIRED[0]).alias("lifecycle_status"),
        text("feeder_id", member), text("circuit_id", member), text("system_id"),
    )
    way = F.when(~F.col("direction").isin(DIRECTIONS), F.col("direction")).alias("direction")
    lean = edges.select("relationship_id", "from_asset_id", "to_asset_id", F.when(kind.isin(MEMBER_TYPES), MEMBER_TYPES[0]).alias("relationship_type"), way, "provisional")
    side = lambda p: small.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("asset_id", "id"), ("vertical", "vertical"), ("asset_class", "class"), ("lifecycle_status", "state"), ("feeder_id", "feeder"), ("circuit_id", "circuit"), ("system_id", "system"))])
    left = lean.join(side("l"), F.col("from_asset_id") == F.col("l_id"), "left")
    left = left.where("l_id IS NOT NULL OR from_asset_id = to_asset_id OR provisional OR direction IS NOT NULL")
    return left.join(side("r"), F.col("to_asset_id") == F.col("r_id"), "left")


def _per_vertical(frame: DataFrame) -> DataFrame:
    return frame.withColumn("vertical", F.explode(F.array_distinct(F.array_compact(F.array("l_vertical", "r_vertical")))))


def edge_rules(frame: DataFrame) -> DataFrame:
    """All rules that look at one edge and its ends; an edge counts for each vertical it touches."""
    d = _per_vertical(frame).withColumn("rule_code", F.explode(_codes(EDGE_RULES)))
    swap = (F.col("rule_code") == "TEL-013") & (F.col("r_class") == "fiber_cable") | (F.col("rule_code") == "WW-014") & (F.col("l_class") != "gravity_main")
    a, b = F.col("from_asset_id"), F.col("to_asset_id")
    return d.select("vertical", "rule_code", F.when(swap, b).otherwise(a).alias("asset_id"), F.when(swap, a).otherwise(b).alias("related_asset_id"), "relationship_id")


def missing_endpoints(frame: DataFrame) -> DataFrame:
    """One finding per end of an edge that is not in the registry."""
    lacking = F.array_compact(F.array(F.when(F.col("l_id").isNull(), F.col("from_asset_id")), F.when(F.col("r_id").isNull(), F.col("to_asset_id"))))
    d = _per_vertical(frame).withColumn("related_asset_id", F.explode(lacking))
    return d.select("vertical", F.lit("SHARED-001").alias("rule_code"), F.coalesce("l_id", "r_id").alias("asset_id"), "related_asset_id", "relationship_id")


def duplicate_edges(frame: DataFrame) -> DataFrame:
    """Second and later edges of the same ends and type, by relationship id."""
    w = Window.partitionBy("from_asset_id", "to_asset_id", "relationship_type").orderBy("relationship_id")
    d = _per_vertical(frame.withColumn("n", F.row_number().over(w)).where("n > 1"))
    return d.select("vertical", F.lit("SHARED-003").alias("rule_code"), F.col("from_asset_id").alias("asset_id"), F.col("to_asset_id").alias("related_asset_id"), "relationship_id")


def incident_counts(frame: DataFrame) -> DataFrame:
    """``asset_id`` with its edges, distinct neighbours inside its vertical, and class counts.

    Each edge is looked at from both ends (a self loop once); counts are pre-aggregated before
    the shuffle, and neighbours are made distinct per pair, so a hub does not gather its edges.
    """
    end = lambda a, b, p, o: [F.col(a).alias("asset_id"), F.col(b).alias("other_id"), F.col(p + "_vertical").alias("v"), F.col(o + "_vertical").alias("ov"), F.col(o + "_class").alias("other_class"), F.col(o + "_state").alias("other_state")]
    turned = frame.where(F.col("from_asset_id") != F.col("to_asset_id")).select("relationship_type", *end("to_asset_id", "from_asset_id", "r", "l"))
    both = frame.select("relationship_type", *end("from_asset_id", "to_asset_id", "l", "r")).unionByName(turned)
    both = both.where("v IS NOT NULL").withColumn("inside", F.coalesce(F.col("v") == F.col("ov"), F.lit(False)))
    typed = {k: c for k, c in AROUND.items() if "relationship_type" in c}
    # what the class and state of a neighbour count for, in one number: the rows of the aggregate stay small
    marks = {"inside": "inside", "live": f"inside AND coalesce(other_state, '') NOT IN {listed(RETIRED)}", "structures": f"inside AND other_class IN {listed(STRUCTURES)}", **{k: c for k, c in AROUND.items() if k not in typed}}
    bits = reduce(Column.__add__, [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(marks.values())])
    has = {m: F.col("bits").bitwiseAND(F.lit(1 << k)) != 0 for k, m in enumerate(marks)}
    pair = both.groupBy("asset_id", "other_id", bits.alias("bits")).agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in typed.items()])
    zero = F.lit(0).cast("long")
    return pair.groupBy("asset_id").agg(
        F.sum("n").alias("edges"), F.count_if(has["inside"]).alias("degree"), F.count_if(has["live"]).alias("live"), F.count_if(has["structures"]).alias("structures"),
        *[F.sum(k if k in typed else F.when(has[k], F.col("n")).otherwise(zero)).alias(k) for k in AROUND],
    )


def incident_rules(assets: DataFrame, frame: DataFrame) -> DataFrame:
    """All rules that look at an asset's surroundings: one aggregate by asset for all of them."""
    counts = incident_counts(frame)
    d = assets.join(counts, "asset_id", "left").fillna(0, ["edges", "degree", "live", "structures", *AROUND])
    d = d.select("vertical", "asset_id", F.explode(_codes(INCIDENT_RULES)).alias("rule_code"))
    none = F.lit(None).cast("string")
    return d.select("vertical", "rule_code", "asset_id", none.alias("related_asset_id"), none.alias("relationship_id"))


def duplicate_identifiers(assets: DataFrame) -> DataFrame:
    """Second and later assets with the same stripped, case-folded identifier, with the first."""
    d = assets.where(F.col("vertical").isin(WATER, SEWER)).withColumn("id", F.lower(F.trim("source_identifier"))).where("id <> ''")
    w = Window.partitionBy("vertical", "id").orderBy("asset_id")
    d = d.withColumn("first", F.first("asset_id").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
    code = F.when(F.col("vertical") == WATER, "WATER-002").otherwise("WW-002")
    return d.select("vertical", code.alias("rule_code"), "asset_id", F.col("first").alias("related_asset_id"), F.lit(None).cast("string").alias("relationship_id"))


#: Strands of a bin: ranges are compared where they share one.
STRAND_BIN = 12
#: Cables of a bin that are compared with the others of the bin in one task.
STRAND_BLOCK = 1000


def strand_overlaps(assets: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Pairs of cables of one route whose strand ranges meet, with ``facts`` (``asset_id`` and more columns, a
    row an asset) of the first one, which are put beside the cables before they are paired.

    Ranges are laid on bins of strands; a pair is counted in the bin of its later start only. The
    cables of a bin are dealt out in blocks of about ``STRAND_BLOCK``, each compared with all of the bin
    in a task of its own: there are as many pairs as the data has, however few the routes are.
    """
    c = assets.where((F.col("vertical") == FIBER) & (F.col("asset_class") == "fiber_cable") & (F.col("route_id") != "") & (F.col("strand_start") <= F.col("strand_end")))
    place = lambda x: F.floor(F.col(x) / STRAND_BIN)
    c = c.select("route_id", "asset_id", F.col("strand_start").alias("a"), F.col("strand_end").alias("b"), F.explode(F.sequence(place("strand_start"), place("strand_end"))).alias("bin"))
    blocks = c.groupBy("route_id", "bin").agg(F.ceil(F.count("*") / STRAND_BLOCK).alias("blocks"))
    c = c.join(blocks, ["route_id", "bin"])
    right = c.select("route_id", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("asset_id").alias("related_asset_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    later = F.greatest("a", "c")
    more = [] if facts is None else [x for x in facts.columns if x != "asset_id"]
    c = c if facts is None else c.join(facts, "asset_id", "left")
    d = c.withColumn("block", F.pmod(F.xxhash64("asset_id"), "blocks")).drop("blocks").join(right, ["route_id", "bin", "block"]).where((F.col("asset_id") < F.col("related_asset_id")) & (later <= F.least("b", "d")) & (F.floor(later / STRAND_BIN) == F.col("bin")))
    return d.select(F.lit(FIBER).alias("vertical"), F.lit("TEL-003").alias("rule_code"), "asset_id", "related_asset_id", F.lit(None).cast("string").alias("relationship_id"), *more)


#: Rules on references, with the column that refers and the classes that it may name.
REFERENCES = [
    ("WATER-013", WATER, "zone_id", ["pressure_zone"]),
    ("WATER-015", WATER, "facility_id", ["pump_station", "storage_tank", "elevated_tank", "reservoir", "treatment_facility", "well"]),
    ("WW-019", SEWER, "zone_id", ["sewer_basin", "collection_area", "wastewater_system_boundary"]),
]


def unresolved_references(assets: DataFrame, vertical: str, field: str, classes: list[str], code: str) -> DataFrame:
    """Assets whose reference is no id, identifier or own reference of the represented classes."""
    own = assets.where(F.col("vertical") == vertical)
    known = own.where(F.col("asset_class").isin(classes)).select(F.explode(F.array("asset_id", "source_identifier", field)).alias(field)).where(F.col(field) != "").distinct()
    d = own.where(F.col(field) != "").join(known, field, "left_anti")
    none = F.lit(None).cast("string")
    return d.select("vertical", F.lit(code).alias("rule_code"), "asset_id", none.alias("related_asset_id"), none.alias("relationship_id"))


def several_systems(assets: DataFrame) -> DataFrame:
    """WW-019 on the first wastewater asset where more than one wastewater system is named."""
    own = assets.where(F.col("vertical") == SEWER).agg(F.min("asset_id").alias("asset_id"), F.min(F.when(F.col("system_id") != "", F.col("system_id"))).alias("lo"), F.max("system_id").alias("hi"))
    none = F.lit(None).cast("string")
    return own.where("lo <> hi").select(F.lit(SEWER).alias("vertical"), F.lit("WW-019").alias("rule_code"), "asset_id", none.alias("related_asset_id"), none.alias("relationship_id"))


def strand_findings(assets: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``strand_overlaps``, each once. There are as many as the square of a route's cables: they go through no
    exchange but where a cable's id comes twice, so they are made anew where they are needed and never kept."""
    pairs = strand_overlaps(assets, facts)
    if assets.where((F.col("vertical") == FIBER) & (F.col("asset_class") == "fiber_cable")).groupBy("asset_id").count().where("count > 1").limit(1).count():
        pairs = pairs.distinct()
    return pairs


def other_findings(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """The findings of all rules but that of ``strand_findings``, without fingerprints, each once. They grow
    with the network.

    The frame is written once for all rules that read it. Findings are told apart by their ids, so only those
    of relationships whose id comes twice are compared as rows, or all where an asset's id does.
    """
    frame = settle(graph_frame(assets, edges), tight=True)
    basin, *_ = [r for r in REFERENCES if r[0] == "WW-019"]
    at_assets = [
        asset_rules(assets), incident_rules(assets, frame), duplicate_identifiers(assets), *[unresolved_references(assets, vertical, field, classes, code) for code, vertical, field, classes in REFERENCES if code != basin[0]],
        unresolved_references(assets, *basin[1:], basin[0]).unionByName(several_systems(assets)).distinct(),
    ]
    at_edges = reduce(DataFrame.unionByName, [missing_endpoints(frame), edge_rules(frame), duplicate_edges(frame)])
    if assets.groupBy("asset_id").count().where("count > 1").limit(1).count():
        return reduce(DataFrame.unionByName, [*at_assets, at_edges]).distinct()
    mark = F.xxhash64("relationship_id").alias("_mark")
    again = settle(edges.groupBy(mark).count().where("count > 1").select("_mark"))
    if again.limit(1).count():
        marked = at_edges.withColumn("_mark", mark)
        at_edges = marked.join(again, "_mark", "left_anti").drop("_mark").unionByName(marked.join(again, "_mark", "left_semi").drop("_mark").distinct())
    return reduce(DataFrame.unionByName, [*at_assets, at_edges])


def all_findings(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Every rule of every vertical, once per fingerprint."""
    return with_identity(other_findings(assets, edges).unionByName(strand_findings(assets)))


def with_identity(findings: DataFrame) -> DataFrame:
    """Adds the fingerprint of what a finding is about (independent of the run)."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("vertical", "rule_code", "asset_id", "related_asset_id", "relationship_id")]
    return findings.withColumn("finding_fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def rule_availability(assets: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_code, available, reason``: a rule needs an asset of its classes and, on one of them,
    a value in one of its attributes. ``rules``: ``rule_code, vertical, classes, fields``."""
    fields = [f.name for f in assets.schema.fields if f.name not in ("vertical", "asset_class", "asset_id")]
    have = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    seen = assets.groupBy("vertical", "asset_class").agg(F.array_distinct(F.flatten(F.collect_set(have))).alias("have"))
    d = rules.join(seen, "vertical", "left")
    fits = (F.size("classes") == 0) | F.array_contains("classes", F.col("asset_class"))
    flags = d.groupBy("rule_code").agg(
        F.bool_or((F.size("classes") == 0) | F.coalesce(fits, F.lit(False))).alias("c"),
        F.bool_or(F.coalesce(fits & ((F.size("fields") == 0) | F.arrays_overlap("fields", "have")), F.lit(False))).alias("f"),
        F.first(F.array_sort("fields")).alias("needed"),
    )
    lacking = F.concat(F.lit("Unable to determine: required evidence is unavailable ("), F.array_join("needed", ", "), F.lit(")."))
    reason = F.when(~F.col("c"), "Unable to determine: no applicable canonical assets are represented.").when(~F.col("f"), lacking).otherwise("")
    return flags.select("rule_code", (F.col("c") & F.col("f")).alias("available"), reason.alias("reason"))


def graph_fingerprint(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertical, assets, edges, asset_hash, edge_hash``: an order-free hash of each network."""
    def row(d: DataFrame) -> Column:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(d.columns)])
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

    a = assets.groupBy("vertical").agg(F.count("*").alias("assets"), F.bit_xor(row(assets)).alias("asset_hash"))
    named = edges.withColumn("edge_hash", row(edges))
    ends = assets.select("asset_id", "vertical")
    touched = named.select(F.explode(F.array_distinct(F.array("from_asset_id", "to_asset_id"))).alias("asset_id"), "relationship_id", "edge_hash").join(ends, "asset_id")
    e = touched.select("vertical", "relationship_id", "edge_hash").distinct().groupBy("vertical").agg(F.count("*").alias("edges"), F.bit_xor("edge_hash").alias("edge_hash"))
    return a.join(e, "vertical", "left").fillna(0, ["edges", "edge_hash"])


def rule_run_status(rules: DataFrame, findings: DataFrame, skipped: DataFrame) -> DataFrame:
    """``rule_code, findings, status``: passed, warning, failed (blocking) or skipped."""
    n = findings.groupBy("rule_code").agg(F.count("*").alias("findings"))
    d = rules.join(n, "rule_code", "left").join(skipped.select("rule_code", F.lit(True).alias("skip")), "rule_code", "left")
    status = F.when(F.col("skip"), "skipped").when(F.coalesce("findings", F.lit(0)) == 0, "passed").when(F.col("blocking"), "failed").otherwise("warning")
    return d.select("rule_code", F.coalesce("findings", F.lit(0)).alias("findings"), status.alias("status"))


def carry_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the newest review of their fingerprint (``reviewed_at``, then ``review_id``)."""
    w = Window.partitionBy("finding_fingerprint").orderBy(F.desc("reviewed_at"), F.desc("review_id"))
    latest = reviews.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return findings.join(latest, "finding_fingerprint", "left").withColumn("review_status", F.coalesce("review_status", F.lit("open")))
