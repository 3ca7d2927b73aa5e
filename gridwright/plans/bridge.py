"""Domain tables derived from the given tables: one SQL text each, valid in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridwright.session import table

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def pick(key: str, values: list[str]) -> str:
    """SQL that takes one of a list of texts by a number."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {cases} END"


SQL = {
    "manholes": """
        SELECT c_custkey AS objectid,
               CASE WHEN c_custkey % 41 = 0 THEN ' ' WHEN c_custkey % 29 = 0 THEN concat('MH-', CAST(c_custkey - 1 AS STRING))
                    ELSE concat('MH-', CAST(c_custkey AS STRING)) END AS asset_id,
               CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE CAST(((c_custkey - CASE WHEN c_custkey % 43 = 0 THEN 1 ELSE 0 END) % 100) * 40 AS DOUBLE) END AS x,
               CAST(floor((c_custkey - CASE WHEN c_custkey % 43 = 0 THEN 1 ELSE 0 END) / 100.0) * 40 AS DOUBLE) AS y,
               CASE WHEN c_custkey % 7 = 0 THEN '<Null>' ELSE c_mktsegment END AS project_id
        FROM customer""",
    "pipes": f"""
        SELECT o_orderkey AS objectid,
               CASE WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderkey % 29 = 0 THEN concat('P-', CAST(o_orderkey - 1 AS STRING))
                    ELSE concat('P-', CAST(o_orderkey AS STRING)) END AS asset_id,
               CASE WHEN o_orderkey % 23 = 0 THEN '<Null>' WHEN o_orderkey % 19 = 0 THEN 'n/a'
                    ELSE CAST(o_orderkey % 260 AS STRING) END AS diameter,
               {pick('o_orderkey', ['PVC', 'Ductile Iron', 'clay', 'none', 'Polyvinyl_Chloride', 'brick', 'RCP', 'VCP', 'ac'])} AS material,
               {pick('o_orderkey', ['1998', '0', '2004', '1', ' ', '1975', '1988'])} AS yr,
               {pick('o_orderkey', ['Active', 'abandoned', 'In Service', 'Retired', '', 'proposed', 'removed', 'decommissioned'])} AS lifecycle,
               {pick('floor(o_orderkey / 8.0)', ['in_service', 'out of service', 'Gravity', 'active', 'bad value', 'NULL'])} AS operational,
               CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS up,
               CAST(floor(round(o_totalprice * 100) / 1000) AS BIGINT) % 1000 AS down,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 70 AS DOUBLE) / 10 END AS slope,
               CASE WHEN o_orderkey % 89 = 0 THEN 0 WHEN o_orderkey % 83 = 0 THEN 1 WHEN o_orderkey % 71 = 0 THEN 3 ELSE 2 END AS vertices,
               o_orderkey % 79 = 0 AS multipart,
               CAST((o_custkey % 100) * 40 + o_orderkey % 17 AS DOUBLE) AS sx,
               CAST(floor(o_custkey / 100.0) * 40 AS DOUBLE) AS sy,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN (o_custkey % 100) * 40 + o_orderkey % 17 + 3
                         WHEN o_orderkey = 500 THEN -90000
                         WHEN o_custkey % 13 = 0 THEN (o_custkey % 100) * 40 + o_orderkey % 17 + 13 + o_orderkey % 3
                         ELSE ((o_custkey + 1) % 100) * 40 END AS DOUBLE) AS ex,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN floor(o_custkey / 100.0) * 40
                         WHEN o_custkey % 13 = 0 THEN floor(o_custkey / 100.0) * 40 + 19
                         ELSE floor((o_custkey + 1) / 100.0) * 40 + o_orderkey % 5 END AS DOUBLE) AS ey
        FROM orders""",
    "layers": f"""
        SELECT p_partkey AS layer_id, p_partkey % 50 AS submission_id,
               concat({pick('p_partkey', ['Town_A_ForceMains', 'WaterLine', 'Town_B_Sewer', 'TownBSewer', 'Proposed_Fiber', 'Manholes_final', 'Stream_WGS84', 'Electric_Poles', 'GravityMain', 'Lift_Station', 'Parcels'])},
                      CASE WHEN p_size > 25 THEN concat('_', CAST(p_size AS STRING)) ELSE '' END) AS layer_name,
               {pick('floor(p_partkey / 3.0)', ['polyline', 'point', 'polygon', 'multipoint', ''])} AS geometry_type,
               {pick('p_size', ['WGS 1984', 'NAD83', '', 'NAD83'])} AS srs,
               p_size AS record_count
        FROM part""",
    "fields": f"""
        SELECT p_partkey AS layer_id, n AS field_pos,
               CASE n WHEN 0 THEN 'OBJECTID' WHEN 1 THEN {pick('p_partkey', ['ASSET_ID', 'FACILITYID', 'PIPE_NO', 'Name'])}
                      WHEN 2 THEN {pick('p_size', ['MATERIAL', 'DIAMETER', 'OWNER', 'INSTALL_DATE', 'STATUS'])} ELSE {pick('floor(p_partkey / 5.0)', ['NOTES', 'CUSTOMER_PHONE', 'LIFECYCLE', 'DEPTH'])} END AS field_name
        FROM part CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "assets": f"""
        SELECT concat('P', CAST(p_partkey AS STRING)) AS asset_id, p_partkey AS k,
               {pick('p_partkey', ['electric_distribution', 'telecom_fiber', 'water', 'wastewater'])} AS vertical,
               CASE p_partkey % 4
                 WHEN 0 THEN {pick('floor(p_partkey / 4.0)', ['overhead_conductor', 'transformer', 'switch', 'underground_conductor', 'fuse', 'service_point'])}
                 WHEN 1 THEN {pick('floor(p_partkey / 4.0)', ['fiber_cable', 'splice_closure', 'terminal', 'fiber_cabinet', 'splitter', 'pole'])}
                 WHEN 2 THEN {pick('floor(p_partkey / 4.0)', ['water_main', 'valve', 'hydrant', 'meter', 'service_line', 'pump', 'pressure_zone', 'reservoir'])}
                 ELSE {pick('floor(p_partkey / 4.0)', ['gravity_main', 'manhole', 'force_main', 'lift_station', 'service_lateral', 'gravity_main', 'sewer_basin'])} END AS asset_class,
               CASE WHEN p_partkey % 31 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN concat(' id', CAST(p_partkey % 40 AS STRING)) ELSE concat('ID', CAST(p_partkey AS STRING)) END AS source_identifier,
               CASE WHEN p_partkey % 62 = 0 THEN '' ELSE p_name END AS canonical_name,
               {pick('floor(p_partkey / 7.0)', ['active', 'retired', 'active', 'unknown', 'abandoned', 'active', 'installed', 'odd', 'removed', 'active', 'active'])} AS lifecycle_status,
               {pick('floor(p_partkey / 3.0)', ['normally_open', 'closed', 'open', 'active', 'unknown'])} AS operational_status,
               {pick('floor(p_partkey / 3.0)', ['point', 'polyline', ''])} AS geometry_type,
               {pick('p_size', ['NAD83', 'unknown', 'NAD83'])} AS spatial_reference, p_size % 11 = 0 AS suspicious_extent,
               {pick('p_size', ['town', '', 'county'])} AS owner_candidate, {pick('p_partkey', ['', 'north', '', '', 'south'])} AS jurisdiction,
               CASE WHEN p_partkey % 6 <> 0 THEN concat('F', CAST(p_size % 9 AS STRING)) END AS feeder_id,
               CASE WHEN p_partkey % 5 <> 0 THEN concat('C', CAST(p_size % 4 AS STRING)) END AS circuit_id,
               {pick('p_size', ['A', 'abc', 'X', '', 'bc'])} AS phase,
               CASE WHEN p_size % 3 = 0 THEN '12.5' END AS nominal_voltage, {pick('p_partkey', ['12.5', '13', ''])} AS operating_voltage,
               {pick('floor(p_partkey / 8.0)', ['underground', 'overhead', 'aerial', ''])} AS placement,
               CASE WHEN p_partkey % 9 = 0 THEN 'conduit' END AS conduit_id, CASE WHEN p_partkey % 7 = 0 THEN 'structure' END AS structure_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'fuse' END AS device_type,
               CASE WHEN p_partkey % 10 = 0 THEN 'zz' WHEN p_partkey % 9 <> 0 THEN CAST(p_size * 10 - 20 AS STRING) END AS diameter,
               {pick('p_size', ['pvc', 'unknown', '', 'N/A', 'clay'])} AS material,
               CASE WHEN p_partkey % 8 <> 0 THEN concat('R', CAST(CAST(floor(p_partkey / 24.0) AS BIGINT) % 3 AS STRING)) END AS route_id,
               CASE WHEN p_partkey % 4 = 1 THEN 'M1' END AS from_structure, CASE WHEN p_size % 4 <> 1 THEN concat('M', CAST(p_size % 3 AS STRING)) END AS to_structure,
               p_partkey % 50 AS strand_start, p_partkey % 50 + p_size % 12 - 2 AS strand_end, CASE WHEN p_size % 2 = 0 THEN CAST(48 AS BIGINT) END AS fiber_count,
               CASE WHEN p_size % 5 <> 0 THEN CAST(36 AS BIGINT) END AS total, CAST(p_size % 30 AS BIGINT) AS used, p_partkey % 13 AS reserved, p_partkey % 25 AS available,
               CASE WHEN p_size % 4 <> 0 THEN concat('ID', CAST(p_partkey - p_partkey % 7 AS STRING)) END AS zone_id,
               CASE WHEN p_size % 7 = 1 THEN concat('ID', CAST(p_partkey - p_partkey % 9 AS STRING)) END AS facility_id,
               CASE WHEN p_partkey % 40 = 0 THEN true WHEN p_partkey % 8 = 0 THEN false END AS normally_open,
               CASE WHEN p_size % 6 = 1 THEN concat('Y', CAST(p_size % 5 AS STRING)) END AS system_id,
               CAST(p_size - 10 AS DOUBLE) / 20 AS slope, CASE WHEN p_size % 8 <> 0 THEN CAST(p_partkey % 90 AS DOUBLE) END AS upstream_invert, CASE WHEN p_size % 9 <> 0 THEN CAST(p_partkey % 70 AS DOUBLE) END AS downstream_invert
        FROM part""",
    "edges": f"""
        SELECT concat('E', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS relationship_id,
               CASE WHEN l_orderkey % 53 = 0 THEN concat('P', CAST(l_partkey AS STRING)) WHEN l_orderkey % 59 = 0 THEN concat('P', CAST(l_partkey + 1 AS STRING))
                    WHEN l_partkey % 12 < 4 THEN concat('Z', CAST(l_partkey AS STRING)) ELSE concat('P', CAST(l_partkey - 4 * (1 + l_orderkey % 5) AS STRING)) END AS from_asset_id,
               CASE WHEN l_orderkey % 67 = 0 THEN concat('X', CAST(l_partkey AS STRING)) ELSE concat('P', CAST(l_partkey AS STRING)) END AS to_asset_id,
               {pick('l_orderkey', ['connects_to', 'feeds', 'flows_to', 'belongs_to_feeder', 'terminates_at', 'routed_through'])} AS relationship_type,
               CASE WHEN l_linestatus = 'F' THEN 'forward' WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE 'bidirectional' END AS direction,
               l_linenumber % 7 = 0 AS provisional
        FROM lineitem""",
    "trace_edges": f"""
        SELECT relationship_id, CASE WHEN ahead THEN a ELSE b END AS from_asset_id, CASE WHEN ahead THEN b ELSE a END AS to_asset_id, relationship_type,
               CASE WHEN ahead THEN CASE WHEN p_size % 4 = 0 THEN 'bidirectional' ELSE 'forward' END ELSE 'reverse' END AS direction, provisional
        FROM (SELECT concat('T', CAST(p_partkey AS STRING), '-', CAST(n AS STRING)) AS relationship_id, (p_partkey + n) % 7 < 5 AS ahead, p_size, (p_partkey + n) % 9 = 0 AS provisional,
                     concat('P', CAST(p_partkey AS STRING)) AS a,
                     concat('P', CAST(CASE WHEN p_partkey % 28 + 4 * n < 28 AND p_partkey + 4 * n <= (SELECT max(p_partkey) FROM part) AND (n = 1 OR p_partkey % 3 = 0) THEN p_partkey + 4 * n ELSE p_partkey END AS STRING)) AS b,
                     {pick('p_size', ['connects_to', 'feeds', 'flows_to', 'connects_to', 'mounted_on', 'feeds', 'belongs_to_feeder'])} AS relationship_type
              FROM part CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) t) e""",
    "trace_requests": f"""
        SELECT p_partkey AS request_id, concat('P', CAST(p_partkey AS STRING)) AS start_asset_id, {pick('p_partkey', ['electric_distribution', 'telecom_fiber', 'water', 'wastewater'])} AS vertical,
               CASE p_partkey % 4
                 WHEN 0 THEN {pick('p_size', ['ELEC-TRACE-001', 'ELEC-TRACE-004', 'ELEC-TRACE-006', 'ELEC-TRACE-003'])} WHEN 1 THEN {pick('p_size', ['TEL-TRACE-007', 'TEL-TRACE-002', 'TEL-TRACE-005', 'TEL-TRACE-006', 'TEL-TRACE-003'])}
                 WHEN 2 THEN {pick('p_size', ['WATER-TRACE-003', 'WATER-TRACE-005', 'WATER-TRACE-001', 'WATER-TRACE-002'])} ELSE {pick('p_size', ['WW-TRACE-003', 'WW-TRACE-002', 'WW-TRACE-005', 'WW-TRACE-007'])} END AS trace_type,
               CASE WHEN p_size % 9 = 0 THEN concat('P', CAST(p_partkey + 8 AS STRING)) END AS target_asset_id,
               {pick('floor(p_partkey / 28.0)', ['downstream', 'bidirectional', 'downstream', 'upstream'])} AS direction,
               {pick('p_size', ['historical', 'include_inactive', 'historical'])} AS lifecycle_mode, {pick('p_size', ['diagnostic', 'respect_state', 'include_unknown'])} AS operational_mode,
               {pick('floor(p_size / 2.0)', ['include_with_warning', 'exclude', 'require_when_only_path'])} AS provisional_policy,
               {pick('floor(p_size / 3.0)', ['conservative', 'strict', 'diagnostic', 'diagnostic'])} AS qa_policy, CAST(CASE WHEN p_size % 5 = 0 THEN 3 ELSE 40 END AS INT) AS max_depth, 250 AS max_assets
        FROM part""",
    "trace_groups": f"""
        SELECT concat('G', CAST(p_partkey AS STRING)) AS issue_group_id, CASE WHEN n < 2 THEN concat('P', CAST(p_partkey + 4 * n AS STRING)) END AS asset_id, CASE WHEN n = 2 THEN concat('T', CAST(p_partkey AS STRING), '-1') END AS relationship_id,
               CASE WHEN p_partkey % 13 = 0 THEN {pick('p_size', ['stops_trace', 'limits_trace', 'advisory', 'introduces_ambiguity', 'not_evaluated'])} ELSE 'no_trace_effect' END AS impact,
               {pick('floor(p_size / 5.0)', ['open', 'false_positive', 'open', 'accepted_risk', 'superseded'])} AS review_status,
               {pick('p_partkey', ['electric_distribution', 'telecom_fiber', 'water', 'wastewater'])} AS vertical,
               {pick('floor(p_partkey / 4.0)', ['ELEC-012', 'SHARED-004', 'TEL-001', 'ELEC-009', 'SHARED-008', 'WATER-012', 'TEL-003'])} AS rule_code,
               {pick('floor(p_partkey / 4.0)', ['Normally open device', 'Provisional relationship evidence', 'Cable endpoint and termination', 'Feeder and circuit assignment conflict', 'Unknown lifecycle state', 'Valve lacks main relationship', 'Fiber strand allocation conflict'])} AS title
        FROM part CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
    "reviews": f"""
        SELECT concat('fp-', CAST(user_id AS STRING), '-', event_type) AS fingerprint,
               CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_id AS event_id, user_id,
               {pick('event_id', ['unreviewed', 'confirmed_defect', 'false_positive', 'likely_defect', 'deferred', 'under_review', 'unreviewed', 'resolved'])} AS disposition,
               {pick('user_id', ['WW_NET_001', 'WW_ID_002', 'WW_NET_006', 'WW_NET_007', 'WW_ATTR_004', 'WW_GEOM_003', 'WW_FLOW_002'])} AS rule_code,
               {pick('user_id', ['high', 'high', 'medium', 'medium', 'medium', 'low', 'low'])} AS severity,
               {pick('user_id', ['Connectivity', 'Identity', 'Connectivity', 'Connectivity', 'Attributes', 'Geometry', 'Connectivity'])} AS category,
               {pick('floor(event_id / 2.0)', ['high', 'candidate'])} AS confidence
        FROM events""",
    "operations": f"""
        SELECT l_orderkey AS proposal_id, l_linenumber AS sequence, l_partkey AS target_key, l_suppkey AS tie,
               concat('P', CAST(l_partkey AS STRING)) AS target_asset_id,
               {pick('l_partkey + l_linenumber', ['update_asset_field', 'retire_asset', 'update_asset_field', 'add_relationship', 'update_asset_field'])} AS operation_type,
               {pick('l_linenumber', ['diameter', 'owner_candidate', 'lifecycle_status', 'bad_field'])} AS field_name,
               CAST(CAST(l_quantity AS BIGINT) AS STRING) AS proposed_value
        FROM lineitem""",
    "proposal_operations": f"""
        SELECT l_orderkey AS proposal_id, l_linenumber AS sequence, l_suppkey AS tie,
               {pick('l_partkey + l_linenumber', ['update_asset_attribute', 'retire_asset', 'add_relationship', 'remove_relationship', 'change_lifecycle_status', 'confirm_provisional_relationship', 'assign_membership', 'update_relationship', 'add_asset', 'remove_membership', 'replace_relationship', 'associate_container', 'mark_relationship_provisional', 'change_operational_status', 'replace_asset'])} AS operation_type,
               CASE WHEN (l_partkey + l_linenumber) % 15 = 8 THEN concat('N', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) ELSE concat('P', CAST(l_partkey AS STRING)) END AS target_asset_id,
               concat('T', CAST(l_partkey AS STRING), '-', CAST(1 + l_linenumber % 2 AS STRING)) AS target_relationship_id,
               CASE WHEN (l_partkey + l_linenumber) % 15 = 7 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'direction' ELSE 'provisional' END
                    WHEN (l_partkey + l_linenumber) % 15 IN (6, 9) THEN {pick('l_linenumber', ['feeder_id', 'circuit_id', 'route_id'])} ELSE {pick('l_suppkey', ['diameter', 'material', 'phase', 'strand_start', 'zone_id', 'owner_candidate', 'slope'])} END AS field_name,
               CASE WHEN (l_partkey + l_linenumber) % 15 = 4 THEN {pick('l_suppkey', ['active', 'retired', 'installed'])} WHEN (l_partkey + l_linenumber) % 15 = 13 THEN {pick('l_suppkey', ['open', 'closed', 'normally_open'])}
                    WHEN (l_partkey + l_linenumber) % 15 = 7 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'bidirectional' ELSE 'true' END WHEN (l_partkey + l_linenumber) % 15 = 6 THEN concat('F', CAST(l_suppkey % 4 AS STRING)) ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS proposed_value,
               {pick('l_suppkey', ['connects_to', 'feeds', 'flows_to', 'terminates_at'])} AS relationship_type,
               concat('P', CAST(l_partkey AS STRING)) AS from_asset_id, concat('P', CAST(l_partkey + 4 * (1 + l_suppkey % 3) AS STRING)) AS to_asset_id, 'forward' AS direction, l_suppkey % 5 = 0 AS provisional,
               {pick('l_partkey', ['transformer', 'fiber_cable', 'valve', 'manhole'])} AS asset_class, {pick('l_partkey', ['electric_distribution', 'telecom_fiber', 'water', 'wastewater'])} AS vertical
        FROM lineitem""",
}
NEEDS: dict[str, list[str]] = {}


def sql_of(name: str, body: str) -> str:
    """The SQL of a query for DuckDB: the derivations it names, then its own text.

    ``body`` may start with ``WITH``; names of derived tables in it are added in front.
    """
    ctes = [f"{n} AS ({t})" for n, t in SQL.items() if re.search(rf"\b{n}\b", body)]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip()[:10].upper() == "RECURSIVE "
        rest = body[5:].lstrip()[10:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*ctes, rest])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table from the Parquet files of ``sf_dir``."""
    text = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in BASE if re.search(rf"(FROM|JOIN)\s+{t}\b", text)}
    for t in used:
        text = re.sub(rf"(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)
