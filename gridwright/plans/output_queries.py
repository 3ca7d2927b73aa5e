"""Queries over result tables as they are written, and roll-ups of layers and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import layer_rules as R
from gridwright.operators import plans as M
from gridwright.plans.bridge import derive, sql_of
from gridwright.plans.layer_queries import LEN, blank, manholes, num, pipes
from gridwright.sources import tables as S

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql_of(name, sql)
        return f

    return add


@query("component_files", "SELECT lifecycle, count(*) AS n, array_to_string(list(objectid ORDER BY objectid), ';') AS ids FROM pipes GROUP BY 1")
def component_files(s, sf):
    return pipes(s, sf).groupBy("lifecycle").agg(F.count("*").alias("n"), S.joined_ids(F.collect_list("objectid")).alias("ids"))


@query(
    "issue_targets",
    """SELECT target, count(*) AS n FROM (SELECT CASE WHEN vertices > 0 THEN 'pipe' END AS target FROM pipes UNION ALL SELECT CASE WHEN x IS NOT NULL THEN 'manhole' END FROM manholes) GROUP BY 1""",
)
def issue_targets(s, sf):
    rows = pipes(s, sf).select(F.lit(R.PIPE).alias("source_layer"), "geometry").unionByName(manholes(s, sf).select(F.lit(R.MANHOLE).alias("source_layer"), "geometry"))
    return S.with_target(rows, R.MANHOLE).groupBy("target").agg(F.count("*").alias("n"))


@query(
    "geojson_features",
    """SELECT concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', CAST(x AS VARCHAR), ',', CAST(y AS VARCHAR), ']},"properties":{"objectid":', objectid, '}}') AS value FROM manholes WHERE x IS NOT NULL""",
)
def geojson_features(s, sf):
    return S.geojson_features(manholes(s, sf), ["objectid"])


@query(
    "run_history_rows",
    f"""SELECT 'run-1' AS run_id, layer, records, findings, CASE WHEN records = 0 THEN 'empty' WHEN findings > 0 THEN 'completed_with_findings' ELSE 'completed' END AS status, '2024-01-01' AS started_at FROM (
        SELECT 'pipes' AS layer, count(*) AS records, count(*) FILTER (coalesce({num('diameter')} < 4 OR {num('diameter')} > 240, true)) + count(*) FILTER (coalesce({LEN}, 0) < 5) AS findings FROM pipes
        UNION ALL SELECT 'manholes', count(*), count(*) FILTER ({blank('asset_id')}) FROM manholes)""",
)
def run_history_rows(s, sf):
    p, m = pipes(s, sf), manholes(s, sf)
    found = R.invalid_diameter(p).unionByName(R.short_pipe(p, 5.0)).select(F.lit("pipes").alias("layer")).unionByName(R.missing_id(m, "WW_ID_001", R.MANHOLE).select(F.lit("manholes").alias("layer")))
    records = p.select(F.lit("pipes").alias("layer")).unionByName(m.select(F.lit("manholes").alias("layer"))).groupBy("layer").agg(F.count("*").alias("records"))
    findings = found.groupBy("layer").agg(F.count("*").alias("findings"))
    return S.run_rows(records.join(findings, "layer", "left").fillna(0), "run-1", "2024-01-01")


#: Roles and fields of the layers; a field with no value in the table is unavailable.
_ROLES = {"pipes": ["asset_id", "diameter", "material", "slope", "lifecycle", "operational"], "manholes": ["asset_id", "project_id"]}
_MAP = {"lifecycle": "lifecycle_status", "operational": "operational_status"}
_STATUS_RULES = [
    ("WW_FLOW_005", True, ["pipes"], ["geometry", "slope", "rim_elevation"]), ("WW_ID_003", True, ["pipes", "manholes"], ["asset_id"]), ("WW_OFF", False, ["pipes"], ["nothing"]), ("WW_NET_001", True, ["network"], ["nothing"]),
    ("WW_ATTR_006", True, ["manholes"], ["project_id", "geometry"]), ("WW_ATTR_007", True, ["pipes"], ["domain_fields"]), ("WW_ATTR_008", True, ["pipes"], ["lifecycle_status", "operational_status"]), ("WW_ATTR_001", True, ["manholes", "pipes"], ["diameter"]),
]


def _status_sql() -> str:
    out = []
    for code, enabled, layers, roles in _STATUS_RULES:
        cases = [] if enabled else ["WHEN true THEN 'Rule is disabled in configuration.'"]
        for layer in [x for x in layers if x != "network"]:
            for role in [r for r in roles if r != "geometry"]:
                field = next((f for f in _ROLES[layer] if _MAP.get(f, f) == role), None)
                if role == "domain_fields":
                    cases.append("WHEN true THEN 'No ArcGIS domains are present on staged wastewater fields.'")
                else:
                    absent = f"(SELECT count({field}) = 0 FROM {layer})" if field else "true"
                    cases.append(f"WHEN {absent} THEN 'Required semantic field {role} is unavailable for {layer}.'")
        reason = f"CASE {' '.join(cases)} ELSE '' END" if cases else "''"
        out.append(f"SELECT '{code}' AS rule_code, CASE WHEN {reason} = '' THEN 'run' ELSE 'skipped' END AS state, {reason} AS reason")
    return " UNION ALL ".join(out)


@query("rule_statuses", _status_sql())
def rule_statuses(s, sf):
    parts = []
    for layer, fields in _ROLES.items():
        counts = derive(s, sf, layer).agg(*[F.count(f).alias(f) for f in fields])
        parts.append(counts.select(F.lit(layer).alias("layer"), F.explode(F.array(*[F.struct(F.lit(_MAP.get(f, f)).alias("role"), F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("c")))
    mapping = parts[0].unionByName(parts[1]).select("layer", "c.role", "c.field", F.when(F.col("c.n") > 0, "high").otherwise("unavailable").alias("confidence"))
    rules = s.createDataFrame(_STATUS_RULES, "rule_code string, enabled boolean, layers array<string>, roles array<string>")
    return R.rule_status(rules, mapping, has_domains=False)


@query(
    "plan_gates",
    """WITH m AS (SELECT layer_id, count(*) AS fields, count(*) FILTER (field_pos = 3 AND layer_id % 4 = 0) AS open_fields, bool_or(lower(field_name) IN ('asset_id', 'facilityid')) AS has_id FROM fields GROUP BY 1)
       SELECT layer_id, fields, open_fields, array_to_string(list_filter([CASE WHEN NOT has_id THEN 'identifier_unmapped' END, CASE WHEN open_fields > 0 THEN 'fields_unreviewed' END, CASE WHEN geometry_type = '' THEN 'geometry_unknown' END, CASE WHEN srs = '' THEN 'spatial_reference_unknown' END, CASE WHEN record_count = 0 THEN 'no_records' END], lambda x: x IS NOT NULL), ';') AS blockers,
         CASE WHEN NOT has_id OR open_fields > 0 OR geometry_type = '' OR srs = '' OR record_count = 0 THEN 'blocked' WHEN layer_id % 3 = 0 THEN 'approved' ELSE 'ready_for_review' END AS status FROM m JOIN layers USING (layer_id)""",
)
def plan_gates(s, sf):
    f = derive(s, sf, "fields")
    fields = f.select("layer_id", F.lower("field_name").isin("asset_id", "facilityid").alias("is_identifier"), ((F.col("field_pos") == 3) & (F.col("layer_id") % 4 == 0)).alias("open"))
    plans = derive(s, sf, "layers").withColumn("approved", F.col("layer_id") % 3 == 0)
    return M.plan_gates(plans, fields)


@query(
    "ownership_decisions",
    """SELECT layer_id, CASE WHEN layer_id % 20 = 0 THEN 'human_confirmed' WHEN contains(lower(layer_name), 'town') THEN 'high' ELSE 'low' END AS confidence, CASE WHEN layer_id % 20 = 0 THEN 'confirmed' WHEN contains(lower(layer_name), 'town') THEN 'provisional' ELSE 'needs_owner_confirmation' END AS owner_status FROM layers""",
)
def ownership_decisions(s, sf):
    d = derive(s, sf, "layers").select("layer_id", "layer_name", F.lit("Town").alias("owner"), (F.col("layer_id") % 20 == 0).alias("acknowledged"))
    return M.ownership(d)


@query("record_totals", "SELECT geometry_type, srs, CAST(sum(record_count) AS BIGINT) AS records, count(*) AS layers FROM layers GROUP BY GROUPING SETS ((geometry_type), (srs), ())")
def record_totals(s, sf):
    return M.record_totals(derive(s, sf, "layers"), ["geometry_type", "srs"], "record_count")


_INV = """iv AS (SELECT layer_id, layer_name, submission_id, geometry_type, srs, record_count, (SELECT min(field_name) FROM fields WHERE fields.layer_id = layers.layer_id AND upper(field_name) IN ('ASSET_ID', 'FACILITYID')) AS unique_id_field,
    ['water', 'wastewater', 'reference', 'electric', 'unknown'][CAST(layer_id % 5 + 1 AS BIGINT)] AS system, ['high', 'medium', 'low', 'review_required'][CAST(record_count % 4 + 1 AS BIGINT)] AS confidence FROM layers)"""


def inventory(s, sf):
    """The layers with the field that names them, a system and a confidence."""
    at = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names) + 1).cast("int"))
    ids = derive(s, sf, "fields").where(F.upper("field_name").isin("ASSET_ID", "FACILITYID")).groupBy("layer_id").agg(F.min("field_name").alias("unique_id_field"))
    d = derive(s, sf, "layers").join(ids, "layer_id", "left")
    return d.withColumns({"system": at(["water", "wastewater", "reference", "electric", "unknown"], "layer_id"), "confidence": at(["high", "medium", "low", "review_required"], "record_count")})


@query("inventory_warnings", f"""WITH {_INV} SELECT layer_id, 'missing spatial reference' AS warning FROM iv WHERE srs = '' UNION ALL SELECT layer_id, 'no likely unique ID field identified' FROM iv WHERE unique_id_field IS NULL
    UNION ALL SELECT layer_id, 'classification needs review' FROM iv WHERE confidence IN ('low', 'review_required')""")
def inventory_warnings(s, sf):
    return M.quality_warnings(inventory(s, sf))


@query("taxonomy_duplicates", f"WITH {_INV} SELECT submission_id, system, geometry_type, count(*) AS layers FROM iv WHERE system NOT IN ('unknown', 'review_required') GROUP BY 1, 2, 3 HAVING count(*) > 1")
def taxonomy_duplicates(s, sf):
    return M.taxonomy_duplicates(inventory(s, sf), ["submission_id", "system", "geometry_type"])


@query("exception_buckets", """SELECT bucket, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN srs = '' THEN 'coordinates' END, CASE WHEN geometry_type = '' THEN 'geometry' END, CASE WHEN record_count > 40 THEN 'large' END, CASE WHEN srs <> '' AND geometry_type <> '' AND record_count <= 40 THEN 'none' END], lambda x: x IS NOT NULL)) AS bucket FROM layers) GROUP BY 1""")
def exception_buckets(s, sf):
    return M.buckets(derive(s, sf, "layers"), {"coordinates": "srs = ''", "geometry": "geometry_type = ''", "large": "record_count > 40"})


@query("primary_system", f"""WITH {_INV}, w AS (SELECT submission_id, system, sum(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN unique_id_field IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN srs <> '' THEN 1 ELSE 0 END) AS w, min(layer_id) AS f
      FROM iv WHERE system NOT IN ('review_required', 'unknown', 'reference', 'shared_reference') GROUP BY 1, 2)
    SELECT submission_id, coalesce(arg_max(system, {{'w': w, 'f': -f}}), 'unknown') AS primary_system FROM (SELECT DISTINCT submission_id FROM iv) LEFT JOIN (SELECT * FROM w WHERE w > 0) USING (submission_id) GROUP BY 1""")
def primary_system(s, sf):
    return M.primary_system(inventory(s, sf), "submission_id")
