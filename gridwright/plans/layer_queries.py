"""Queries over the derived pipe and manhole layers and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import values as V
from gridwright.operators import layer_rules as R
from gridwright.operators import network as N
from gridwright.operators import profile as P
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


def pipes(spark: SparkSession, sf: str) -> DataFrame:
    p = derive(spark, sf, "pipes")
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    n = F.col("vertices")
    path = F.when(n == 1, F.array(xy("sx", "sy"))).when(n == 3, F.array(xy("sx", "sy"), xy("ex", "ey"), xy("sx", "sy"))).otherwise(F.array(xy("sx", "sy"), xy("ex", "ey")))
    leg = F.sqrt((F.col("ex") - F.col("sx")) * (F.col("ex") - F.col("sx")) + (F.col("ey") - F.col("sy")) * (F.col("ey") - F.col("sy")))
    length = F.when(n == 1, F.lit(0.0)).when(n == 3, leg * 2).otherwise(leg)
    g = F.struct(F.lit("polyline").alias("type"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array(path).alias("paths"), length.alias("length"), F.lit(False).alias("is_empty"), F.col("multipart").alias("is_multipart"))
    return p.withColumn("geometry", F.when(n > 0, g).cast(R.GEOMETRY)).withColumn("ordinal", F.col("objectid")).drop("sx", "sy", "ex", "ey", "vertices", "multipart")


def manholes(spark: SparkSession, sf: str) -> DataFrame:
    m = derive(spark, sf, "manholes")
    none = F.lit(None)
    g = F.struct(F.lit("point").alias("type"), F.col("x"), F.col("y"), none.alias("paths"), none.alias("length"), F.lit(False).alias("is_empty"), F.lit(False).alias("is_multipart"))
    return m.withColumn("geometry", F.when(F.col("x").isNotNull(), g.cast(R.GEOMETRY))).withColumn("ordinal", F.col("objectid")).drop("x", "y")


BLANK = "(coalesce(lower(trim({c}, ' ')), '') IN ('', '<null>', 'null', 'none', '-9999-'))"
blank = lambda c: BLANK.format(c=c)
NUM = "CASE WHEN regexp_full_match(trim(CAST({c} AS VARCHAR)), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) END"
num = lambda c: NUM.format(c=c)
LEN = "CASE vertices WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 3 THEN 2 * sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) ELSE sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) END"
ASSET = f"CASE WHEN {blank('asset_id')} THEN '' ELSE asset_id END"
short = lambda d: d.select("rule_code", "source_objectid", "source_asset_id", "related_objectid")


def _simple(code: str, where: str, table_: str = "pipes") -> str:
    return f"SELECT '{code}' AS rule_code, CAST(objectid AS VARCHAR) AS source_objectid, {ASSET} AS source_asset_id, '' AS related_objectid FROM {table_} WHERE {where}"


def _rule(name: str, job, code: str, where: str, table_: str = "pipes") -> None:
    source = pipes if table_ == "pipes" else manholes
    query(name, _simple(code, where, table_))(lambda s, sf, job=job: short(job(source(s, sf))))


_rule("rule_missing_manhole_id", lambda m: R.missing_id(m, "WW_ID_001", R.MANHOLE), "WW_ID_001", blank("asset_id"), "manholes")
_rule("rule_missing_pipe_id", lambda p: R.missing_id(p, "WW_ID_003", R.PIPE), "WW_ID_003", blank("asset_id"))
_rule("rule_missing_diameter", lambda p: R.missing_field(p, "diameter", "WW_ATTR_001", R.PIPE), "WW_ATTR_001", blank("diameter"))
_rule("rule_missing_material", lambda p: R.missing_field(p, "material", "WW_ATTR_002", R.PIPE), "WW_ATTR_002", blank("material"))
_rule("rule_missing_year", lambda p: R.missing_field(p, "yr", "WW_ATTR_003", R.PIPE, True), "WW_ATTR_003", f"{blank('yr')} OR trim(yr) IN ('0', '1')")
_rule("rule_invalid_diameter", R.invalid_diameter, "WW_ATTR_004", f"coalesce({num('diameter')} < 4 OR {num('diameter')} > 240, true)")
_rule("rule_missing_lifecycle", lambda p: R.missing_field(p, "lifecycle", "WW_ATTR_005", R.PIPE), "WW_ATTR_005", blank("lifecycle"))
_rule("rule_missing_project", lambda m: R.missing_field(m, "project_id", "WW_ATTR_006", R.MANHOLE), "WW_ATTR_006", blank("project_id"), "manholes")
_rule("rule_status_conflict", lambda p: R.conflicting_status(p, R.PIPE), "WW_ATTR_008", "lower(trim(lifecycle)) IN ('abandoned', 'retired', 'inactive') AND lower(trim(operational)) = 'active'")
_rule("rule_null_geometry", lambda p: R.null_geometry(p, R.PIPE), "WW_GEOM_001", "vertices = 0")
_rule("rule_null_point", lambda m: R.null_geometry(m, R.MANHOLE), "WW_GEOM_001", "x IS NULL", "manholes")
_rule("rule_few_vertices", lambda p: R.too_few_vertices(p, R.PIPE), "WW_GEOM_002", "vertices = 1")
_rule("rule_short_pipe", lambda p: R.short_pipe(p, V.feet_to_units(5, "US survey foot")), "WW_GEOM_003", f"coalesce({LEN}, 0) < 5")
_rule("rule_multipart", lambda p: R.multipart(p, R.PIPE), "WW_GEOM_006", "multipart AND vertices > 0")
_rule("rule_line_anomaly", R.line_anomaly, "WW_GEOM_007", "vertices = 3 OR (vertices = 2 AND sx = ex AND sy = ey)")
_rule("rule_uphill", R.uphill, "WW_FLOW_001", "up <> 0 AND down <> 0 AND up < down")
_rule("rule_missing_upstream", lambda p: R.missing_invert(p, "up", "WW_FLOW_002"), "WW_FLOW_002", "up = 0")
_rule("rule_missing_downstream", lambda p: R.missing_invert(p, "down", "WW_FLOW_003"), "WW_FLOW_003", "down = 0")
SLOPE = f"(CAST(up AS DOUBLE) - CAST(down AS DOUBLE)) / ({LEN}) * 100"
_FLOW = f"up <> 0 AND down <> 0 AND {LEN} <> 0"
_rule("rule_slope_range", R.slope_range, "WW_FLOW_004", f"{_FLOW} AND ({SLOPE} <= 0 OR {SLOPE} > 25)")
_rule("rule_slope_conflict", R.slope_conflict, "WW_FLOW_005", f"{_FLOW} AND abs(slope - {SLOPE}) > 0.5")


def _dup(code: str, table_: str, key: str, where: str) -> str:
    return f"""WITH k AS (SELECT *, {key} AS dup_key FROM {table_} WHERE {where}),
        g AS (SELECT dup_key, list(objectid ORDER BY objectid) AS ids FROM k GROUP BY 1 HAVING count(*) > 1)
        SELECT '{code}' AS rule_code, CAST(objectid AS VARCHAR) AS source_objectid, {ASSET} AS source_asset_id,
               array_to_string(list_filter(ids, lambda i: i <> objectid), ',') AS related_objectid FROM k JOIN g USING (dup_key)"""


query("rule_duplicate_manhole_id", _dup("WW_ID_002", "manholes", "trim(asset_id)", f"NOT {blank('asset_id')}"))(lambda s, sf: short(R.duplicate_id(manholes(s, sf), "WW_ID_002", R.MANHOLE)))
query("rule_duplicate_pipe_id", _dup("WW_ID_004", "pipes", "trim(asset_id)", f"NOT {blank('asset_id')}"))(lambda s, sf: short(R.duplicate_id(pipes(s, sf), "WW_ID_004", R.PIPE)))
query("rule_duplicate_line", _dup("WW_GEOM_004", "pipes", "concat_ws('|', vertices, sx, sy, CASE WHEN vertices > 1 THEN ex END, CASE WHEN vertices > 1 THEN ey END)", "vertices > 0"))(lambda s, sf: short(R.duplicate_geometry(pipes(s, sf), R.PIPE, "WW_GEOM_004")))
query("rule_duplicate_point", _dup("WW_GEOM_005", "manholes", "concat_ws('|', x, y)", "x IS NOT NULL"))(lambda s, sf: short(R.duplicate_geometry(manholes(s, sf), R.MANHOLE, "WW_GEOM_005")))


@query(
    "rule_domain",
    f"""SELECT 'WW_ATTR_007' AS rule_code, CAST(objectid AS VARCHAR) AS source_objectid, v AS issue_key FROM (
        SELECT objectid, concat('material:', material) AS v FROM pipes WHERE NOT {blank('material')} AND material NOT IN ('PVC', 'RCP', 'VCP')
        UNION ALL SELECT objectid, concat('operational:', operational) FROM pipes WHERE NOT {blank('operational')} AND operational NOT IN ('in_service', 'active'))""",
)
def rule_domain(s, sf):
    codes = [("material", c) for c in ("PVC", "RCP", "VCP")] + [("operational", c) for c in ("in_service", "active")]
    domains = s.createDataFrame([(R.PIPE, f, c) for f, c in codes], "layer string, field string, code string")
    return R.invalid_domain(pipes(s, sf), domains, ["material", "operational", "yr"], R.PIPE).select("rule_code", "source_objectid", "issue_key")


@query(
    "later_duplicates",
    f"""SELECT objectid, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY objectid) AS n FROM pipes WHERE NOT {blank('asset_id')}) WHERE n > 1""",
)
def later_duplicates(s, sf):
    return R.later_duplicates(pipes(s, sf), "asset_id").select("objectid", "asset_id")


@query(
    "missing_required",
    """SELECT objectid AS ordinal, concat_ws(';', CASE WHEN project_id IS NULL OR project_id = '' THEN 'project_id' END, CASE WHEN x IS NULL THEN 'geometry' END) AS missing
       FROM manholes WHERE project_id IS NULL OR project_id = '' OR x IS NULL""",
)
def missing_required(s, sf):
    m = manholes(s, sf).withColumn("geometry", F.to_json("geometry"))
    return R.missing_required(m, ["project_id", "geometry"]).select("ordinal", F.array_join("missing", ";").alias("missing"))


#: Parts of the rule table that these queries need.
RULES = [
    ("WW_ID_002", "Identity", "high"), ("WW_ID_004", "Identity", "high"), ("WW_ID_001", "Identity", "high"), ("WW_ID_003", "Identity", "high"),
    *[(f"WW_ATTR_00{k}", "Attributes", "low" if k == 6 else "medium") for k in range(1, 9)],
    *[(f"WW_GEOM_00{k}", "Geometry", "high" if k < 3 else "low" if k == 3 else "medium") for k in range(1, 8)],
    *[(f"WW_FLOW_00{k}", "Connectivity", "low" if k in (2, 3) else "medium") for k in range(1, 6)],
]


def rules_table(s: SparkSession) -> DataFrame:
    rows = [(c, f"Rule {c}", k, v, "", "", "") for c, k, v in RULES]
    return s.createDataFrame(rows, "rule_code string, name string, category string, severity string, description string, detection_method string, recommended_action string")


_NS = "unhex('6ba7b8119dad11d180b400c04fd430c8')"


@query(
    "issue_ids",
    f"""SELECT source_objectid, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', ('89ab')[(('0x' || h[17])::INT % 4) + 1], h[18:20], '-', h[21:32]) AS issue_id FROM (
        SELECT CAST(objectid AS VARCHAR) AS source_objectid,
               sha1({_NS} || encode(concat('utilities-platform:wastewater:run-1|WW_ATTR_004|wastewater_gravity_main|', objectid, '||', diameter))) AS h
        FROM pipes WHERE coalesce({num('diameter')} < 4 OR {num('diameter')} > 240, true))""",
)
def issue_ids(s, sf):
    return R.issues(R.invalid_diameter(pipes(s, sf)), rules_table(s), "run-1", "2024-01-01").select("source_objectid", "issue_id")


_ALL_RULES = " UNION ALL ".join(
    [
        f"SELECT '{c}' AS rule_code, '{l}' AS layer, objectid FROM {t} WHERE {w}"
        for c, t, l, w in [
            ("WW_ID_002", "manholes", "m", f"NOT {blank('asset_id')} AND trim(asset_id) IN (SELECT trim(asset_id) FROM manholes GROUP BY 1 HAVING count(*) > 1)"),
            ("WW_ID_004", "pipes", "p", f"NOT {blank('asset_id')} AND trim(asset_id) IN (SELECT trim(asset_id) FROM pipes GROUP BY 1 HAVING count(*) > 1)"),
            ("WW_ATTR_004", "pipes", "p", f"coalesce({num('diameter')} < 4 OR {num('diameter')} > 240, true)"),
            ("WW_GEOM_003", "pipes", "p", f"coalesce({LEN}, 0) < 5"),
        ]
    ]
)


@query(
    "qa_summary",
    f"""WITH i AS (SELECT DISTINCT * FROM ({_ALL_RULES})),
        r AS (SELECT i.*, CASE WHEN rule_code LIKE 'WW_ID%' THEN 'high' WHEN rule_code LIKE 'WW_ATTR%' THEN 'medium' ELSE 'low' END AS severity FROM i)
        SELECT severity, rule_code, count(*) AS issues, count(DISTINCT objectid) FILTER (layer = 'p') AS pipes, count(DISTINCT objectid) FILTER (layer = 'm') AS manholes
        FROM r GROUP BY GROUPING SETS ((severity), (rule_code), ())""",
)
def qa_summary(s, sf):
    from gridwright.operators.review import qa_summary as summary

    p, m = pipes(s, sf), manholes(s, sf)
    found = R.duplicate_id(m, "WW_ID_002", R.MANHOLE).unionByName(R.duplicate_id(p, "WW_ID_004", R.PIPE)).unionByName(R.invalid_diameter(p)).unionByName(R.short_pipe(p, 5.0))
    return summary(R.issues(found, rules_table(s), "run-1", "2024-01-01"), ["severity"], ["rule_code"])


_E = """e AS (SELECT objectid, k AS "end", CASE k WHEN 'start' THEN sx WHEN 'end' THEN CASE vertices WHEN 3 THEN sx ELSE ex END END AS x,
        CASE k WHEN 'start' THEN sy ELSE CASE vertices WHEN 3 THEN sy ELSE ey END END AS y
        FROM pipes, (VALUES ('start'), ('end')) t(k) WHERE vertices >= 2),
    pt AS MATERIALIZED (SELECT * FROM e), mm AS MATERIALIZED (SELECT objectid, x, y FROM manholes WHERE x IS NOT NULL),
    b AS MATERIALIZED (SELECT pt.objectid, pt."end", min({'d': (pt.x - mm.x) * (pt.x - mm.x) + (pt.y - mm.y) * (pt.y - mm.y), 'o': mm.objectid}) AS best FROM pt, mm GROUP BY 1, 2),
    n AS MATERIALIZED (SELECT objectid, "end", best.o AS near_id, sqrt(best.d) AS distance FROM b)"""


@query("nearest_manhole", f'WITH {_E} SELECT objectid, "end", near_id, distance FROM n')
def nearest_manhole(s, sf):
    return N.match_endpoints(pipes(s, sf), manholes(s, sf)).select("objectid", "end", "near_id", "distance")


@query("pipe_endpoints", f'WITH {_E} SELECT objectid, "end", x, y FROM e')
def pipe_endpoints(s, sf):
    return N.pipe_endpoints(pipes(s, sf)).drop("asset_id")


@query(
    "endpoint_gaps",
    f"""WITH {_E} SELECT c AS rule_code, CAST(objectid AS VARCHAR) AS source_objectid, "end" AS issue_key, CAST(near_id AS VARCHAR) AS related_objectid
        FROM n, (VALUES ('WW_NET_001', 3), ('WW_NET_003', 10)) t(c, t) WHERE distance > t""",
)
def endpoint_gaps(s, sf):
    return N.gap_findings(N.match_endpoints(pipes(s, sf), manholes(s, sf))).select("rule_code", "source_objectid", "issue_key", "related_objectid")


_DEG = f"""{_E}, dg AS (SELECT m.objectid, count(n.objectid) AS degree FROM manholes m LEFT JOIN n ON n.near_id = m.objectid AND distance <= 3 GROUP BY 1)"""


@query(
    "manhole_degrees",
    f"""WITH {_DEG} SELECT c AS rule_code, CAST(objectid AS VARCHAR) AS source_objectid, degree
        FROM dg, (VALUES ('WW_NET_002'), ('WW_NET_007'), ('WW_NET_008')) t(c) WHERE (degree = 0 AND c <> 'WW_NET_008') OR (degree > 6 AND c = 'WW_NET_008')""",
)
def manhole_degrees(s, sf):
    m = manholes(s, sf)
    return N.degree_findings(N.manhole_degrees(N.match_endpoints(pipes(s, sf), m), m)).drop("source_layer")


_COMP = f"""{_DEG}, ed AS MATERIALIZED (SELECT DISTINCT objectid * 2 + 1 AS a, near_id * 2 AS b FROM n WHERE distance <= 3),
    sym AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    reach AS (SELECT a AS id, a AS root FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.id AND reach.root < sym.b),
    low AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
    nodes AS (SELECT 'pipe' AS kind, objectid, objectid * 2 + 1 AS id FROM pipes UNION ALL SELECT 'manhole', objectid, objectid * 2 FROM manholes),
    memb AS MATERIALIZED (SELECT kind, objectid, coalesce(component, nodes.id) AS component FROM nodes LEFT JOIN low ON low.id = nodes.id),
    ct AS (SELECT component, count(*) FILTER (kind = 'pipe') AS pipe_count, count(*) FILTER (kind = 'manhole') AS manhole_count,
           array_to_string(list(objectid ORDER BY objectid) FILTER (kind = 'pipe'), ';') AS pipe_objectids, array_to_string(list(objectid ORDER BY objectid) FILTER (kind = 'manhole'), ';') AS manhole_objectids,
           min(objectid) FILTER (kind = 'manhole') AS fm, min(objectid) FILTER (kind = 'pipe') AS fp FROM memb GROUP BY component),
    tab AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pipe_count DESC, manhole_count DESC, fm NULLS LAST, fp NULLS LAST) AS component_id FROM ct)"""


def _members(s, sf):
    p, m = pipes(s, sf), manholes(s, sf)
    matches = N.match_endpoints(p, m)
    return p, m, matches, N.components(p, m, matches)


@query("components", f"WITH RECURSIVE {_COMP} SELECT component_id, component, pipe_count, manhole_count, coalesce(pipe_objectids, '') AS pipe_objectids, coalesce(manhole_objectids, '') AS manhole_objectids FROM tab")
def components(s, sf):
    return N.component_table(_members(s, sf)[3])


@query(
    "component_findings",
    f"""WITH RECURSIVE {_COMP} SELECT 'WW_NET_005' AS rule_code, component FROM tab WHERE pipe_count > 0 AND pipe_count + manhole_count < (SELECT max(pipe_count + manhole_count) FROM tab)
        UNION ALL SELECT 'WW_NET_006', component FROM tab WHERE pipe_count = 1""",
)
def component_findings(s, sf):
    return N.component_findings(N.component_table(_members(s, sf)[3]))


@query(
    "network_summary",
    f"""WITH RECURSIVE {_COMP}, a AS (SELECT count(*) AS components, max(pipe_count + manhole_count) AS largest_size, max(pipe_count) AS largest_pipes, count(*) FILTER (pipe_count + manhole_count = 1) AS isolated_components,
          count(*) FILTER (pipe_count = 1) AS isolated_pipes, count(*) FILTER (pipe_count = 0 AND manhole_count = 1) AS isolated_manholes FROM tab),
        z AS (SELECT count(*) FILTER (distance <= 3) AS matched, count(*) FILTER (distance > 3) AS unmatched, {V.rounded_sql("count(*) FILTER (distance <= 3) / count(*)", 4)} AS match_rate,
          {V.rounded_sql("CAST(sum(CAST(distance AS DECIMAL(38,9))) FILTER (distance <= 3) AS DOUBLE) / count(*) FILTER (distance <= 3)", 4)} AS mean_distance, {V.rounded_sql("max(distance) FILTER (distance <= 3)", 4)} AS max_distance FROM n)
        SELECT a.*, z.*, (SELECT count(*) FROM dg WHERE degree > 6) AS high_degree FROM a, z""",
)
def network_summary(s, sf):
    p, m, matches, members = _members(s, sf)
    return N.network_summary(N.component_table(members), matches, N.manhole_degrees(matches, m))


_SEG = """sg AS (SELECT objectid, 0 AS i, sx AS ax, sy AS ay, ex AS bx, ey AS b_y FROM pipes WHERE vertices >= 2
    UNION ALL SELECT objectid, 1, ex, ey, sx, sy FROM pipes WHERE vertices = 3),
  sb AS MATERIALIZED (SELECT *, least(ax, bx) AS x0, greatest(ax, bx) AS x1, least(ay, b_y) AS y0, greatest(ay, b_y) AS y1 FROM sg),
  sc AS MATERIALIZED (SELECT *, unnest(range(CAST(floor(x0 / 50) AS BIGINT), CAST(floor(x1 / 50) AS BIGINT) + 1)) AS cx FROM sb),
  pr AS (SELECT DISTINCT l.objectid AS lo, r.objectid AS ro, l.i AS li, r.i AS ri, l.ax AS lax, l.ay AS lay, l.bx AS lbx, l.b_y AS lby, r.ax AS rax, r.ay AS ray, r.bx AS rbx, r.b_y AS rby
         FROM sc l JOIN sc r ON l.cx = r.cx AND floor(l.y0 / 500) <= floor(r.y1 / 500) AND l.objectid < r.objectid AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1),
  dn AS (SELECT *, (lax - lbx) * (ray - rby) - (lay - lby) * (rax - rbx) AS den FROM pr),
  tu AS (SELECT *, ((lax - rax) * (ray - rby) - (lay - ray) * (rax - rbx)) / den AS t, -((lax - lbx) * (lay - ray) - (lay - lby) * (lax - rax)) / den AS u FROM dn WHERE abs(den) >= 1e-9),
  ft AS (SELECT lo, ro, min({'li': li, 'ri': ri, 'x': lax + t * (lbx - lax), 'y': lay + t * (lby - lay)}) AS m FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1, 2),
  px AS (SELECT lo, ro, m.x AS x, m.y AS y FROM ft)"""


@query(
    "crossings",
    f"""WITH {_SEG} SELECT lo AS objectid, ro AS related_objectid, {V.rounded_sql("x", 6)} AS x, {V.rounded_sql("y", 6)} AS y FROM px
        WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.objectid IN (lo, ro) AND ((ax - px.x) * (ax - px.x) + (ay - px.y) * (ay - px.y) <= 1e-6 OR (bx - px.x) * (bx - px.x) + (b_y - px.y) * (b_y - px.y) <= 1e-6))
        AND NOT EXISTS (SELECT 1 FROM manholes m WHERE (m.x - px.x) * (m.x - px.x) + (m.y - px.y) * (m.y - px.y) <= 9 AND m.x BETWEEN px.x - 3 AND px.x + 3)""",
)
def crossings(s, sf):
    return N.crossings(pipes(s, sf), manholes(s, sf)).select("objectid", "related_objectid", V.rounded(F.col("x"), 6).alias("x"), V.rounded(F.col("y"), 6).alias("y"))


_two = lambda c: V.rounded_sql(c, 2)
_mean = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(38,9))) AS DOUBLE) / count({c})"
_EXT = f"""{_COMP}, vx AS (SELECT 'pipe' AS kind, objectid, sx AS x, sy AS y FROM pipes WHERE vertices >= 1 UNION ALL SELECT 'pipe', objectid, ex, ey FROM pipes WHERE vertices >= 2
    UNION ALL SELECT 'pipe', objectid, sx, sy FROM pipes WHERE vertices = 3 UNION ALL SELECT 'manhole', objectid, x, y FROM manholes WHERE x IS NOT NULL),
  bx AS (SELECT component, {_two("min(x)")} AS x_min, {_two("max(x)")} AS x_max, {_two("min(y)")} AS y_min, {_two("max(y)")} AS y_max, {_two(_mean("x"))} AS cx, {_two(_mean("y"))} AS cy FROM vx JOIN memb USING (kind, objectid) GROUP BY 1),
  ln AS (SELECT component, {_two(f"CAST(sum(CAST(({LEN}) AS DECIMAL(38,9))) AS DOUBLE)")} AS total_length FROM memb JOIN pipes USING (objectid) WHERE kind = 'pipe' GROUP BY 1),
  un AS (SELECT component, count(*) AS unmatched FROM n JOIN memb ON memb.kind = 'pipe' AND memb.objectid = n.objectid, (VALUES (3), (10)) t(t) WHERE distance > t GROUP BY 1)"""


@query(
    "component_extents",
    f"""WITH RECURSIVE {_EXT} SELECT tab.component, pipe_count, manhole_count, coalesce(total_length, 0) AS total_length, coalesce(unmatched, 0) AS unmatched_endpoints, x_min, x_max, y_min, y_max, cx, cy,
        CASE WHEN pipe_count + manhole_count <= 1 THEN 'isolated' ELSE 'connected_component' END AS isolated_status, CASE WHEN pipe_count + manhole_count > 500 THEN 'primary_network' ELSE 'unknown' END AS likely_class
        FROM tab LEFT JOIN bx USING (component) LEFT JOIN ln USING (component) LEFT JOIN un USING (component)""",
)
def component_extents(s, sf):
    p, m, matches, members = _members(s, sf)
    return N.component_extents(members, p, m, N.gap_findings(matches))


@query(
    "nearest_component",
    f"""WITH RECURSIVE {_EXT}, cc AS MATERIALIZED (SELECT component, cx, cy FROM bx)
        SELECT a.component, {_two("sqrt(min((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)))")} AS nearest_distance FROM cc a, cc b WHERE a.component <> b.component GROUP BY 1""",
)
def nearest_component(s, sf):
    p, m, matches, members = _members(s, sf)
    return N.nearest_component(N.component_extents(members, p, m, N.gap_findings(matches)))


@query(
    "extent_overlap",
    """WITH b AS (SELECT layer_id, submission_id, srs, (layer_id % 100) * 10 AS x_min, (layer_id % 100) * 10 + record_count AS x_max, (layer_id % 70) * 10 AS y_min, (layer_id % 70) * 10 + record_count AS y_max FROM layers)
       SELECT layer_id FROM b WHERE layer_id % 9 <> 0 AND EXISTS (SELECT 1 FROM b a WHERE a.layer_id % 9 = 0 AND a.srs = b.srs AND a.x_min <= b.x_max AND b.x_min <= a.x_max AND a.y_min <= b.y_max AND b.y_min <= a.y_max)""",
)
def extent_overlap(s, sf):
    b = derive(s, sf, "layers").selectExpr("layer_id", "srs", "(layer_id % 100) * 10 AS x_min", "(layer_id % 100) * 10 + record_count AS x_max", "(layer_id % 70) * 10 AS y_min", "(layer_id % 70) * 10 + record_count AS y_max")
    return N.extents_overlap(b.where("layer_id % 9 <> 0"), b.where("layer_id % 9 = 0")).select("layer_id")


_PF = ["asset_id", "diameter", "material", "yr", "lifecycle", "operational"]
_MELT = "c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM pipes" for f in _PF) + ")"


@query(
    "field_profile",
    f"""WITH {_MELT}, g AS (SELECT field, value, count(*) AS n, {blank('value')} AS b FROM c GROUP BY ALL),
        t AS (SELECT field, sum(n) AS r, coalesce(sum(n) FILTER (b), 0) AS null_count, count(*) FILTER (NOT b) AS distinct_count FROM g GROUP BY 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM g WHERE NOT b AND length(value) <= 80)
        SELECT field, CAST(null_count AS BIGINT) AS null_count, {V.rounded_sql("null_count * 100.0 / r", 2)} AS null_percentage, distinct_count,
               (SELECT string_agg(concat(value, '=', n), ';' ORDER BY k.k) FROM k WHERE k.field = t.field AND k.k <= 8) AS top_values FROM t""",
)
def field_profile(s, sf):
    return P.field_profile(pipes(s, sf), _PF)


@query(
    "catalog_profile",
    f"""WITH {_MELT}, g AS (SELECT field, value, count(*) AS n, {blank('value')} AS b FROM c GROUP BY ALL)
        SELECT field, CASE WHEN field = 'asset_id' THEN CAST(sum(n - 1) FILTER (NOT b) AS BIGINT) ELSE 0 END AS duplicate_ids, min(value) FILTER (NOT b) AS smallest, max(value) FILTER (NOT b) AS largest FROM g GROUP BY 1""",
)
def catalog_profile(s, sf):
    return P.catalog_profile(pipes(s, sf), _PF, "asset_id").select("field", "duplicate_ids", "smallest", "largest")


@query(
    "pattern_profile",
    f"""WITH {_MELT}, g AS (SELECT field, regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS p, count(*) AS n FROM c GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p) AS k FROM g WHERE NOT {blank('p')})
        SELECT field, CAST(coalesce(sum(n) FILTER ({blank('p')}), 0) AS BIGINT) AS null_count, count(*) FILTER (NOT {blank('p')}) AS pattern_count,
               (SELECT string_agg(p, ';' ORDER BY p) FROM k WHERE k.field = g.field AND k.k <= 10) AS patterns FROM g GROUP BY field""",
)
def pattern_profile(s, sf):
    return P.pattern_profile(pipes(s, sf), _PF)


@query(
    "field_mapping",
    f"""WITH {_MELT}, r(role, field, confidence) AS (VALUES ('asset_id', 'asset_id', 'high'), ('diameter', 'diameter', 'medium'), ('project_id', 'project', 'high')),
        t AS (SELECT field, count(DISTINCT value) FILTER (NOT {blank('value')}) AS distinct_count FROM c GROUP BY 1)
        SELECT role, r.field, CASE WHEN t.field IS NULL THEN 'unavailable' ELSE confidence END AS confidence, distinct_count FROM r LEFT JOIN t USING (field)""",
)
def field_mapping(s, sf):
    roles = s.createDataFrame([("asset_id", "asset_id", "high"), ("diameter", "diameter", "medium"), ("project_id", "project", "high")], "role string, field string, confidence string")
    return P.field_mapping(roles, P.field_profile(pipes(s, sf), _PF)).drop("null_percentage")


#: Words that name the usual roles of fields.
ROLE_WORDS = {"identifier": ["asset_id", "facilityid", "objectid"], "material": ["material"], "diameter": ["diam"], "owner": ["owner"], "status": ["status", "lifecycle"], "date": ["date"]}


@query(
    "role_fields",
    "WITH w(role, k, word) AS (VALUES " + ", ".join(f"('{r}', {k}, '{w}')" for r, ws in ROLE_WORDS.items() for k, w in enumerate(ws)) + ")"
    """ SELECT layer_id, role, (list(field_name ORDER BY k, field_pos))[1] AS field_name FROM fields JOIN w ON contains(lower(field_name), word) GROUP BY 1, 2""",
)
def role_fields(s, sf):
    return P.role_fields(derive(s, sf, "fields"), ROLE_WORDS)


#: Field names and the columns that they fill.
FIELD_ALIASES = {"material": ("material", "domain_mapping"), "diameter": ("diameter", "numeric_parse"), "owner": ("owner_candidate", "normalized_text"), "installdate": ("installation_date", "date_parse"), "status": ("lifecycle_status", "lifecycle_mapping"), "notes": ("notes", "direct")}


@query(
    "recommended_fields",
    "WITH a(f, target, how) AS (VALUES " + ", ".join(f"('{k}', '{t}', '{h}')" for k, (t, h) in FIELD_ALIASES.items()) + "),"
    """ d AS (SELECT *, regexp_replace(lower(field_name), '[^a-z0-9]', '', 'g') AS f FROM fields),
        x AS (SELECT d.*, f IN ('objectid', 'assetid', 'facilityid') AS is_id, count(*) FILTER (f IN ('objectid', 'assetid', 'facilityid')) OVER (PARTITION BY layer_id ORDER BY field_pos) = 1 AND f IN ('objectid', 'assetid', 'facilityid') AS first_id FROM d)
        SELECT layer_id, field_name, CASE WHEN first_id THEN 'source_asset_identifier' ELSE coalesce(target, 'unmapped') END AS target,
               CASE WHEN first_id THEN 'normalized_identifier' ELSE coalesce(how, 'unmapped') END AS transformation, CASE WHEN first_id OR target IS NOT NULL THEN 'high' ELSE 'unavailable' END AS confidence
        FROM x LEFT JOIN a USING (f)""",
)
def recommended_fields(s, sf):
    return P.recommended_fields(derive(s, sf, "fields"), FIELD_ALIASES, ["objectid", "assetid", "facilityid"])


@query(
    "completeness",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (NOT {blank(f)}{' AND ' + num(f) + ' > 0' if f == 'diameter' else ''}) AS present, count(*) AS total FROM pipes" for f in _PF) + ")",
)
def completeness(s, sf):
    return P.completeness(pipes(s, sf), _PF, ["diameter"])


@query(
    "identity_metrics",
    f"""WITH g AS (SELECT trim(asset_id) AS id, count(*) AS n FROM pipes WHERE NOT {blank('asset_id')} GROUP BY 1)
        SELECT (SELECT count(*) FROM pipes) AS total, CAST(sum(n) AS BIGINT) AS present, count(*) AS distinct_ids, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM g""",
)
def identity_metrics(s, sf):
    return P.identity_metrics(pipes(s, sf), "asset_id")


@query(
    "standard_values",
    """SELECT objectid,
        CASE k WHEN '' THEN 'unknown' WHEN 'pvc' THEN 'pvc' WHEN 'polyvinyl chloride' THEN 'pvc' WHEN 'ductile iron' THEN 'ductile_iron' WHEN 'clay' THEN 'clay' WHEN 'vcp' THEN 'clay' WHEN 'rcp' THEN 'reinforced_concrete' WHEN 'ac' THEN 'asbestos_cement' ELSE 'other' END AS material_code,
        CASE WHEN regexp_full_match(diameter, '[0-9]+') THEN CAST(diameter AS DOUBLE) END AS diameter_value,
        CASE WHEN regexp_full_match(diameter, '[0-9]+') THEN 'medium' ELSE 'unavailable' END AS diameter_confidence,
        CASE regexp_replace(lower(lifecycle), '[^a-z0-9]+', '', 'g') WHEN 'decommissioned' THEN 'retired' WHEN 'active' THEN 'active' WHEN 'abandoned' THEN 'abandoned' WHEN 'retired' THEN 'retired' WHEN 'proposed' THEN 'proposed' WHEN 'removed' THEN 'removed' ELSE 'unknown' END AS lifecycle_code
       FROM (SELECT *, trim(regexp_replace(lower(material), '[_-]+', ' ', 'g')) AS k FROM pipes)""",
)
def standard_values(s, sf):
    d = pipes(s, sf).withColumn("dia", V.diameter(F.col("diameter"), "inch"))
    return d.select("objectid", V.material(F.col("material"))["code"].alias("material_code"), F.col("dia.value").alias("diameter_value"), F.col("dia.confidence").alias("diameter_confidence"), V.status(F.col("lifecycle"))["code"].alias("lifecycle_code"))


@query(
    "layer_names",
    """SELECT layer_id, regexp_replace(lower(regexp_replace(layer_name, '(_|-)?WGS84$', '')), '[^a-z0-9]+', '', 'g') AS name_key,
        regexp_replace(regexp_replace(layer_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS pattern,
        CASE WHEN contains(lower(layer_name), 'proposed') THEN 'proposed' WHEN contains(lower(layer_name), 'final') THEN 'final_as_built' ELSE 'existing' END AS signal FROM layers""",
)
def layer_names(s, sf):
    c = F.col("layer_name")
    return derive(s, sf, "layers").select("layer_id", V.name_key(c).alias("name_key"), V.value_pattern(c).alias("pattern"), V.lifecycle_signal(c).alias("signal"))


_FOLD = lambda c: f"trim(regexp_replace(lower(CAST({c} AS VARCHAR)), '\\s+', ' ', 'g'))"


@query("stable_ids", f"""SELECT objectid, concat('asset_', left(sha256(concat_ws('|', 'water', CAST(objectid AS VARCHAR), {_FOLD("asset_id")}, {_FOLD("lifecycle")})), 20)) AS asset_key FROM pipes""")
def stable_ids(s, sf):
    return pipes(s, sf).select("objectid", V.stable_id("asset", F.lit(" Water"), F.col("objectid"), F.col("asset_id"), F.col("lifecycle")).alias("asset_key"))


_AT = lambda c: f"CAST({V.rounded_sql(c, 2)} AS VARCHAR)"
_SIGN = f"""CASE WHEN vertices = 0 THEN 'geom:none' ELSE concat_ws(':', 'line', {_AT('sx')}, {_AT('sy')}, {_AT('CASE vertices WHEN 2 THEN ex ELSE sx END')}, {_AT('CASE vertices WHEN 2 THEN ey ELSE sy END')}, {_AT(f'({LEN})')}) END"""


@query(
    "issue_fingerprints",
    f"""SELECT objectid, sha256(concat('{{"asset_key":"', {_FOLD(f"CASE WHEN {blank('asset_id')} THEN CAST(objectid AS VARCHAR) ELSE asset_id END")}, '","geometry":"', {_SIGN}, '","related_key":"","rule_code":"ww_geom_003","source_layer":"wastewater_gravity_main","threshold":"5.0 ft","utility_system":"wastewater"}}')) AS fingerprint
        FROM pipes WHERE coalesce({LEN}, 0) < 5""",
)
def issue_fingerprints(s, sf):
    p = pipes(s, sf)
    found = R.short_pipe(p, 5.0).join(p.select(F.col("objectid").cast("string").alias("source_objectid"), "objectid", "geometry"), "source_objectid")
    key = F.when(F.col("source_asset_id") == "", F.col("source_objectid")).otherwise(F.col("source_asset_id"))
    print_ = V.issue_fingerprint(F.lit("Wastewater"), F.col("source_layer"), key, F.col("rule_code"), F.col("related_objectid"), F.col("geometry"), F.lit(" 5.0  ft"))
    return found.select("objectid", print_.alias("fingerprint"))


@query("all_layer_rules")
def all_layer_rules(s, sf):
    # the layers are derived once and kept; every rule reads what it needs of them
    return R.issues(R.run_rules(N.cut(pipes(s, sf)), N.cut(manholes(s, sf))), rules_table(s), "run-1", "2024-01-01")
