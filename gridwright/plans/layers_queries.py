"""Queries over the derived source layers, submissions and catalogs and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import layers as L
from gridwright.operators import plans as M
from gridwright.plans.bridge import derive, sql_of
from gridwright.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql_of(name, sql)
        return f

    return add


#: Part of a rule table (pattern, targets, confidence, score).
RULES = [
    ("R_FORCE", 1, "force_?main", ["wastewater/pressurized/force_main"], "high", 0.93),
    ("R_SEWER", 2, "sewer", ["wastewater/gravity/gravity_main", "wastewater/pressurized/force_main"], "low", 0.6),
    ("R_WATERLINE", 3, "water_?line", ["water/distribution/water_main", "environmental_regulatory/hydrography/stream"], "medium", 0.62),
    ("R_MANHOLE", 4, "manhole", ["wastewater/structures/manhole"], "high", 0.9),
    ("R_GRAVITY", 5, "gravity", ["wastewater/gravity/gravity_main"], "high", 0.92),
    ("R_STREAM", 6, "stream", ["environmental_regulatory/hydrography/stream"], "high", 0.9),
    ("R_PARCEL", 7, "parcel", ["shared_reference/land/parcel"], "high", 0.95),
    ("R_FIBER", 8, "fiber", ["telecom/fiber/cable"], "medium", 0.8),
]
SYSTEMS = {"wastewater": ["sewer", "manhole", "force", "gravity", "lift"], "water": ["water", "hydrant", "valve"], "electric": ["electric", "pole"], "telecom": ["fiber", "telecom"]}
KINDS = {"manhole": ["manhole"], "force_main": ["force"], "gravity_main": ["gravity", "sewer"], "water_main": ["water"], "pole": ["pole"]}


def layers(s, sf):
    return derive(s, sf, "layers")


def candidates(s, sf):
    rules = s.createDataFrame(RULES, "rule_code string, rule_order int, pattern string, targets array<string>, confidence string, score double")
    return L.classify(layers(s, sf).select("layer_id", F.lower("layer_name").alias("text")), rules)


_HITS = " UNION ALL ".join(
    f"SELECT layer_id, '{c}' AS rule_code, {o} AS ro, {k} AS off, '{t}' AS target, '{conf}' AS confidence, round({sc} - {k} * 0.03, 4) AS score FROM layers WHERE regexp_matches(lower(layer_name), '{p}')"
    for c, o, p, ts, conf, sc in RULES
    for k, t in enumerate(ts)
)
CAND = f"""h AS (SELECT * FROM ({_HITS})), h2 AS (SELECT * FROM h UNION ALL SELECT layer_id, 'ULR_UNAVAILABLE', 0, 0, 'review_required', 'unavailable', 0.0 FROM layers WHERE layer_id NOT IN (SELECT layer_id FROM h)),
  cd AS (SELECT layer_id, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY score DESC, ro, off) AS INTEGER) AS rank, rule_code, target, confidence, CAST(score AS DOUBLE) AS score FROM h2)"""

query("layer_candidates", f"WITH {CAND} SELECT * FROM cd")(candidates)
_SCORES = {n: " + ".join(f"contains(lower(layer_name), '{w}')::INT" for w in ws) for n, ws in SYSTEMS.items()}
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(layer_name), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in KINDS.items()) + " ELSE 'unknown' END"


@query(
    "keyword_classes",
    f"""WITH x AS (SELECT layer_id, {', '.join(f'{e} AS {n}' for n, e in _SCORES.items())}, {_KIND} AS a FROM layers), y AS (SELECT *, greatest({', '.join(_SCORES)}) AS b FROM x)
        SELECT layer_id, CASE WHEN b = 0 THEN 'unknown' {' '.join(f"WHEN {n} = b THEN '{n}'" for n in _SCORES)} END AS system, CAST(b AS BIGINT) AS score, CASE WHEN b = 0 THEN 'unknown' ELSE a END AS asset,
          CASE WHEN b = 0 THEN 'unknown' WHEN b >= 2 AND a <> 'unknown' THEN 'high' ELSE 'medium' END AS confidence FROM y""",
)
def keyword_classes(s, sf):
    return L.keyword_classify(layers(s, sf).select("layer_id", F.lower("layer_name").alias("text")), SYSTEMS, KINDS)


@query(
    "routing_states",
    f"""WITH {CAND}, t AS (SELECT layer_id, count(*) AS n, arg_min(target, rank) AS target, arg_min(confidence, rank) AS c FROM cd GROUP BY 1)
        SELECT layer_id, CASE split_part(target, '/', 1) WHEN 'shared_reference' THEN 'shared_reference_candidate' WHEN 'environmental_regulatory' THEN 'environmental_reference_candidate' ELSE
          CASE WHEN n > 1 AND c IN ('low', 'medium') THEN 'needs_taxonomy_review' WHEN c = 'high' THEN 'ready_for_classification_review' WHEN c = 'medium' THEN 'needs_taxonomy_review' WHEN c = 'low' THEN 'needs_source_owner_confirmation' ELSE 'needs_data_owner_confirmation' END END AS state FROM t""",
)
def routing_states(s, sf):
    return L.routing_state(candidates(s, sf))


COORD = """co AS (SELECT layer_id, CASE WHEN lower(srs) IN ('', 'unknown') THEN 'unknown_spatial_reference' WHEN contains(lower(layer_name), 'wgs') AND NOT contains(lower(srs), 'wgs') THEN 'name_and_metadata_conflict'
   WHEN count(DISTINCT CASE WHEN srs NOT IN ('', 'unknown') THEN srs END) OVER (PARTITION BY submission_id) > 1 THEN 'mixed_source_spatial_references' ELSE 'coordinate_ready' END AS coordinate_status FROM layers)"""
query("coordinate_status", f"WITH {COORD} SELECT * FROM co")(lambda s, sf: L.coordinate_status(layers(s, sf)))

_SIG = "regexp_replace(lower(regexp_replace(trim(layer_name), '(?i)[_-]?wgs84$', '')), '[^a-z0-9]+', '', 'g')"
for _old, _new in L.SIGNATURE:
    _SIG = f"replace({_SIG}, '{_old}', '{_new}')"
DUP = f"dp AS (SELECT submission_id, {_SIG} AS signature, count(*) AS members, list(layer_id ORDER BY layer_id) AS layer_ids FROM layers GROUP BY 1, 2 HAVING count(*) > 1)"


@query("duplicate_layers", f"WITH {DUP} SELECT submission_id, signature, members, array_to_string(layer_ids, ';') AS layer_ids, CASE WHEN submission_id % 7 = 0 THEN 'separate' ELSE 'potential_duplicate' END AS status FROM dp")
def duplicate_layers(s, sf):
    prior = L.duplicate_groups(layers(s, sf)).select("submission_id", "signature", F.when(F.col("submission_id") % 7 == 0, "separate").otherwise("potential_duplicate").alias("status"))
    d = L.duplicate_groups(layers(s, sf), prior)
    return d.withColumn("layer_ids", F.array_join(F.col("layer_ids").cast("array<string>"), ";"))


@query(
    "package_prefixes",
    """SELECT layer_id, CASE WHEN submission_id % 3 = 0 AND layer_id % 8 <> 0 AND n8 >= greatest(5, floor((n + 1) / 2)) THEN layer_name ELSE full_name END AS canonical_name FROM (
         SELECT layer_id, submission_id, layer_name, CASE WHEN submission_id % 3 = 0 AND layer_id % 8 <> 0 THEN concat('Enterprise_GIS_DBO_', layer_name) ELSE layer_name END AS full_name,
                count(*) OVER (PARTITION BY submission_id) AS n, count(*) FILTER (submission_id % 3 = 0 AND layer_id % 8 <> 0) OVER (PARTITION BY submission_id) AS n8 FROM layers)""",
)
def package_prefixes(s, sf):
    d = layers(s, sf)
    name = F.when((F.col("submission_id") % 3 == 0) & (F.col("layer_id") % 8 != 0), F.concat(F.lit("Enterprise_GIS_DBO_"), "layer_name")).otherwise(F.col("layer_name"))
    return L.package_prefixes(d.withColumn("layer_name", name))


@query(
    "inherited_sensitivity",
    """SELECT layer_id, CASE submission_id % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'public' WHEN 2 THEN 'restricted' ELSE 'restricted' END AS sensitivity, CASE WHEN s THEN 'needs_sensitivity_review' ELSE 'inherited_from_package' END AS status,
         submission_id % 4 = 1 AND NOT s AS public_use_allowed, submission_id % 4 = 1 AND NOT s AS export_allowed
       FROM layers JOIN (SELECT layer_id, bool_or(contains(replace(lower(field_name), '_', ''), 'customerphone') OR contains(lower(field_name), 'owner')) AS s FROM fields GROUP BY 1) USING (layer_id)""",
)
def inherited_sensitivity(s, sf):
    k = F.col("submission_id") % 4
    levels = layers(s, sf).select("layer_id", F.when(k == 0, "internal").when(k == 1, "public").when(k == 2, "restricted").otherwise("secret").alias("level"))
    return L.inherited_sensitivity(derive(s, sf, "fields"), levels, ["customerphone", "owner"])


DEC = f"""{CAND}, tp AS (SELECT layer_id, split_part(target, '/', 1) AS sys, score, confidence FROM cd WHERE rank = 1),
  rv AS (SELECT DISTINCT layer_id FROM cd JOIN tp t USING (layer_id) WHERE rank > 1 AND split_part(target, '/', 1) <> t.sys AND t.score - cd.score <= 0.05 + 1e-9),
  fc AS (SELECT layer_id, geometry_type <> '' AS geometry_ok, layer_id % 3 <> 0 AS corroborated, CASE WHEN layer_id % 50 = 0 THEN 'excluded' WHEN layer_id % 40 = 0 THEN 'approved' END AS manual FROM layers),
  bb AS (SELECT layer_id, manual, list_filter([CASE WHEN confidence <> 'high' THEN 'confidence' END, CASE WHEN NOT geometry_ok THEN 'geometry' END, CASE WHEN NOT corroborated THEN 'corroboration' END, CASE WHEN layer_id IN (SELECT layer_id FROM rv) THEN 'contradiction' END], lambda x: x IS NOT NULL) AS b FROM tp JOIN fc USING (layer_id)),
  td AS (SELECT layer_id, CASE WHEN manual IS NOT NULL THEN manual WHEN len(b) = 0 THEN 'approved' ELSE 'deferred' END AS status, CASE WHEN manual IS NULL THEN coalesce(array_to_string(b, ';'), '') ELSE '' END AS blockers FROM bb)"""


def decisions(s, sf):
    k = F.col("layer_id")
    facts = layers(s, sf).select("layer_id", (F.col("geometry_type") != "").alias("geometry_ok"), (k % 3 != 0).alias("corroborated"), F.when(k % 50 == 0, "excluded").when(k % 40 == 0, "approved").alias("manual"))
    return L.taxonomy_decisions(candidates(s, sf), facts)


query("taxonomy_decisions", f"WITH {DEC} SELECT * FROM td")(decisions)


@query(
    "staging_readiness",
    f"""WITH {DEC}, {COORD}, {DUP}, du AS (SELECT DISTINCT unnest(layer_ids) AS layer_id FROM dp WHERE members > 3)
        SELECT layer_id, CASE WHEN status = 'excluded' THEN 'excluded' WHEN status <> 'approved' THEN 'deferred' WHEN coordinate_status <> 'coordinate_ready' OR layer_id IN (SELECT layer_id FROM du) THEN 'staging_blocked'
          WHEN layer_id % 4 <> 0 THEN 'human_review_required' ELSE 'fully_ready_for_staging_review' END AS readiness FROM td JOIN co USING (layer_id)""",
)
def staging_readiness(s, sf):
    d = layers(s, sf)
    dup = L.duplicate_groups(d).where("members > 3").select(F.explode("layer_ids").alias("layer_id"))
    owners = d.select("layer_id", F.when(F.col("layer_id") % 4 == 0, "confirmed").otherwise("provisional").alias("owner_status"))
    return L.staging_readiness(decisions(s, sf), L.coordinate_status(d), dup, owners)


@query(
    "staging_names",
    """WITH b AS (SELECT layer_id, layer_name, submission_id, CASE WHEN regexp_matches(n, '^[a-z]') THEN n ELSE concat('layer_', n) END AS b FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(concat_ws('__', split_part(layer_name, '_', 1), geometry_type)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS n FROM layers)),
         r AS (SELECT *, row_number() OVER (PARTITION BY submission_id, b ORDER BY lower(layer_name), layer_id) AS n FROM b)
       SELECT layer_id, CASE WHEN n = 1 THEN b ELSE concat(b, '_', n) END AS target_name FROM r""",
)
def staging_names(s, sf):
    return L.staging_names(layers(s, sf), F.concat_ws("__", F.split_part("layer_name", F.lit("_"), F.lit(1)), "geometry_type"))


@query("asset_registry", """WITH x AS (SELECT from_asset_id AS asset_id, provisional FROM edges UNION ALL SELECT to_asset_id, provisional FROM edges WHERE to_asset_id <> from_asset_id), n AS (SELECT asset_id, count(*) AS c, bool_or(provisional) AS p FROM x GROUP BY 1)
  SELECT asset_id, coalesce(c, 0) AS edge_count, coalesce(p, false) AS has_provisional FROM assets LEFT JOIN n USING (asset_id)""")
def asset_registry(s, sf):
    return L.asset_registry(derive(s, sf, "assets"), derive(s, sf, "edges")).select("asset_id", "edge_count", "has_provisional")


_BY = ["vertical", "lifecycle_status", "asset_class", "owner_candidate"]


@query("registry_counts", " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, 'unknown') AS value, count(*) AS n FROM assets GROUP BY 2" for f in _BY))
def registry_counts(s, sf):
    return L.counts_by(derive(s, sf, "assets"), _BY)


@query("insert_assets", """WITH r AS (SELECT * FROM assets WHERE k % 3 = 0), c AS (SELECT asset_id, source_identifier FROM assets WHERE k % 2 = 0 AND asset_id NOT IN (SELECT asset_id FROM r) AND source_identifier NOT IN (SELECT source_identifier FROM r))
  SELECT min(asset_id) AS asset_id, source_identifier FROM c GROUP BY 2""")
def insert_assets(s, sf):
    a = derive(s, sf, "assets").select("asset_id", "source_identifier", "k")
    return L.insert_assets(a.where("k % 3 = 0"), a.where("k % 2 = 0").drop("k"), [["asset_id"], ["source_identifier"]])


@query("catalog_upsert", """WITH o AS (SELECT layer_id, layer_name, record_count FROM layers WHERE layer_id % 3 <> 0), n AS (SELECT layer_id, layer_name, record_count + CASE WHEN layer_id % 5 = 0 THEN 1 ELSE 0 END AS record_count FROM layers WHERE layer_id % 4 <> 0)
  SELECT coalesce(o.layer_id, n.layer_id) AS layer_id, coalesce(n.layer_name, o.layer_name) AS layer_name, coalesce(n.record_count, o.record_count) AS record_count,
    CASE WHEN o.layer_id IS NULL THEN 'registered' WHEN n.layer_id IS NULL THEN 'kept' WHEN o.record_count <> n.record_count THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.layer_id = n.layer_id""")
def catalog_upsert(s, sf):
    d = layers(s, sf).select("layer_id", "layer_name", "record_count")
    found = d.where("layer_id % 4 <> 0").withColumn("record_count", F.col("record_count") + F.when(F.col("layer_id") % 5 == 0, 1).otherwise(0))
    return L.catalog_upsert(d.where("layer_id % 3 <> 0"), found, ["layer_id"], ["layer_name", "record_count"])


@query("inventory_decision", """SELECT layer_id, CASE WHEN s IN ('reference', 'shared_reference') THEN 'internal' ELSE 'restricted' END AS sensitivity,
   CASE WHEN s = 'review_required' THEN 'review_required' WHEN c = 'high' AND srs <> '' THEN 'candidate_for_staging_review' WHEN c IN ('unknown', 'low') THEN 'manual_review' ELSE 'defer_until_reviewed' END AS action
   FROM (SELECT layer_id, srs, ['water', 'shared_reference', 'review_required'][layer_id % 3 + 1] AS s, ['high', 'medium', 'low', 'unknown'][layer_id % 4 + 1] AS c FROM layers)""")
def inventory_decision(s, sf):
    at = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("layer_id") % k + 1).cast("int"))
    d = layers(s, sf).withColumn("system", at(["water", "shared_reference", "review_required"], 3)).withColumn("confidence", at(["high", "medium", "low", "unknown"], 4))
    return L.inventory_decision(d)


@query("allow_list", "SELECT layer_id, layer_name, layer_id % 3 = 0 AS approved FROM layers")
def allow_list(s, sf):
    d = layers(s, sf)
    return L.allow_list(d.select("layer_id", "layer_name"), d.where("layer_id % 3 = 0").select("layer_id", F.lit(True).alias("approved")))


@query("duplicate_packages", "SELECT doc_id AS submission_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY n_chars, doc_id) AS f FROM documents)")
def duplicate_packages(s, sf):
    d = table(s, sf, "documents").select(F.col("doc_id").alias("submission_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("n_chars").alias("received_at"))
    return L.duplicate_packages(d)


@query("package_hashes", "SELECT doc_id // 50 AS submission_id, sha256(string_agg(concat(p, chr(9), strlen(coalesce(text, '')), chr(9), sha256(coalesce(text, ''))), chr(10) ORDER BY lower(p))) AS package_hash FROM (SELECT *, concat(CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'b' END, '/', doc_id) AS p FROM documents) GROUP BY 1")
def package_hashes(s, sf):
    d = table(s, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("submission_id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("b"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return L.package_hashes(d)


@query("stage_manifest", """SELECT layer_id, CASE WHEN layer_id % 8 = 0 THEN 'export' WHEN layer_id % 4 = 0 THEN 'curated' WHEN layer_id % 2 = 0 THEN 'staging' ELSE 'raw' END AS primary_stage, CASE WHEN layer_id % 8 = 0 THEN 4 WHEN layer_id % 4 = 0 THEN 3 WHEN layer_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS stages FROM layers""")
def stage_manifest(s, sf):
    d = layers(s, sf).select("layer_id")
    return L.stage_manifest({"raw": d, "staging": d.where("layer_id % 2 = 0"), "curated": d.where("layer_id % 4 = 0"), "export": d.where("layer_id % 8 = 0")}, "layer_id")


@query("missing_approved", "SELECT layer_id FROM layers WHERE layer_id % 5 = 0 AND layer_id % 2 = 0")
def missing_approved(s, sf):
    d = layers(s, sf)
    return L.approved_copies(d.select("layer_id", (F.col("layer_id") % 5 == 0).alias("approved")), d.where("layer_id % 2 = 1").select("layer_id", "layer_name"), "layer_id")[1]


_REC = f"""{CAND}, rt AS (SELECT layer_id, arg_min(split_part(target, '/', 1), rank) AS sys, arg_min(split_part(target, '/', 3), rank) AS kind, arg_min(confidence, rank) AS conf, list_sort(list(DISTINCT split_part(target, '/', 1)) FILTER (split_part(target, '/', 1) IN ('water', 'wastewater'))) AS seen FROM cd GROUP BY 1),
  r1 AS (SELECT rt.*, layer_name, CASE WHEN sys IN ('water', 'wastewater') THEN sys WHEN len(seen) = 2 THEN 'water_wastewater' WHEN len(seen) = 1 THEN seen[1] ELSE 'unknown' END AS domain FROM rt JOIN layers USING (layer_id)),
  r2 AS (SELECT *, (domain = 'water' AND list_contains({M.CLASSES['water']}, kind)) OR (domain <> 'water' AND list_contains({M.CLASSES['wastewater']}, kind)) AS known FROM r1),
  r3 AS (SELECT *, domain = 'wastewater' AND NOT known AND regexp_matches(regexp_replace(lower(concat(regexp_replace(layer_name, '(?i)[_-]?wgs84$', ''), kind)), '[^a-z0-9]+', '', 'g'), 'sewer|main|pipe') AS vague FROM r2),
  r4 AS (SELECT *, list_filter([CASE WHEN vague THEN 'behavior_unknown' END, CASE WHEN NOT vague AND NOT known THEN 'class_unsupported' END, CASE WHEN domain NOT IN ('water', 'wastewater') THEN 'domain_unconfirmed' END], lambda x: x IS NOT NULL) AS notes FROM r3),
  rc AS (SELECT layer_id, domain, CASE WHEN vague THEN 'unknown_wastewater_line' WHEN known THEN kind ELSE '' END AS asset_class, coalesce(array_to_string(notes, ';'), '') AS contradictions, CASE WHEN len(notes) > 0 THEN 'low' ELSE conf END AS confidence, CASE WHEN len(notes) > 0 THEN 'review_required' ELSE 'candidate' END AS status FROM r4)"""


def recommended(s, sf):
    return M.recommend_layers(layers(s, sf).select("layer_id", "layer_name"), candidates(s, sf))


query("recommended_layers", f"WITH {_REC} SELECT * FROM rc")(recommended)
query("mapping_summary", f"WITH {_REC} SELECT domain, status, confidence, count(*) AS layers FROM rc GROUP BY GROUPING SETS ((domain), (status), (confidence), ())")(lambda s, sf: M.mapping_summary(recommended(s, sf)))


@query("export_gate", "SELECT layer_id AS dataset_id, CASE WHEN layer_id % 2 = 0 AND (layer_id % 5 = 0 OR layer_id % 7 = 0) AND NOT (layer_id % 3 = 0 AND layer_id % 5 = 0) THEN 'refused' ELSE 'allowed' END AS decision FROM layers")
def export_gate(s, sf):
    k = F.col("layer_id")
    return M.export_gate(layers(s, sf).select(k.alias("dataset_id"), F.when(k % 2 == 0, "Restricted").otherwise("internal").alias("sensitivity"), F.when(k % 7 == 0, "/out/Sanitized_Portfolio/x").otherwise("/out/partner").alias("destination"), (k % 3 == 0).alias("sanitized"), F.when(k % 5 == 0, True).alias("approved")))


@query("cad_layers", "SELECT layer_id, CASE upper(layer_name) WHEN 'WATERLINE' THEN 'water_main' WHEN 'MANHOLES_FINAL' THEN 'manhole' ELSE 'unmapped' END AS target FROM layers")
def cad_layers(s, sf):
    return M.cad_layers(layers(s, sf), s.createDataFrame([("waterline", "water_main"), ("Manholes_Final", "manhole")], "cad_name string, target string"))


@query(
    "package_rollup",
    f"""WITH {_REC}, j AS (SELECT layers.*, domain, confidence, status, list_position(['unavailable', 'low', 'medium', 'high'], confidence) AS r FROM layers LEFT JOIN rc USING (layer_id))
        SELECT *, CASE WHEN coordinate_reviews > 0 THEN 'review_coordinates' WHEN reviews > 0 THEN 'review_classification' ELSE 'plan_staging' END AS next_action FROM (
          SELECT submission_id, count(*) AS layers, CAST(sum(record_count) AS BIGINT) AS records, count(*) FILTER (geometry_type <> '') AS spatial_layers, array_to_string(list_sort(list(DISTINCT domain)), ';') AS domains, arg_min(confidence, r) AS lowest_confidence,
            count(*) FILTER (status = 'review_required') AS reviews, count(*) FILTER (srs = '') AS coordinate_reviews FROM j GROUP BY 1)""",
)
def package_rollup(s, sf):
    return M.package_rollup(layers(s, sf), recommended(s, sf).select("layer_id", "domain", "confidence", "status"))
