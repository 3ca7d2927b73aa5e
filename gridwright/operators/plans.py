"""Mapping plans, ownership, and roll-ups of inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.values import name_key


def plan_gates(plans: DataFrame, fields: DataFrame) -> DataFrame:
    """``layer_id, fields, open_fields, blockers, status``: what keeps a mapping plan from approval.

    ``fields``: ``layer_id, is_identifier, open``; ``plans``: ``layer_id, geometry_type, srs,
    record_count, approved``.
    """
    m = fields.groupBy("layer_id").agg(F.count("*").alias("fields"), F.count_if("open").alias("open_fields"), F.bool_or("is_identifier").alias("_id"))
    d = plans.join(m, "layer_id")
    b = F.array_compact(F.array(
        F.when(~F.col("_id"), "identifier_unmapped"), F.when(F.col("open_fields") > 0, "fields_unreviewed"), F.when(F.col("geometry_type") == "", "geometry_unknown"),
        F.when(F.col("srs") == "", "spatial_reference_unknown"), F.when(F.col("record_count") == 0, "no_records"),
    ))
    status = F.when(F.size(b) > 0, "blocked").when(F.col("approved"), "approved").otherwise("ready_for_review")
    return d.select("layer_id", "fields", "open_fields", F.array_join(b, ";").alias("blockers"), status.alias("status"))


def ownership(layers: DataFrame) -> DataFrame:
    """``layer_id, confidence, owner_status``: an owner is likely if the layer's name says so, and
    confirmed only by a person (``acknowledged``)."""
    owner = name_key(F.coalesce("owner", F.lit("unknown")))
    likely = (owner != "") & (owner != "unknown") & name_key(F.col("layer_name")).contains(owner)
    confidence = F.when(F.col("acknowledged"), "human_confirmed").when(likely, "high").otherwise("low")
    status = F.when(F.col("acknowledged"), "confirmed").when(likely, "provisional").otherwise("needs_owner_confirmation")
    return layers.select("layer_id", confidence.alias("confidence"), status.alias("owner_status"))


def record_totals(rows: DataFrame, fields: list[str], amount: str) -> DataFrame:
    """Rows and summed amounts by each field and in total, in one pass."""
    sets = [[F.col(f)] for f in fields] + [[]]
    return rows.groupingSets(sets, *[F.col(f) for f in fields]).agg(F.sum(F.col(amount).cast("long")).alias("records"), F.count("*").alias("layers"))


def quality_warnings(layers: DataFrame) -> DataFrame:
    """``layer_id, warning``: no spatial reference, no field that names a row, a doubtful class."""
    marks = F.array_compact(F.array(
        F.when(F.coalesce("srs", F.lit("")) == "", "missing spatial reference"), F.when(F.coalesce("unique_id_field", F.lit("")) == "", "no likely unique ID field identified"),
        F.when(F.col("confidence").isin("low", "unknown", "review_required"), "classification needs review"),
    ))
    return layers.select("layer_id", F.explode(marks).alias("warning"))


def taxonomy_duplicates(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Taxonomies that more than one layer has, with their number; unknown systems do not count."""
    return layers.where(~F.col("system").isin("unknown", "review_required")).groupBy(*keys).agg(F.count("*").alias("layers")).where("layers > 1")


def buckets(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``bucket, n``: a row counts in each bucket whose condition holds, else in ``none``."""
    marks = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in conditions.items()]))
    filled = F.when(F.size(marks) > 0, marks).otherwise(F.array(F.lit("none")))
    return rows.select(F.explode(filled).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def primary_system(layers: DataFrame, key: str) -> DataFrame:
    """The system that most speaks for: high confidence counts 3, medium 1, a naming field and a
    spatial reference 1 each. Of equal systems the one of the first layer wins; none is ``unknown``."""
    weight = (
        F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 1).otherwise(0)
        + (F.coalesce("unique_id_field", F.lit("")) != "").cast("int") + (F.coalesce("srs", F.lit("")) != "").cast("int")
    )
    counted = ~F.col("system").isin("review_required", "unknown", "reference", "shared_reference")
    sums = layers.groupBy(key, "system").agg(F.sum(F.when(counted, weight)).alias("w"), F.min("layer_id").alias("f"))
    best = sums.groupBy(key).agg(F.max(F.when(F.col("w") > 0, F.struct("w", (-F.col("f")).alias("f"), "system"))).alias("b"))
    return best.select(key, F.coalesce("b.system", F.lit("unknown")).alias("primary_system"))


#: Taxonomy subcategories that are canonical classes of their domain.
CLASSES = {
    "water": ["water_main", "transmission_main", "distribution_main", "service_line", "hydrant_lateral", "valve", "isolation_valve", "hydrant", "meter", "meter_vault", "pump", "pump_station", "storage_tank", "reservoir", "treatment_facility", "well", "pressure_zone", "water_system_boundary"],
    "wastewater": ["gravity_main", "force_main", "pressure_sewer", "service_lateral", "manhole", "cleanout", "lift_station", "wet_well", "treatment_facility", "sewer_basin"],
}


def recommend_layers(layers: DataFrame, candidates: DataFrame) -> DataFrame:
    """``layer_id, domain, asset_class, contradictions, confidence, status`` of each layer.

    ``candidates``: ``layer_id, rank, target, confidence`` with targets ``system/group/class``.
    A domain other than water or wastewater is replaced by what the candidates agree on; a
    sewer line of unknown kind and any contradiction ask for review.
    """
    part = lambda k: F.split_part("target", F.lit("/"), F.lit(k))
    c = candidates.withColumn("system", part(1)).withColumn("kind", part(3))
    both = ["water", "wastewater"]
    d = c.groupBy("layer_id").agg(
        F.min_by(F.struct("system", "kind", "confidence"), "rank").alias("top"),
        F.array_sort(F.collect_set(F.when(F.col("system").isin(both), F.col("system")))).alias("seen"),
    ).join(layers, "layer_id")
    top = F.col("top.system")
    domain = F.when(top.isin(both), top).when(F.size("seen") == 2, "water_wastewater").when(F.size("seen") == 1, F.get("seen", F.lit(0))).otherwise("unknown")
    d = d.withColumn("domain", domain)
    kind = F.col("top.kind")
    known = ((F.col("domain") == "water") & kind.isin(CLASSES["water"])) | ((F.col("domain") != "water") & kind.isin(CLASSES["wastewater"]))
    text = name_key(F.concat_ws(" ", "layer_name", kind))
    vague = (F.col("domain") == "wastewater") & ~known & text.rlike("sewer|main|pipe")
    target = F.when(vague, "unknown_wastewater_line").when(known, kind)
    notes = F.array_compact(F.array(
        F.when(vague, "behavior_unknown"), F.when(target.isNull(), "class_unsupported"), F.when(~F.col("domain").isin(both), "domain_unconfirmed"),
    ))
    return d.select(
        "layer_id", "domain", F.coalesce(target, F.lit("")).alias("asset_class"), F.array_join(notes, ";").alias("contradictions"),
        F.when(F.size(notes) > 0, "low").otherwise(F.col("top.confidence")).alias("confidence"), F.when(F.size(notes) > 0, "review_required").otherwise("candidate").alias("status"),
    )


def mapping_summary(recommended: DataFrame) -> DataFrame:
    """Counts of layers by domain, status and confidence, and in total, in one pass."""
    c = [F.col(n) for n in ("domain", "status", "confidence")]
    return recommended.groupingSets([[c[0]], [c[1]], [c[2]], []], *c).agg(F.count("*").alias("layers"))


def export_gate(datasets: DataFrame) -> DataFrame:
    """``dataset_id, decision``: a restricted dataset goes public only sanitized and approved.

    ``datasets``: ``dataset_id, sensitivity, destination, sanitized, approved``. An export is public
    if it is approved for public use or goes to the sanitized portfolio; others are not refused.
    """
    no = F.lit(False)
    approved, sanitized = F.coalesce("approved", no), F.coalesce("sanitized", no)
    public = approved | F.contains(F.lower(F.coalesce("destination", F.lit(""))), F.lit("sanitized_portfolio"))
    blocked = (F.lower(F.coalesce("sensitivity", F.lit(""))) == "restricted") & public & ~(sanitized & approved)
    return datasets.select("dataset_id", F.when(blocked, "refused").otherwise("allowed").alias("decision"))


def cad_layers(layers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``layer_id, target``: case-insensitive names against a mapping; others stay unmapped."""
    m = mapping.select(F.upper("cad_name").alias("_k"), "target").dropDuplicates(["_k"])
    d = layers.withColumn("_k", F.upper("layer_name")).join(m, "_k", "left")
    return d.select("layer_id", F.coalesce("target", F.lit("unmapped")).alias("target"))


def package_rollup(layers: DataFrame, domains: DataFrame) -> DataFrame:
    """Per submission: layers, records, spatial layers, domains, lowest confidence, next action.

    ``domains``: ``layer_id, domain, confidence, status``.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in {"unavailable": 0, "low": 1, "medium": 2, "high": 3}.items() for x in (k, v)]), F.col("confidence"))
    d = layers.join(domains, "layer_id", "left")
    g = d.groupBy("submission_id").agg(
        F.count("*").alias("layers"), F.sum(F.col("record_count").cast("long")).alias("records"), F.count_if(F.col("geometry_type") != "").alias("spatial_layers"),
        F.array_join(F.array_sort(F.collect_set("domain")), ";").alias("domains"), F.min_by("confidence", rank).alias("lowest_confidence"),
        F.count_if(F.col("status") == "review_required").alias("reviews"), F.count_if(F.col("srs") == "").alias("coordinate_reviews"),
    )
    action = F.when(F.col("coordinate_reviews") > 0, "review_coordinates").when(F.col("reviews") > 0, "review_classification").otherwise("plan_staging")
    return g.withColumn("next_action", action)
