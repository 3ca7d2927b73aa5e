"""Classification, staging readiness and cataloguing of source layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.values import name_key, rounded

#: Replacements of the duplicate signature, in order.
SIGNATURE = [("sewer", "wwpipe"), ("pipes", "wwpipe"), ("pipe", "wwpipe"), ("line", "wwpipe"), ("lines", "wwpipe"), ("water", "waterpipe"), ("mh", "manhole"), ("manholes", "manhole"), ("mains", "main")]
INFRASTRUCTURE = ["gis", "dbo", "sde", "enterprise", "egis"]
REFERENCE_STATES = {"out_of_scope": "out_of_scope_candidate", "shared_reference": "shared_reference_candidate", "environmental_regulatory": "environmental_reference_candidate", "planning_reference": "planning_reference_candidate"}


def classify(layers: DataFrame, rules: DataFrame) -> DataFrame:
    """Ranked candidates: ``layer_id, rank, rule_code, target, confidence, score``.

    ``layers``: ``layer_id, text`` (name, alias, dataset and fields in lower case). ``rules``:
    ``rule_code, rule_order, pattern, targets ARRAY, confidence, score``; a rule table is small
    by nature, and each later target of a rule scores 0.03 less. Layers without a match get one
    candidate that asks for review.
    """
    hits = layers.join(F.broadcast(rules), F.expr("text rlike pattern"))
    d = hits.select("layer_id", "rule_code", "rule_order", "confidence", "score", F.posexplode("targets").alias("offset", "target"))
    d = d.withColumn("score", rounded(F.col("score") - F.col("offset") * 0.03, 4))
    none = layers.join(d, "layer_id", "left_anti").select("layer_id", F.lit("ULR_UNAVAILABLE").alias("rule_code"), F.lit(0).alias("rule_order"), F.lit("unavailable").alias("confidence"), F.lit(0.0).alias("score"), F.lit(0).alias("offset"), F.lit("review_required").alias("target"))
    w = Window.partitionBy("layer_id").orderBy(F.desc("score"), "rule_order", "offset")
    return d.unionByName(none).withColumn("rank", F.row_number().over(w)).select("layer_id", "rank", "rule_code", "target", "confidence", "score")


def keyword_classify(layers: DataFrame, systems: dict[str, list[str]], assets: dict[str, list[str]]) -> DataFrame:
    """``layer_id, system, score, asset``: keyword hits per system (the first best wins) and the
    first asset kind with a keyword. ``layers``: ``layer_id, text``."""
    text = F.col("text")
    hits = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    scored = F.array(*[F.struct(hits(words).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("system")) for k, (name, words) in enumerate(systems.items())])
    best = F.array_max(scored)
    asset = F.lit("unknown")
    for name, words in reversed(list(assets.items())):
        asset = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)), F.lit(name)).otherwise(asset)
    d = layers.select("layer_id", best.alias("b"), asset.alias("a"))
    known = F.col("b.score") > 0
    confidence = F.when(~known, "unknown").when((F.col("b.score") >= 2) & (F.col("a") != "unknown"), "high").otherwise("medium")
    return d.select("layer_id", F.when(known, F.col("b.system")).otherwise("unknown").alias("system"), F.col("b.score").cast("long").alias("score"), F.when(known, F.col("a")).otherwise("unknown").alias("asset"), confidence.alias("confidence"))


def routing_state(candidates: DataFrame) -> DataFrame:
    """``layer_id, state`` from the first candidate, the number of candidates and confidence."""
    d = candidates.groupBy("layer_id").agg(F.count("*").alias("n"), F.min_by("target", "rank").alias("target"), F.min_by("confidence", "rank").alias("c"))
    c, system = F.col("c"), F.split_part("target", F.lit("/"), F.lit(1))
    state = F.lit(None).cast("string")
    for name, value in REFERENCE_STATES.items():
        state = F.when(system == name, F.lit(value)).otherwise(state)
    rest = (
        F.when((F.col("n") > 1) & c.isin("low", "medium"), "needs_taxonomy_review")
        .when(c == "high", "ready_for_classification_review")
        .when(c == "medium", "needs_taxonomy_review")
        .when(c == "low", "needs_source_owner_confirmation")
        .otherwise("needs_data_owner_confirmation")
    )
    return d.select("layer_id", F.coalesce(state, rest).alias("state"))


def coordinate_status(layers: DataFrame) -> DataFrame:
    """``layer_id, coordinate_status``; a submission with two or more known references is mixed."""
    known = layers.where("coalesce(srs, '') NOT IN ('', 'unknown')").groupBy("submission_id").agg((F.min("srs") != F.max("srs")).alias("mixed"))
    d = layers.join(known, "submission_id", "left")
    low = F.lower(F.coalesce("srs", F.lit("")))
    status = (
        F.when(low.isin("", "unknown"), "unknown_spatial_reference")
        .when(F.lower("layer_name").contains("wgs") & ~low.contains("wgs"), "name_and_metadata_conflict")
        .when(F.coalesce("mixed", F.lit(False)), "mixed_source_spatial_references")
        .otherwise("coordinate_ready")
    )
    return d.select("layer_id", status.alias("coordinate_status"))


def duplicate_signature(name: Column) -> Column:
    out = name_key(name)
    for old, new in SIGNATURE:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def duplicate_groups(layers: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """``submission_id, signature, members, layer_ids, status`` of names that look the same; a
    decision that a person made earlier (``prior``) stays."""
    d = layers.groupBy("submission_id", duplicate_signature(F.col("layer_name")).alias("signature")).agg(F.count("*").alias("members"), F.array_sort(F.collect_list("layer_id")).alias("layer_ids"))
    d = d.where("members > 1")
    if prior is None:
        return d.withColumn("status", F.lit("potential_duplicate"))
    human = prior.where("status <> 'potential_duplicate'").withColumnRenamed("status", "_s")
    return d.join(human, ["submission_id", "signature"], "left").withColumn("status", F.coalesce("_s", F.lit("potential_duplicate"))).drop("_s")


def package_prefixes(layers: DataFrame, infrastructure: list[str] = INFRASTRUCTURE) -> DataFrame:
    """``layer_id, canonical_name``: the layer name without the longest repeated package prefix.

    A prefix of at most five tokens must end in an infrastructure token and begin at least half
    of the submission's names, and five of them.
    """
    tokens = F.filter(F.split("layer_name", "[_\\-.]+"), lambda t: t != "")
    d = layers.select("layer_id", "submission_id", "layer_name", tokens.alias("tokens"))
    size = F.least(F.lit(5), F.size("tokens"))
    heads = d.select("submission_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda n: F.transform(F.slice("tokens", 1, n), F.lower))).alias("prefix"))
    total = d.groupBy("submission_id").agg(F.greatest(F.lit(5), F.floor((F.count("*") + 1) / 2)).alias("least"))
    counts = heads.where(F.element_at("prefix", -1).isin(infrastructure)).groupBy("submission_id", "prefix").agg(F.count("*").alias("n")).join(total, "submission_id").where("n >= least")
    best = counts.groupBy("submission_id").agg(F.max_by("prefix", F.struct(F.size("prefix"), "n", "prefix")).alias("prefix"))
    d = d.join(best, "submission_id", "left")
    n = F.size("prefix")
    match = F.col("prefix").isNotNull() & (F.transform(F.slice("tokens", 1, F.greatest(n, F.lit(1))), F.lower) == F.col("prefix"))
    rest = F.array_join(F.when(match, F.slice(F.col("tokens"), n + 1, F.size("tokens"))).otherwise(F.col("tokens")), "_")
    return d.select("layer_id", F.when(rest == "", F.col("layer_name")).otherwise(rest).alias("canonical_name"))


def inherited_sensitivity(fields: DataFrame, levels: DataFrame, words: list[str]) -> DataFrame:
    """``layer_id, sensitivity, status, public_use_allowed, export_allowed``: the package's level (a
    level that is not known is restricted). A field whose name, without underscores, has one of
    ``words`` asks for a review and forbids public use and export."""
    hit = F.replace(F.lower("field_name"), F.lit("_"), F.lit("")).rlike("|".join(words))
    f = fields.groupBy("layer_id").agg(F.bool_or(hit).alias("s"))
    d = levels.join(f, "layer_id", "left").withColumn("s", F.coalesce("s", F.lit(False)))
    level = F.when(F.col("level").isin("restricted", "confidential", "internal", "public"), F.col("level")).otherwise("restricted")
    free = (level == "public") & ~F.col("s")
    status = F.when(F.col("s"), "needs_sensitivity_review").otherwise("inherited_from_package")
    return d.select("layer_id", level.alias("sensitivity"), status.alias("status"), free.alias("public_use_allowed"), free.alias("export_allowed"))


def taxonomy_decisions(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """``layer_id, status, blockers``: approved only with high confidence, a fitting geometry,
    corroborating fields and no rival of another system within 0.05.

    ``facts``: ``layer_id, geometry_ok, corroborated, manual`` where ``manual`` (not null) is a
    person's decision that stays.
    """
    system = F.split_part("target", F.lit("/"), F.lit(1))
    d = candidates.withColumn("system", system)
    top = d.groupBy("layer_id").agg(F.min_by(F.struct("system", "score", "confidence"), "rank").alias("top"))
    rival = d.join(top, "layer_id").where((F.col("rank") > 1) & (F.col("system") != F.col("top.system")) & (F.col("top.score") - F.col("score") <= 0.05 + 1e-9)).select("layer_id", F.lit(True).alias("rival")).distinct()
    j = top.join(facts, "layer_id").join(rival, "layer_id", "left")
    b = F.array_compact(F.array(
        F.when(F.col("top.confidence") != "high", "confidence"), F.when(~F.col("geometry_ok"), "geometry"),
        F.when(~F.col("corroborated"), "corroboration"), F.when(F.col("rival"), "contradiction"),
    ))
    blockers = F.when(F.col("manual").isNull(), F.array_join(b, ";")).otherwise("")
    return j.select("layer_id", F.when(F.col("manual").isNotNull(), F.col("manual")).when(F.size(b) == 0, "approved").otherwise("deferred").alias("status"), blockers.alias("blockers"))


def staging_readiness(decisions: DataFrame, coordinates: DataFrame, duplicates: DataFrame, owners: DataFrame) -> DataFrame:
    """``layer_id, readiness`` from the four reviews. ``duplicates``: ``layer_id``; ``owners``:
    ``layer_id, owner_status``."""
    d = decisions.join(coordinates, "layer_id", "left").join(duplicates.select("layer_id", F.lit(True).alias("dup")).distinct(), "layer_id", "left").join(owners, "layer_id", "left")
    state = (
        F.when(F.col("status") == "excluded", "excluded")
        .when(F.col("status") != "approved", "deferred")
        .when((F.coalesce("coordinate_status", F.lit("")) != "coordinate_ready") | F.col("dup"), "staging_blocked")
        .when(F.coalesce("owner_status", F.lit("")) != "confirmed", "human_review_required")
        .otherwise("fully_ready_for_staging_review")
    )
    return d.select("layer_id", state.alias("readiness"))


#: Names that a geodatabase keeps for itself.
RESERVED = ["table", "select", "from", "where"]


def staging_names(layers: DataFrame, base: Column, longest: int = 60) -> DataFrame:
    """``layer_id, target_name``: names that are unique in a submission: the base, or the first of
    base_2, base_3, ... that is free, in the order of layer names.

    Where one base can only meet itself, its layers are numbered by a window. Bases that may meet the
    numbered names of others (``x_2`` beside ``x``) are taken up one after the other; such a group is
    what shares the base without its numbers. Taken names stay taken, so each base goes on from the last
    number that it has tried, and a group costs time in proportion to its layers.
    """
    clean = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9_]+", "_"), "_+", "_"), F.lit("_"))
    clean = F.when(clean.rlike("^[a-z]"), clean).otherwise(F.concat(F.lit("layer_"), clean))
    clean = F.when(clean.isin(RESERVED), F.concat(F.lit("up_"), clean)).otherwise(clean)
    d = layers.select("submission_id", "layer_id", F.lower("layer_name").alias("o"), clean.alias("b"))
    d = d.withColumn("root", F.substring(F.regexp_replace("b", "(_[0-9]+)+$", ""), 1, longest - 20))
    kinds = d.groupBy("submission_id", "root").agg((F.min("b") != F.max("b")).alias("mixed"))
    d = d.join(kinds, ["submission_id", "root"])
    n = F.row_number().over(Window.partitionBy("submission_id", "b").orderBy("o", "layer_id"))
    suffix = F.concat(F.lit("_"), n.cast("string"))
    plain = d.where("NOT mixed").select("layer_id", F.when(n == 1, F.substring("b", 1, longest)).otherwise(F.concat(F.substring(F.col("b"), F.lit(1), F.lit(longest) - F.length(suffix)), suffix)).alias("target_name"))

    def one_by_one(rows):
        rows, used, names, tried = rows.sort_values(["o", "layer_id"]), set(), [], {}
        for b in rows["b"]:
            k = tried.get(b, 1)
            name = b[:longest] if k == 1 else f"{b[: longest - len(f'_{k}')]}_{k}"
            while name in used:
                k += 1
                name = f"{b[: longest - len(f'_{k}')]}_{k}"
            tried[b] = k
            used.add(name)
            names.append(name)
        return rows.assign(target_name=names)[["layer_id", "target_name"]]

    schema = f"layer_id {layers.schema['layer_id'].dataType.simpleString()}, target_name string"
    return plain.unionByName(d.where("mixed").groupBy("submission_id", "root").applyInPandas(one_by_one, schema))


def insert_assets(registry: DataFrame, candidates: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Candidates that are new under every one of the unique keys, one row per key."""
    new = candidates
    for key in keys:
        new = new.join(registry.select(*key).distinct(), key, "left_anti")
    for key in keys:
        w = Window.partitionBy(*key).orderBy(*[c for c in sorted(candidates.columns)])
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return new


def asset_registry(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Assets with the number of edges at them and whether any is provisional."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_asset_id", "to_asset_id"))).alias("asset_id"), "provisional")
    n = ends.groupBy("asset_id").agg(F.count("*").alias("edge_count"), F.bool_or("provisional").alias("has_provisional"))
    return assets.join(n, "asset_id", "left").fillna(0, ["edge_count"]).withColumn("has_provisional", F.coalesce("has_provisional", F.lit(False)))


def counts_by(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n`` for each field, in one pass over the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields])).alias("c")
    return rows.select(cells).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def catalog_upsert(catalog: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The catalog after an inventory: new rows in, changed values updated, others kept.

    ``action`` says which: registered, updated, unchanged or kept. Of rows with one key the first
    in the order of the values counts.
    """
    first = Window.partitionBy(*keys).orderBy(*[F.col(v) for v in values])
    new = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, *[F.col(v).alias("_" + v) for v in values], F.lit(True).alias("_new"))
    old = catalog.select(*keys, *values, F.lit(True).alias("_old"))
    d = old.join(new, keys, "full_outer")
    differs = F.exists(F.array(*[~F.col("_" + v).eqNullSafe(F.col(v)) for v in values]), lambda x: x)
    action = F.when(F.col("_old").isNull(), "registered").when(F.col("_new").isNull(), "kept").when(differs, "updated").otherwise("unchanged")
    return d.select(*keys, *[F.when(F.col("_new"), F.col("_" + v)).otherwise(F.col(v)).alias(v) for v in values], action.alias("action"))


def refused_registrations(catalog: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the catalog already."""
    return rows.join(catalog.select(*keys).distinct(), keys, "left_semi")


def inventory_decision(layers: DataFrame) -> DataFrame:
    """``layer_id, sensitivity, action`` from system, confidence and spatial reference."""
    s, c = F.col("system"), F.col("confidence")
    action = F.when(s == "review_required", "review_required").when((c == "high") & (F.coalesce("srs", F.lit("")) != ""), "candidate_for_staging_review").when(c.isin("unknown", "low"), "manual_review").otherwise("defer_until_reviewed")
    return layers.select("layer_id", F.when(s.isin("reference", "shared_reference"), "internal").otherwise("restricted").alias("sensitivity"), action.alias("action"))


def allow_list(candidates: DataFrame, earlier: DataFrame) -> DataFrame:
    """Candidates with the approval that they had before, else not approved."""
    return candidates.join(earlier.select("layer_id", "approved"), "layer_id", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def duplicate_packages(submissions: DataFrame) -> DataFrame:
    """Each submission with the earliest one of the same content hash, if it is another."""
    w = Window.partitionBy("sha").orderBy("received_at", "submission_id")
    d = submissions.withColumn("first", F.first("submission_id").over(w))
    return d.select("submission_id", F.when(F.col("first") != F.col("submission_id"), F.col("first")).alias("duplicate_of"))


def package_hashes(files: DataFrame) -> DataFrame:
    """One hash per package: its files' path, size and hash, by tabs, a line each, in the order of
    the lower-cased paths. A package's list of files is held by one task."""
    entry = F.struct(F.lower("path").alias("k"), F.concat_ws("\t", "path", F.col("size").cast("string"), "sha").alias("line"))
    rows = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"])
    return files.groupBy("submission_id").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("package_hash"))


def stage_manifest(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Items of all stages with the furthest stage that each has reached."""
    order = list(stages)
    parts = [d.select(key, F.lit(k).alias("k"), F.lit(s).alias("stage")) for k, (s, d) in enumerate(stages.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    assert order
    return every.groupBy(key).agg(F.max_by("stage", "k").alias("primary_stage"), F.countDistinct("k").alias("stages"))


def approved_copies(allowed: DataFrame, catalog: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(approved rows found in the catalog, approved keys that it lacks)."""
    yes = allowed.where("approved")
    return yes.join(catalog, key), yes.select(key).join(catalog, key, "left_anti")
