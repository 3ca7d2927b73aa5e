"""Field profiles, semantic field mapping and completeness figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.values import is_blank, number_or_null, rounded, value_pattern


def melt(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value``: one row per cell, values as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")
    return rows.select(cells).select("c.field", "c.value")


def field_profile(rows: DataFrame, fields: list[str], top: int = 8, longest: int = 80) -> DataFrame:
    """``field, null_count, null_percentage, distinct_count, top_values`` for each field.

    Values are counted once per field and value before anything is ranked, so a field of many
    values is spread over all tasks; the ``top`` values are by count, then by value.
    """
    counts = melt(rows, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    blank = is_blank(F.col("value"))
    totals = counts.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(~blank).alias("distinct_count"),
    )
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    best = counts.where(~blank & (F.length("value") <= longest)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    listed = best.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n"))), lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ";").alias("top_values"))
    out = totals.join(listed, "field", "left")
    return out.select("field", "null_count", rounded(F.col("null_count") * 100.0 / F.col("rows"), 2).alias("null_percentage"), "distinct_count", F.coalesce("top_values", F.lit("")).alias("top_values"))


def catalog_profile(rows: DataFrame, fields: list[str], id_field: str | None = None, top: int = 10) -> DataFrame:
    """As ``field_profile``, with duplicates of the id field and the smallest and largest value."""
    counts = melt(rows, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    full = ~is_blank(F.col("value"))
    extra = counts.groupBy("field").agg(F.coalesce(F.sum(F.when(full, F.col("n") - 1)), F.lit(0)).alias("d"), F.min(F.when(full, F.col("value"))).alias("smallest"), F.max(F.when(full, F.col("value"))).alias("largest"))
    extra = extra.withColumn("duplicate_ids", F.when(F.col("field") == F.lit(id_field), F.col("d")).otherwise(F.lit(0)))
    return field_profile(rows, fields, top).join(extra.drop("d"), "field")


def pattern_profile(rows: DataFrame, fields: list[str], most: int = 10) -> DataFrame:
    """``field, null_count, pattern_count, patterns``: shapes of values, the first ``most`` sorted."""
    cells = melt(rows, fields).groupBy("field", value_pattern(F.col("value")).alias("pattern")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("pattern")
    full = ~is_blank(F.col("pattern"))
    totals = cells.groupBy("field").agg(F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("null_count"), F.count_if(full).alias("pattern_count"))
    some = cells.where(full).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return totals.join(some.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("pattern")), ";").alias("patterns")), "field", "left")


def field_mapping(roles: DataFrame, profile: DataFrame) -> DataFrame:
    """Roles (``role, field, confidence, evidence``) with the figures of their field; a role
    whose field is not there is ``unavailable``."""
    known = profile.select(F.col("field"), "null_percentage", "distinct_count", F.lit(True).alias("_there"))
    out = roles.join(known, "field", "left")
    return out.select("role", "field", F.when(F.col("_there"), F.col("confidence")).otherwise("unavailable").alias("confidence"), "null_percentage", "distinct_count")


def role_fields(fields: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """``layer_id, role, field_name``: for each role the first field that has its first keyword.

    ``fields``: ``layer_id, field_pos, field_name``. Keywords are tried in order.
    """
    pairs = [(role, k, word) for role, words in keywords.items() for k, word in enumerate(words)]
    table = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("k"), F.lit(w).alias("word")) for r, k, w in pairs])
    d = fields.withColumn("w", F.explode(table)).where(F.lower("field_name").contains(F.col("w.word")))
    return d.groupBy("layer_id", F.col("w.role").alias("role")).agg(F.min_by("field_name", F.struct("w.k", "field_pos")).alias("field_name"))


def recommended_fields(fields: DataFrame, aliases: dict[str, tuple[str, str]], id_words: list[str]) -> DataFrame:
    """``layer_id, field_name, target, transformation, confidence`` for each source field.

    ``aliases``: normalised field name -> (target, transformation). The first field of a layer
    that looks like an id becomes the identifier; others without an alias stay unmapped.
    """
    key = F.regexp_replace(F.lower("field_name"), "[^a-z0-9]", "")
    target = F.element_at(F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v[0])]), key)
    how = F.element_at(F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v[1])]), key)
    w = Window.partitionBy("layer_id").orderBy("field_pos")
    is_id = key.isin(id_words)
    d = fields.withColumn("is_id", is_id).withColumn("first_id", is_id & (F.count_if(is_id).over(w) == 1))
    return d.select(
        "layer_id", "field_name",
        F.when(F.col("first_id"), "source_asset_identifier").otherwise(F.coalesce(target, F.lit("unmapped"))).alias("target"),
        F.when(F.col("first_id"), "normalized_identifier").otherwise(F.coalesce(how, F.lit("unmapped"))).alias("transformation"),
        F.when(F.col("first_id") | target.isNotNull(), "high").otherwise("unavailable").alias("confidence"),
    )


def completeness(rows: DataFrame, fields: list[str], positive: list[str] = ()) -> DataFrame:
    """``field, present, total``: non-blank cells; for ``positive`` fields numbers above 0."""
    figures = [F.count_if(~is_blank(F.col(f)) & ((number_or_null(F.col(f)) > 0) if f in positive else F.lit(True))).alias(f) for f in fields]
    one = rows.agg(F.count("*").alias("total"), *figures)
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("c")).select("c.field", "c.present", "total")


def identity_metrics(rows: DataFrame, field: str) -> DataFrame:
    """``total, present, distinct_ids, duplicate_rows`` of an id field, in one pass over its values."""
    counts = rows.groupBy(F.when(~is_blank(F.col(field)), F.btrim(F.col(field).cast("string"), F.lit(" \t\n\r\x0b\x0c"))).alias("id")).agg(F.count("*").alias("n"))
    named = F.col("id").isNotNull()
    return counts.agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("present"),
        F.count_if(named).alias("distinct_ids"), F.coalesce(F.sum(F.when(named & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )
