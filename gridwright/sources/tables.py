"""Reading layer, table and rule inputs, and writing result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTES = "map<string,string>"
GEOMETRY = "struct<type:string,x:double,y:double,paths:array<array<struct<x:double,y:double>>>,length:double,is_empty:boolean,is_multipart:boolean>"
LAYER = f"objectid long, ordinal long, attributes {ATTRIBUTES}, geometry {GEOMETRY}"


def read_layer(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A source layer with its explicit schema (Parquet, JSON lines or ORC)."""
    d = spark.read.schema(LAYER).format(form).load(path)
    return d


def with_ordinal(layer: DataFrame) -> DataFrame:
    """Adds ``ordinal`` from the object id where the source has no order of its own."""
    if "ordinal" in layer.columns:
        return layer.withColumn("ordinal", F.coalesce("ordinal", "objectid"))
    return layer.withColumn("ordinal", F.col("objectid"))


def roles(layer: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The layer with one column per mapped role, taken from its attributes."""
    return layer.select("*", *[F.element_at("attributes", F.lit(field)).alias(role) for role, field in mapping.items()])


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and an explicit schema; nothing is inferred from the data."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file: one JSON document whose ``rules`` become rows; parameters as numbers."""
    rule = T.StructType.fromDDL(
        "rule_code string, name string, description string, category string, applicable_layer string, severity string, enabled boolean, "
        "required_semantic_fields array<string>, parameters map<string,double>, detection_method string, limitation string, recommended_action string"
    )
    schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("rules", T.ArrayType(rule))])
    return spark.read.schema(schema).json(path, multiLine=True).select("version", F.explode("rules").alias("r")).select("version", "r.*")


def joined_ids(ids: Column) -> Column:
    """Ids in numeric order, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ";")


def write_issues(issues: DataFrame, folder: str, fields: list[str]) -> None:
    """Issue rows as CSV and JSON lines with the given columns."""
    flat = issues.select(*fields)
    flat.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    flat.write.mode("overwrite").json(f"{folder}/json", ignoreNullFields=False)


def geojson_geometry(geometry: Column) -> Column:
    """GeoJSON text: a point, or the first path as a line; null for anything else."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(geometry["x"], geometry["y"]).alias("coordinates")))
    path = F.get(geometry["paths"], F.lit(0))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(path, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))
    return F.when(geometry["type"] == "point", point).when((geometry["type"] == "polyline") & (F.size(path) > 0), line)


def geojson_features(issues: DataFrame, properties: list[str], geometry: str = "geometry") -> DataFrame:
    """``value``: one GeoJSON feature per row; rows without a geometry are dropped."""
    g = geojson_geometry(F.col(geometry))
    d = issues.withColumn("_g", g).where("_g IS NOT NULL")
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return d.select(F.concat(F.lit('{"type":"Feature","geometry":'), "_g", F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(issues: DataFrame, path: str, properties: list[str]) -> None:
    geojson_features(issues, properties).write.mode("overwrite").text(path)


def with_target(issues: DataFrame, manhole_layer: str) -> DataFrame:
    """Which map layer an issue belongs to: pipe (line), manhole (point there) or network (point)."""
    kind = F.col("geometry.type")
    target = F.when(kind == "polyline", "pipe").when((kind == "point") & (F.col("source_layer") == manhole_layer), "manhole").when(kind == "point", "network")
    return issues.withColumn("target", target)


def write_layers(issues: DataFrame, path: str, manhole_layer: str) -> None:
    """Issues split into a folder per map layer."""
    with_target(issues, manhole_layer).where("target IS NOT NULL").write.mode("overwrite").partitionBy("target").parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds processing rows to the run history; earlier rows are never rewritten."""
    rows.write.mode("append").parquet(path)


def run_rows(layers: DataFrame, run_id: str, started_at: str) -> DataFrame:
    """One history row per input layer: records, findings and a status."""
    status = F.when(F.col("records") == 0, "empty").when(F.col("findings") > 0, "completed_with_findings").otherwise("completed")
    return layers.select(F.lit(run_id).alias("run_id"), "layer", "records", "findings", status.alias("status"), F.lit(started_at).alias("started_at"))


def first_of_key(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """One row per key: the first in input order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
