"""Scans of the fact, turn, edge and event tables, and duplicate-free ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.registry import query


@query("S1_scan_facts", "SELECT fact_id, fact_type, created_at, access_count FROM facts WHERE profile_id = 'en' AND fact_type IN ('semantic', 'opinion')")
def s1_scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where("profile_id = 'en' AND fact_type IN ('semantic', 'opinion')").select("fact_id", "fact_type", "created_at", "access_count")


@query("S2_facts_by_entity", "SELECT p_partkey AS entity_id, count(*) AS facts, max(l_shipdate) AS latest FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand = 'Brand#13' GROUP BY p_partkey")
def s2_facts_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that mention an entity, for all entities of a brand: an equi-join instead of a search in arrays."""
    part = views.read(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("entity_id"))
    lines = views.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), "l_shipdate")
    return lines.join(part, "entity_id").groupBy("entity_id").agg(F.count("*").alias("facts"), F.max("l_shipdate").alias("latest"))


@query("S3_edges_for_node", "SELECT node, count(*) AS edges, round(sum(weight), 6) AS weight FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY node")
def s3_edges_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir)
    both = edges.select(F.col("src").alias("node"), "weight").union(edges.select("dst", "weight"))
    return both.groupBy("node").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query("S4_events_in_range", "SELECT event_id, fact_id, accessed_at FROM access WHERE accessed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def s4_events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.access(spark, sf_dir).where("accessed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'").select("event_id", "fact_id", "accessed_at")


def export_facts(facts: DataFrame, path: str, form: str = "json") -> None:
    """Writes facts as json (one object a line), csv or parquet, partitioned by profile."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown format {form!r}")
    writer = facts.write.mode("overwrite").partitionBy("profile_id")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[form](path)


def import_facts(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """Reads what `export_facts` has written; the schema is given, never inferred."""
    reader = spark.read.schema(schema)
    return {"json": reader.json, "csv": lambda p: reader.option("header", True).csv(p), "parquet": reader.parquet}[form](path)


def ingest_once(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first item of each key."""
    return items.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


@query("S7_ingest_dedup", "SELECT event_type, value, min(event_id) AS event_id FROM access GROUP BY event_type, value")
def s7_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items once for each (source type, key)."""
    return views.access(spark, sf_dir).groupBy("event_type", "value").agg(F.min("event_id").alias("event_id"))


@query(
    "S8_legacy_copy",
    "SELECT 'fact-' || doc_id AS fact_id, coalesce(lang, 'default') AS profile_id, source AS session_id, n_chars AS size FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
)
def s8_legacy_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows under new names, without those that are there already."""
    old, done = views.read(spark, sf_dir, "documents"), views.read(spark, sf_dir, "labels").select("doc_id")
    new = old.join(done, "doc_id", "left_anti")
    return new.select(F.concat(F.lit("fact-"), "doc_id").alias("fact_id"), F.coalesce("lang", F.lit("default")).alias("profile_id"), F.col("source").alias("session_id"), F.col("n_chars").alias("size"))


@query("S9_reembed_stale", "SELECT doc_id AS fact_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label % 2 = 0)")
def s9_reembed_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a vector of the current model (here: an even label)."""
    current = views.read(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("fact_id"))
    return views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id")).join(current, "fact_id", "left_anti")
