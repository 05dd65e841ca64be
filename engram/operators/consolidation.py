"""Consolidation and the wider retrieval channels: candidate actions, contradictions, bridges, clusters, flows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.fusion import SQL_CHANNELS, SQL_RRF, channels, weighted_rrf
from engram.operators.graph import components, cut
from engram.operators.lexical import best
from engram.operators.reports import a24_bandit_posterior
from engram.operators.text import sql_list
from engram.operators.vectors import SQL_TOPK, dot, neighbours, norm, query_vectors, topk
from engram.registry import query

count = lambda: F.count("*")


@query(
    "E6_route_type_embedding",
    """WITH t AS (SELECT label % 4 AS type, vec FROM vectors), s AS (SELECT f.fact_id, type, avg(list_cosine_similarity(f.vec, t.vec)) AS s FROM vectors f CROSS JOIN t GROUP BY f.fact_id, type),
    r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(s, 9) DESC, type) AS n FROM s) SELECT fact_id, type, round(s, 6) AS similarity FROM r WHERE n = 1""",
)
def e6_route_type_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type (label modulo 4) whose vectors have the largest mean cosine: one mean unit vector a type is enough."""
    facts = views.vectors(spark, sf_dir)
    known = facts.select((F.col("label") % 4).alias("type"), F.col("vec").alias("v"), norm("vec").alias("size"))
    each = known.select("type", F.posexplode("v").alias("i", "x"), "size").groupBy("type", "i").agg(F.avg(F.col("x") / F.col("size")).alias("x"))
    templates = each.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("t"))
    scored = facts.select("fact_id", "vec", norm("vec").alias("size")).crossJoin(F.broadcast(templates)).select("fact_id", "type", (dot("vec", "t") / F.col("size")).alias("s"))
    top = scored.groupBy("fact_id").agg(F.max_by(F.struct("type", "s"), F.struct(F.round("s", 9), -F.col("type"))).alias("b"))
    return top.select("fact_id", F.col("b.type").alias("type"), F.round("b.s", 6).alias("similarity"))


@query(
    "J20_hebbian_code_links",
    "WITH c AS (SELECT e.src AS node, n.file_path, count(*) AS shared FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.weight >= 0.5 GROUP BY ALL) SELECT node, file_path, round(least(0.8, 0.3 + 0.1 * shared), 6)::DOUBLE AS weight FROM c",
)
def j20_hebbian_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes to files by the number of strong neighbours there: 0.3 + 0.1 each, 0.8 at most."""
    files = views.nodes(spark, sf_dir).select(F.col("node_id").alias("dst"), "file_path")
    c = views.edges(spark, sf_dir).where("weight >= 0.5").join(files, "dst").groupBy(F.col("src").alias("node"), "file_path").agg(count().alias("shared"))
    return c.select("node", "file_path", F.round(F.least(F.lit(0.8), 0.3 + 0.1 * F.col("shared")), 6).alias("weight"))


LEVELS = ["semantic", "episodic", "opinion", "temporal"]


@query("B19_synthetic_pairs", f"SELECT fact_id, fact_type, (CASE WHEN access_count >= 8 OR importance >= 0.8 THEN 1 ELSE 0 END)::INT AS label FROM facts WHERE list_contains({sql_list(LEVELS)}, fact_type) AND (access_count >= 8 OR importance >= 0.8 OR access_count = 0)")
def b19_synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with strong use or importance as positives, unused ones as negatives."""
    good = (F.col("access_count") >= 8) | (F.col("importance") >= 0.8)
    return views.facts(spark, sf_dir).where(F.col("fact_type").isin(LEVELS) & (good | (F.col("access_count") == 0))).select("fact_id", "fact_type", F.when(good, 1).otherwise(0).alias("label"))
