"""Further operators of every kind: dates and descriptions, approximate and mixed-precision search, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.vectors import SQL_TOPK, query_vectors, topk
from engram.registry import query

count = lambda: F.count("*")

@query("E12_entity_timeline", "SELECT l_partkey AS entity_id, l_orderkey AS fact_id, row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(l_shipdate, TIMESTAMP '2999-01-01'), l_orderkey, l_linenumber) AS place FROM lineitem")
def e12_entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_partkey").orderBy(F.asc_nulls_last("l_shipdate"), "l_orderkey", "l_linenumber")
    lines = views.read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return lines.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("fact_id"), F.row_number().over(order).cast("long").alias("place"))


TECH = {"python": "language", "java": "language", "docker": "ops", "apache": "ops", "license": "legal", "mit": "legal", "copyright": "legal"}


@query("E19_tech_keywords", "WITH k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in TECH) + "]) AS word) SELECT word, count(*) AS texts FROM k JOIN facts ON contains(lower(content), word) GROUP BY word")
def e19_tech_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that contain each keyword; all keywords are tested in one pass."""
    low = F.lower("content")
    hit = F.filter(F.array(*[F.when(low.contains(k), F.lit(k)) for k in TECH]), lambda x: x.isNotNull())
    return views.facts(spark, sf_dir).select(F.explode(hit).alias("word")).groupBy("word").agg(count().alias("texts"))


@query(
    "J6_auto_link",
    f"WITH {SQL_TOPK.format(on='f.fact_id <> q.fact_id')} SELECT query_id, fact_id, round(similarity, 6) AS similarity FROM k WHERE rank <= 10 AND similarity >= 0.2",
)
def j6_auto_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten links of cosine 0.2 or more (0.7 for real embeddings) for each asked fact."""
    near = topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 11).where("query_id <> fact_id")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("n", n).where("n <= 10 AND similarity >= 0.2").select("query_id", "fact_id", F.round("similarity", 6).alias("similarity"))


@query("A23_adaptive_weights", "WITH r AS (SELECT agent_id, signal, row_number() OVER (PARTITION BY agent_id ORDER BY seen_at DESC, query_id, position, fact_id) AS n FROM signals) SELECT agent_id, round(avg((signal <> 'rejected')::INT), 6) AS relevant, avg((signal <> 'rejected')::INT) < 0.5 AS switched FROM r WHERE n <= 500 GROUP BY agent_id HAVING count(*) >= 20")
def a23_adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("agent_id").orderBy(F.desc("seen_at"), "query_id", "position", "fact_id")
    last = views.signals(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 500")
    share = last.groupBy("agent_id").agg(count().alias("c"), F.avg((F.col("signal") != "rejected").cast("int")).alias("r")).where("c >= 20")
    return share.select("agent_id", F.round("r", 6).alias("relevant"), (F.col("r") < 0.5).alias("switched"))


@query("B11_topic_interest", "WITH w AS (SELECT profile_id, unnest(regexp_extract_all(lower(content), '[a-z]{6,}')) AS word FROM facts), c AS (SELECT profile_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, word) AS k FROM c WHERE n >= 3) SELECT profile_id, word, n FROM r WHERE k <= 15")
def b11_topic_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most frequent long words of a profile; counted before any window sees them."""
    words = views.facts(spark, sf_dir).select("profile_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word"))
    c = words.groupBy("profile_id", "word").agg(count().alias("n")).where("n >= 3")
    return c.withColumn("k", F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc("n"), "word"))).where("k <= 15").drop("k")


