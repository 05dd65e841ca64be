"""Joins that link, resolve, validate and merge facts, entities and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.vectors import SQL_TOPK, neighbours, query_vectors, topk
from engram.registry import query

#: An entity with more facts than this joins nothing: the guard against hubs.
HUB = 200


@query(
    "J3_temporal_edges",
    """WITH m AS (SELECT l_partkey AS entity, l_orderkey AS fact, l_shipdate AS t, l_linenumber AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) < 200))
    SELECT a.fact AS a, b.fact AS b, a.entity, round(greatest(0.01, exp(-date_diff('day', a.t, b.t) / 30.0)), 4)::DOUBLE AS weight FROM m a JOIN m b ON a.entity = b.entity AND b.t >= a.t AND date_diff('day', a.t, b.t) <= 7 AND (a.fact, a.n) < (b.fact, b.n)""",
)
def j3_temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one entity within a week. Both sides are cut into weeks, a row looks into its own and the next only."""
    m = views.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("t"))
    m = m.join(m.groupBy("entity").agg(F.count("*").alias("degree")).where(F.col("degree") < HUB), "entity")
    m = m.withColumn("week", F.floor(F.datediff("t", F.lit("1970-01-01")) / 7))
    ahead = m.select("entity", "fact", "n", "t", F.explode(F.array(F.col("week"), F.col("week") + 1)).alias("week"))
    days = F.datediff("b.t", "a.t")
    near = ahead.alias("a").join(m.alias("b"), ["entity", "week"]).where((days >= 0) & (days <= 7)).where("a.fact < b.fact OR (a.fact = b.fact AND a.n < b.n)")
    return near.select(F.col("a.fact").alias("a"), F.col("b.fact").alias("b"), "entity", F.round(F.greatest(F.lit(0.01), F.exp(-days / 30.0)), 4).alias("weight"))


@query("J4_semantic_edges", f"WITH {SQL_TOPK.format(on='true')}, e AS (SELECT query_id, fact_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM k WHERE query_id <> fact_id AND similarity >= 0.1) SELECT query_id, fact_id, round(similarity, 6) AS similarity FROM e WHERE n <= 5")
def j4_semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of cosine 0.1 or more (0.7 for real embeddings) of the asked facts."""
    near = topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 6).where("query_id <> fact_id AND similarity >= 0.1")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("n", n).where("n <= 5").select("query_id", "fact_id", F.round("similarity", 6).alias("similarity"))


@query(
    "J7_sheaf_contradiction",
    f"""WITH {SQL_TOPK.format(on='true')}, d AS (SELECT query_id, fact_id, list_dot_product(qvec, qvec) AS aa, list_dot_product(fvec, fvec) AS bb, list_dot_product(qvec, fvec) AS ab FROM k WHERE rank BETWEEN 2 AND 10),
    x AS (SELECT *, aa + bb - 2 * ab AS dd, aa - ab AS ad, ab - bb AS bd FROM d) SELECT query_id, fact_id, round(sqrt(dd) / (sqrt(0.49 * aa + 0.51 * ad * ad / dd) + sqrt(0.49 * bb + 0.51 * bd * bd / dd)), 6) AS severity FROM x WHERE dd > 0""",
)
def j7_sheaf_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|d| / (|Ra| + |Rb|) with R = 0.7 I + 0.3 dd'/|d|^2, d = a - b, in closed form from three dot products."""
    from engram.operators.vectors import dot

    near = neighbours(spark, sf_dir, 10).where("rank >= 2").select("query_id", "fact_id", dot("qvec", "qvec").alias("aa"), dot("vec", "vec").alias("bb"), dot("qvec", "vec").alias("ab"))
    x = near.select("*", (F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("dd"), (F.col("aa") - F.col("ab")).alias("ad"), (F.col("ab") - F.col("bb")).alias("bd")).where("dd > 0")
    r = lambda n, p: F.sqrt(0.49 * F.col(n) + 0.51 * F.col(p) * F.col(p) / F.col("dd"))
    return x.select("query_id", "fact_id", F.round(F.sqrt("dd") / (r("aa", "ad") + r("bb", "bd")), 6).alias("severity"))


@query(
    "J12_prefix_dedup",
    "WITH k AS (SELECT fact_id, lower(substr(content, 1, 100)) AS key, row_number() OVER (PARTITION BY lower(substr(content, 1, 100)) ORDER BY importance DESC, confidence DESC, fact_id) AS n, first_value(fact_id) OVER (PARTITION BY lower(substr(content, 1, 100)) ORDER BY importance DESC, confidence DESC, fact_id) AS canonical FROM facts) SELECT fact_id, canonical FROM k WHERE n > 1",
)
def j12_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose texts begin alike, and the one that stays: most important, then confident, then oldest.

    The best of each key is an aggregate that combines before the shuffle, so a hot key costs one row a task.
    """
    f = views.facts(spark, sf_dir).select("fact_id", "importance", "confidence", F.md5(F.lower(F.substring("content", 1, 100))).alias("key"))
    top = f.groupBy("key").agg(F.max_by("fact_id", F.struct("importance", "confidence", -F.col("fact_id"))).alias("canonical"))
    return f.join(top, "key").where("fact_id <> canonical").select("fact_id", "canonical")


@query("J13_apply_merges", "WITH c AS (SELECT p_name, max(p_partkey) AS keep FROM part GROUP BY p_name) SELECT p_partkey AS fact_id, CASE WHEN p_partkey <> keep THEN keep END AS merged_into, CASE WHEN p_partkey <> keep THEN 'merged' ELSE 'live' END AS status FROM part JOIN c USING (p_name)")
def j13_apply_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    keep = part.groupBy("p_name").agg(F.max("p_partkey").alias("keep"))
    lost = F.col("p_partkey") != F.col("keep")
    return part.join(keep, "p_name").select(F.col("p_partkey").alias("fact_id"), F.when(lost, F.col("keep")).alias("merged_into"), F.when(lost, "merged").otherwise("live").alias("status"))


@query("J18_hunks_to_nodes", "WITH h AS (SELECT s_suppkey AS hunk, s_suppkey * 90 AS lo, s_suppkey * 90 + 40 AS hi FROM supplier) SELECT hunk, node_id FROM h JOIN nodes ON line_start <= hi AND line_end >= lo")
def j18_hunks_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed line ranges and the nodes that they overlap: both are dealt into bands of 100 lines and met there once."""
    hunks = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hunk"), (F.col("s_suppkey") * 90).alias("lo"), (F.col("s_suppkey") * 90 + 40).alias("hi"))
    bands = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 100), F.floor(F.col(b) / 100))).alias("band")
    h = hunks.select("*", bands("lo", "hi"))
    n = views.nodes(spark, sf_dir).select("node_id", "line_start", "line_end", bands("line_start", "line_end"))
    met = h.join(n, "band").where("line_start <= hi AND line_end >= lo")
    once = F.col("band") == F.floor(F.greatest("lo", "line_start") / 100)
    return met.where(once).select("hunk", "node_id")


@query("J19_stale_links", "SELECT l_orderkey AS fact_id, l_partkey AS node_id FROM lineitem WHERE l_partkey NOT IN (SELECT node_id FROM nodes WHERE NOT is_test)")
def j19_stale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = views.nodes(spark, sf_dir).where("NOT is_test").select("node_id")
    return views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("node_id")).join(alive, "node_id", "left_anti").select("fact_id", "node_id")


@query(
    "J21_incremental_changes",
    "WITH o AS (SELECT p_partkey AS path, md5(p_name) AS hash FROM part WHERE p_size > 5), n AS (SELECT p_partkey AS path, md5(p_name || CASE WHEN p_size % 3 = 0 THEN '!' ELSE '' END) AS hash FROM part WHERE p_size < 45) SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN o.path IS NULL THEN 'new' WHEN o.hash <> n.hash THEN 'change' ELSE 'skip' END AS action FROM o FULL JOIN n ON o.path = n.path",
)
def j21_incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by old and new hash."""
    part = views.read(spark, sf_dir, "part")
    old = part.where("p_size > 5").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("old"))
    new = part.where("p_size < 45").select(F.col("p_partkey").alias("path"), F.md5(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "!").otherwise(""))).alias("new"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "change").otherwise("skip")
    return old.join(new, "path", "full").select("path", action.alias("action"))


@query("J22_outcomes_for_fact", "SELECT fact_id, count(*) AS outcomes, bool_or(reward > 0.9) AS rewarded FROM outcomes WHERE settled_at >= TIMESTAMP '1998-01-01' GROUP BY fact_id")
def j22_outcomes_for_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = views.outcomes(spark, sf_dir).where("settled_at >= TIMESTAMP_NTZ '1998-01-01'")
    return recent.groupBy("fact_id").agg(F.count("*").alias("outcomes"), F.bool_or(F.col("reward") > 0.9).alias("rewarded"))
