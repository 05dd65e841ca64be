"""Behaviour mining from tool and usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.registry import query

count = lambda: F.count("*")


@query(
    "B1_tool_bigrams",
    """WITH n AS (SELECT tool_name AS a, lead(tool_name) OVER (PARTITION BY session_id ORDER BY ts, id) AS b FROM tools), g AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL AND a <> b GROUP BY a, b), t AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER () AS share FROM g)
    SELECT a, b, n, round(share, 6) AS share, round(least(0.9, 2 * share), 6)::DOUBLE AS confidence FROM t WHERE n >= 3 AND share >= 0.05""",
)
def b1_tool_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different tools in a row: at least three and 5 % of all."""
    after = F.lead("tool_name").over(W.partitionBy("session_id").orderBy("ts", "id"))
    pairs = views.tools(spark, sf_dir).select(F.col("tool_name").alias("a"), after.alias("b")).where("b IS NOT NULL AND a <> b").groupBy("a", "b").agg(count().alias("n"))
    shared = pairs.crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("all")))).withColumn("s", F.col("n") / F.col("all")).where("n >= 3 AND s >= 0.05")
    return shared.select("a", "b", "n", F.round("s", 6).alias("share"), F.round(F.least(F.lit(0.9), 2 * F.col("s")), 6).alias("confidence"))


@query("B2_correction_rate", "SELECT session_id, count(*) AS n, round(avg(failed::INT), 6) AS rate FROM tools GROUP BY session_id HAVING count(*) >= 3 AND avg(failed::INT) > 0.15")
def b2_correction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.tools(spark, sf_dir).groupBy("session_id").agg(count().alias("n"), F.avg(F.col("failed").cast("int")).alias("r")).where("n >= 3 AND r > 0.15")
    return rated.select("session_id", "n", F.round("r", 6).alias("rate"))


@query(
    "B3_tool_preference",
    "WITH c AS (SELECT project, tool_name, count(*) AS n FROM tools GROUP BY ALL), s AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY project) AS share, row_number() OVER (PARTITION BY project ORDER BY n DESC, tool_name) AS rank FROM c) SELECT project, tool_name, n, round(share, 6) AS share FROM s WHERE rank <= 5 AND n >= 3 AND share > 0.1",
)
def b3_tool_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.partitionBy("project")
    c = views.tools(spark, sf_dir).groupBy("project", "tool_name").agg(count().alias("n"))
    s = c.select("*", (F.col("n") / F.sum("n").over(p)).alias("s"), F.row_number().over(p.orderBy(F.desc("n"), "tool_name")).alias("rank"))
    return s.where("rank <= 5 AND n >= 3 AND s > 0.1").select("project", "tool_name", "n", F.round("s", 6).alias("share"))


@query("B4_peak_hours", "WITH c AS (SELECT session_id, hour(ts)::INT AS hour, count(*) AS n FROM tools GROUP BY 1, 2), s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY session_id) AS share FROM c) SELECT session_id, hour, n FROM s WHERE share > 0.10")
def b4_peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more than 10 % of a session's events."""
    c = views.tools(spark, sf_dir).groupBy("session_id", F.hour("ts").alias("hour")).agg(count().alias("n"))
    return c.withColumn("all", F.sum("n").over(W.partitionBy("session_id"))).where("n > 0.10 * all").select("session_id", "hour", "n")


@query(
    "B5_assertion_upsert",
    "SELECT substr(sha256(tool_name || '|' || project), 1, 16) AS id, count(*) AS n, round(1 - (1 - least(0.7, avg(value) / 500)) * pow(0.85, least(count(*) - 1, 50)), 6) AS confidence FROM tools GROUP BY tool_name, project",
)
def b5_assertion_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repetition adds 0.15 of what is missing: 1 - (1 - c) * 0.85 ** repetitions, whatever their order."""
    key = F.substring(F.sha2(F.concat_ws("|", "tool_name", "project"), 256), 1, 16)
    c = F.least(F.lit(0.7), F.avg("value") / 500)
    confidence = 1 - (1 - c) * F.pow(F.lit(0.85), F.least(count() - 1, F.lit(50)))
    return views.tools(spark, sf_dir).groupBy("tool_name", "project").agg(count().alias("n"), F.round(confidence, 6).alias("confidence")).select(key.alias("id"), "n", "confidence")


@query("B6_promote_global", "WITH p AS (SELECT project, tool_name, avg(value) / 500 AS c FROM tools GROUP BY ALL) SELECT tool_name, count(DISTINCT project) AS projects, round(avg(c), 6) AS confidence FROM p GROUP BY tool_name HAVING count(DISTINCT project) >= 2 AND avg(c) >= 0.1")
def b6_promote_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.tools(spark, sf_dir).groupBy("project", "tool_name").agg((F.avg("value") / 500).alias("c"))
    g = p.groupBy("tool_name").agg(F.countDistinct("project").alias("projects"), F.avg("c").alias("m")).where("projects >= 2 AND m >= 0.1")
    return g.select("tool_name", "projects", F.round("m", 6).alias("confidence"))


@query("B8_skill_pairs", "WITH s AS (SELECT DISTINCT session_id, tool_name FROM tools) SELECT a.tool_name AS a, b.tool_name AS b, count(*) AS sessions FROM s a JOIN s b ON a.session_id = b.session_id AND a.tool_name < b.tool_name GROUP BY ALL HAVING count(*) >= 2")
def b8_skill_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of one session in pairs; a session has as many as there are kinds of tools."""
    s = views.tools(spark, sf_dir).select("session_id", "tool_name").distinct()
    pairs = s.alias("a").join(s.alias("b"), "session_id").where("a.tool_name < b.tool_name")
    return pairs.groupBy(F.col("a.tool_name").alias("a"), F.col("b.tool_name").alias("b")).agg(count().alias("sessions")).where("sessions >= 2")


_PART = "CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END"


@query(
    "B10_activity_by_daypart",
    f"WITH c AS (SELECT project, {_PART} AS part, tool_name, count(*) AS n FROM tools GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY project, part ORDER BY n DESC, tool_name) AS k FROM c WHERE n >= 5) SELECT project, part, tool_name, n FROM r WHERE k = 1",
)
def b10_activity_by_daypart(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    c = views.tools(spark, sf_dir).groupBy("project", part.alias("part"), "tool_name").agg(count().alias("n")).where("n >= 5")
    k = F.row_number().over(W.partitionBy("project", "part").orderBy(F.desc("n"), "tool_name"))
    return c.withColumn("k", k).where("k = 1").select("project", "part", "tool_name", "n")


@query("B12_session_heavy", "WITH s AS (SELECT session_id, count(*) AS n FROM tools GROUP BY session_id) SELECT session_id, n FROM s WHERE n > 1.2 * (SELECT avg(n) FROM s)")
def b12_session_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.tools(spark, sf_dir).groupBy("session_id").agg(count().alias("n"))
    return s.crossJoin(F.broadcast(s.agg(F.avg("n").alias("mean")))).where("n > 1.2 * mean").select("session_id", "n")


@query("B13_channel_performance", "SELECT signal, count(*) AS n, round(avg(position), 6) AS mean FROM signals GROUP BY signal HAVING count(*) >= 5")
def b13_channel_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.signals(spark, sf_dir).groupBy("signal").agg(count().alias("n"), F.round(F.avg("position"), 6).alias("mean")).where("n >= 5")


@query("B15_pattern_store", "SELECT tool_name, project, count(*) AS evidence, round(least(count(*) / 10.0, 1) * 2 * abs(avg(failed::INT) - 0.5), 6)::DOUBLE AS confidence FROM tools GROUP BY ALL")
def b15_pattern_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.least(count() / 10.0, F.lit(1.0)) * 2 * F.abs(F.avg(F.col("failed").cast("int")) - 0.5)
    return views.tools(spark, sf_dir).groupBy("tool_name", "project").agg(count().alias("evidence"), F.round(confidence, 6).alias("confidence"))


@query(
    "B20_training_matrix",
    """SELECT query_id, fact_id, avg(position) AS position, count(*) AS shown, max((signal = 'store')::INT)::INT AS stored, max(access_count)::BIGINT AS used, max(p_retailprice) AS size FROM signals JOIN part ON p_partkey = fact_id JOIN (SELECT p_partkey AS pk, p_partkey % 12 AS access_count FROM part) ON pk = fact_id GROUP BY query_id, fact_id""",
)
def b20_training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each (query, fact)."""
    part = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), (F.col("p_partkey") % 12).alias("access_count"), "p_retailprice")
    s = views.signals(spark, sf_dir).join(part, "fact_id")
    return s.groupBy("query_id", "fact_id").agg(F.avg("position").alias("position"), count().alias("shown"), F.max((F.col("signal") == "store").cast("int")).alias("stored"), F.max("access_count").alias("used"), F.max("p_retailprice").alias("size"))


