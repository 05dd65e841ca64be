"""Fusion, rescoring and shaping of ranked channels.

A channel is a long table (query_id, channel, fact_id, score, rank). Every operator is a window or an aggregate by
query; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.operators.lexical import SQL_BM25, best, bm25
from engram.operators.text import entities
from engram.operators.vectors import SQL_TOPK, query_vectors, topk
from engram.registry import query


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels over vectors: nearest, same label, most used. Queries are every twentieth vector."""
    near = topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 20).select("query_id", F.lit("semantic").alias("channel"), "fact_id", F.col("similarity").alias("score"), "rank")
    facts = views.vectors(spark, sf_dir).select("fact_id", "label", "access_count")
    asked = facts.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "label")
    # Of each label only its 20 first facts can show, whatever the query.
    mates = facts.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("fact_id"))).where("r <= 21")
    same = mates.join(asked, "label").where("fact_id <> query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("fact_id")).cast("long")).where("rank <= 20")
    used = facts.where("access_count = 11").orderBy("fact_id").limit(20)
    popular = asked.crossJoin(F.broadcast(used.select("fact_id", F.row_number().over(W.orderBy("fact_id")).cast("long").alias("rank"))))
    return near.union(same.select("query_id", F.lit("entity_graph"), "fact_id", F.lit(1.0), "rank")).union(popular.select("query_id", F.lit("temporal"), "fact_id", F.lit(0.5), "rank"))


SQL_CHANNELS = f"""{SQL_TOPK.format(on='true')}, qs AS (SELECT fact_id AS query_id, label FROM vectors WHERE fact_id % 20 = 0),
    same AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS rank FROM qs JOIN vectors USING (label) WHERE fact_id <> query_id),
    used AS (SELECT fact_id, row_number() OVER (ORDER BY fact_id) AS rank FROM vectors WHERE access_count = 11),
    ch AS (SELECT query_id, 'semantic' AS channel, fact_id, similarity AS score, rank FROM k WHERE rank <= 20 UNION ALL SELECT query_id, 'entity_graph', fact_id, 1.0, rank FROM same WHERE rank <= 20
      UNION ALL SELECT query_id, 'temporal', fact_id, 0.5, rank FROM qs CROSS JOIN used WHERE rank <= 20)"""
SQL_WEIGHT = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in fixed.CHANNEL_WEIGHTS.items()) + " END"


def weight(channel: str = "channel") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in fixed.CHANNEL_WEIGHTS.items() for x in p]), F.col(channel))


def weighted_rrf(ranked: DataFrame) -> DataFrame:
    """(query_id, fact_id, fused): sum of w / (15 + rank); a channel of the query that lacks the fact counts as rank 1000."""
    absent = fixed.RRF_K + fixed.RRF_ABSENT
    w = weight()
    base = ranked.select("query_id", "channel").distinct().groupBy("query_id").agg(F.sum(w / absent).alias("base"))
    gain = ranked.groupBy("query_id", "fact_id").agg(F.sum(w / (fixed.RRF_K + F.col("rank")) - w / absent).alias("gain"))
    return gain.join(base, "query_id").select("query_id", "fact_id", (F.col("gain") + F.col("base")).alias("fused"))


SQL_RRF = f"""w AS (SELECT *, {SQL_WEIGHT} AS w FROM ch), b AS (SELECT query_id, sum(w / 1015) AS base FROM (SELECT DISTINCT query_id, channel, w FROM w) GROUP BY query_id),
    f AS (SELECT query_id, fact_id, any_value(base) + sum(w / (15 + rank) - w / 1015) AS fused FROM w JOIN b USING (query_id) GROUP BY query_id, fact_id)"""


@query("F1_weighted_rrf", f"WITH {SQL_CHANNELS}, {SQL_RRF} SELECT query_id, fact_id, round(fused, 6) AS fused FROM f")
def f1_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_rrf(channels(spark, sf_dir)).withColumn("fused", F.round("fused", 6))


@query("F2_rrf60", f"WITH {SQL_CHANNELS} SELECT query_id, fact_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused FROM ch GROUP BY query_id, fact_id")
def f2_rrf60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).groupBy("query_id", "fact_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("fused"))


@query(
    "F3_cross_channel_boost",
    f"""WITH {SQL_CHANNELS}, {SQL_RRF}, g AS (SELECT query_id, fact_id, count(DISTINCT channel) AS n, bool_or(channel = 'temporal') AND bool_or(channel = 'entity_graph') AS ts FROM ch GROUP BY query_id, fact_id)
    SELECT query_id, fact_id, round(fused * CASE WHEN n >= 3 THEN 2.0 WHEN ts THEN 1.8 WHEN n = 2 THEN 1.5 ELSE 1.0 END, 6) AS boosted FROM f JOIN g USING (query_id, fact_id)""",
)
def f3_cross_channel_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores, twice for facts in three channel groups, 1.8 for time and structure, 1.5 for two."""
    ranked = channels(spark, sf_dir)
    group = F.element_at(F.create_map(*[F.lit(x) for p in fixed.CHANNEL_GROUPS.items() for x in p]), F.col("channel"))
    groups = ranked.groupBy("query_id", "fact_id").agg(F.collect_set(group).alias("g"))
    factor = F.when(F.size("g") >= 3, 2.0).when(F.array_contains("g", "temporal") & F.array_contains("g", "structure"), 1.8).when(F.size("g") == 2, 1.5).otherwise(1.0)
    return weighted_rrf(ranked).join(groups, ["query_id", "fact_id"]).select("query_id", "fact_id", F.round(F.col("fused") * factor, 6).alias("boosted"))


@query(
    "F8_blend_rerank",
    f"""WITH {SQL_BM25}, x AS (SELECT query_id, fact_id, score, access_count::DOUBLE AS e FROM r JOIN facts USING (fact_id) WHERE rank <= 30),
    m AS (SELECT *, min(e) OVER p AS lo, max(e) OVER p AS hi, max(score) OVER p AS top FROM x WINDOW p AS (PARTITION BY query_id))
    SELECT query_id, fact_id, round(0.75 * CASE WHEN hi > lo THEN (e - lo) / (hi - lo) ELSE 0.5 END + 0.25 * score / top, 6) AS score FROM m""",
)
def f8_blend_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.75 of an external score (a column, min-max scaled in the query) and 0.25 of the fused one."""
    facts = views.facts(spark, sf_dir).select("fact_id", F.col("access_count").cast("double").alias("e"))
    hits = bm25(views.queries(spark, sf_dir), views.facts(spark, sf_dir), 30).join(facts, "fact_id")
    p = W.partitionBy("query_id")
    scaled = hits.select("*", F.min("e").over(p).alias("lo"), F.max("e").over(p).alias("hi"), F.max("score").over(p).alias("top"))
    e = F.when(F.col("hi") > F.col("lo"), (F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return scaled.select("query_id", "fact_id", F.round(0.75 * e + 0.25 * F.col("score") / F.col("top"), 6).alias("score"))


@query(
    "F9_result_score",
    f"""WITH {SQL_BM25}, x AS (SELECT query_id, fact_id, score, date_diff('day', created_at, TIMESTAMP '{views.NOW}')::DOUBLE AS age, access_count, length(content) AS n, confidence FROM r JOIN facts USING (fact_id) WHERE rank <= 30),
    y AS (SELECT query_id, fact_id, score * (0.8 + 0.3 * pow(2, -age / (30 * least(2.0, 1 + 0.1 * access_count)))) * CASE WHEN n < 20 THEN 0.3 WHEN n < 60 THEN 0.7 ELSE 1.0 END * (0.5 + confidence) AS s FROM x)
    SELECT query_id, fact_id, round(1 / (1 + exp(-0.5 * s)), 6) AS score FROM y""",
)
def f9_result_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score by recency, length and trust, then a sigmoid."""
    facts = views.facts(spark, sf_dir)
    hits = bm25(views.queries(spark, sf_dir), facts, 30).join(facts, "fact_id")
    age = F.datediff(views.now(), "created_at")
    recency = 0.8 + 0.3 * F.pow(F.lit(2.0), -age / (30 * F.least(F.lit(2.0), 1 + 0.1 * F.col("access_count"))))
    size = F.when(F.length("content") < 20, 0.3).when(F.length("content") < 60, 0.7).otherwise(1.0)
    score = F.col("score") * recency * size * (0.5 + F.col("confidence"))
    return hits.select("query_id", "fact_id", F.round(1 / (1 + F.exp(-0.5 * score)), 6).alias("score"))


@query("F10_final_normalise", f"WITH {SQL_BM25} SELECT query_id, fact_id, round(1 / (1 + exp(-score * 2 / greatest(1, max(score) OVER (PARTITION BY query_id)))), 4) AS score FROM r WHERE rank <= 50")
def f10_final_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25(views.queries(spark, sf_dir), views.facts(spark, sf_dir), 50)
    top = F.greatest(F.lit(1.0), F.max("score").over(W.partitionBy("query_id")))
    return hits.select("query_id", "fact_id", F.round(1 / (1 + F.exp(-F.col("score") * 2 / top)), 4).alias("score"))


@query("F11_apply_channel_weights", f"WITH {SQL_CHANNELS} SELECT query_id, fact_id, round(sum(score * {SQL_WEIGHT}), 6) AS score FROM ch GROUP BY query_id, fact_id")
def f11_apply_channel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).groupBy("query_id", "fact_id").agg(F.round(F.sum(F.col("score") * weight()), 6).alias("score"))


@query("F13_temporal_validity_filter", "SELECT fact_id, valid_from FROM validity WHERE valid_until IS NULL")
def f13_temporal_validity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.validity(spark, sf_dir).where("valid_until IS NULL").select("fact_id", "valid_from")


@query(
    "F14_auto_invoke_score",
    f"""WITH a AS (SELECT fact_id, count(*) AS n, date_diff('second', max(accessed_at), TIMESTAMP '{views.NOW}')::DOUBLE AS idle, avg(value) / 500 AS sim FROM access GROUP BY fact_id), m AS (SELECT *, max(n) OVER () AS most FROM a)
    SELECT fact_id, round(0.40 * sim + 0.25 * greatest(0.01, exp(-0.01 * idle)) + 0.20 * ln(1 + n) / ln(1 + most) + 0.15 * 0.5, 6) AS score FROM m WHERE 0.40 * sim + 0.25 * greatest(0.01, exp(-0.01 * idle)) + 0.20 * ln(1 + n) / ln(1 + most) + 0.15 * 0.5 >= 0.12""",
)
def f14_auto_invoke_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.40 similarity, 0.25 recency, 0.20 frequency, 0.15 trust; at least 0.12."""
    used = views.access(spark, sf_dir).groupBy("fact_id").agg(F.count("*").alias("n"), F.max("accessed_at").cast("timestamp").alias("last"), (F.avg("value") / 500).alias("sim"))
    idle = F.unix_timestamp(views.now()) - F.unix_timestamp("last")
    most = used.agg(F.max("n").alias("most"))
    score = 0.40 * F.col("sim") + 0.25 * F.greatest(F.lit(0.01), F.exp(-0.01 * idle)) + 0.20 * F.log1p("n") / F.log1p("most") + 0.15 * 0.5
    return used.crossJoin(F.broadcast(most)).select("fact_id", F.round(score, 6).alias("score"), score.alias("raw")).where("raw >= 0.12").drop("raw")


@query(
    "F15_act_r_base_level",
    f"""WITH r AS (SELECT fact_id, date_diff('second', accessed_at, TIMESTAMP '{views.NOW}')::DOUBLE AS t, row_number() OVER (PARTITION BY fact_id ORDER BY accessed_at DESC, event_id) AS n FROM access)
    SELECT fact_id, round(1 / (1 + exp(-ln(sum(pow(greatest(t, 1), -0.5))))), 6) AS level FROM r WHERE n <= 100 GROUP BY fact_id""",
)
def f15_act_r_base_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoid of the log of summed powers of age, over the last 100 accesses."""
    t = F.unix_timestamp(views.now()) - F.unix_timestamp(F.col("accessed_at").cast("timestamp"))
    recent = views.access(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("fact_id").orderBy(F.desc("accessed_at"), "event_id"))).where("n <= 100")
    level = F.log(F.sum(F.pow(F.greatest(t, F.lit(1)), F.lit(-0.5))))
    return recent.groupBy("fact_id").agg(F.round(1 / (1 + F.exp(-level)), 6).alias("level"))


@query(
    "F16_core_block_select",
    """WITH c AS (SELECT session_id, fact_id, pinned, importance, access_count, length(content) // 4 AS tokens FROM facts WHERE pinned OR importance >= 0.8 OR access_count >= 2),
    r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (PARTITION BY session_id ORDER BY pinned DESC, importance DESC, access_count DESC, fact_id ROWS UNBOUNDED PRECEDING) AS used FROM c WINDOW w AS (PARTITION BY session_id ORDER BY pinned DESC, importance DESC, access_count DESC, fact_id))
    SELECT session_id, fact_id, rank FROM r WHERE rank <= 5 AND used <= 1000""",
)
def f16_core_block_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pinned, important or used facts of a session, up to the first that passes 1,000 tokens."""
    able = views.facts(spark, sf_dir).where("pinned OR importance >= 0.8 OR access_count >= 2").withColumn("tokens", F.floor(F.length("content") / 4))
    order = W.partitionBy("session_id").orderBy(F.desc("pinned"), F.desc("importance"), F.desc("access_count"), "fact_id")
    ranked = able.select("session_id", "fact_id", F.row_number().over(order).cast("long").alias("rank"), F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("used"))
    return ranked.where("rank <= 5 AND used <= 1000").select("session_id", "fact_id", "rank")


@query(
    "F17_edge_order",
    f"WITH {SQL_TOPK.format(on='true')} SELECT query_id, fact_id, (CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE 11 - rank // 2 END)::BIGINT AS place FROM k WHERE rank <= 10",
)
def f17_edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best first, second last, third second: the strongest stand at both edges."""
    place = F.when(F.col("rank") % 2 == 1, F.floor((F.col("rank") + 1) / 2)).otherwise(11 - F.floor(F.col("rank") / 2))
    return topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 10).select("query_id", "fact_id", place.cast("long").alias("place"))


@query(
    "F18_token_budget",
    f"""WITH {SQL_BM25}, x AS (SELECT query_id, fact_id, rank, least(600, length(content) // 4) AS tokens FROM r JOIN facts USING (fact_id) WHERE rank <= 20),
    y AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM x) SELECT query_id, fact_id, used::BIGINT AS used FROM y WHERE used <= 4000""",
)
def f18_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in order until the budget of 4,000 tokens breaks; an item counts 600 at most."""
    facts = views.facts(spark, sf_dir).select("fact_id", F.least(F.lit(600), F.floor(F.length("content") / 4)).alias("tokens"))
    hits = bm25(views.queries(spark, sf_dir), views.facts(spark, sf_dir), 20).join(facts, "fact_id")
    used = F.sum("tokens").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("used", used).where("used <= 4000").select("query_id", "fact_id", F.col("used").cast("long").alias("used"))


