"""Precision of vectors by their standing, residual codes, archives, and a ranker judged on held-out queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.entities import both_ways, links, standing
from engram.operators.graph import cut, pageranks
from engram.operators.lexical import SQL_BM25, best, scores, term_index, tokens
from engram.operators.lifecycle import SQL_RETENTION, _retention
from engram.operators.vectors import fisher_variance, unit
from engram.registry import query

_SQL_VARIANCE = """n AS (SELECT fact_id, vec, access_count, sqrt(list_dot_product(vec, vec)) AS size FROM vectors), m AS (SELECT fact_id, access_count, list_transform(vec, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0 END) AS mean FROM n),
    t AS (SELECT *, list_max(list_transform(mean, lambda x: abs(x))) AS top FROM m), v AS (SELECT fact_id, access_count, list_transform(mean, lambda x: CASE WHEN top > 0 THEN greatest(0.05, least(2.0, 2.0 - 1.95 * abs(x) / top)) ELSE 2.0 END) AS var FROM t)"""


@query(
    "Y8_fisher_confidence",
    f"""WITH {_SQL_VARIANCE}, c AS (SELECT fact_id, 1 / (1 + list_sum(var) / len(var)) + least(0.02 * access_count, 0.2) AS c, 0.3 + 0.06 * access_count AS radius FROM v)
    SELECT fact_id, round(c, 6)::DOUBLE AS confidence, CASE WHEN c > 0.55 THEN 'stabilise' WHEN c > 0.42 THEN 'neutral' ELSE 'fade' END AS band,
      round(CASE WHEN c > 0.55 THEN 1.2 WHEN c > 0.42 THEN 1.0 ELSE 0.7 END * CASE WHEN radius > 0.85 THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS weight FROM c""",
)
def y8_fisher_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 / (1 + mean variance) plus 0.02 for each use up to 0.2, in three bands with a weight; 0.8 of it beyond a radius of
    0.85 (an input, here by uses)."""
    var = views.vectors(spark, sf_dir).select("fact_id", "access_count", unit("vec").alias("mean")).select("fact_id", "access_count", fisher_variance("mean").alias("var"))
    mean = F.aggregate("var", F.lit(0.0), lambda s, x: s + x) / F.size("var")
    c = var.select("fact_id", (1 / (1 + mean) + F.least(0.02 * F.col("access_count"), F.lit(0.2))).alias("c"), (0.3 + 0.06 * F.col("access_count")).alias("radius"))
    band = lambda a, b, z: F.when(F.col("c") > 0.55, a).when(F.col("c") > 0.42, b).otherwise(z)
    weight = band(1.2, 1.0, 0.7) * F.when(F.col("radius") > 0.85, 0.8).otherwise(1.0)
    return c.select("fact_id", F.round("c", 6).alias("confidence"), band("stabilise", "neutral", "fade").alias("band"), F.round(weight, 6).alias("weight"))


@query(
    "Y9_coupled_weight",
    f"""WITH {SQL_RETENTION}, {_SQL_VARIANCE}, c AS (SELECT fact_id, 1 / (1 + list_sum(var) / len(var)) + least(0.02 * access_count, 0.2) AS c, 0.3 + 0.06 * access_count AS radius FROM v),
    y AS (SELECT fact_id, round(CASE WHEN c > 0.55 THEN 1.2 WHEN c > 0.42 THEN 1.0 ELSE 0.7 END * CASE WHEN radius > 0.85 THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS w FROM c)
    SELECT ret.fact_id, round(coalesce(w, 1.0) * CASE zone WHEN 'active' THEN 1.0 WHEN 'warm' THEN 0.7 WHEN 'cold' THEN 0.3 ELSE 0 END, 6)::DOUBLE AS weight,
      round(15 * (1 + 0.5 * (1 - retention)), 6)::DOUBLE AS temperature FROM ret LEFT JOIN y ON y.fact_id = ret.fact_id""",
)
def y9_coupled_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's weight by confidence (Y8; 1 without a vector) times that of its zone, and a temperature that forgetting raises."""
    z = F.col("zone")
    factor = F.when(z == "active", 1.0).when(z == "warm", 0.7).when(z == "cold", 0.3).otherwise(0.0)
    rows = _retention(spark, sf_dir).select("fact_id", "zone", "retention").join(y8_fisher_confidence(spark, sf_dir).select("fact_id", "weight"), "fact_id", "left")
    return rows.select("fact_id", F.round(F.coalesce("weight", F.lit(1.0)) * factor, 6).alias("weight"), F.round(15 * (1 + 0.5 * (1 - F.col("retention"))), 6).alias("temperature"))


@query(
    "Y11_precision_from_centrality",
    f"""WITH {SQL_RETENTION}, dg AS (SELECT src AS fact_id, count(*) AS degree FROM ends GROUP BY src), ac AS (SELECT fact_id, count(*) AS uses FROM access GROUP BY fact_id),
    j AS (SELECT s.fact_id, pr, coalesce(degree, 0) AS degree, coalesce(uses, 0) AS uses FROM standing s LEFT JOIN dg ON dg.fact_id = s.fact_id LEFT JOIN ac ON ac.fact_id = s.fact_id),
    x AS (SELECT fact_id, 0.5 * pr / max(pr) OVER () + 0.3 * degree / max(degree) OVER () + 0.2 * uses / max(uses) OVER () AS c FROM j),
    b AS (SELECT x.fact_id, c, CASE WHEN round(c, 9) > 0.7 THEN 32 WHEN round(c, 9) > 0.4 THEN 8 WHEN round(c, 9) > 0.15 THEN 4 ELSE 2 END AS central, CASE WHEN retention > 0.8 THEN 32 WHEN retention > 0.5 THEN 8 WHEN retention > 0.2 THEN 4 WHEN retention > 0.05 THEN 2 ELSE 0 END AS kept FROM x JOIN ret USING (fact_id))
    SELECT fact_id, round(c, 6)::DOUBLE AS centrality, greatest(central, kept)::INT AS bits, CASE WHEN greatest(central, kept) > kept THEN 'up' WHEN kept = 32 THEN 'skip' ELSE 'keep' END AS action FROM b""",
)
def y11_precision_from_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.5 rank + 0.3 degree + 0.2 use, each over its largest, as a ladder of widths; the wider of this and the width by
    retention counts."""
    facts, ends = views.facts(spark, sf_dir), both_ways(links(spark, sf_dir))
    degree = ends.groupBy(F.col("src").alias("fact_id")).agg(F.count("*").alias("degree"))
    uses = views.access(spark, sf_dir).groupBy("fact_id").agg(F.count("*").alias("uses"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = standing(facts, pageranks(spark, sf_dir)).join(degree, "fact_id", "left").join(uses, "fact_id", "left").select("fact_id", "pr", zero("degree").alias("degree"), zero("uses").alias("uses"))
    top = j.agg(F.max("pr").alias("mp"), F.max("degree").alias("md"), F.max("uses").alias("mu"))
    c = 0.5 * F.col("pr") / F.col("mp") + 0.3 * F.col("degree") / F.col("md") + 0.2 * F.col("uses") / F.col("mu")
    x = j.crossJoin(F.broadcast(top)).select("fact_id", c.alias("c")).join(_retention(spark, sf_dir).select("fact_id", "retention"), "fact_id")
    k, r = F.round("c", 9), F.col("retention")
    central = F.when(k > 0.7, 32).when(k > 0.4, 8).when(k > 0.15, 4).otherwise(2)
    kept = F.when(r > 0.8, 32).when(r > 0.5, 8).when(r > 0.2, 4).when(r > 0.05, 2).otherwise(0)
    bits = F.greatest(central, kept)
    action = F.when(bits > kept, "up").when(kept == 32, "skip").otherwise("keep")
    return x.select("fact_id", F.round("c", 6).alias("centrality"), bits.alias("bits"), action.alias("action"))


@query(
    "Y12_reward_gated_archive",
    """SELECT fact_id, CASE WHEN octet_length(encode(content)) > 262144 THEN '{"id":' || fact_id || ',"stub":true}' ELSE '{"id":' || fact_id || ',"md5":"' || md5(content) || '"}' END AS payload FROM facts
    WHERE lifecycle = 'cold' AND importance < 1 AND fact_id NOT IN (SELECT fact_id FROM outcomes WHERE reward > 0.3 AND settled_at >= (SELECT max(settled_at) FROM outcomes) - INTERVAL 60 DAY)""",
)
def y12_reward_gated_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold facts of importance below 1 without a reward above 0.3 in the last 60 days, with their payload as JSON (here the hash of
    the text stands for it); a stub for texts of over 256 KiB."""
    settled = views.outcomes(spark, sf_dir)
    last = F.broadcast(settled.agg(F.max("settled_at").alias("last")))
    good = settled.crossJoin(last).where((F.col("reward") > 0.3) & (F.col("settled_at") >= F.col("last") - F.expr("INTERVAL 60 DAYS"))).select("fact_id")
    cold = views.facts(spark, sf_dir).where("lifecycle = 'cold' AND importance < 1").join(good, "fact_id", "left_anti")
    whole = F.to_json(F.struct(F.col("fact_id").alias("id"), F.md5("content").alias("md5")))
    stub = F.to_json(F.struct(F.col("fact_id").alias("id"), F.lit(True).alias("stub")))
    return cold.select("fact_id", F.when(F.octet_length("content") > 262144, stub).otherwise(whole).alias("payload"))


@query(
    "L3_bm25plus_phrase",
    f"""WITH {SQL_BM25}, s3 AS (SELECT query_id, p.fact_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))) AS score FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term JOIN l ON l.fact_id = p.fact_id CROSS JOIN stats GROUP BY query_id, p.fact_id),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM s3),
    x AS (SELECT r3.query_id, r3.fact_id, r3.score * CASE WHEN length(text) >= 5 AND contains(lower(content), lower(text)) THEN 1.5 ELSE 1.0 END AS score FROM r3 JOIN facts ON facts.fact_id = r3.fact_id JOIN queries ON queries.query_id = r3.query_id),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM x) SELECT query_id, fact_id, round(score, 6) AS score FROM y WHERE rank <= 10""",
)
def l3_bm25plus_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25+ (one more for each matched term), 1.5 times that for texts which contain a whole query of five characters or
    more; the ten best.

    A text that holds the query holds its terms, but for the first and the last, which may be parts of longer ones there:
    only such hits are read. They and the ten best without the factor hold the ten best with it.
    """
    facts, asked = views.facts(spark, sf_dir), views.queries(spark, sf_dir)
    hits = cut(scores(asked, term_index(facts), delta=1.0))
    able = asked.where(F.length("text") >= 5).select("query_id", F.lower("text").alias("phrase"), F.size(F.array_distinct(tokens("text"))).alias("terms"))
    read = hits.join(able, "query_id").where("matched >= terms - 2").join(facts.select("fact_id", "content"), "fact_id")
    held = read.where(F.lower("content").contains(F.col("phrase"))).select("query_id", "fact_id", (1.5 * F.col("score")).alias("score"))
    plain = best(hits.select("query_id", "fact_id", "score"), 10).select("query_id", "fact_id", "score")
    both = held.union(plain).groupBy("query_id", "fact_id").agg(F.max("score").alias("score"))
    return best(both, 10).select("query_id", "fact_id", F.round("score", 6).alias("score"))


@query("B21_train_ranker")
def b21_train_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted regression of relevance (2 stored, 1 recalled, 0 rejected) on features of the fact alone, fitted on
    four fifths of the queries; NDCG@10 of the others by the model, by the bandit's prior (mean relevance of a fact in the
    fitted part) and by their blend, and that of the order shown."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gain = F.when(F.col("signal") == "store", 2.0).when(F.col("signal") == "recall", 1.0).otherwise(0.0)
    s = views.signals(spark, sf_dir).groupBy("query_id", "fact_id").agg(F.max(gain).alias("label"), F.min("position").alias("shown"))
    part = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    degree = both_ways(views.edges(spark, sf_dir)).groupBy(F.col("src").alias("fact_id")).agg(F.count("*").cast("double").alias("degree"), F.sum("weight").alias("weight"))
    held = F.crc32(F.col("query_id").cast("string")) % 5 == 0
    rows = s.join(part, "fact_id").join(degree, "fact_id", "left").fillna(0.0, ["degree", "weight"]).withColumn("held", held)
    prior = rows.where("NOT held").groupBy("fact_id").agg(F.avg("label").alias("prior"))
    features = ["size", "price", "degree", "weight"]
    x = VectorAssembler(inputCols=features, outputCol="x").transform(rows.select("query_id", "fact_id", "label", "shown", "held", *features))
    model = GBTRegressor(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(x.where("NOT held"))
    scored = model.transform(x.where("held")).join(prior, "fact_id", "left").fillna(0.0, ["prior"])
    orders = {"model": F.col("prediction"), "prior": F.col("prior"), "blend": 0.6 * F.col("prediction") + 0.4 * F.col("prior"), "shown": -F.col("shown").cast("double")}
    each = scored.select("query_id", "fact_id", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("by"), v.alias("score")) for k, v in orders.items()])).alias("z")).select("query_id", "fact_id", "label", "z.*")
    rank = F.row_number().over(W.partitionBy("by", "query_id").orderBy(F.desc("score"), "fact_id"))
    ideal = F.row_number().over(W.partitionBy("by", "query_id").orderBy(F.desc("label"), "fact_id"))
    dcg = lambda r: F.sum(F.when(r <= 10, (F.pow(F.lit(2.0), "label") - 1) / F.log2(1 + r)).otherwise(0.0))
    q = each.withColumn("r", rank).withColumn("i", ideal).groupBy("by", "query_id").agg(dcg(F.col("r")).alias("d"), dcg(F.col("i")).alias("best"))
    return q.where("best > 0").groupBy("by").agg(F.round(F.avg(F.col("d") / F.col("best")), 6).alias("ndcg"), F.count("*").alias("queries"))
