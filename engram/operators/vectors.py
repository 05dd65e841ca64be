"""Vector scoring: a stated set of query vectors against all vectors, and per-vector statistics.

Query sets are small tables: their size is checked before they are broadcast, and larger ones are joined in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.registry import query

#: Query vectors that go into one broadcast.
BLOCK = 4_096


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def given(vec: Column | str, scalar: Column, f) -> Column:
    """f(vec, scalar) with the scalar computed once, not for every element that a lambda visits."""
    return F.transform(F.array(F.struct(F.col(vec).alias("v") if isinstance(vec, str) else vec.alias("v"), scalar.alias("s"))), lambda z: f(z["v"], z["s"]))[0]


def topk(queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, similarity, rank): the k nearest facts of each query by cosine; a zero vector has 0.

    queries: (query_id, vec), facts: (fact_id, vec). Queries are taken in blocks of 4,096 that are broadcast as one
    matrix; each partition of facts is scored by matrix products and keeps its best k, and a window ranks those.
    """
    spark = facts.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    schema = pa.schema([("query_id", pa.int64()), ("fact_id", pa.int64()), ("similarity", pa.float64())])
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", "vec").collect()
        if not rows:
            continue
        ids = np.array([r.query_id for r in rows], dtype=np.int64)
        matrix = np.array([r.vec for r in rows], dtype=np.float64)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((ids, np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)))

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            best_s, best_f = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = batch.column("vec")
                x = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                s = np.concatenate((best_s, matrix @ np.divide(x, length, out=np.zeros_like(x), where=length > 0).T), axis=1)
                f = np.concatenate((best_f, np.broadcast_to(batch.column("fact_id").to_numpy(), (len(ids), batch.num_rows))), axis=1)
                order = np.lexsort((f, -s), axis=1)[:, :k]
                best_s, best_f = np.take_along_axis(s, order, 1), np.take_along_axis(f, order, 1)
            m = best_s.shape[1]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best_f.ravel()), pa.array(best_s.ravel())], schema=schema)

        found = facts.select("fact_id", "vec").mapInArrow(score, "query_id long, fact_id long, similarity double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, fact_id long, similarity double, rank long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "fact_id")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all vectors."""
    return views.vectors(spark, sf_dir).where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "vec")


SQL_TOPK = """s AS (SELECT q.fact_id AS query_id, f.fact_id, list_cosine_similarity(q.vec, f.vec) AS similarity, f.label, f.access_count, q.vec AS qvec, f.vec AS fvec FROM vectors q JOIN vectors f ON {on} WHERE q.fact_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, fact_id) AS rank FROM s)"""


@query("V1_cosine_topk", f"WITH {SQL_TOPK.format(on='true')} SELECT query_id, fact_id, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 10")
def v1_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))


@query("V2_cosine_topk_tier", f"WITH {SQL_TOPK.format(on='f.label <= 3')} SELECT query_id, fact_id, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 10")
def v2_cosine_topk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among facts of some tiers."""
    return topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir).where("label <= 3"), 10).withColumn("similarity", F.round("similarity", 6))


def unit(vec: str) -> Column:
    return given(vec, norm(vec), lambda v, s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(0.0)))


def fisher_variance(mean: str) -> Column:
    """Falls from 2 to 0.05 with a coordinate's share of the largest."""
    top = F.array_max(F.transform(mean, F.abs))
    return given(mean, top, lambda v, t: F.transform(v, lambda m: F.when(t > 0, F.greatest(F.lit(0.05), F.least(F.lit(2.0), 2.0 - 1.95 * F.abs(m) / t))).otherwise(2.0)))


views.SQL["fisher"] = """WITH n AS (SELECT fact_id, vec, sqrt(list_dot_product(vec, vec)) AS size FROM vectors), m AS (SELECT fact_id, list_transform(vec, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0 END) AS mean FROM n),
    t AS (SELECT *, list_max(list_transform(mean, lambda x: abs(x))) AS top FROM m) SELECT fact_id, mean, list_transform(mean, lambda x: CASE WHEN top > 0 THEN greatest(0.05, least(2.0, 2.0 - 1.95 * abs(x) / top)) ELSE 2.0 END) AS var FROM t"""


@query("V4_fisher_params", "SELECT fact_id, round(list_sum(mean), 6) AS mean_sum, round(list_sum(var), 6) AS var_sum, round(list_min(var), 6) AS var_min FROM fisher")
def v4_fisher_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean on the unit sphere, and the variance of each coordinate."""
    got = views.vectors(spark, sf_dir).select("fact_id", unit("vec").alias("mean")).select("fact_id", "mean", fisher_variance("mean").alias("var"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return got.select("fact_id", F.round(total("mean"), 6).alias("mean_sum"), F.round(total("var"), 6).alias("var_sum"), F.round(F.array_min("var"), 6).alias("var_min"))


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest of each query with both vectors; only k rows a query are joined back."""
    near = topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), k)
    facts = views.vectors(spark, sf_dir)
    with_fact = near.join(facts, "fact_id")
    return with_fact.join(facts.select(F.col("fact_id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")


#: Distances divide by this before they become similarities; coordinates' arguments below SMALL take the series.
TEMPERATURE, SMALL = 15.0, 1e-7
#: Width of a fact's vector in bits, by its id.
BITS = "CASE fact_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 8 ELSE 4 END"

# Queries beside their facts by rank, with both means and variances; the fact's also inflated for its width.
SQL_NEAR = f"""{SQL_TOPK.format(on='true')}, nb AS (SELECT k.query_id, k.fact_id, rank, similarity, k.access_count, q.mean AS qm, q.var AS qv, f.mean AS fm, f.var AS fv, {BITS.replace('fact_id', 'k.fact_id')} AS bits FROM k JOIN fisher q ON q.fact_id = k.query_id JOIN fisher f ON f.fact_id = k.fact_id),
    pr AS (SELECT *, list_transform(fv, lambda v: least(2.0, greatest(0.05, v * sqrt(32.0::DOUBLE / bits)))) AS wide FROM nb)"""


def _sql_simple(var: str = "fv") -> str:
    return f"exp(-list_sum(list_transform(list_zip(qm, fm, {var}), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / greatest(z[3], 1e-6))) / {TEMPERATURE})"


def _sql_distance(var: str = "fv") -> str:
    delta = f"list_transform(list_zip(qm, qv, fm, {var}), lambda z: (power(z[1] - z[3], 2) + 2 * power(z[2] - z[4], 2)) / (4 * z[2] * z[4]))"
    return f"sqrt(list_sum(list_transform({delta}, lambda d: 2 * power(CASE WHEN d < {SMALL} THEN sqrt(2 * d) * (1 - d / 12) ELSE ln(1 + d + sqrt(d * (d + 2))) END, 2))))"


def gaussian_neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest of each query with means and variances (qm, qv, fm, fv), the width in bits, and the variance for it."""
    made = views.vectors(spark, sf_dir).select("fact_id", "access_count", unit("vec").alias("fm")).withColumn("fv", fisher_variance("fm"))
    near = topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), k).join(made, "fact_id")
    both = near.join(made.select(F.col("fact_id").alias("query_id"), F.col("fm").alias("qm"), F.col("fv").alias("qv")), "query_id").withColumn("bits", F.expr(BITS))
    return both.withColumn("wide", given("fv", F.sqrt(32.0 / F.col("bits")), lambda v, s: F.transform(v, lambda x: F.least(F.lit(2.0), F.greatest(F.lit(0.05), x * s)))))


def fisher_simple(var: str = "fv") -> Column:
    """exp(-sum of squared differences over the fact's variance / temperature)."""
    pair = F.zip_with("qm", "fm", lambda x, y: (x - y) * (x - y))
    return F.exp(-F.aggregate(F.zip_with(pair, var, lambda d, v: d / F.greatest(v, F.lit(1e-6))), F.lit(0.0), lambda s, x: s + x) / TEMPERATURE)


def fisher_distance(var: str = "fv") -> Column:
    """Geodesic distance of Gaussians: root of the sum of 2 acosh(1 + delta)², delta of each coordinate's means and
    variances; the series stands for small delta, where 1 + delta would lose it."""
    means = F.zip_with("qm", "fm", lambda x, y: (x - y) * (x - y))
    spread = F.zip_with("qv", var, lambda x, y: F.struct((2 * (x - y) * (x - y)).alias("d"), (4 * x * y).alias("p")))
    delta = F.zip_with(means, spread, lambda m, z: (m + z["d"]) / z["p"])
    each = F.transform(delta, lambda d: F.when(d < SMALL, F.sqrt(2 * d) * (1 - d / 12)).otherwise(F.log(1 + d + F.sqrt(d * (d + 2)))))
    return F.sqrt(F.aggregate(each, F.lit(0.0), lambda s, x: s + 2 * x * x))


@query("V6_fisher_simple", f"WITH {SQL_NEAR} SELECT query_id, fact_id, round({_sql_simple()}, 6) AS similarity FROM pr WHERE rank <= 10")
def v6_fisher_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaussian_neighbours(spark, sf_dir, 10).select("query_id", "fact_id", F.round(fisher_simple(), 6).alias("similarity"))


@query(
    "V5_fisher_distance",
    f"WITH {SQL_NEAR}, d AS (SELECT query_id, fact_id, {_sql_distance()} AS d FROM pr WHERE rank <= 10) SELECT query_id, fact_id, round(d, 6) AS distance, round(exp(-d / {TEMPERATURE}), 6) AS similarity FROM d",
)
def v5_fisher_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = gaussian_neighbours(spark, sf_dir, 10).select("query_id", "fact_id", fisher_distance().alias("d"))
    return far.select("query_id", "fact_id", F.round("d", 6).alias("distance"), F.round(F.exp(-F.col("d") / TEMPERATURE), 6).alias("similarity"))


@query("V9_frqad", f"WITH {SQL_NEAR} SELECT query_id, fact_id, round(least(1.0, exp(-{_sql_distance('wide')} / {TEMPERATURE})), 6) AS similarity FROM pr WHERE rank <= 10")
def v9_frqad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with the fact's variances times the root of 32 / bits, between 0.05 and 2."""
    near = gaussian_neighbours(spark, sf_dir, 10)
    return near.select("query_id", "fact_id", F.round(F.least(F.lit(1.0), F.exp(-fisher_distance("wide") / TEMPERATURE)), 6).alias("similarity"))


@query("V7_fisher_bayes_update", "SELECT l_partkey AS fact_id, round(least(2.0, greatest(0.05, 1 / (1 / 2.0 + sum(1 / (0.5 + l_discount))))), 6) AS variance, count(*) AS observations FROM lineitem GROUP BY l_partkey HAVING count(*) >= 3")
def v7_fisher_bayes_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance after a batch of observations: precisions add up, so one sum and one clip are the sequence of updates."""
    lines = views.read(spark, sf_dir, "lineitem")
    new = F.least(F.lit(2.0), F.greatest(F.lit(0.05), 1 / (1 / F.lit(2.0) + F.sum(1 / (0.5 + F.col("l_discount"))))))
    return lines.groupBy(F.col("l_partkey").alias("fact_id")).agg(F.round(new, 6).alias("variance"), F.count("*").alias("observations")).where("observations >= 3")


@query("V8_adaptive_temperature", "SELECT label, round(greatest(0.1, 15 * (1 + avg(abs(list_sum(vec)))) / 2), 6) AS temperature FROM vectors GROUP BY label")
def v8_adaptive_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.abs(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x))
    return views.vectors(spark, sf_dir).groupBy("label").agg(F.round(F.greatest(F.lit(0.1), 15 * (1 + F.avg(spread)) / 2), 6).alias("temperature"))


@query(
    "V10_semantic_channel",
    f"""WITH {SQL_NEAR}, w AS (SELECT query_id, fact_id, similarity, least(1.0, least(1.2, greatest(0.15, 1.2 * access_count / 10))) AS w,
      CASE WHEN bits < 32 THEN exp(-{_sql_distance('wide')} / {TEMPERATURE}) ELSE {_sql_simple()} END AS fisher FROM pr WHERE rank <= 20),
    x AS (SELECT query_id, fact_id, w * fisher + (1 - w) * similarity AS score FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM x WHERE score > 0.05)
    SELECT query_id, fact_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def v10_semantic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest, rescored by a mix of Fisher similarity and cosine that leans to Fisher with use; the best ten. Facts kept
    in fewer than 32 bits are compared by the distance with inflated variances (V9), others simply (V6)."""
    w = F.least(F.lit(1.0), F.least(F.lit(1.2), F.greatest(F.lit(0.15), 1.2 * F.col("access_count") / 10)))
    fisher = F.when(F.col("bits") < 32, F.exp(-fisher_distance("wide") / TEMPERATURE)).otherwise(fisher_simple())
    scored = gaussian_neighbours(spark, sf_dir, 20).withColumn("score", w * fisher + (1 - w) * F.col("similarity")).where("score > 0.05")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "fact_id")).cast("long")
    return scored.withColumn("rank", rank).where("rank <= 10").select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


@query(
    "V17_entropy_gap",
    """WITH p AS (SELECT label, fact_id, vec FROM vectors WHERE fact_id % 20 = 0) SELECT p.fact_id, round(coalesce(least(1.0, greatest(0.0, 1 - avg(list_cosine_similarity(p.vec, f.vec)))), 0.5), 6) AS gap
    FROM p LEFT JOIN vectors f ON f.label = p.label AND f.fact_id <> p.fact_id GROUP BY p.fact_id""",
)
def v17_entropy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - mean cosine of a vector to its cluster. The mean of dot products is one dot product with the cluster's sum."""
    units = views.vectors(spark, sf_dir).select("fact_id", "label", unit("vec").alias("unit"))
    sums = units.select("label", F.posexplode("unit").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    cluster = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    size = units.groupBy("label").agg(F.count("*").alias("n"))
    mine = units.where("fact_id % 20 = 0").join(cluster, "label").join(size, "label")
    mean = (dot("unit", "total") - dot("unit", "unit")) / (F.col("n") - 1)
    return mine.select("fact_id", F.round(F.when(F.col("n") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - mean))).otherwise(0.5), 6).alias("gap"))


@query("V18_vector_backfill", "SELECT fact_id FROM facts WHERE fact_id NOT IN (SELECT vec_id FROM embeddings)")
def v18_vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("fact_id").join(views.vectors(spark, sf_dir).select("fact_id"), "fact_id", "left_anti")
