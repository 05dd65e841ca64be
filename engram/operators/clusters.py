"""Scenes, clusters of ageing facts, and the choice of an arm for each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.graph import components, cut
from engram.operators.lifecycle import SQL_RETENTION, _retention
from engram.operators.reports import a24_bandit_posterior
from engram.operators.text import SQL_ENTITIES, entities
from engram.operators.vectors import query_vectors, topk
from engram.registry import query

# --- G14: scenes -----------------------------------------------------------------------------------------------------


def assign_scenes(facts: DataFrame, themes: DataFrame, least: float = 0.6, near: int = 10) -> DataFrame:
    """(fact_id, scene, known): the scene whose theme is nearest if its cosine is `least` or more; else a new scene.

    facts: (fact_id, vec), themes: (scene, vec). Facts that no theme takes are linked with their `near` nearest among
    themselves at `least` or more; each component is a new scene, named by its least fact, which is its theme from then on.
    """
    first = topk(facts.select(F.col("fact_id").alias("query_id"), "vec"), themes.select(F.col("scene").alias("fact_id"), "vec"), 1)
    close = cut(first.where(F.round("similarity", 9) >= least).select(F.col("query_id").alias("fact_id"), F.col("fact_id").alias("scene")))
    left = cut(facts.select("fact_id", "vec").join(close, "fact_id", "left_anti"))
    if left.isEmpty():
        return close.withColumn("known", F.lit(True))
    mates = topk(left.select(F.col("fact_id").alias("query_id"), "vec"), left, near + 1).where((F.col("query_id") != F.col("fact_id")) & (F.round("similarity", 9) >= least))
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    links = cut(mates.withColumn("n", n).where(F.col("n") <= near).select(F.col("query_id").alias("src"), F.col("fact_id").alias("dst")))
    labels = components(links).select(F.col("node").alias("fact_id"), F.col("label").alias("scene")) if not links.isEmpty() else left.select("fact_id", F.col("fact_id").alias("scene")).limit(0)
    new = left.select("fact_id").join(labels, "fact_id", "left").select("fact_id", F.coalesce("scene", "fact_id").alias("scene"))
    return close.withColumn("known", F.lit(True)).union(new.withColumn("known", F.lit(False)))


@query(
    "G14_scene_assign",
    """WITH RECURSIVE th AS (SELECT min(fact_id) AS scene FROM vectors GROUP BY label), a AS (SELECT fact_id, vec FROM vectors WHERE fact_id % 20 = 0),
    s AS (SELECT a.fact_id, scene, list_cosine_similarity(a.vec, t.vec) AS c FROM a CROSS JOIN th JOIN vectors t ON t.fact_id = scene), k AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(c, 9) DESC, scene) AS n FROM s),
    cl AS (SELECT fact_id, scene FROM k WHERE n = 1 AND round(c, 9) >= 0.25), l AS (SELECT * FROM a WHERE fact_id NOT IN (SELECT fact_id FROM cl)),
    m AS (SELECT x.fact_id AS src, y.fact_id AS dst, list_cosine_similarity(x.vec, y.vec) AS c, row_number() OVER (PARTITION BY x.fact_id ORDER BY round(list_cosine_similarity(x.vec, y.vec), 9) DESC, y.fact_id) AS n FROM l x JOIN l y ON x.fact_id <> y.fact_id),
    e AS (SELECT src, dst FROM m WHERE n <= 10 AND round(c, 9) >= 0.25), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT fact_id AS node, fact_id AS label FROM l UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.node)
    SELECT fact_id, scene, true AS known FROM cl UNION ALL SELECT node, min(label), false FROM c GROUP BY node""",
)
def g14_scene_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked facts to the themes (a label's first vector) or to new scenes, at a cosine of 0.25 (0.6 for real embeddings)."""
    themes = views.vectors(spark, sf_dir).groupBy("label").agg(F.min("fact_id").alias("scene"), F.min_by("vec", "fact_id").alias("vec"))
    return assign_scenes(query_vectors(spark, sf_dir).withColumnRenamed("query_id", "fact_id"), themes, 0.25)


# --- G15: clusters of ageing facts -----------------------------------------------------------------------------------


def shared_components(names: DataFrame, least: int = 2) -> DataFrame:
    """names: (fact_id, name), distinct. (fact_id, cluster): components of facts that share `least` names or more (1 or 2),
    of which each fact has one at all; a cluster is named by its least fact.

    Two facts share two names if they share a pair of names. The facts of a pair are linked to the least of them, so their
    number of links is that of the facts and no facts are paired; the pairs of a fact are of its own names in several facts.
    """
    several = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    held = names.join(several, "name").groupBy("fact_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    keys = F.expr("names" if least == 1 else "flatten(transform(names, (x, i) -> transform(slice(names, i + 2, size(names)), y -> concat(x, '\\u0000', y))))")
    keyed = held.select("fact_id", F.explode(keys).alias("key")).select("fact_id", F.xxhash64("key").alias("h"), "key")
    first = keyed.groupBy("h", "key").agg(F.min("fact_id").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = keyed.join(first, ["h", "key"]).where("fact_id <> dst").select(F.col("fact_id").alias("src"), "dst").distinct()
    return components(cut(links)).select(F.col("node").alias("fact_id"), F.col("label").alias("cluster"))


def gap_sessions(rows: DataFrame, days: int = 7) -> DataFrame:
    """`rows` (cluster, created_at, ...) with `session`: one more after each gap of over `days` days within a cluster.

    First and last times of each day are compared, of which a cluster has no more than the calendar, whatever its size.
    """
    day = F.to_date("created_at")
    daily = rows.groupBy("cluster", day.alias("day")).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    w = W.partitionBy("cluster").orderBy("day")
    gap = F.col("first") - F.lag("last").over(w) > F.expr(f"INTERVAL {days} DAYS")
    session = daily.withColumn("gap", F.when(gap, 1).otherwise(0)).select("cluster", "day", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("session"))
    return rows.withColumn("day", day).join(session, ["cluster", "day"]).drop("day")


def ageing_clusters(facts: DataFrame, kept: DataFrame, names: DataFrame, below: float = 0.5, smallest: int = 3, largest: int = 20) -> DataFrame:
    """(cluster, session, size, shared, retention, at, gist, names): groups of warm or cold facts that fade together.

    Facts with a retention below `below` that share two names are one cluster, split where nothing happened for over seven
    days; groups of `smallest` to `largest` facts stay. shared: names in two facts of the group or more; gist: the text of
    the best by importance * confidence, then the least id; names: the five names in most of its facts.
    """
    able = facts.where("lifecycle IN ('warm', 'cold')").join(kept.where(F.col("retention") < below).select("fact_id", "retention"), "fact_id")
    able = cut(able.select("fact_id", "content", "created_at", "retention", (F.col("importance") * F.col("confidence")).alias("merit")))
    mine = cut(names.join(able.select("fact_id"), "fact_id", "left_semi").distinct())
    rows = cut(gap_sessions(able.join(shared_components(mine), "fact_id")))
    sized = rows.groupBy("cluster", "session").agg(
        F.count("*").alias("size"), F.avg("retention").alias("retention"), F.timestamp_seconds(F.floor(F.avg(F.unix_timestamp("created_at")))).alias("at"), F.max_by("content", F.struct(F.round("merit", 9), -F.col("fact_id"))).alias("gist")
    )
    sized = sized.where(F.col("size").between(smallest, largest))
    each = rows.select("cluster", "session", "fact_id").join(sized.select("cluster", "session"), ["cluster", "session"]).join(mine, "fact_id").groupBy("cluster", "session", "name").agg(F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy("cluster", "session").orderBy(F.desc("n"), "name"))
    ranked = each.withColumn("k", order).groupBy("cluster", "session").agg(F.count(F.when(F.col("n") > 1, 1)).alias("shared"), F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "name")))).alias("z"))
    ranked = ranked.select("cluster", "session", "shared", F.array_join(F.transform("z", lambda z: z["name"]), ",").alias("names"))
    return sized.join(ranked, ["cluster", "session"])


@query(
    "G15_ccq_clusters",
    f"""WITH RECURSIVE {SQL_RETENTION}, f AS (SELECT * FROM ret WHERE lifecycle IN ('warm', 'cold') AND retention < 0.5),
    m AS (SELECT DISTINCT fact_id, name FROM (SELECT fact_id, unnest({SQL_ENTITIES}) AS name FROM f) WHERE length(name) >= 5), e AS (SELECT a.fact_id AS src, b.fact_id AS dst FROM m a JOIN m b ON a.name = b.name AND a.fact_id <> b.fact_id GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT DISTINCT src AS node, src AS label FROM e UNION SELECT e.dst, c.label FROM c JOIN e ON e.src = c.node), l AS (SELECT node, min(label) AS cluster FROM c GROUP BY node),
    r AS (SELECT f.*, cluster FROM f JOIN l ON node = fact_id), g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY cluster ORDER BY created_at, fact_id) > INTERVAL 7 DAY THEN 1 ELSE 0 END AS gap FROM r),
    s AS (SELECT *, sum(gap) OVER (PARTITION BY cluster ORDER BY created_at, fact_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
    z AS (SELECT cluster, session, count(*) AS size, avg(retention) AS retention, floor(avg(epoch(created_at)))::BIGINT AS mean_at, arg_max(content, (round(importance * confidence, 9), -fact_id)) AS gist FROM s GROUP BY ALL HAVING count(*) BETWEEN 3 AND 20),
    n0 AS (SELECT z.cluster, z.session, name, count(*) AS n FROM z JOIN s ON s.cluster = z.cluster AND s.session = z.session JOIN m ON m.fact_id = s.fact_id GROUP BY z.cluster, z.session, name),
    n AS (SELECT *, row_number() OVER (PARTITION BY cluster, session ORDER BY n DESC, name) AS k FROM n0)
    SELECT z.cluster, z.session::BIGINT AS session, size, round(retention, 6)::DOUBLE AS retention, mean_at, md5(coalesce(gist, '')) AS gist_md5, count(CASE WHEN n > 1 THEN 1 END) AS shared, string_agg(CASE WHEN k <= 5 THEN name END, ',' ORDER BY k) AS names
    FROM z JOIN n ON n.cluster = z.cluster AND n.session = z.session GROUP BY z.cluster, z.session, size, retention, mean_at, gist""",
)
def g15_ccq_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By names of five letters or more, as shorter ones join all the invented texts."""
    facts = views.facts(spark, sf_dir)
    names = facts.select("fact_id", F.explode(entities(F.col("content"))).alias("name")).where(F.length("name") >= 5)
    found = ageing_clusters(facts, _retention(spark, sf_dir), names)
    return found.select("cluster", "session", "size", F.round("retention", 6).alias("retention"), F.unix_timestamp("at").alias("mean_at"), F.md5(F.coalesce("gist", F.lit(""))).alias("gist_md5"), "shared", "names")


# --- A25: an arm for each query --------------------------------------------------------------------------------------


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hash of integers, the same for the same numbers wherever it is taken."""
    h = np.full(1, 0x243F6A8885A308D3, dtype=np.uint64)
    for x in parts:
        h = (h ^ np.asarray(x).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    return ((_mixed(*parts) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _gamma(shape: np.ndarray, key: tuple) -> np.ndarray:
    """A gamma variate (shape >= 1) for each place, by squeezed cubes of normals; draws are numbered by round."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_, k = np.zeros(shape.shape), np.ones(shape.shape, dtype=bool), 0
    while open_.any():
        normal = np.sqrt(-2 * np.log(_uniform(*key, 3 * k))) * np.cos(2 * np.pi * _uniform(*key, 3 * k + 1))
        v = (1 + c * normal) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = open_ & (v > 0) & (np.log(_uniform(*key, 3 * k + 2)) < 0.5 * normal**2 + d - d * v + d * np.log(v))
        out[ok], open_, k = (d * v)[ok], open_ & ~ok, k + 1
    return out


def beta_draws(query_id: np.ndarray, arm: np.ndarray, alpha: np.ndarray, beta: np.ndarray, seed: int) -> np.ndarray:
    """One Beta(alpha, beta) draw for each query (rows) and arm (columns); alpha and beta are 1 or more."""
    q, a = query_id[:, None], arm[None, :]
    shape = lambda x: np.broadcast_to(x[None, :], (len(query_id), len(arm)))
    q, a = np.broadcast_to(q, shape(alpha).shape), np.broadcast_to(a, shape(alpha).shape)
    x, y = _gamma(shape(alpha), (seed, q, a, 0)), _gamma(shape(beta), (seed, q, a, 1))
    return x / (x + y)


def choose_arms(asked: DataFrame, arms: DataFrame, seed: int = 1) -> DataFrame:
    """asked: (query_id, stratum), arms: (stratum, arm, alpha, beta), a small table. (query_id, arm, draw): the arm with the
    largest draw of the query's stratum. A draw is a function of seed, query and arm, so partitions and retries change
    nothing. Queries of a stratum without arms are left out."""
    table: dict[object, list] = {}
    for r in arms.orderBy("stratum", "arm").collect():
        table.setdefault(r.stratum, []).append((r.arm, float(r.alpha), float(r.beta)))
    held = asked.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("query_id", pa.int64()), ("arm", pa.string()), ("draw", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, strata = batch.column("query_id").to_numpy(), np.array(batch.column("stratum").to_pylist())
            for stratum in np.unique(strata).tolist():
                if own := held.value.get(stratum):
                    mine = ids[strata == stratum]
                    draws = beta_draws(mine, np.arange(len(own)), np.array([x[1] for x in own]), np.array([x[2] for x in own]), seed)
                    top = draws.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array([own[i][0] for i in top.tolist()]), pa.array(draws[np.arange(len(mine)), top])], schema=schema)

    return asked.select("query_id", "stratum").mapInArrow(run, "query_id long, arm string, draw double")


@query("A25_bandit_choose")
def a25_bandit_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm for every order as a query, its stratum by customer."""
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 5).alias("stratum"))
    return choose_arms(orders, a24_bandit_posterior(spark, sf_dir))
