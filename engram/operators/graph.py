"""Graph analytics over edge tables: iterations are joins, cut by written tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.registry import query


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder of spark.checkpoint.dir; a local session may go without one."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:8]}")
    return df.checkpoint()


#: Sets of so many keys are broadcast.
FEW = 1_000_000


def edges_around(spark: SparkSession, sf_dir: str, nodes: DataFrame, hops: int) -> DataFrame:
    """The edges of `views.edges` with an end within `hops` steps of `nodes` (column node): all that hops + 1 rounds from them can use.

    Steps go from parts to their orders and on to the parts of these, so only lines of orders that are reached are paired.
    Once over a million parts are reached all edges are taken.
    """
    lines = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")

    def within(key: str, keys: DataFrame, n: int) -> DataFrame:
        return lines.join(F.broadcast(keys) if n <= FEW else keys, key, "left_semi")

    parts = cut(nodes.select(F.col("node").alias("l_partkey")).distinct())
    n = parts.count()
    for hop in range(hops + 1):
        if n > FEW:
            return views.edges(spark, sf_dir)
        orders = cut(within("l_partkey", parts, n).select("l_orderkey").distinct())
        held = within("l_orderkey", orders, orders.count())
        if hop < hops:
            parts = cut(held.select("l_partkey").distinct().union(parts).distinct())
            n = parts.count()
    held = held.distinct().join(F.broadcast(parts.withColumn("near", F.lit(True))), "l_partkey", "left")
    pairs = held.alias("a").join(held.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey AND (a.near OR b.near)")
    return views.edges_of(pairs)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


@query("G1_merge_edges", "SELECT src, dst, max(weight) AS weight FROM edges GROUP BY src, dst UNION ALL SELECT node_id, NULL, NULL FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def g1_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaviest edge of each directed pair, and nodes without edges."""
    edges = views.edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    alone = views.nodes(spark, sf_dir).select("node_id").join(ends, "node_id", "left_anti")
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).union(alone.select("node_id", F.lit(None).cast("long"), F.lit(None).cast("double")))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `rounds` rounds; mass of nodes without out-edges is spread evenly, so ranks sum to 1."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    n = nodes.agg(F.count("*").alias("n"))
    ranks = cut(nodes.crossJoin(F.broadcast(n)).select("node", (1 / F.col("n")).alias("rank"), "n"))
    dead = nodes.join(out.withColumnRenamed("src", "node"), "node", "left_anti").withColumn("dead", F.lit(True))
    ranks = cut(ranks.join(dead, "node", "left").select("node", "rank", "n", F.coalesce("dead", F.lit(False)).alias("dead")))
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dead"), F.col("rank")).otherwise(0.0)).alias("lost"))
        got = share.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        ranks = cut(ranks.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", new.alias("rank"), "n", "dead"))
    return ranks.select("node", "rank")


def _sql_pagerank(rounds: int) -> str:
    parts = ["o AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src)", "sh AS (SELECT e.src, dst, weight / total AS p FROM edges e JOIN o ON o.src = e.src)", "nn AS (SELECT count(*)::DOUBLE AS n FROM nodes)"]
    parts.append("r0 AS (SELECT node_id AS node, 1 / n AS rank, node_id NOT IN (SELECT src FROM o) AS dead FROM nodes CROSS JOIN nn)")
    for i in range(rounds):
        parts.append(f"g{i} AS (SELECT dst AS node, sum(p * rank) AS got FROM sh JOIN r{i} ON node = src GROUP BY dst)")
        parts.append(f"r{i + 1} AS (SELECT r.node, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE dead) / n) AS rank, dead FROM r{i} r LEFT JOIN g{i} g ON g.node = r.node CROSS JOIN nn)")
    return "WITH " + ", ".join(parts) + f" SELECT node, rank FROM r{rounds}"


#: PageRank of the nodes after five rounds.
views.SQL["pageranks"] = _sql_pagerank(5)


def pageranks(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    nodes = views.nodes(spark, sf_dir).select(F.col("node_id").alias("node"))
    return pagerank(nodes, views.edges(spark, sf_dir) if edges is None else edges, 5)


@query("G2_pagerank", "SELECT node, round(rank, 8) AS rank FROM pageranks")
def g2_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageranks(spark, sf_dir).withColumn("rank", F.round("rank", 8))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): each round a node takes its neighbours' heaviest label, of equals the least."""
    both = cut(undirected(edges))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        labels = cut(votes.groupBy("node").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
    return labels


@query("G3_label_propagation")
def g3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_propagation(views.edges(spark, sf_dir).where("weight >= 0.5"), 4)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by neighbours' labels and pointer jumps."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        less = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = cut(less.join(far, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


@query(
    "G4_connected_components",
    """WITH RECURSIVE e AS (SELECT src, dst FROM edges WHERE weight >= 0.75), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT DISTINCT src AS node, src AS label FROM b UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.node)
    SELECT node, min(label) AS label FROM c GROUP BY node""",
)
def g4_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(views.edges(spark, sf_dir).where("weight >= 0.75"))


@query("G5_degree_centrality", "WITH d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT node, round(d / ((SELECT count(*) FROM nodes) - 1.0), 6)::DOUBLE AS centrality FROM d")
def g5_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = undirected(views.edges(spark, sf_dir)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    n = views.nodes(spark, sf_dir).agg((F.count("*") - 1.0).alias("n"))
    return degree.crossJoin(F.broadcast(n)).select("node", F.round(F.col("d") / F.col("n"), 6).alias("centrality"))


def distances(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hops): least number of undirected edges from any seed, up to `hops`."""
    both = cut(undirected(edges).select("src", "dst").distinct())
    seen = cut(seeds.select("node", F.lit(0).alias("hops")))
    frontier = seen
    for k in range(1, hops + 1):
        new = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(new.withColumn("hops", F.lit(k)))
        seen = cut(seen.union(frontier))
        if frontier.isEmpty():
            break
    return seen


_STRONG = "SELECT src, dst FROM edges WHERE weight >= 0.5 UNION SELECT dst, src FROM edges WHERE weight >= 0.5"


@query("G8_cap_degree", "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges) WHERE n <= 5")
def g8_cap_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest out-edges of each node (five here)."""
    n = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return views.edges(spark, sf_dir).withColumn("n", n).where("n <= 5").select("src", "dst", "weight")


@query(
    "G10_collapse_triangles",
    "WITH s AS (SELECT src, dst, weight FROM edges WHERE weight >= 0.5) SELECT src, dst FROM s x WHERE NOT EXISTS (SELECT 1 FROM s ab JOIN s ac ON ab.src = ac.src WHERE ab.dst = x.src AND ac.dst = x.dst AND ac.weight >= 0.8 * x.weight)",
)
def g10_collapse_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b -> c goes where a -> b and a -> c exist and a -> c weighs at least 0.8 as much."""
    s = views.edges(spark, sf_dir).where("weight >= 0.5").select("src", "dst", "weight")
    ab = s.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ac = s.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("weight").alias("w"))
    bc = s.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("weight").alias("v"))
    gone = bc.join(ab, "b").join(ac, ["a", "c"]).where("w >= 0.8 * v").select(F.col("b").alias("src"), F.col("c").alias("dst"))
    return s.join(gone, ["src", "dst"], "left_anti").select("src", "dst")


@query(
    "G12_hebbian_strengthen",
    "WITH c AS (SELECT least(a.fact_id, b.fact_id) AS src, greatest(a.fact_id, b.fact_id) AS dst, count(*) AS n FROM signals a JOIN signals b ON a.query_id = b.query_id AND a.position < b.position AND a.fact_id <> b.fact_id WHERE a.signal = 'recall' AND b.signal = 'recall' GROUP BY ALL) SELECT e.src, e.dst, round(least(1.0, weight + 0.05 * coalesce(n, 0)), 6)::DOUBLE AS weight FROM edges e LEFT JOIN c ON c.src = e.src AND c.dst = e.dst",
)
def g12_hebbian_strengthen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.05 for each time that both ends were recalled together, 1 at most."""
    s = views.signals(spark, sf_dir).where("signal = 'recall'").select("query_id", "fact_id", "position")
    pairs = s.alias("x").join(s.alias("y"), "query_id").where("x.position < y.position AND x.fact_id <> y.fact_id")
    n = pairs.groupBy(F.least("x.fact_id", "y.fact_id").alias("src"), F.greatest("x.fact_id", "y.fact_id").alias("dst")).agg(F.count("*").alias("n"))
    return views.edges(spark, sf_dir).join(n, ["src", "dst"], "left").select("src", "dst", F.round(F.least(F.lit(1.0), F.col("weight") + 0.05 * F.coalesce("n", F.lit(0))), 6).alias("weight"))


@query(
    "G17_blast_radius",
    f"WITH RECURSIVE b AS ({_STRONG}), p AS (SELECT node_id AS node, 0 AS hops FROM nodes WHERE file_path = 'Brand#13' UNION SELECT dst, hops + 1 FROM p JOIN b ON b.src = p.node WHERE hops < 2) SELECT file_path, count(DISTINCT node) AS nodes FROM p JOIN nodes ON node_id = node GROUP BY file_path",
)
def g17_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files within two hops of a changed one, and how many of their nodes."""
    nodes = views.nodes(spark, sf_dir)
    seeds = nodes.where("file_path = 'Brand#13'").select(F.col("node_id").alias("node"))
    near = distances(views.edges(spark, sf_dir).where("weight >= 0.5"), seeds, 2)
    return near.join(nodes.select(F.col("node_id").alias("node"), "file_path"), "node").groupBy("file_path").agg(F.count("*").alias("nodes"))


@query("G20_coupling", "SELECT least(a.file_path, b.file_path) AS x, greatest(a.file_path, b.file_path) AS y, count(*) AS edges, CASE WHEN count(*) >= 200 THEN 'high' WHEN count(*) >= 100 THEN 'medium' ELSE 'low' END AS level FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.file_path <> b.file_path GROUP BY ALL")
def g20_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.nodes(spark, sf_dir)
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("file_path").alias("fa")), nodes.select(F.col("node_id").alias("dst"), F.col("file_path").alias("fb"))
    joined = views.edges(spark, sf_dir).join(a, "src").join(b, "dst").where("fa <> fb")
    counted = joined.groupBy(F.least("fa", "fb").alias("x"), F.greatest("fa", "fb").alias("y")).agg(F.count("*").alias("edges"))
    return counted.withColumn("level", F.when(F.col("edges") >= 200, "high").when(F.col("edges") >= 100, "medium").otherwise("low"))


@query("G21_callers_callees", "SELECT node_id, name, (SELECT count(*) FROM edges WHERE dst = node_id) AS callers, (SELECT count(*) FROM edges WHERE src = node_id) AS callees FROM nodes")
def g21_callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir)
    in_ = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("callees"))
    nodes = views.nodes(spark, sf_dir).select("node_id", "name")
    return nodes.join(in_, "node_id", "left").join(out, "node_id", "left").select("node_id", "name", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


@query("G22_tested_by", "SELECT b.node_id AS tested, a.node_id AS test FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.is_test AND NOT b.is_test")
def g22_tested_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.nodes(spark, sf_dir)
    tests = nodes.where("is_test").select(F.col("node_id").alias("src"))
    rest = nodes.where("NOT is_test").select(F.col("node_id").alias("dst"))
    return views.edges(spark, sf_dir).join(tests, "src", "left_semi").join(rest, "dst", "left_semi").select(F.col("dst").alias("tested"), F.col("src").alias("test"))


@query("G23_dead_code", "SELECT node_id, name, lines FROM nodes WHERE lines >= 10 AND NOT is_test AND node_id NOT IN (SELECT dst FROM edges WHERE weight >= 0.5)")
def g23_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = views.edges(spark, sf_dir).where("weight >= 0.5").select(F.col("dst").alias("node_id"))
    return views.nodes(spark, sf_dir).where("lines >= 10 AND NOT is_test").join(called, "node_id", "left_anti").select("node_id", "name", "lines")


