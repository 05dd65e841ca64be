"""Paths and chains in directed and undirected graphs, by joins that double or meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import views
from engram.operators.graph import cut, undirected
from engram.registry import query


def collapse_chains(edges: DataFrame) -> DataFrame:
    """edges: (src, dst). Each chain a -> b -> c becomes a -> c and b -> c goes, until none is left: (src, dst), distinct.

    What stays leads from the heads, which nothing leads to, to all that they reach. Every node points to what leads to
    it, and in a round hands its pointers that are no heads on to what these point to: so a chain of n takes log2(n)
    rounds. Edges from nodes that no head reaches, on rings and behind them, stay. Loops from a node to itself go.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    heads = cut(links.select(F.col("src").alias("head")).distinct().join(links.select(F.col("dst").alias("head")).distinct(), "head", "left_anti"))
    found = _from_heads(links, heads)
    # Nodes that no head reaches lie on rings or behind them.
    loose = links.join(heads.select(F.col("head").alias("src")), "src", "left_anti").join(found.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    return found.union(loose.select("src", "dst"))


def _from_heads(links: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, node) as (src, dst), of all nodes that a head reaches."""
    top = heads.select(F.col("head").alias("src"), F.lit(True).alias("top"))
    each = links.join(top, "src", "left").select("src", "dst", F.coalesce("top", F.lit(False)).alias("top"))
    each = cut(each)
    done, todo = each.where("top").select("src", "dst"), each.where("NOT top").select("src", "dst")
    steps, length = each, 1
    nodes = links.select("src").union(links.select("dst")).distinct().count()
    while length <= nodes and not todo.isEmpty():
        above = steps.select(F.col("src").alias("up"), F.col("dst").alias("src"), "top")
        new = cut(todo.join(above, "src").where("up <> dst").select(F.col("up").alias("src"), "dst", "top").distinct())
        done = cut(done.union(new.where("top").select("src", "dst")).distinct())
        todo = new.where("NOT top").select("src", "dst")
        # Twice as far from now on: to the heads that are known, and through what is still open.
        steps = done.withColumn("top", F.lit(True)).union(todo.withColumn("top", F.lit(False)))
        length *= 2
    return done


_SUP = "s AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'supersedes' AND weight >= 0.75)"


@query("G9_collapse_supersedes", f"WITH RECURSIVE {_SUP}, c AS (SELECT src, dst FROM s WHERE src NOT IN (SELECT dst FROM s) UNION SELECT c.src, s.dst FROM c JOIN s ON s.src = c.dst) SELECT src, dst FROM c")
def g9_collapse_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong chains of supersession, each to its end."""
    return collapse_chains(views.edges(spark, sf_dir).where("edge_type = 'supersedes' AND weight >= 0.75"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """pairs: (a, b), distinct, edges: (src, dst), undirected. (a, b, hops, path): a shortest path of at most `most` edges;
    pairs without one are left out, and a node's path to itself is the node.

    Frontiers from both ends carry the node before them and grow in turn until they meet; a pair that has met grows no
    more. Of equal ways the one by the least nodes before counts. The path is then walked back from where they met.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    pairs = cut(pairs.select("a", "b"))
    none = F.lit(None).cast("long")
    reached = [cut(pairs.select("a", "b", F.col(end).alias("node"), none.alias("before"), F.lit(0).alias("depth"))) for end in ("a", "b")]
    depth, met, open_ = [0, 0], pairs.where("a = b").select("a", "b", F.col("a").alias("node"), F.lit(0).alias("hops")), cut(pairs.where("a <> b"))
    while depth[0] + depth[1] < most and not open_.isEmpty():
        side = 0 if depth[0] <= depth[1] else 1
        front = reached[side].where(F.col("depth") == depth[side]).join(open_, ["a", "b"], "left_semi")
        depth[side] += 1
        new = front.join(both, F.col("node") == F.col("src")).groupBy("a", "b", "dst").agg(F.min("node").alias("before")).withColumnRenamed("dst", "node")
        new = cut(new.join(reached[side].select("a", "b", "node"), ["a", "b", "node"], "left_anti").select("a", "b", "node", "before", F.lit(depth[side]).alias("depth")))
        reached[side] = cut(reached[side].union(new))
        hit = new.select("a", "b", "node").join(reached[1 - side].select("a", "b", "node", F.col("depth").alias("other")), ["a", "b", "node"])
        hit = hit.groupBy("a", "b").agg(F.min(F.struct((F.col("other") + depth[side]).alias("hops"), "node")).alias("z"))
        met = cut(met.union(hit.select("a", "b", "z.node", "z.hops")))
        open_ = cut(open_.join(met, ["a", "b"], "left_anti"))
    rows = met.select("a", "b", "hops", F.array("node").alias("path"), F.col("node").alias("left"), F.col("node").alias("right"))
    for side, end in ((0, "left"), (1, "right")):
        back = reached[side].where("before IS NOT NULL").select("a", "b", F.col("node").alias(end), "before")
        for _ in range(depth[side]):
            step = rows.join(back, ["a", "b", end], "left")
            grown = F.concat(F.array("before"), "path") if end == "left" else F.concat("path", F.array("before"))
            other = "right" if end == "left" else "left"
            rows = step.select("a", "b", "hops", F.when(F.col("before").isNull(), F.col("path")).otherwise(grown).alias("path"), F.coalesce("before", end).alias(end), other)
        rows = cut(rows)
    return rows.select("a", "b", "hops", "path")


_PAIRS = "pr AS (SELECT node_id AS a, (node_id * 31 + 17) % (SELECT max(node_id) FROM nodes) AS b FROM nodes WHERE node_id % 20 = 0)"


@query(
    "G6_shortest_path",
    f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT src, dst FROM edges WHERE weight >= 0.75 UNION SELECT dst, src FROM edges WHERE weight >= 0.75),
    p AS (SELECT a, b, a AS node, 0 AS hops FROM pr UNION SELECT a, b, dst, hops + 1 FROM p JOIN w ON src = node WHERE hops < 4) SELECT a, b, min(hops)::INT AS hops FROM p WHERE node = b GROUP BY a, b""",
)
def g6_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of shortest paths of up to four strong edges for a table of pairs; `shortest_paths` gives the nodes too."""
    nodes = views.nodes(spark, sf_dir).select("node_id")
    last = nodes.agg(F.max("node_id").alias("last"))
    pairs = nodes.where("node_id % 20 = 0").crossJoin(F.broadcast(last)).select(F.col("node_id").alias("a"), ((F.col("node_id") * 31 + 17) % F.col("last")).alias("b"))
    return shortest_paths(pairs, undirected(views.edges(spark, sf_dir).where("weight >= 0.75")), 4).select("a", "b", "hops")
