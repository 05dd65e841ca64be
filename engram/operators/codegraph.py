"""Spreading activation over tables of queries, and the analysis of a graph of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.entities import mentions
from engram.operators.graph import cut, edges_around
from engram.operators.lexical import best
from engram.operators.tagging import SQL_CODE_MENTIONS, code_mentions, remarks
from engram.operators.vectors import SQL_TOPK, query_vectors, topk
from engram.registry import query

KINDS = {"entity": "CALLS", "temporal": "IMPORTS_FROM", "semantic": "INHERITS", "supersedes": "CONTAINS"}
views.SQL["relations"] = "SELECT src, dst, weight, CASE edge_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END AS kind FROM edges"
views.SQL["calls"] = "SELECT src, dst FROM relations WHERE kind = 'CALLS' AND weight >= 0.5"
views.SQL["code"] = "SELECT *, split_part(name, ' ', 2) AS word, substr(file_path, 1, 7) AS directory FROM nodes"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("edge_type"))
    return views.edges(spark, sf_dir).select("src", "dst", "weight", kind.alias("kind"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).where("kind = 'CALLS' AND weight >= 0.5").select("src", "dst")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.nodes(spark, sf_dir).select("*", F.split_part("name", F.lit(" "), F.lit(2)).alias("word"), F.substring("file_path", 1, 7).alias("directory"))


# --- activation ------------------------------------------------------------------------------------------------------


def nearest_seeds(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, node, a): the k nearest facts of each query and their cosine."""
    return topk(query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), k).select("query_id", F.col("fact_id").alias("node"), F.col("similarity").alias("a"))


def synapse(seeds: DataFrame, edges: DataFrame, rounds: int = 3, neighbours: int = 30, keep: int = 10, least: float = 0.05) -> DataFrame:
    """(query_id, node, gate): spread 0.8 * weight / degree over a node's 30 heaviest edges both ways, and half of its own
    activation; after `rounds` the ten most active of a query, gated by a sigmoid of the activation less 0.2.

    A query whose largest activation is under `least` has no result. Degree is the number of edges kept.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    top = both.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("k") <= neighbours)
    share = cut(top.select("src", "dst", (0.8 * F.col("weight") / F.count("*").over(W.partitionBy("src"))).alias("p")))
    a = seeds
    for _ in range(rounds):
        sent = share.join(a.withColumnRenamed("node", "src"), "src").select("query_id", F.col("dst").alias("node"), (F.col("p") * F.col("a")).alias("a"))
        a = cut(sent.union(a.select("query_id", "node", 0.5 * F.col("a"))).groupBy("query_id", "node").agg(F.sum("a").alias("a")))
    found = best(a.select("query_id", F.col("node").alias("fact_id"), F.col("a").alias("score")), keep)
    alive = found.groupBy("query_id").agg(F.max("score").alias("top")).where(F.col("top") >= least).select("query_id")
    return found.join(alive, "query_id").select("query_id", F.col("fact_id").alias("node"), (1 / (1 + F.exp(-(F.col("score") - 0.2)))).alias("gate"))


def _sql_synapse(rounds: int = 3) -> str:
    parts = [
        f"{SQL_TOPK.format(on='true')}, b AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS i FROM b)",
        "t AS (SELECT src, dst, 0.8::DOUBLE * weight / count(*) OVER (PARTITION BY src) AS p FROM n WHERE i <= 30)",
        "a0 AS (SELECT query_id, fact_id AS node, similarity AS a FROM k WHERE rank <= 10)",
    ]
    for i in range(rounds):
        parts.append(f"a{i + 1} AS (SELECT query_id, node, sum(a) AS a FROM (SELECT query_id, dst AS node, p * a AS a FROM a{i} JOIN t ON src = node UNION ALL SELECT query_id, node, 0.5 * a FROM a{i}) GROUP BY query_id, node)")
    parts.append(f"o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, node) AS rank, max(a) OVER (PARTITION BY query_id) AS top FROM a{rounds})")
    return ", ".join(parts)


@query("L10_synapse_activation", f"WITH {_sql_synapse()} SELECT query_id, node, round(1 / (1 + exp(-(a - 0.2))), 6) AS gate FROM o WHERE rank <= 10 AND top >= 0.05")
def l10_synapse_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = cut(nearest_seeds(spark, sf_dir, 10))
    found = synapse(seeds, edges_around(spark, sf_dir, seeds, 2))
    return found.withColumn("gate", F.round("gate", 6))


MU = {"entity": 1.2, "causal": 1.3, "semantic": 0.8, "temporal": 0.9, "supersedes": 0.0}


def typed_activation(seeds: DataFrame, edges: DataFrame, depth: int = 4, most: int = 50, least: float = 0.01) -> DataFrame:
    """(query_id, node, a): seeds at 1, 0.7 * weight * factor of the edge type at each hop, the largest wins; the `most`
    active of each query above `least`."""
    mu = F.element_at(F.create_map(*[F.lit(x) for p in MU.items() for x in p]), F.col("edge_type"))
    one = edges.select("src", "dst", (F.col("weight") * 0.7 * mu).alias("p")).where("p > 0")
    p = cut(one.union(one.select("dst", "src", "p")))
    a = seeds.select("query_id", "node", F.lit(1.0).alias("a"))
    for _ in range(depth):
        sent = p.join(a.withColumnRenamed("node", "src"), "src").select("query_id", F.col("dst").alias("node"), (F.col("a") * F.col("p")).alias("a")).where(F.col("a") > least)
        a = cut(a.union(sent).groupBy("query_id", "node").agg(F.max("a").alias("a")))
    return best(a.select("query_id", F.col("node").alias("fact_id"), F.col("a").alias("score")), most).select("query_id", F.col("fact_id").alias("node"), F.col("score").alias("a"))


def _sql_typed(depth: int = 4) -> str:
    mu = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MU.items())
    parts = [
        f"{SQL_TOPK.format(on='true')}, e1 AS (SELECT src, dst, weight * 0.7::DOUBLE * CASE edge_type {mu} END AS p FROM edges), b AS (SELECT * FROM e1 WHERE p > 0 UNION ALL SELECT dst, src, p FROM e1 WHERE p > 0)",
        "a0 AS (SELECT query_id, fact_id AS node, 1.0::DOUBLE AS a FROM k WHERE rank <= 3)",
    ]
    for i in range(depth):
        parts.append(f"a{i + 1} AS (SELECT query_id, node, max(a) AS a FROM (SELECT * FROM a{i} UNION ALL SELECT query_id, dst, a * p FROM a{i} JOIN b ON src = node WHERE a * p > 0.01) GROUP BY query_id, node)")
    parts.append(f"o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, node) AS rank FROM a{depth})")
    return ", ".join(parts)


@query("L11_typed_activation", f"WITH {_sql_typed()} SELECT query_id, node, round(a, 6) AS activation FROM o WHERE rank <= 50")
def l11_typed_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hops from the three nearest facts of each query."""
    seeds = cut(nearest_seeds(spark, sf_dir, 3))
    found = typed_activation(seeds, edges_around(spark, sf_dir, seeds, 3))
    return found.select("query_id", "node", F.round("a", 6).alias("activation"))


@query(
    "L12_hop_decay_activation",
    """WITH s0 AS (SELECT fact_id AS query_id, fact_id AS node FROM vectors WHERE fact_id % 20 = 0), b AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
    h1 AS (SELECT query_id, dst AS node, max(0.5 * weight) AS s FROM s0 JOIN b ON src = node GROUP BY ALL), h2 AS (SELECT query_id, dst AS node, max(0.25 * weight) AS s FROM (SELECT DISTINCT query_id, node FROM h1) JOIN b ON src = node GROUP BY ALL),
    h3 AS (SELECT query_id, dst AS node, max(0.125 * weight) AS s FROM (SELECT DISTINCT query_id, node FROM h2) JOIN b ON src = node GROUP BY ALL),
    m AS (SELECT query_id, node, max(s) AS s FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE node <> query_id GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, node) AS rank FROM m) SELECT query_id, node, round(s, 6)::DOUBLE AS score FROM o WHERE rank <= 50""",
)
def l12_hop_decay_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.5 ** hop * weight of the last edge, three hops from each query's fact, the largest wins, the 50 best of a query."""
    frontier = query_vectors(spark, sf_dir).select("query_id", F.col("query_id").alias("src"))
    e = cut(edges_around(spark, sf_dir, frontier.select(F.col("src").alias("node")), 2).select("src", "dst", "weight"))
    both = e.union(e.select("dst", "src", "weight"))
    out = None
    for hop in (1, 2, 3):
        step = frontier.join(both, "src").groupBy("query_id", F.col("dst").alias("node")).agg(F.max(0.5**hop * F.col("weight")).alias("s"))
        step = cut(step)
        out = step if out is None else out.union(step)
        frontier = step.select("query_id", F.col("node").alias("src"))
    found = out.where("node <> query_id").groupBy("query_id", "node").agg(F.max("s").alias("score"))
    return best(found.withColumnRenamed("node", "fact_id"), 50).select("query_id", F.col("fact_id").alias("node"), F.round("score", 6).alias("score"))


# --- names -----------------------------------------------------------------------------------------------------------


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case."""
    low = F.lower(text)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


_SQL_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3)))"


def trigram_lookup(asked: DataFrame, names: DataFrame, most: int = 256, least: int = 2, k: int = 10) -> DataFrame:
    """asked: (query_id, text), names: (entity_id, name, weight). Entities that share `least` trigrams or more with a text,
    the k best by hits, then weight; of a text with many trigrams the `most` rarest are looked up."""
    index = names.select("entity_id", "weight", F.explode(grams(F.col("name"))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    wanted = asked.select("query_id", F.explode(grams(F.col("text"))).alias("gram")).join(df, "gram")
    rare = wanted.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("df", "gram"))).where(F.col("r") <= most)
    hits = rare.join(index, "gram").groupBy("query_id", "entity_id", "weight").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("weight"), "entity_id"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


@query(
    "L14_trigram_lookup",
    f"""WITH n AS (SELECT min(p_partkey) AS entity_id, p_name AS name, count(*) AS weight FROM part GROUP BY p_name), i AS (SELECT entity_id, weight, unnest({_SQL_GRAMS.format('name')}) AS gram FROM n),
    df AS (SELECT gram, count(*) AS df FROM i GROUP BY gram), w AS (SELECT p_partkey AS query_id, unnest({_SQL_GRAMS.format("replace(p_name, 'e', 'i')")}) AS gram FROM part WHERE p_partkey % 20 = 0),
    r AS (SELECT query_id, w.gram, row_number() OVER (PARTITION BY query_id ORDER BY df, w.gram) AS r FROM w JOIN df ON df.gram = w.gram),
    h AS (SELECT query_id, entity_id, weight, count(*) AS hits FROM r JOIN i ON i.gram = r.gram WHERE r <= 256 GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, weight DESC, entity_id) AS rank FROM h) SELECT query_id, entity_id, hits, rank FROM o WHERE rank <= 10""",
)
def l14_trigram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names (every twentieth, e as i) among all different names."""
    part = views.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("weight"))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.replace("p_name", F.lit("e"), F.lit("i")).alias("text"))
    return trigram_lookup(asked, names).select("query_id", "entity_id", "hits", "rank")


def kind_boost(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 1.3).when(kind == "class", 1.1).when(kind == "module", 0.9).when(kind == "file", 0.8).otherwise(1.0)


@query(
    "L15_code_keyword_search",
    """WITH q AS (SELECT node_id AS query_id, name AS text, node_id % 40 = 0 AS style FROM nodes WHERE node_id % 20 = 0), w AS (SELECT DISTINCT query_id, style, unnest(string_split(lower(text), ' ')) AS word FROM q),
    u AS (SELECT DISTINCT word FROM w), h AS (SELECT word, node_id, kind, is_test, CASE WHEN lower(name) = word THEN 3.0 WHEN starts_with(lower(name), word) THEN 2.0 WHEN contains(lower(name), word) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(file_path || '.' || replace(name, ' ', '_')), word) THEN 0.5 ELSE 0 END AS s FROM u CROSS JOIN nodes),
    g AS (SELECT query_id, node_id, sum(s) * any_value(CASE WHEN kind IN ('function', 'method') THEN 1.3 WHEN kind = 'class' THEN 1.1 WHEN kind = 'module' THEN 0.9 WHEN kind = 'file' THEN 0.8 ELSE 1.0 END) * any_value(CASE WHEN style AND NOT is_test THEN 1.5 ELSE 1.0 END) AS score
      FROM w JOIN h USING (word) WHERE s > 0 GROUP BY query_id, node_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM g) SELECT query_id, node_id, round(score, 6)::DOUBLE AS score, rank FROM o WHERE rank <= 10""",
)
def l15_code_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by words of a query: 3 for the name itself, 2 for its begin, 1 within, 0.5 in the qualified name; times a
    factor for the kind, and 1.5 if the query's naming style is the node's (here: even queries, no tests)."""
    nodes = views.nodes(spark, sf_dir)
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("name"), " ")))))
    asked = nodes.where("node_id % 20 = 0").groupBy(F.col("node_id").alias("query_id")).agg(words.alias("words")).withColumn("style", F.col("query_id") % 40 == 0)
    return keyword_search(asked, nodes, 10).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


def keyword_search(asked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rank): the k best nodes of each query; asked: (query_id, words, style).

    Queries of the same words and style have one result, and nodes that agree in name, path, kind and test score alike,
    so of these the k least are enough, and each such class stands first by its least node: what is among the k best nodes
    is in the k best classes. The different words of all queries are looked up once in the classes.
    """
    same = ["texts", "kind", "is_test"]
    whole = nodes.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("name", "file_path"))).alias("texts"), F.min("kind").alias("kind"), F.min("is_test").alias("is_test"))
    few = whole.withColumn("n", F.row_number().over(W.partitionBy(*same).orderBy("node_id"))).where(F.col("n") <= k)
    few = cut(few.withColumn("least", F.min("node_id").over(W.partitionBy(*same))))
    asked = cut(asked.withColumn("like", F.min("query_id").over(W.partitionBy("words", "style"))))
    forms = asked.where("query_id = like").select("like", "style", F.explode("words").alias("word"))
    words = forms.select("word").distinct()
    words = F.broadcast(words) if words.count() <= 100_000 else words
    texts = few.where("n = 1").select("least", "kind", "is_test", F.explode("texts").alias("t")).select("least", "kind", "is_test", F.lower("t.name").alias("low"), F.lower(F.concat("t.file_path", F.lit("."), F.replace("t.name", F.lit(" "), F.lit("_")))).alias("qualified"))
    low, word = F.col("low"), F.col("word")
    s = F.when(low == word, 3.0).when(low.startswith(word), 2.0).when(low.contains(word), 1.0).otherwise(0.0) + F.when(F.col("qualified").contains(word), 0.5).otherwise(0.0)
    hits = texts.join(words, low.contains(word) | F.col("qualified").contains(word)).groupBy("word", "least", "kind", "is_test").agg(F.sum(s).alias("s"))
    got = forms.join(hits, "word").groupBy("like", "least", "kind", "is_test", "style").agg(F.sum("s").alias("s"))
    score = F.col("s") * kind_boost(F.col("kind")) * F.when(F.col("style") & ~F.col("is_test"), 1.5).otherwise(1.0)
    classes = best(got.select(F.col("like").alias("query_id"), F.col("least").alias("fact_id"), score.alias("score")), k).select("query_id", F.col("fact_id").alias("least"), "score")
    found = best(classes.join(few.select("least", F.col("node_id").alias("fact_id")), "least").select("query_id", "fact_id", "score"), k)
    return asked.select("query_id", "like").join(found.select(F.col("query_id").alias("like"), F.col("fact_id").alias("node_id"), "score", "rank"), "like").drop("like")


SQL_MATCH = f"""WITH {SQL_CODE_MENTIONS}, a AS (SELECT fact_id, mention, max(CASE WHEN kind IN ('backtick', 'call', 'snake_call') THEN 0.05 ELSE 0 END) AS bonus FROM m GROUP BY fact_id, mention), u AS (SELECT DISTINCT mention FROM a),
    x AS (SELECT word AS mention, min(node_id) AS node_id, 0.90 AS c FROM code GROUP BY word), y AS (SELECT word || '.run' AS mention, min(node_id) AS node_id, 0.85 AS c FROM code GROUP BY word),
    z AS (SELECT lower(directory) AS mention, min(node_id) AS node_id, 0.80 AS c FROM code GROUP BY 1), nn AS (SELECT name, min(node_id) AS node_id FROM code GROUP BY name),
    w AS (SELECT mention, min(node_id) AS node_id, 0.60 AS c FROM u JOIN nn ON length(mention) >= 4 AND contains(name, lower(mention)) GROUP BY mention),
    b AS (SELECT u.mention, coalesce(x.node_id, y.node_id, z.node_id, w.node_id) AS node_id, coalesce(x.c, y.c, z.c, w.c) AS c FROM u LEFT JOIN x ON x.mention = u.mention LEFT JOIN y ON y.mention = u.mention LEFT JOIN z ON z.mention = u.mention LEFT JOIN w ON w.mention = u.mention)
    SELECT fact_id, a.mention, node_id, round(least(0.95, c + bonus), 6)::DOUBLE AS confidence FROM a JOIN b ON b.mention = a.mention WHERE node_id IS NOT NULL"""


@query("J16_code_entity_match", SQL_MATCH)
def j16_code_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code_mentions(remarks(spark, sf_dir))
    return match_mentions(found, code(spark, sf_dir)).select("fact_id", "mention", "node_id", F.round("confidence", 6).alias("confidence"))


def match_mentions(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fact_id, mention, node_id, confidence): exact name 0.90, qualified name 0.85, path 0.80, part of a name (four
    letters or more) 0.60; 0.05 more for a mention in backticks or as a call, 0.95 at most; unmatched mentions go.

    Each different mention is resolved once; parts of names are looked for among different names only.
    """
    bonus = F.max(F.when(F.col("kind").isin("backtick", "call", "snake_call"), 0.05).otherwise(0.0))
    asked = found.groupBy("fact_id", "mention").agg(bonus.alias("bonus"))
    mention = asked.select("mention").distinct()
    by = lambda key, name: nodes.groupBy(key.alias("mention")).agg(F.min("node_id").alias(name))
    exact, qualified, path = by(F.col("word"), "x"), by(F.concat("word", F.lit(".run")), "y"), by(F.lower("directory"), "z")
    names = nodes.groupBy("name").agg(F.min("node_id").alias("node_id"))
    names = F.broadcast(names) if names.count() <= 100_000 else names
    inside = mention.where("length(mention) >= 4").join(names, F.col("name").contains(F.lower("mention"))).groupBy("mention").agg(F.min("node_id").alias("w"))
    best_ = mention.join(exact, "mention", "left").join(qualified, "mention", "left").join(path, "mention", "left").join(inside, "mention", "left")
    c = F.when(F.col("x").isNotNull(), 0.90).when(F.col("y").isNotNull(), 0.85).when(F.col("z").isNotNull(), 0.80).when(F.col("w").isNotNull(), 0.60)
    best_ = best_.select("mention", F.coalesce("x", "y", "z", "w").alias("node_id"), c.alias("c")).where("node_id IS NOT NULL")
    return asked.join(best_, "mention").select("fact_id", "mention", "node_id", F.least(F.lit(0.95), F.col("c") + F.col("bonus")).alias("confidence"))


@query(
    "J17_resolve_calls",
    """WITH c AS (SELECT e.src AS caller, s.file_path AS file, s.directory AS dir, d.name FROM relations e JOIN code s ON s.node_id = e.src JOIN code d ON d.node_id = e.dst WHERE e.kind = 'CALLS'),
    im AS (SELECT s.file_path AS file, d.name, min(d.node_id) AS n FROM relations e JOIN code s ON s.node_id = e.src JOIN code d ON d.node_id = e.dst WHERE e.kind = 'IMPORTS_FROM' AND e.weight >= 0.5 GROUP BY ALL),
    sf AS (SELECT file_path AS file, name, min(node_id) AS n FROM code GROUP BY ALL), g AS (SELECT name, min(node_id) AS n, count(*) AS k FROM code GROUP BY name), di AS (SELECT directory AS dir, name, min(node_id) AS n FROM code GROUP BY ALL),
    r AS (SELECT DISTINCT caller, c.name, im.n AS a, sf.n AS b, CASE WHEN k = 1 THEN g.n END AS u, di.n AS d FROM c LEFT JOIN im ON im.file = c.file AND im.name = c.name LEFT JOIN sf ON sf.file = c.file AND sf.name = c.name LEFT JOIN g ON g.name = c.name LEFT JOIN di ON di.dir = c.dir AND di.name = c.name)
    SELECT caller, name, coalesce(a, b, u, d) AS callee, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 1.0::DOUBLE WHEN u IS NOT NULL THEN 0.9 ELSE 0.72 END AS confidence FROM r WHERE coalesce(a, b, u, d) IS NOT NULL""",
)
def j17_resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call by name goes to what the caller's file imports (1.0), else to its own file (1.0), else to the only node of
    that name (0.9), else to the first one in the caller's directory (0.8 of that); a call without any is dropped."""
    nodes, e = code(spark, sf_dir), relations(spark, sf_dir)
    src = nodes.select(F.col("node_id").alias("src"), F.col("file_path").alias("file"), F.col("directory").alias("dir"))
    dst = nodes.select(F.col("node_id").alias("dst"), "name")
    ends = e.join(src, "src").join(dst, "dst")
    made = ends.where("kind = 'CALLS'").select(F.col("src").alias("caller"), "file", "dir", "name").distinct()
    imports = ends.where("kind = 'IMPORTS_FROM' AND weight >= 0.5").groupBy("file", "name").agg(F.min("dst").alias("a"))
    own = nodes.groupBy(F.col("file_path").alias("file"), "name").agg(F.min("node_id").alias("b"))
    only = nodes.groupBy("name").agg(F.min("node_id").alias("u"), F.count("*").alias("k")).where("k = 1").drop("k")
    close = nodes.groupBy(F.col("directory").alias("dir"), "name").agg(F.min("node_id").alias("d"))
    met = made.join(imports, ["file", "name"], "left").join(own, ["file", "name"], "left").join(only, "name", "left").join(close, ["dir", "name"], "left")
    sure = F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), 1.0).when(F.col("u").isNotNull(), 0.9).otherwise(0.72)
    return met.select("caller", "name", F.coalesce("a", "b", "u", "d").alias("callee"), sure.alias("confidence")).where("callee IS NOT NULL")


# --- pruning ---------------------------------------------------------------------------------------------------------

#: The edges with what pruning is for: doubled ones of half the weight, loops, and ends that do not exist.
views.SQL["raw_edges"] = """SELECT src, dst, edge_type, weight FROM edges UNION ALL SELECT src, dst, edge_type, weight / 2 FROM edges WHERE src % 3 = 0
    UNION ALL SELECT src, src, edge_type, weight FROM edges WHERE dst % 7 = 0 UNION ALL SELECT src, dst + 1000000, edge_type, weight FROM edges WHERE dst % 5 = 0"""


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir).select("src", "dst", "edge_type", "weight")
    half = e.where("src % 3 = 0").withColumn("weight", F.col("weight") / 2)
    loops, lost = e.where("dst % 7 = 0").withColumn("dst", F.col("src")), e.where("dst % 5 = 0").withColumn("dst", F.col("dst") + 1000000)
    return e.union(half).union(loops.select(*e.columns)).union(lost.select(*e.columns))


def prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, no loops, and of equal (src, dst, type) the heaviest, which combines before the shuffle."""
    real = edges.where("src <> dst")
    for end in ("src", "dst"):
        real = real.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return real.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


@query("G7_prune_orphans", "SELECT src, dst, edge_type, max(weight) AS weight FROM raw_edges WHERE src <> dst AND src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY ALL")
def g7_prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune(raw_edges(spark, sf_dir), views.nodes(spark, sf_dir))


views.SQL["last_used"] = "SELECT fact_id, max(accessed_at) AS last FROM access GROUP BY fact_id"


def last_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.access(spark, sf_dir).groupBy("fact_id").agg(F.max("accessed_at").cast("timestamp").alias("last"))


@query(
    "G11_prune_inactive",
    f"""WITH b AS (SELECT node_id FROM nodes WHERE contains(name, 'bolt')), a AS (SELECT fact_id FROM last_used WHERE last >= TIMESTAMP '{views.NOW}' - INTERVAL 90 DAY)
    SELECT src, dst, CASE WHEN src IN (SELECT node_id FROM b) OR dst IN (SELECT node_id FROM b) THEN 'blacklisted' ELSE 'inactive' END AS reason FROM edges
    WHERE src IN (SELECT node_id FROM b) OR dst IN (SELECT node_id FROM b) OR (src NOT IN (SELECT fact_id FROM a) AND dst NOT IN (SELECT fact_id FROM a))""",
)
def g11_prune_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to prune: those that touch a blacklisted term, and those with no access within 90 days on either end."""
    e = views.edges(spark, sf_dir).select("src", "dst")
    bad = views.nodes(spark, sf_dir).where(F.col("name").contains("bolt")).select(F.col("node_id").alias("id"), F.lit(True).alias("bad"))
    used = last_used(spark, sf_dir).where(F.col("last") >= views.now() - F.expr("INTERVAL 90 DAYS")).select(F.col("fact_id").alias("id"), F.lit(True).alias("used"))
    for end in ("src", "dst"):
        e = e.join(bad.select(F.col("id").alias(end), F.col("bad").alias(f"{end}_bad")), end, "left").join(used.select(F.col("id").alias(end), F.col("used").alias(f"{end}_used")), end, "left")
    bad_, used_ = F.coalesce("src_bad", "dst_bad").isNotNull(), F.coalesce("src_used", "dst_used").isNotNull()
    return e.where(bad_ | ~used_).select("src", "dst", F.when(bad_, "blacklisted").otherwise("inactive").alias("reason"))


@query(
    "G13_edge_decay",
    f"""WITH u AS (SELECT src, dst, weight, greatest(a.last, b.last) AS last FROM edges LEFT JOIN last_used a ON a.fact_id = src LEFT JOIN last_used b ON b.fact_id = dst),
    d AS (SELECT src, dst, CASE WHEN last IS NULL OR date_diff('day', last, TIMESTAMP '{views.NOW}') >= 30 THEN weight * exp(-0.3) ELSE weight END AS weight FROM u) SELECT src, dst, round(weight, 6) AS weight FROM d WHERE weight >= 0.25""",
)
def g13_edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges unused on both ends for 30 days fall by exp(-0.3); those below 0.25 (0.05 by default) are dropped."""
    used = last_used(spark, sf_dir)
    e = views.edges(spark, sf_dir).select("src", "dst", "weight")
    for end in ("src", "dst"):
        e = e.join(used.select(F.col("fact_id").alias(end), F.col("last").alias(f"{end}_last")), end, "left")
    last = F.greatest("src_last", "dst_last")
    idle = last.isNull() | (F.datediff(views.now(), last) >= 30)
    return e.select("src", "dst", F.when(idle, F.col("weight") * F.exp(F.lit(-0.3))).otherwise(F.col("weight")).alias("w")).where("w >= 0.25").select("src", "dst", F.round("w", 6).alias("weight"))


@query(
    "G16_entity_clusters",
    r"""WITH m AS (SELECT name, fact_id, confidence, created_at, trim(coalesce(string_split_regex(content, '[.!?\n]+')[1], ''), ' ') AS s FROM mentions JOIN facts USING (fact_id) WHERE lifecycle IN ('warm', 'cold') AND NOT pinned),
    k AS (SELECT *, count(*) OVER (PARTITION BY name) AS size, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, created_at DESC, fact_id) AS n FROM m)
    SELECT name, any_value(size) AS size, string_agg(fact_id::VARCHAR, ',' ORDER BY n) AS facts, md5(substr(name || ': ' || string_agg(s, '. ' ORDER BY n), 1, 2000)) AS summary_md5 FROM k WHERE size >= 3 AND n <= 10 GROUP BY name""",
)
def g16_entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with three or more warm or cold facts that are not pinned: their ten best by confidence and recency, and
    a summary of these facts' first sentences, 2,000 characters at most."""
    facts = views.facts(spark, sf_dir)
    able = facts.where("lifecycle IN ('warm', 'cold') AND NOT pinned")
    s = F.trim(F.coalesce(F.get(F.split("content", r"[.!?\n]+"), F.lit(0)), F.lit("")))
    m = mentions(facts).join(able.select("fact_id", "confidence", "created_at", s.alias("s")), "fact_id")
    large = m.groupBy("name").agg(F.count("*").alias("size")).where("size >= 3")
    n = F.row_number().over(W.partitionBy("name").orderBy(F.desc("confidence"), F.desc("created_at"), "fact_id"))
    top = m.join(large, "name").withColumn("n", n).where("n <= 10")
    got = top.groupBy("name", "size").agg(F.array_sort(F.collect_list(F.struct("n", "fact_id", "s"))).alias("x"))
    text = F.concat("name", F.lit(": "), F.array_join(F.transform("x", lambda z: z["s"]), ". "))
    return got.select("name", "size", F.array_join(F.transform("x", lambda z: z["fact_id"].cast("string")), ",").alias("facts"), F.md5(F.substring(text, 1, 2000)).alias("summary_md5"))


# --- flows -----------------------------------------------------------------------------------------------------------

SECURITY = "bolt"
ENTRY = "^(main|small) "


def flows(nodes: DataFrame, edges: DataFrame, depth: int = 15) -> DataFrame:
    """(entry, node, depth): what each entry point reaches, at its least depth.

    Entry points are functions that nothing calls, and functions by name. The frontier loop ends when no entry reaches a
    node that is new to it; every round is cut off by a checkpoint.
    """
    starts = nodes.where("kind = 'function'").select(F.col("node_id").alias("entry"), F.col("name").rlike(ENTRY).alias("by_name"))
    called = edges.select(F.col("dst").alias("entry")).distinct().withColumn("called", F.lit(True))
    starts = starts.join(called, "entry", "left").where("by_name OR called IS NULL").select("entry")
    step = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(starts.select("entry", F.col("entry").alias("node"), F.lit(0).alias("depth")))
    for k in range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("src")).select("entry", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(seen, ["entry", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


SQL_FLOWS = f"""st AS (SELECT node_id AS entry FROM nodes WHERE kind = 'function' AND (regexp_matches(name, '{ENTRY}') OR node_id NOT IN (SELECT dst FROM calls))), ca AS (SELECT DISTINCT src, dst FROM calls),
    p AS (SELECT entry, entry AS node, 0 AS depth FROM st UNION SELECT entry, dst, depth + 1 FROM p JOIN ca ON ca.src = p.node WHERE depth < 15), fl AS (SELECT entry, node, min(depth) AS depth FROM p GROUP BY entry, node)"""
SQL_CRITICALITY = f"""cr AS (SELECT entry, count(*) AS nodes, max(depth)::INT AS depth, count(DISTINCT file_path) AS files, 0.10::DOUBLE * least(1, max(depth) / 10.0) + 0.15::DOUBLE * least(1, count(*) / 20.0) + 0.30::DOUBLE * least(1, (count(DISTINCT file_path) - 1) / 4.0)
    + 0.20::DOUBLE * (1 - avg(CASE WHEN node IN (SELECT dst FROM calls JOIN nodes t ON t.node_id = src WHERE t.is_test) THEN 1 ELSE 0 END)) + 0.25::DOUBLE * avg(CASE WHEN contains(name, '{SECURITY}') THEN 1 ELSE 0 END) AS c FROM fl JOIN nodes ON node_id = node GROUP BY entry)"""


def criticality(reached: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, nodes, depth, files, criticality): 0.10 depth, 0.15 nodes, 0.30 files, 0.20 untested share, 0.25 security share."""
    tested = edges.join(nodes.where("is_test").select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("tested", F.lit(1))
    info = nodes.select(F.col("node_id").alias("node"), "file_path", F.when(F.col("name").contains(SECURITY), 1).otherwise(0).alias("security"))
    met = reached.join(info, "node").join(tested, "node", "left")
    one = F.lit(1.0)
    got = met.groupBy("entry").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.countDistinct("file_path").alias("files"), F.avg(F.coalesce("tested", F.lit(0))).alias("t"), F.avg("security").alias("s"))
    c = 0.10 * F.least(one, F.col("depth") / 10) + 0.15 * F.least(one, F.col("nodes") / 20) + 0.30 * F.least(one, (F.col("files") - 1) / 4) + 0.20 * (1 - F.col("t")) + 0.25 * F.col("s")
    return got.select("entry", "nodes", "depth", "files", F.round(c, 6).alias("criticality"))


@query("G18_trace_flows", f"WITH RECURSIVE {SQL_FLOWS}, {SQL_CRITICALITY} SELECT entry, nodes, depth, files, round(c, 6) AS criticality FROM cr")
def g18_trace_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.nodes(spark, sf_dir), cut(calls(spark, sf_dir))
    return criticality(flows(nodes, edges), nodes, edges)


@query(
    "G24_affected_flows",
    f"WITH RECURSIVE {SQL_FLOWS}, {SQL_CRITICALITY}, ch AS (SELECT node_id FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE node_id % 50 = 0)), a AS (SELECT entry, count(*) AS touched FROM fl WHERE node IN (SELECT node_id FROM ch) GROUP BY entry) SELECT entry, touched, round(c, 6) AS criticality FROM a JOIN cr USING (entry)",
)
def g24_affected_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that pass through nodes of changed files (here: files of every fiftieth node), and how many such nodes."""
    nodes, edges = views.nodes(spark, sf_dir), cut(calls(spark, sf_dir))
    reached = flows(nodes, edges)
    files = nodes.where("node_id % 50 = 0").select("file_path").distinct()
    changed = nodes.join(files, "file_path", "left_semi").select(F.col("node_id").alias("node"))
    touched = reached.join(changed, "node", "left_semi").groupBy("entry").agg(F.count("*").alias("touched"))
    return touched.join(criticality(reached, nodes, edges), "entry").select("entry", "touched", "criticality")


@query(
    "G19_risk_score",
    f"""WITH RECURSIVE {SQL_FLOWS}, f AS (SELECT node, count(*) AS flows FROM fl GROUP BY node), x AS (SELECT dst, count(*) AS callers, count(*) FILTER (s.directory <> d.directory) AS far FROM calls JOIN code s ON s.node_id = src JOIN code d ON d.node_id = dst GROUP BY dst),
    t AS (SELECT DISTINCT dst FROM calls JOIN nodes ON node_id = src WHERE is_test)
    SELECT node_id, round(least(0.25::DOUBLE, 0.05::DOUBLE * coalesce(flows, 0)) + least(0.15::DOUBLE, 0.05::DOUBLE * coalesce(far, 0)) + CASE WHEN t.dst IS NULL THEN 0.30::DOUBLE ELSE 0.05::DOUBLE END
      + CASE WHEN contains(name, '{SECURITY}') THEN 0.20::DOUBLE ELSE 0 END + least(0.10::DOUBLE, coalesce(callers, 0) / 20.0), 6) AS risk FROM nodes LEFT JOIN f ON f.node = node_id LEFT JOIN x ON x.dst = node_id LEFT JOIN t ON t.dst = node_id""",
)
def g19_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows through a node (0.05 each, 0.25 at most), callers from other communities (0.15 at most), 0.30 without a test
    and 0.05 with one, 0.20 for security, callers / 20 (0.10 at most)."""
    nodes, edges = code(spark, sf_dir), cut(calls(spark, sf_dir))
    through = flows(nodes, edges).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("flows"))
    place = nodes.select("node_id", "directory")
    ends = edges.join(place.select(F.col("node_id").alias("src"), F.col("directory").alias("a")), "src").join(place.select(F.col("node_id").alias("dst"), F.col("directory").alias("b")), "dst")
    callers = ends.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers"), F.count_if(F.col("a") != F.col("b")).alias("far"))
    tested = edges.join(nodes.where("is_test").select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct().withColumn("tested", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    risk = F.least(F.lit(0.25), 0.05 * zero("flows")) + F.least(F.lit(0.15), 0.05 * zero("far")) + F.when(F.col("tested").isNull(), 0.30).otherwise(0.05)
    risk = risk + F.when(F.col("name").contains(SECURITY), 0.20).otherwise(0.0) + F.least(F.lit(0.10), zero("callers") / 20)
    return nodes.join(through, "node_id", "left").join(callers, "node_id", "left").join(tested, "node_id", "left").select("node_id", F.round(risk, 6).alias("risk"))


@query(
    "G22_contains_tested_by",
    """SELECT 'CONTAINS' AS kind, min(node_id) OVER (PARTITION BY file_path) AS src, node_id AS dst FROM nodes
    UNION ALL SELECT DISTINCT 'TESTED_BY', dst, src FROM calls JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.is_test AND NOT b.is_test""",
)
def g22_contains_tested_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each file (its first node) to all it contains, and from each node to the tests that call it."""
    nodes = views.nodes(spark, sf_dir)
    parent = nodes.groupBy("file_path").agg(F.min("node_id").alias("src"))
    inside = nodes.join(parent, "file_path").select(F.lit("CONTAINS").alias("kind"), "src", F.col("node_id").alias("dst"))
    test, real = nodes.where("is_test").select(F.col("node_id").alias("src")), nodes.where("NOT is_test").select(F.col("node_id").alias("dst"))
    tested = calls(spark, sf_dir).join(test, "src", "left_semi").join(real, "dst", "left_semi").select(F.lit("TESTED_BY"), F.col("dst"), F.col("src")).distinct()
    return inside.union(tested)


@query(
    "G23_large_functions",
    """WITH l AS (SELECT node_id, lines, row_number() OVER (ORDER BY lines DESC, node_id) AS place FROM nodes WHERE kind IN ('function', 'method') AND lines >= 40)
    SELECT 'large' AS what, node_id, lines, place FROM l WHERE place <= 100 UNION ALL SELECT 'dead', node_id, lines, NULL FROM nodes WHERE kind = 'function' AND NOT is_test AND node_id NOT IN (SELECT dst FROM calls)""",
)
def g23_large_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred longest functions of 40 lines or more, longest first, and functions that nothing calls and no test is."""
    nodes = views.nodes(spark, sf_dir)
    top = nodes.where("kind IN ('function', 'method') AND lines >= 40").orderBy(F.desc("lines"), "node_id").limit(100)
    large = top.select(F.lit("large").alias("what"), "node_id", "lines", F.row_number().over(W.orderBy(F.desc("lines"), "node_id")).cast("long").alias("place"))
    dead = nodes.where("kind = 'function' AND NOT is_test").join(calls(spark, sf_dir).select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    return large.union(dead.select(F.lit("dead"), "node_id", "lines", F.lit(None).cast("long")))


@query(
    "G25_code_memories",
    """WITH l AS (SELECT node_id, l_orderkey AS fact_id, l_shipdate AS t, l_shipdate < TIMESTAMP '1992-01-01' + to_days((60 * lines)::INT) AS stale FROM lineitem JOIN nodes ON node_id = l_partkey WHERE kind IN ('function', 'method', 'class'))
    SELECT node_id, count(*) AS facts, count(*) FILTER (stale) AS stale, arg_min(fact_id, (t, fact_id)) AS first_fact, arg_max(fact_id, (t, fact_id)) AS last_fact FROM l GROUP BY node_id""",
)
def g25_code_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts linked to functions, methods and classes: first and last by time, and how many links are older than the
    node's last change (here: 60 days a line after the beginning of 1992)."""
    nodes = views.nodes(spark, sf_dir).where("kind IN ('function', 'method', 'class')").select("node_id", F.date_add(F.lit("1992-01-01").cast("date"), (60 * F.col("lines")).cast("int")).alias("changed"))
    links = views.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("fact_id"), F.col("l_shipdate").alias("t")).join(nodes, "node_id")
    order = F.struct("t", "fact_id")
    return links.groupBy("node_id").agg(F.count("*").alias("facts"), F.count_if(F.col("t") < F.col("changed")).alias("stale"), F.min_by("fact_id", order).alias("first_fact"), F.max_by("fact_id", order).alias("last_fact"))


#: Name of the question, kind of edge, and whether the node asked for is the edge's end.
PATTERNS = [
    ("callers_of", "CALLS", True), ("callees_of", "CALLS", False), ("imports_of", "IMPORTS_FROM", False), ("imported_by", "IMPORTS_FROM", True),
    ("inherits_from", "INHERITS", False), ("inherited_by", "INHERITS", True), ("contains", "CONTAINS", False), ("tests_for", "TESTED_BY", False),
]


@query(
    "G26_typed_neighbours",
    "WITH r AS (SELECT src, dst, kind FROM relations UNION ALL SELECT dst, src, 'TESTED_BY' FROM relations JOIN nodes ON node_id = src WHERE relations.kind = 'CALLS' AND is_test), x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS pattern, {'dst' if end else 'src'} AS node, {'src' if end else 'dst'} AS other FROM r WHERE kind = '{k}'" for n, k, end in PATTERNS)
    + ") SELECT pattern, node, count(*) AS n, min(other) AS first FROM x WHERE node % 20 = 0 GROUP BY ALL",
)
def g26_typed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every twentieth node by the eight questions: how many, and the first."""
    r = relations(spark, sf_dir).select("src", "dst", "kind")
    tests = views.nodes(spark, sf_dir).where("is_test").select(F.col("node_id").alias("src"))
    r = r.union(r.where("kind = 'CALLS'").join(tests, "src", "left_semi").select("dst", "src", F.lit("TESTED_BY")))
    asked = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(k).alias("of"), (F.col("dst") if end else F.col("src")).alias("node"), (F.col("src") if end else F.col("dst")).alias("other")) for n, k, end in PATTERNS])
    each = r.select("kind", F.explode(F.filter(asked, lambda z: z["of"] == F.col("kind"))).alias("z")).select("z.*").where("node % 20 = 0")
    return each.groupBy("pattern", "node").agg(F.count("*").alias("n"), F.min("other").alias("first"))
