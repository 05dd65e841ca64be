"""Keyword, time and entity channels over tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.operators.index import Index, look_up, stored
from engram.operators.text import sql_list
from engram.registry import query

#: A token, for lower-case text.
TOKEN = r"[a-z0-9][a-z0-9_'-]*[a-z0-9]|[a-z0-9]"
SQL_TOKENS = "list_filter(regexp_extract_all(lower({}), '" + TOKEN.replace("'", "''") + "'), lambda w: NOT list_contains(" + sql_list(fixed.STOP_WORDS) + ", w))"


def tokens(text: str):
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(fixed.STOP_WORDS))


def term_index(facts: DataFrame) -> Index:
    """The stored inverted index of the facts' tokens."""
    return stored(facts, "terms", tokens("content"))


def scores(queries: DataFrame, index: Index, k1: float = 1.2, b: float = 0.75, delta: float = 0.0) -> DataFrame:
    """(query_id, fact_id, score, matched): BM25 (BM25+ with a delta) of all facts with any term of a query, and the number
    of its distinct terms that they have. Postings come from their buckets; corpus statistics are one row."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("key"))
    hits = look_up(terms, index).crossJoin(F.broadcast(index.stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * (delta + F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    return hits.select("query_id", "fact_id", w.alias("w")).groupBy("query_id", "fact_id").agg(F.sum("w").alias("score"), F.count("*").alias("matched"))


def bm25(queries: DataFrame, facts: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, delta: float = 0.0) -> DataFrame:
    """(query_id, fact_id, score, rank): the k best facts of each query, any term matches.

    Ranks of the hits run in two steps, within hash parts of a query and then over the parts' best, so that no query's
    hits meet in one task.
    """
    return best(scores(queries, term_index(facts), k1, b, delta).drop("matched"), k)


def best(scored: DataFrame, k: int, parts: int = 16) -> DataFrame:
    """The k best rows of each query_id, by score and then fact_id."""
    order = (F.round("score", 9).desc(), F.asc("fact_id"))
    local = scored.withColumn("_p", F.pmod(F.xxhash64("fact_id"), F.lit(parts)))
    local = local.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_p").orderBy(*order))).where(F.col("_r") <= k)
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).drop("_p", "_r")


SQL_BM25 = f"""t AS (SELECT fact_id, {SQL_TOKENS.format('content')} AS t FROM facts), l AS (SELECT fact_id, len(t) AS length FROM t), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
    p AS (SELECT term, fact_id, count(*) AS tf FROM (SELECT fact_id, unnest(t) AS term FROM t) GROUP BY term, fact_id), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT query_id, unnest(list_distinct({SQL_TOKENS.format('text')})) AS term FROM queries),
    s AS (SELECT query_id, p.fact_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term JOIN l ON l.fact_id = p.fact_id CROSS JOIN stats GROUP BY query_id, p.fact_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM s)"""


@query("L1_tokenize", f"SELECT fact_id, len({SQL_TOKENS.format('content')})::BIGINT AS n, md5(array_to_string({SQL_TOKENS.format('content')}, ' ')) AS tokens_md5 FROM facts")
def l1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("fact_id", tokens("content").alias("t")).select("fact_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("L2_bm25_topk", f"WITH {SQL_BM25} SELECT query_id, fact_id, round(score, 6) AS score, rank FROM r WHERE rank <= 50")
def l2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(views.queries(spark, sf_dir), views.facts(spark, sf_dir), 50).select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


@query(
    "L4_keyword_like",
    """WITH w AS (SELECT unnest(['idiot', 'license', 'apache', 'question', 'moron']) AS word), h AS (SELECT word, fact_id, access_count FROM w JOIN facts ON contains(lower(content), word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY access_count DESC, fact_id) AS rank FROM h) SELECT word, fact_id, rank FROM r WHERE rank <= 10""",
)
def l4_keyword_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that contain a keyword, most used first; the five keywords are tested in one pass over the texts."""
    keywords = ["idiot", "license", "apache", "question", "moron"]
    low = F.lower("content")
    hit = F.filter(F.array(*[F.when(low.contains(k), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())
    hits = views.facts(spark, sf_dir).select("fact_id", F.col("access_count").cast("double").alias("score"), F.explode(hit).alias("query_id"))
    return best(hits, 10).select(F.col("query_id").alias("word"), "fact_id", "rank")
