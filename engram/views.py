"""Model views over the given tables, in Spark and as DuckDB SQL for the oracles.

facts from documents, turns from conversations, queries from benchmark, access log and tool events from events, edges
from parts that are bought together, outcomes from orders, signals from lineitem, code nodes from part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every operator that needs one.
NOW = "2024-02-01 00:00:00"
EPOCH = 1704067200


def now():
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("fact_id"),
        F.col("lang").alias("profile_id"),
        F.col("text").alias("content"),
        F.col("source").alias("session_id"),
        F.element_at(F.array(*map(F.lit, ("semantic", "episodic", "opinion", "temporal"))), (d % 4 + 1).cast("int")).alias("fact_type"),
        F.element_at(F.array(*map(F.lit, ("active", "warm", "cold", "archived"))), (F.floor(d / 4) % 4 + 1).cast("int")).alias("lifecycle"),
        ((d % 10) / 10).alias("importance"),
        (0.5 + (d % 50) / 100).alias("confidence"),
        (d % 12).alias("access_count"),
        (d % 5).alias("evidence_count"),
        (d % 17 == 0).alias("pinned"),
        F.timestamp_seconds(F.lit(EPOCH) + d * 600 % 2500000).alias("created_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("embedding").cast("array<double>").alias("vec"), "label", (F.col("vec_id") % 12).alias("access_count"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("fact_id"), F.col("ts").alias("accessed_at"), "event_type", "value")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_name"), (F.col("user_id") % 5).alias("project"), "ts", (F.col("event_type") == "error").alias("failed"), "value"
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order, src < dst, weight: in how many orders, most at 1."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return edges_of(lines.alias("a").join(lines.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey"))


def edges_of(pairs: DataFrame) -> DataFrame:
    """Edges from pairs of lines of an order, a.l_partkey < b.l_partkey."""
    counted = pairs.groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).agg(F.count("*").alias("n"))
    kinds = F.array(*map(F.lit, ("entity", "temporal", "semantic", "supersedes")))
    return counted.select("src", "dst", F.least(F.lit(1.0), F.col("n") / 4).alias("weight"), F.element_at(kinds, ((F.col("src") + F.col("dst")) % 4 + 1).cast("int")).alias("edge_type"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome for each line of an order: fact, reward from the order's total price."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("outcome_id"), F.col("l_partkey").alias("fact_id"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("reward"), F.col("o_orderdate").alias("settled_at"), F.col("o_orderstatus").alias("status")
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "store").otherwise("recall")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("agent_id"), F.col("l_partkey").alias("fact_id"), kind.alias("signal"), F.col("l_shipdate").alias("seen_at"), F.col("l_linenumber").alias("position"), F.col("l_orderkey").alias("query_id"))


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("valid_until")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("function", "method", "class", "file", "module")))
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.element_at(kinds, (p % 5 + 1).cast("int")).alias("kind"), (F.col("p_size") % 5 == 0).alias("is_test"), F.col("p_size").cast("long").alias("lines"), (p * 10).alias("line_start"), (p * 10 + F.col("p_size")).alias("line_end")
    )


#: The same views in DuckDB.
SQL = {
    "facts": f"""SELECT doc_id AS fact_id, lang AS profile_id, text AS content, source AS session_id,
        (['semantic','episodic','opinion','temporal'])[(doc_id % 4 + 1)::INT] AS fact_type,
        (['active','warm','cold','archived'])[((doc_id // 4) % 4 + 1)::INT] AS lifecycle,
        (doc_id % 10)::DOUBLE / 10 AS importance, 0.5::DOUBLE + (doc_id % 50)::DOUBLE / 100 AS confidence, doc_id % 12 AS access_count,
        doc_id % 5 AS evidence_count, doc_id % 17 = 0 AS pinned, make_timestamp(({EPOCH} + doc_id * 600 % 2500000) * 1000000) AS created_at FROM documents""",
    "turns": "SELECT conv_id AS session_id, turn, role AS speaker, text AS content FROM conversations",
    "queries": "SELECT item_id AS query_id, text FROM benchmark",
    "vectors": "SELECT vec_id AS fact_id, embedding::DOUBLE[] AS vec, label, vec_id % 12 AS access_count FROM embeddings",
    "access": "SELECT event_id, user_id AS fact_id, ts AS accessed_at, event_type, value FROM events",
    "tools": "SELECT event_id AS id, user_id AS session_id, event_type AS tool_name, user_id % 5 AS project, ts, event_type = 'error' AS failed, value FROM events",
    "bought": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
    "edges": """SELECT a.l_partkey AS src, b.l_partkey AS dst, least(1.0::DOUBLE, count(*)::DOUBLE / 4) AS weight,
        (['entity','temporal','semantic','supersedes'])[((a.l_partkey + b.l_partkey) % 4 + 1)::INT] AS edge_type
        FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey""",
    "outcomes": """SELECT o_orderkey AS outcome_id, l_partkey AS fact_id, least(1.0::DOUBLE, o_totalprice / 400000) AS reward,
        o_orderdate AS settled_at, o_orderstatus AS status FROM bought JOIN orders ON l_orderkey = o_orderkey""",
    "signals": """SELECT l_suppkey AS agent_id, l_partkey AS fact_id, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'store' ELSE 'recall' END AS signal,
        l_shipdate AS seen_at, l_linenumber AS position, l_orderkey AS query_id FROM lineitem""",
    "validity": """SELECT l_orderkey * 10 + l_linenumber AS fact_id, o_orderdate AS valid_from, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS valid_until
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "nodes": """SELECT p_partkey AS node_id, p_name AS name, p_brand AS file_path, (['function','method','class','file','module'])[(p_partkey % 5 + 1)::INT] AS kind,
        p_size % 5 = 0 AS is_test, p_size::BIGINT AS lines, p_partkey * 10 AS line_start, p_partkey * 10 + p_size AS line_end FROM part""",
}


def with_views(sql: str) -> str:
    """The SQL with the views that it names put in front."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I) and name not in used:
                need(body)
                used.append(name)

    need(sql)
    if not used:
        return sql
    front = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {front}, {body[recursive.end():]}"
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {front}, {body[4:].strip()}"
    return f"WITH {front} {body}"
