"""Reports, audits and behaviour mining that join several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.entities import mentions, standing
from engram.operators.graph import pageranks
from engram.operators.fusion import SQL_CHANNELS, channels
from engram.operators.lifecycle import SQL_RETENTION, _retention
from engram.operators.mining import _PART
from engram.operators.reports import SQL_TRUST, trust
from engram.operators.tagging import SQL_CLASS, classify
from engram.registry import query

count = lambda: F.count("*")

# --- reports ---------------------------------------------------------------------------------------------------------


@query(
    "A3_unified_timeline",
    f"""WITH {SQL_RETENTION}, t AS (SELECT 'fact' AS kind, fact_id AS id, created_at AS seen_at, fact_id FROM facts UNION ALL SELECT 'event', event_id, accessed_at, fact_id FROM access UNION ALL SELECT 'action', id * 10, ts, session_id FROM tools WHERE tool_name = 'purchase'),
    tr AS (SELECT fact_id, (1 + count(*) FILTER (event_type <> 'error')) / (2 + count(*))::DOUBLE AS trust FROM access GROUP BY fact_id)
    SELECT kind, id, seen_at, f.session_id AS community, round(tr.trust, 6) AS trust, round(retention, 6)::DOUBLE AS retention FROM t LEFT JOIN facts f ON f.fact_id = t.fact_id LEFT JOIN tr ON tr.fact_id = t.fact_id LEFT JOIN ret ON ret.fact_id = t.fact_id
    WHERE seen_at >= TIMESTAMP '2024-01-10' AND seen_at < TIMESTAMP '2024-01-20'""",
)
def a3_unified_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, events and actions of ten days, with community, trust and retention of the fact that each is about."""
    facts, access, tools = views.facts(spark, sf_dir), views.access(spark, sf_dir), views.tools(spark, sf_dir)
    rows = facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.col("created_at").alias("seen_at"), "fact_id")
    rows = rows.union(access.select(F.lit("event"), "event_id", F.col("accessed_at").cast("timestamp"), "fact_id"))
    rows = rows.union(tools.where("tool_name = 'purchase'").select(F.lit("action"), F.col("id") * 10, F.col("ts").cast("timestamp"), "session_id"))
    rows = rows.where("seen_at >= TIMESTAMP '2024-01-10' AND seen_at < TIMESTAMP '2024-01-20'")
    good = access.groupBy("fact_id").agg(((1 + F.count_if(F.col("event_type") != "error")) / (2 + count())).alias("trust"))
    kept = _retention(spark, sf_dir).select("fact_id", "retention")
    full = rows.join(facts.select("fact_id", F.col("session_id").alias("community")), "fact_id", "left").join(good, "fact_id", "left").join(kept, "fact_id", "left")
    return full.select("kind", "id", "seen_at", "community", F.round("trust", 6).alias("trust"), F.round("retention", 6).alias("retention"))


@query(
    "A6_health_report",
    f"""WITH {SQL_TRUST}, {SQL_RETENTION} SELECT 'trust' AS report, 'mean' AS key, round(avg(trust), 6) AS value FROM trust UNION ALL SELECT 'trust', 'below 0.3', count(*) FILTER (trust < 0.3) FROM trust
    UNION ALL SELECT 'zone', zone, count(*) FROM ret GROUP BY zone UNION ALL SELECT 'type', fact_type, count(*) FROM facts GROUP BY fact_type UNION ALL SELECT 'total', 'facts', count(*) FROM facts
    UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'total', 'events', count(*) FROM access""",
)
def a6_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust, retention zones, coverage of types, and totals."""
    line = lambda df, report, key, value: df.select(F.lit(report).alias("report"), key.alias("key"), value.cast("double").alias("value"))
    facts, scores = views.facts(spark, sf_dir), trust(views.signals(spark, sf_dir))
    total = lambda df, name: line(df.agg(count().alias("n")), "total", F.lit(name), F.col("n"))
    out = line(scores.agg(F.round(F.avg("trust"), 6).alias("m")), "trust", F.lit("mean"), F.col("m"))
    out = out.union(line(scores.agg(F.count_if(F.col("trust") < 0.3).alias("n")), "trust", F.lit("below 0.3"), F.col("n")))
    out = out.union(line(_retention(spark, sf_dir).groupBy("zone").agg(count().alias("n")), "zone", F.col("zone"), F.col("n")))
    out = out.union(line(facts.groupBy("fact_type").agg(count().alias("n")), "type", F.col("fact_type"), F.col("n")))
    return out.union(total(facts, "facts")).union(total(views.edges(spark, sf_dir), "edges")).union(total(views.access(spark, sf_dir), "events"))


@query(
    "A12_channel_credit",
    f"""WITH {SQL_CHANNELS}, c AS (SELECT doc_id AS query_id, {SQL_CLASS} AS query_type FROM (SELECT doc_id, text FROM documents)),
    h AS (SELECT query_type, channel, (f.label = q.label AND f.fact_id <> q.fact_id)::INT AS hit FROM ch JOIN c ON c.query_id = ch.query_id JOIN vectors f ON f.fact_id = ch.fact_id JOIN vectors q ON q.fact_id = ch.query_id)
    SELECT query_type, channel, count(*) AS total, round(0.7 + 0.8 * avg(hit), 6) AS weight FROM h GROUP BY ALL HAVING count(*) >= 5""",
)
def a12_channel_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate of every channel for every class of query with five results or more, as weight 0.7 + 0.8 * rate."""
    kinds = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), classify(F.col("text")).alias("query_type"))
    label = views.vectors(spark, sf_dir).select("fact_id", "label")
    found = channels(spark, sf_dir).join(kinds, "query_id").join(label, "fact_id").join(label.select(F.col("fact_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    hit = ((F.col("label") == F.col("own")) & (F.col("fact_id") != F.col("query_id"))).cast("int")
    return found.groupBy("query_type", "channel").agg(count().alias("total"), F.round(0.7 + 0.8 * F.avg(hit), 6).alias("weight")).where("total >= 5")


@query(
    "A17_success_rate",
    """WITH r AS (SELECT fact_id, status, row_number() OVER (PARTITION BY fact_id ORDER BY settled_at DESC, outcome_id) AS n FROM outcomes), s AS (SELECT fact_id, avg(CASE status WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0 END) AS rate, count(*) AS n FROM r WHERE n <= 500 GROUP BY fact_id)
    SELECT f.fact_id, round(coalesce(rate, 0.5), 4)::DOUBLE AS rate, coalesce(n, 0) AS n FROM (SELECT node_id AS fact_id FROM nodes UNION SELECT -1) f LEFT JOIN s ON s.fact_id = f.fact_id""",
)
def a17_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(success + half of partial) / all over the last 500 outcomes of each fact; 0.5 for facts without any."""
    value = F.when(F.col("status") == "F", 1.0).when(F.col("status") == "P", 0.5).otherwise(0.0)
    last = F.row_number().over(W.partitionBy("fact_id").orderBy(F.desc("settled_at"), "outcome_id"))
    rated = views.outcomes(spark, sf_dir).withColumn("k", last).where("k <= 500").groupBy("fact_id").agg(F.avg(value).alias("r"), count().alias("c"))
    facts = views.nodes(spark, sf_dir).select(F.col("node_id").alias("fact_id")).union(spark.range(1).select(F.lit(-1).cast("long")))
    return facts.join(rated, "fact_id", "left").select("fact_id", F.round(F.coalesce("r", F.lit(0.5)), 4).alias("rate"), F.coalesce("c", F.lit(0)).alias("n"))


@query(
    "A31_rollback_watch",
    """WITH v AS (SELECT agent_id, query_id, min(seen_at) AS seen_at, coalesce(max(CASE WHEN signal = 'store' THEN 1 / log2(1 + position) END), 0) AS ndcg FROM signals GROUP BY ALL),
    b AS (SELECT agent_id, avg(ndcg) AS base FROM v WHERE seen_at < TIMESTAMP '1998-01-01' GROUP BY agent_id), r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seen_at, query_id) AS n FROM v WHERE seen_at >= TIMESTAMP '1998-01-01'),
    m AS (SELECT agent_id, avg(ndcg) AS mean, count(*) AS n FROM r WHERE n <= 200 GROUP BY agent_id)
    SELECT agent_id, m.n, round(base, 6) AS baseline, round(mean, 6) AS mean, round(base - mean, 6) >= round(base / (base + 0.05) * 0.02 * base + 0.05 / (base + 0.05) * 0.02, 6) AS rollback FROM m JOIN b USING (agent_id)""",
)
def a31_rollback_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of the first 200 queries after a promotion against the mean before: rolled back if it falls by more than
    a blend of 2 % and of 0.02, which leans to the share of the baseline as that grows beyond 0.05."""
    gain = F.max(F.when(F.col("signal") == "store", 1 / F.log2(1 + F.col("position"))))
    v = views.signals(spark, sf_dir).groupBy("agent_id", "query_id").agg(F.min("seen_at").alias("seen_at"), F.coalesce(gain, F.lit(0.0)).alias("ndcg"))
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    base = v.where(F.col("seen_at") < at).groupBy("agent_id").agg(F.avg("ndcg").alias("base"))
    after = v.where(F.col("seen_at") >= at).withColumn("k", F.row_number().over(W.partitionBy("agent_id").orderBy("seen_at", "query_id"))).where("k <= 200")
    mean = after.groupBy("agent_id").agg(F.avg("ndcg").alias("m"), count().alias("n")).join(base, "agent_id")
    lean = F.col("base") / (F.col("base") + 0.05)
    need = lean * 0.02 * F.col("base") + 0.05 / (F.col("base") + 0.05) * 0.02
    return mean.select("agent_id", "n", F.round("base", 6).alias("baseline"), F.round("m", 6).alias("mean"), (F.round(F.col("base") - F.col("m"), 6) >= F.round(need, 6)).alias("rollback"))


_BLOCKS = [
    ("profile", "fact_type IN ('semantic', 'opinion')", "access_count DESC"),
    ("recent", "fact_type = 'episodic'", "created_at DESC"),
    ("behaviour", "access_count >= 5", "confidence DESC"),
    ("decisions", "importance >= 0.8", "evidence_count DESC"),
    ("opinions", "fact_type = 'opinion' AND confidence >= 0.7", "confidence DESC"),
]


@query(
    "A33_core_blocks",
    "WITH b AS ("
    + " UNION ALL ".join(f"SELECT profile_id, '{n}' AS block, fact_id, content, row_number() OVER (PARTITION BY profile_id ORDER BY {o}, fact_id) AS n FROM facts WHERE {c}" for n, c, o in _BLOCKS)
    + ") SELECT profile_id, block, count(*) AS facts, md5(substr(string_agg(substr(content, 1, 200), ' | ' ORDER BY n), 1, 500)) AS text_md5 FROM b WHERE n <= 5 GROUP BY ALL",
)
def a33_core_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five blocks of a profile, five facts each, 500 characters at most: profile, recent, behaviour, decisions, opinions."""
    facts, out = views.facts(spark, sf_dir), None
    for name, condition, order in _BLOCKS:
        n = F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc(order.split()[0]), "fact_id"))
        top = facts.where(condition).select("profile_id", F.lit(name).alias("block"), F.substring("content", 1, 200).alias("t"), n.alias("n")).where("n <= 5")
        out = top if out is None else out.union(top)
    got = out.groupBy("profile_id", "block").agg(count().alias("facts"), F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
    text = F.substring(F.array_join(F.transform("x", lambda z: z["t"]), " | "), 1, 500)
    return got.select("profile_id", "block", "facts", F.md5(text).alias("text_md5"))


@query(
    "A39_gdpr_export",
    """WITH s AS (SELECT c_custkey AS subject FROM customer WHERE c_custkey % 50 = 0), o AS (SELECT o_custkey AS subject, o_orderkey AS id FROM orders),
    r AS (SELECT 'customer' AS kind, c_custkey AS subject, c_custkey AS id FROM customer UNION ALL SELECT 'orders', subject, id FROM o UNION ALL SELECT 'lineitem', subject, l_orderkey * 10 + l_linenumber FROM lineitem JOIN o ON id = l_orderkey)
    SELECT 'export' AS action, kind, subject, id FROM r WHERE subject IN (SELECT subject FROM s) UNION ALL SELECT 'kept', kind, NULL, count(*) FROM r WHERE subject NOT IN (SELECT subject FROM s) GROUP BY kind""",
)
def a39_gdpr_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the given subjects in every table (every fiftieth customer), and how many rows stay when they are forgotten."""
    people = views.read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("subject"), F.col("c_custkey").alias("id"))
    subjects = people.where("subject % 50 = 0").select("subject")
    orders = views.read(spark, sf_dir, "orders").select(F.lit("orders"), F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"))
    lines = views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber").join(orders.select("subject", "id"), "id")
    rows = people.union(orders).union(lines.select(F.lit("lineitem"), "subject", F.col("id") * 10 + F.col("l_linenumber")))
    taken = rows.join(subjects, "subject", "left_semi").select(F.lit("export").alias("action"), "kind", "subject", "id")
    kept = rows.join(subjects, "subject", "left_anti").groupBy("kind").agg(count().alias("id"))
    return taken.union(kept.select(F.lit("kept"), "kind", F.lit(None).cast("long"), "id"))


#: An audit log in chains of three: payloads, stored hashes, and two kinds of tampering afterwards.
views.SQL["audit"] = """SELECT user_id, k, event_id, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END || payload AS payload, CASE WHEN event_id % 89 = 0 THEN sha256('x') ELSE prev_hash END AS prev_hash, event_hash FROM (
    SELECT *, CASE i WHEN 0 THEN 'genesis' WHEN 1 THEN h0 ELSE h1 END AS prev_hash, CASE i WHEN 0 THEN sha256('genesis' || payload) WHEN 1 THEN h1 ELSE sha256(h1 || payload) END AS event_hash FROM (
      SELECT *, CASE i WHEN 1 THEN sha256('genesis' || p1) WHEN 2 THEN sha256('genesis' || p2) END AS h0, CASE i WHEN 1 THEN sha256(sha256('genesis' || p1) || payload) WHEN 2 THEN sha256(sha256('genesis' || p2) || p1) END AS h1 FROM (
        SELECT *, lag(payload) OVER w AS p1, lag(payload, 2) OVER w AS p2 FROM (SELECT user_id, event_id, event_type || '|' || user_id || '|' || event_id AS payload, (n - 1) // 3 AS k, (n - 1) % 3 AS i FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)) WINDOW w AS (PARTITION BY user_id, k ORDER BY event_id))))"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    e = views.read(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("|", "event_type", "user_id", "event_id").alias("payload"), n.alias("n"))
    e = e.select("user_id", "event_id", "payload", F.floor(F.col("n") / 3).alias("k"), (F.col("n") % 3).alias("i"))
    w = W.partitionBy("user_id", "k").orderBy("event_id")
    e = e.withColumn("p1", F.lag("payload").over(w)).withColumn("p2", F.lag("payload", 2).over(w))
    sha = lambda *c: F.sha2(F.concat(*c), 256)
    start, p, p1, p2 = F.lit("genesis"), F.col("payload"), F.col("p1"), F.col("p2")
    i = F.col("i")
    prev = F.when(i == 0, start).when(i == 1, sha(start, p1)).otherwise(sha(sha(start, p2), p1))
    own = sha(prev, p)
    odd = lambda m: F.col("event_id") % m == 0
    return e.select("user_id", "k", "event_id", F.when(odd(97), F.concat(F.lit("x"), p)).otherwise(p).alias("payload"), F.when(odd(89), F.sha2(F.lit("x"), 256)).otherwise(prev).alias("prev_hash"), own.alias("event_hash"))


def verify_chain(log: DataFrame, keys: list[str]) -> DataFrame:
    """Adds why a row of a hash chain is broken: 'link' if prev_hash is not the hash before it, 'hash' if its own hash does
    not follow from prev_hash and payload; null if it is whole."""
    before = F.coalesce(F.lag("event_hash").over(W.partitionBy(*keys).orderBy("event_id")), F.lit("genesis"))
    own = F.sha2(F.concat("prev_hash", "payload"), 256)
    return log.withColumn("broken", F.when(F.col("prev_hash") != before, "link").when(F.col("event_hash") != own, "hash"))


@query(
    "A41_audit_verify",
    """WITH v AS (SELECT user_id, event_id, CASE WHEN prev_hash <> coalesce(lag(event_hash) OVER (PARTITION BY user_id, k ORDER BY event_id), 'genesis') THEN 'link' WHEN event_hash <> sha256(prev_hash || payload) THEN 'hash' END AS broken FROM audit)
    SELECT user_id, count(*) AS n, count(broken) AS broken, count(*) FILTER (broken = 'link') AS links, min(event_id) FILTER (broken IS NOT NULL) AS first_broken FROM v GROUP BY user_id""",
)
def a41_audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify_chain(audit(spark, sf_dir), ["user_id", "k"])
    bad = F.col("broken").isNotNull()
    return found.groupBy("user_id").agg(count().alias("n"), F.count("broken").alias("broken"), F.count_if(F.col("broken") == "link").alias("links"), F.min(F.when(bad, F.col("event_id"))).alias("first_broken"))


@query(
    "A45_paired_observations",
    """WITH p AS (SELECT fact_id FROM outcomes WHERE status = 'F' INTERSECT SELECT fact_id FROM outcomes WHERE status = 'O'), l AS (SELECT fact_id, max(settled_at) AS last FROM outcomes GROUP BY fact_id)
    SELECT fact_id, count(*) AS n, round(avg(reward), 6) AS mean FROM outcomes JOIN p USING (fact_id) JOIN l USING (fact_id) WHERE settled_at > last - INTERVAL 24 HOUR GROUP BY fact_id""",
)
def a45_paired_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts seen on both arms, and number and mean of their rewards in the last 24 hours."""
    seen = views.outcomes(spark, sf_dir)
    pairs = seen.where("status = 'F'").select("fact_id").intersect(seen.where("status = 'O'").select("fact_id"))
    last = seen.groupBy("fact_id").agg(F.max("settled_at").alias("last"))
    recent = seen.join(pairs, "fact_id").join(last, "fact_id").where(F.col("settled_at") > F.col("last") - F.expr("INTERVAL 24 HOURS"))
    return recent.groupBy("fact_id").agg(count().alias("n"), F.round(F.avg("reward"), 6).alias("mean"))


@query(
    "A46_association_stats",
    """WITH n AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT node, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, node) AS rank FROM n GROUP BY node)
    SELECT 'type' AS report, edge_type AS key, count(*) AS n, round(avg(weight), 6) AS mean FROM edges GROUP BY edge_type UNION ALL SELECT 'communities', 'facts', count(DISTINCT community), NULL FROM standing
    UNION ALL SELECT 'top', node || ': ' || substr(name, 1, 40), degree, NULL FROM d JOIN nodes ON node_id = node WHERE rank <= 5""",
)
def a46_association_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and mean weight by type, number of communities, and the five nodes of largest degree with a preview."""
    edges = views.edges(spark, sf_dir)
    kinds = edges.groupBy("edge_type").agg(count().alias("n"), F.round(F.avg("weight"), 6).alias("mean"))
    groups = views.facts(spark, sf_dir).agg(F.countDistinct("session_id").alias("n"))
    top = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).groupBy("node_id").agg(count().alias("n")).orderBy(F.desc("n"), "node_id").limit(5)
    named = top.join(views.nodes(spark, sf_dir).select("node_id", F.substring("name", 1, 40).alias("name")), "node_id")
    none = F.lit(None).cast("double")
    out = kinds.select(F.lit("type").alias("report"), F.col("edge_type").alias("key"), "n", "mean").union(groups.select(F.lit("communities"), F.lit("facts"), "n", none))
    return out.union(named.select(F.lit("top"), F.concat(F.col("node_id").cast("string"), F.lit(": "), "name"), "n", none))


@query(
    "A47_community_report",
    """WITH m AS (SELECT community, count(*) AS members, avg(pr) AS pr FROM standing GROUP BY community), e AS (SELECT session_id AS community, name, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, name) AS k FROM mentions JOIN facts USING (fact_id) GROUP BY session_id, name)
    SELECT m.community, members, round(pr, 9) AS pagerank, string_agg(name, ',' ORDER BY k) AS top_entities, any_value(CASE WHEN k = 1 THEN name END) AS label FROM m JOIN e ON e.community = m.community WHERE k <= 3 GROUP BY m.community, members, pr""",
)
def a47_community_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and mean rank of each community, its three most named entities, the first of which labels it."""
    facts = views.facts(spark, sf_dir)
    info = standing(facts, pageranks(spark, sf_dir)).groupBy("community").agg(count().alias("members"), F.avg("pr").alias("pr"))
    named = mentions(facts).join(facts.select("fact_id", F.col("session_id").alias("community")), "fact_id").groupBy("community", "name").agg(count().alias("n"))
    top = named.withColumn("k", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "name"))).where("k <= 3")
    got = top.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("x"))
    names = F.transform("x", lambda z: z["name"])
    return info.join(got, "community").select("community", "members", F.round("pr", 9).alias("pagerank"), F.array_join(names, ",").alias("top_entities"), names[0].alias("label"))


# --- behaviour -------------------------------------------------------------------------------------------------------


@query(
    "B7_skill_effectiveness",
    """WITH w AS (SELECT tool_name, session_id, project, coalesce(max((tool_name IN ('purchase', 'signup'))::INT) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) AS good,
      coalesce(max(failed::INT) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS bad,
      (count(*) OVER (PARTITION BY session_id, tool_name ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING) > 0)::INT AS again FROM tools),
    s AS (SELECT *, greatest(-1, least(1, good - bad - again)) AS v FROM w)
    SELECT tool_name, count(*) AS n, sum((v > 0)::INT)::BIGINT AS positive, sum((v < 0)::INT)::BIGINT AS negative, round((sum((v > 0)::INT) - sum((v < 0)::INT)) / count(*)::DOUBLE, 6) AS score, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects FROM s GROUP BY tool_name""",
)
def b7_skill_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+1 if a success follows within ten events, -1 for the same tool again within an hour (300 s by default), -1 for an
    error within three events; clipped to one, then (positive - negative) / uses."""
    w = W.partitionBy("session_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")  # the nearest one, as in the SQL
    soon = W.partitionBy("session_id", "tool_name").orderBy(second.asc_nulls_last()).rangeBetween(1, 3600)
    flag = lambda c, frame: F.coalesce(F.max(c.cast("int")).over(frame), F.lit(0))
    good, bad = flag(F.col("tool_name").isin("purchase", "signup"), w.rowsBetween(1, 10)), flag(F.col("failed"), w.rowsBetween(1, 3))
    again = (F.count(F.lit(1)).over(soon) > 0).cast("int")
    v = F.greatest(F.lit(-1), F.least(F.lit(1), good - bad - again))
    seen = views.tools(spark, sf_dir).select("tool_name", "session_id", "project", v.alias("v"))
    up, down = F.count_if(F.col("v") > 0), F.count_if(F.col("v") < 0)
    return seen.groupBy("tool_name").agg(count().alias("n"), up.alias("positive"), down.alias("negative"), F.round((up - down) / count(), 6).alias("score"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("project").alias("projects"))


def _sql_ngrams() -> str:
    leads = ", ".join(f"lead(tool_name, {i}) OVER w AS t{i}" for i in range(1, 5))
    each = []
    for n in range(2, 6):
        cols = ["t0", *(f"t{i}" for i in range(1, n))]
        differ = " AND ".join(f"{a} <> {b}" for a, b in zip(cols, cols[1:], strict=False))
        each.append(f"SELECT session_id, {n} AS n, {' || chr(62) || '.join(cols)} AS gram FROM l WHERE {cols[-1]} IS NOT NULL AND {differ}")
    return f"l AS (SELECT session_id, tool_name AS t0, {leads} FROM tools WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)), g AS ({' UNION ALL '.join(each)})"


@query(
    "B9_workflow_ngrams",
    f"""WITH {_sql_ngrams()}, c AS (SELECT n, gram, count(*) AS uses, count(DISTINCT session_id) / (SELECT count(DISTINCT session_id) FROM tools)::DOUBLE AS support FROM g GROUP BY n, gram),
    r AS (SELECT *, row_number() OVER (ORDER BY support DESC, uses DESC, gram) AS k FROM c WHERE support >= 0.3) SELECT n, gram, uses, round(support, 6) AS support FROM r WHERE k <= 20""",
)
def b9_workflow_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to five tools without repeats next to each other that occur in 30 % of sessions; the 20 most frequent."""
    w = W.partitionBy("session_id").orderBy("ts", "id")
    tools = views.tools(spark, sf_dir)
    t = tools.select("session_id", F.col("tool_name").alias("t0"), *(F.lead("tool_name", i).over(w).alias(f"t{i}") for i in range(1, 5)))
    grams = []
    for n in range(2, 6):
        ok = F.col(f"t{n - 1}").isNotNull()
        for i in range(n - 1):
            ok = ok & (F.col(f"t{i}") != F.col(f"t{i + 1}"))
        grams.append(F.when(ok, F.struct(F.lit(n).alias("n"), F.concat_ws(">", *(f"t{i}" for i in range(n))).alias("gram"))))
    each = t.select("session_id", F.explode(F.array_compact(F.array(*grams))).alias("g")).groupBy("g.n", "g.gram").agg(count().alias("uses"), F.countDistinct("session_id").alias("s"))
    shared = each.crossJoin(F.broadcast(tools.agg(F.countDistinct("session_id").alias("all")))).withColumn("support", F.col("s") / F.col("all")).where("support >= 0.3")
    return shared.orderBy(F.desc("support"), F.desc("uses"), "gram").limit(20).select("n", "gram", "uses", F.round("support", 6).alias("support"))


@query(
    "B12_usage_patterns",
    f"""WITH p AS (SELECT {_PART} AS part, count(*) AS n FROM tools GROUP BY 1), s AS (SELECT session_id, count(*) AS n FROM tools GROUP BY session_id), t AS (SELECT fact_type, count(*) AS n FROM facts GROUP BY fact_type),
    e AS (SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS k FROM mentions GROUP BY name HAVING count(*) >= 3)
    SELECT 'daypart' AS report, part AS key, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM p UNION ALL SELECT 'heavy session', session_id::VARCHAR, n, NULL FROM s WHERE n > 1.2 * (SELECT avg(n) FROM s)
    UNION ALL SELECT 'type', fact_type, n, round(n / (SELECT sum(n) FROM t)::DOUBLE, 6) FROM t WHERE n = (SELECT max(n) FROM t) UNION ALL SELECT 'entity', name, n, NULL FROM e WHERE k <= 15""",
)
def b12_usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the parts of the day, sessions over 1.2 times the mean (2 by default), the dominant type of fact, and the
    15 most named entities of three facts or more."""
    tools, facts = views.tools(spark, sf_dir), views.facts(spark, sf_dir)
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    share = lambda df: df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.avg("n").alias("mean"))))
    line = lambda df, report, key, share_: df.select(F.lit(report).alias("report"), key.alias("key"), "n", share_.alias("share"))
    none, rate = F.lit(None).cast("double"), F.round(F.col("n") / F.col("all"), 6)
    out = line(share(tools.groupBy(part.alias("part")).agg(count().alias("n"))), "daypart", F.col("part"), rate)
    heavy = share(tools.groupBy("session_id").agg(count().alias("n"))).where("n > 1.2 * mean")
    kinds = share(facts.groupBy("fact_type").agg(count().alias("n"))).where("n = most")
    named = mentions(facts).groupBy("name").agg(count().alias("n")).where("n >= 3").orderBy(F.desc("n"), "name").limit(15)
    return out.union(line(heavy, "heavy session", F.col("session_id").cast("string"), none)).union(line(kinds, "type", F.col("fact_type"), rate)).union(line(named, "entity", F.col("name"), none))


_CATEGORY = "CASE WHEN tool_name IN ('click', 'view') THEN 'browse' WHEN tool_name = 'error' THEN 'fail' ELSE 'convert' END"


@query(
    "B14_cross_profile_preference",
    f"""WITH p AS (SELECT project, {_CATEGORY} AS category, tool_name, count(*) AS n, max(ts) AS last, count(*) FILTER (ts >= TIMESTAMP '{views.NOW}' - INTERVAL 15 DAY) AS recent FROM tools GROUP BY ALL HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY project, category ORDER BY n DESC, tool_name) AS k, row_number() OVER (PARTITION BY project, category ORDER BY recent DESC, tool_name) AS kr, row_number() OVER (PARTITION BY project, category ORDER BY n - recent DESC, tool_name) AS ko FROM p),
    m AS (SELECT category, tool_name, sum(n * exp(-date_diff('day', last, TIMESTAMP '{views.NOW}') / 365.0)) AS evidence FROM r WHERE k = 1 GROUP BY ALL), c AS (SELECT *, evidence / sum(evidence) OVER (PARTITION BY category) AS share FROM m),
    ch AS (SELECT category, count(DISTINCT a.project) AS changed FROM (SELECT project, category, tool_name FROM r WHERE kr = 1) a JOIN (SELECT project, category, tool_name AS old FROM r WHERE ko = 1) b USING (project, category) WHERE tool_name <> old GROUP BY category)
    SELECT c.category, tool_name, round(evidence, 6) AS evidence, round(least(0.95, share), 6) AS confidence, coalesce(changed, 0) AS changed FROM c LEFT JOIN ch ON ch.category = c.category WHERE share >= 0.3""",
)
def b14_cross_profile_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of every project and category with two uses or more, merged over projects with exp(-days / 365); shares
    of 0.3 or more, 0.95 at most; and in how many projects the winner of the last 15 days (90 by default) is new."""
    t = F.col("tool_name")
    category = F.when(t.isin("click", "view"), "browse").when(t == "error", "fail").otherwise("convert")
    recent = F.count_if(F.col("ts") >= views.now() - F.expr("INTERVAL 15 DAYS"))
    p = views.tools(spark, sf_dir).groupBy("project", category.alias("category"), "tool_name").agg(count().alias("n"), F.max("ts").alias("last"), recent.alias("recent")).where("n >= 2")
    w = W.partitionBy("project", "category")
    r = p.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "tool_name"))).withColumn("kr", F.row_number().over(w.orderBy(F.desc("recent"), "tool_name")))
    r = r.withColumn("ko", F.row_number().over(w.orderBy((F.col("n") - F.col("recent")).desc(), "tool_name")))
    age = F.datediff(views.now(), "last")
    m = r.where("k = 1").groupBy("category", "tool_name").agg(F.sum(F.col("n") * F.exp(-age / 365.0)).alias("e"))
    c = m.withColumn("share", F.col("e") / F.sum("e").over(W.partitionBy("category"))).where("share >= 0.3")
    moved = r.where("kr = 1").select("project", "category", "tool_name").join(r.where("ko = 1").select("project", "category", F.col("tool_name").alias("old")), ["project", "category"])
    changed = moved.where("tool_name <> old").groupBy("category").agg(F.countDistinct("project").alias("changed"))
    return c.join(changed, "category", "left").select("category", "tool_name", F.round("e", 6).alias("evidence"), F.round(F.least(F.lit(0.95), F.col("share")), 6).alias("confidence"), F.coalesce("changed", F.lit(0)).alias("changed"))


@query(
    "B16_query_habits",
    f"""WITH q AS (SELECT query_id, {SQL_CLASS} AS kind FROM queries), h0 AS (SELECT hour(ts)::INT AS hour, count(*) AS n FROM tools GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY n DESC, hour) AS k FROM h0), e AS (SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS k FROM asked GROUP BY name)
    SELECT 'hour' AS report, hour::VARCHAR AS key, n, round(least(1, n / 100.0), 6)::DOUBLE AS confidence FROM h WHERE k <= 5 UNION ALL SELECT 'entity', name, n, round(least(1, n / 100.0), 6) FROM e WHERE k <= 10
    UNION ALL SELECT 'type', kind, count(*), round(count(*) / (SELECT count(*) FROM q)::DOUBLE, 6) FROM q GROUP BY kind""",
)
def b16_query_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five busiest hours, the ten entities asked for most, and the share of every class of query."""
    from engram.operators.entities import asked_names

    queries = views.queries(spark, sf_dir)
    hours = views.tools(spark, sf_dir).groupBy(F.hour("ts").alias("key")).agg(count().alias("n")).orderBy(F.desc("n"), "key").limit(5)
    names = asked_names(queries).groupBy(F.col("name").alias("key")).agg(count().alias("n")).orderBy(F.desc("n"), "key").limit(10)
    kinds = queries.groupBy(classify(F.col("text")).alias("key")).agg(count().alias("n"))
    sure = F.round(F.least(F.lit(1.0), F.col("n") / 100), 6)
    out = hours.select(F.lit("hour").alias("report"), F.col("key").cast("string").alias("key"), "n", sure.alias("confidence")).union(names.select(F.lit("entity"), "key", "n", sure))
    return out.union(kinds.crossJoin(F.broadcast(kinds.agg(F.sum("n").alias("all")))).select(F.lit("type"), "key", "n", F.round(F.col("n") / F.col("all"), 6)))


SQL_PATTERNS = f"""pa AS (SELECT 'tool' AS source, tool_name AS key, 'style' AS category, least(1.0, count(*) / 2500.0)::DOUBLE AS c, count(DISTINCT project) AS projects FROM tools GROUP BY tool_name
    UNION ALL SELECT 'hour', 'hour ' || hour(ts), 'routine', least(1.0, count(*) / 1000.0), count(DISTINCT project) FROM tools GROUP BY hour(ts)
    UNION ALL SELECT 'workflow', a || '>' || b, 'routine', least(1.0, count(*) / 800.0), count(DISTINCT project) FROM (SELECT tool_name AS a, project, lead(tool_name) OVER (PARTITION BY session_id ORDER BY ts, id) AS b FROM tools) WHERE b IS NOT NULL AND a <> b GROUP BY a, b
    UNION ALL SELECT 'entity', name, 'topic', least(1.0, count(*) / 50.0), count(DISTINCT session_id) FROM mentions JOIN facts USING (fact_id) GROUP BY name HAVING count(*) >= 3
    UNION ALL SELECT 'outcome', tool_name, 'style', avg(CASE WHEN failed THEN 0.0 ELSE 0.5 END), count(DISTINCT project) FROM tools GROUP BY tool_name),
    pb AS (SELECT source, key, category, least(1.0, c * CASE WHEN projects >= 2 THEN 1.2 ELSE 1.0 END) AS c FROM pa WHERE c >= 0.1), pu AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(c, 9) DESC, source) AS k FROM pb)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, key, category, c): patterns of tools, hours, workflows, entities and outcomes of 0.1 or more, 1.2 times that
    if two projects show it, the best of each key."""
    tools, facts = views.tools(spark, sf_dir), views.facts(spark, sf_dir)
    projects = F.countDistinct("project").alias("projects")
    line = lambda df, source, category: df.select(F.lit(source).alias("source"), F.col("key").cast("string").alias("key"), F.lit(category).alias("category"), F.least(F.lit(1.0), F.col("c")).alias("c"), "projects")
    after = F.lead("tool_name").over(W.partitionBy("session_id").orderBy("ts", "id"))
    runs = tools.select("project", F.col("tool_name").alias("a"), after.alias("b")).where("b IS NOT NULL AND a <> b")
    named = mentions(facts).join(facts.select("fact_id", "session_id"), "fact_id").groupBy(F.col("name").alias("key")).agg(count().alias("n"), F.countDistinct("session_id").alias("projects")).where("n >= 3")
    out = line(tools.groupBy(F.col("tool_name").alias("key")).agg((count() / 2500).alias("c"), projects), "tool", "style")
    out = out.union(line(tools.groupBy(F.concat(F.lit("hour "), F.hour("ts")).alias("key")).agg((count() / 1000).alias("c"), projects), "hour", "routine"))
    out = out.union(line(runs.groupBy(F.concat_ws(">", "a", "b").alias("key")).agg((count() / 800).alias("c"), projects), "workflow", "routine"))
    out = out.union(line(named.withColumn("c", F.col("n") / 50), "entity", "topic"))
    out = out.union(line(tools.groupBy(F.col("tool_name").alias("key")).agg(F.avg(F.when(F.col("failed"), 0.0).otherwise(0.5)).alias("c"), projects), "outcome", "style"))
    strong = out.where("c >= 0.1").withColumn("c", F.least(F.lit(1.0), F.col("c") * F.when(F.col("projects") >= 2, 1.2).otherwise(1.0)))
    return strong.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.round("c", 9).desc(), "source"))).where("k = 1").select("source", "key", "category", "c")


@query("B17_pattern_union", f"WITH {SQL_PATTERNS} SELECT source, key, category, round(c, 6) AS confidence FROM pu WHERE k = 1")
def b17_pattern_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns(spark, sf_dir).select("source", "key", "category", F.round("c", 6).alias("confidence"))


@query(
    "B18_soft_prompts",
    f"""WITH {SQL_PATTERNS}, t AS (SELECT category, c, key, '- prefers ' || key || ' (' || source || ')' AS line FROM pu WHERE k = 1),
    u AS (SELECT *, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY category ORDER BY round(c, 9) DESC, key ROWS UNBOUNDED PRECEDING) AS used FROM t), b AS (SELECT category, CASE category WHEN 'style' THEN 120 WHEN 'routine' THEN 90 ELSE 60 END AS budget FROM (SELECT DISTINCT category FROM t))
    SELECT category, count(*) AS lines, max(used)::BIGINT AS tokens, md5(string_agg(line, chr(10) ORDER BY round(c, 9) DESC, key)) AS prompt_md5 FROM u JOIN b USING (category) WHERE used <= budget GROUP BY category""",
)
def b18_soft_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt for each category: its patterns as lines, strongest first, up to the category's share of the token budget."""
    t = patterns(spark, sf_dir).withColumn("line", F.concat(F.lit("- prefers "), "key", F.lit(" ("), "source", F.lit(")")))
    order = W.partitionBy("category").orderBy(F.round("c", 9).desc(), "key")
    budget = F.when(F.col("category") == "style", 120).when(F.col("category") == "routine", 90).otherwise(60)
    used = F.sum(F.ceil(F.length("line") / 4)).over(order.rowsBetween(W.unboundedPreceding, 0))
    fit = t.withColumn("n", F.row_number().over(order)).withColumn("used", used).where(F.col("used") <= budget)
    got = fit.groupBy("category").agg(count().alias("lines"), F.max("used").cast("long").alias("tokens"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return got.select("category", "lines", "tokens", F.md5(F.array_join(F.transform("x", lambda z: z["line"]), "\n")).alias("prompt_md5"))


@query(
    "B22_skill_degradation",
    """WITH o AS (SELECT session_id, tool_name, project, failed, lead(failed) OVER (PARTITION BY session_id ORDER BY ts, id) AS after FROM tools), s AS (SELECT tool_name, project, count(*) AS n, 1 - avg((failed OR coalesce(after, false))::INT) AS e FROM o GROUP BY ALL),
    p AS (SELECT tool_name, project, session_id, count(*) AS uses, count(*) FILTER (failed OR coalesce(after, false)) AS bad FROM o GROUP BY ALL), q AS (SELECT tool_name, project, count(*) AS sessions FROM p WHERE uses >= 5 AND bad >= 2 GROUP BY ALL)
    SELECT s.tool_name, s.project, n, CASE WHEN e < 0.4 THEN 'FIX' WHEN e < 0.55 THEN 'DERIVED' ELSE 'OK' END AS action, coalesce(sessions, 0) AS bad_sessions FROM s LEFT JOIN q ON q.tool_name = s.tool_name AND q.project = s.project WHERE n >= 5""",
)
def b22_skill_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By share of uses without an error then or next: below 0.4 fix, below 0.55 derive, from five uses on; and sessions
    with five uses or more and two bad ones or more."""
    after = F.lead("failed").over(W.partitionBy("session_id").orderBy("ts", "id"))
    o = views.tools(spark, sf_dir).select("session_id", "tool_name", "project", (F.col("failed") | F.coalesce(after, F.lit(False))).alias("bad"))
    s = o.groupBy("tool_name", "project").agg(count().alias("n"), (1 - F.avg(F.col("bad").cast("int"))).alias("e")).where("n >= 5")
    q = o.groupBy("tool_name", "project", "session_id").agg(count().alias("uses"), F.count_if("bad").alias("b")).where("uses >= 5 AND b >= 2").groupBy("tool_name", "project").agg(count().alias("bad_sessions"))
    action = F.when(F.col("e") < 0.4, "FIX").when(F.col("e") < 0.55, "DERIVED").otherwise("OK")
    return s.join(q, ["tool_name", "project"], "left").select("tool_name", "project", "n", action.alias("action"), F.coalesce("bad_sessions", F.lit(0)).alias("bad_sessions"))
