"""Aggregations and analytic reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.operators.text import sql_list
from engram.registry import query

count = lambda: F.count("*")


@query("A1_system_stats", "SELECT fact_type, session_id, count(*) AS facts, count(DISTINCT profile_id) AS profiles, sum(length(content))::BIGINT AS chars FROM facts GROUP BY GROUPING SETS ((fact_type), (session_id), ())")
def a1_system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by type, by session and over all, in one pass with grouping sets."""
    facts = views.facts(spark, sf_dir).select("fact_type", "session_id", "profile_id", F.length("content").alias("n"))
    sets = facts.groupingSets([["fact_type"], ["session_id"], []], "fact_type", "session_id")
    return sets.agg(count().alias("facts"), F.countDistinct("profile_id").alias("profiles"), F.sum("n").cast("long").alias("chars"))


@query("A2_timeline_counts", "SELECT strftime(date_trunc('week', accessed_at), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM access GROUP BY GROUPING SETS ((1, 2), (1), ())")
def a2_timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col("accessed_at")), "yyyy-MM-dd").alias("week")
    return views.access(spark, sf_dir).select(week, "event_type").rollup("week", "event_type").agg(count().alias("n"))


@query("A4_changed_recently", f"SELECT fact_id, fact_type FROM facts WHERE created_at >= TIMESTAMP '{views.NOW}' - INTERVAL 28 DAY")
def a4_changed_recently(spark: SparkSession, sf_dir: str, days: int = 28) -> DataFrame:
    """Facts of the last `days` days; four weeks, as small tables have no facts of the last one."""
    return views.facts(spark, sf_dir).where(F.col("created_at") >= views.now() - F.expr(f"INTERVAL {days} DAYS")).select("fact_id", "fact_type")


@query("A5_contradiction_report", "SELECT src, dst, a.name AS src_name, b.name AS dst_name, weight FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE edge_type = 'supersedes' AND weight >= 0.5")
def a5_contradiction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.nodes(spark, sf_dir).select("node_id", "name")
    strong = views.edges(spark, sf_dir).where("edge_type = 'supersedes' AND weight >= 0.5")
    a, b = names.select(F.col("node_id").alias("src"), F.col("name").alias("src_name")), names.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    return strong.join(a, "src").join(b, "dst").select("src", "dst", "src_name", "dst_name", "weight")


@query("A7_cross_session_entities", "SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS sessions FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1")
def a7_cross_session_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.countDistinct("l_orderkey").alias("sessions")).where("sessions > 1")


@query("A8_cluster_stats", "SELECT label, count(*) AS members, max(access_count) AS most_used FROM vectors GROUP BY label")
def a8_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vectors(spark, sf_dir).groupBy("label").agg(count().alias("members"), F.max("access_count").alias("most_used"))


@query("A9_graph_stats", "SELECT edge_type, count(*) AS edges, round(avg(weight), 6) AS weight, round(2.0 * count(*) / (SELECT count(*) FROM part), 6)::DOUBLE AS degree FROM edges GROUP BY edge_type")
def a9_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = views.nodes(spark, sf_dir).agg(count().alias("nodes"))
    by_type = views.edges(spark, sf_dir).groupBy("edge_type").agg(count().alias("edges"), F.round(F.avg("weight"), 6).alias("weight"))
    return by_type.crossJoin(F.broadcast(total)).select("edge_type", "edges", "weight", F.round(2.0 * F.col("edges") / F.col("nodes"), 6).alias("degree"))


@query("A10_tier_stats", "SELECT profile_id, count(*) FILTER (lifecycle = 'active') AS active, count(*) FILTER (pinned) AS pinned, round(100.0 * count(*) FILTER (lifecycle = 'active') / count(*), 4)::DOUBLE AS share FROM facts GROUP BY profile_id")
def a10_tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.count_if(F.col("lifecycle") == "active")
    return views.facts(spark, sf_dir).groupBy("profile_id").agg(active.alias("active"), F.count_if("pinned").alias("pinned"), F.round(100.0 * active / count(), 4).alias("share"))


@query("A11_access_counts", f"SELECT fact_id, count(*) AS n, max(accessed_at) AS last, count(*) FILTER (accessed_at >= TIMESTAMP '{views.NOW}' - INTERVAL 14 DAY) AS recent FROM access GROUP BY fact_id")
def a11_access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.count_if(F.col("accessed_at") >= views.now() - F.expr("INTERVAL 14 DAYS"))
    return views.access(spark, sf_dir).groupBy("fact_id").agg(count().alias("n"), F.max("accessed_at").alias("last"), recent.alias("recent"))


@query(
    "A13_co_retrieval_pairs",
    "SELECT least(a.fact_id, b.fact_id) AS a, greatest(a.fact_id, b.fact_id) AS b, count(*) AS n FROM signals a JOIN signals b ON a.query_id = b.query_id AND b.position > a.position AND b.position <= a.position + 4 AND a.fact_id <> b.fact_id GROUP BY ALL",
)
def a13_co_retrieval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at most four places apart in one result list; a list has few places, so pairs stay linear in lists."""
    s = views.signals(spark, sf_dir).select("query_id", "fact_id", "position")
    near = s.alias("x").join(s.alias("y"), "query_id").where("y.position > x.position AND y.position <= x.position + 4 AND x.fact_id <> y.fact_id")
    return near.groupBy(F.least("x.fact_id", "y.fact_id").alias("a"), F.greatest("x.fact_id", "y.fact_id").alias("b")).agg(count().alias("n"))


_ALPHA = "CASE signal " + " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in fixed.TRUST_WEIGHTS.items()) + " END::DOUBLE"
_BETA = "CASE signal " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in fixed.TRUST_WEIGHTS.items()) + " END::DOUBLE"


def trust(signals: DataFrame) -> DataFrame:
    """Beta(1, 1) prior plus the weights of all signals, by agent."""
    a = F.element_at(F.create_map(*[F.lit(x) for k, (p, _) in fixed.TRUST_WEIGHTS.items() for x in (k, p)]), F.col("signal"))
    b = F.element_at(F.create_map(*[F.lit(x) for k, (_, q) in fixed.TRUST_WEIGHTS.items() for x in (k, q)]), F.col("signal"))
    summed = signals.groupBy("agent_id").agg((1 + F.sum(a)).alias("alpha"), (1 + F.sum(b)).alias("beta"), count().alias("evidence"), F.max("seen_at").alias("last"))
    return summed.withColumn("trust", F.col("alpha") / (F.col("alpha") + F.col("beta")))


SQL_TRUST = f"tr AS (SELECT agent_id, 1 + sum({_ALPHA}) AS alpha, 1 + sum({_BETA}) AS beta, count(*) AS evidence, max(seen_at) AS last FROM signals GROUP BY agent_id), trust AS (SELECT *, alpha / (alpha + beta) AS trust FROM tr)"


@query("A14_trust_beta", f"WITH {SQL_TRUST} SELECT agent_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, evidence, round(trust, 6) AS trust FROM trust")
def a14_trust_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust(views.signals(spark, sf_dir)).select("agent_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "evidence", F.round("trust", 6).alias("trust"))


@query(
    "A15_trust_decay",
    f"WITH {SQL_TRUST}, d AS (SELECT *, greatest(0, 1 - 0.05 * greatest(0, date_diff('day', last, TIMESTAMP '2002-01-01') - 30)) AS keep FROM trust) SELECT agent_id, round(1 + greatest(0.01, (alpha - 1) * keep), 6)::DOUBLE AS alpha, round(1 + greatest(0.01, (beta - 1) * keep), 6)::DOUBLE AS beta FROM d",
)
def a15_trust_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence above the prior shrinks by 5 % for each day beyond 30 idle ones."""
    idle = F.datediff(F.lit("2002-01-01").cast("date"), "last")
    keep = F.greatest(F.lit(0.0), 1 - 0.05 * F.greatest(F.lit(0), idle - 30))
    new = lambda c: F.round(1 + F.greatest(F.lit(0.01), (F.col(c) - 1) * keep), 6).alias(c)
    return trust(views.signals(spark, sf_dir)).select("agent_id", new("alpha"), new("beta"))


@query("A16_source_quality", "SELECT source, round((1.0 + sum(quality)) / (2 + count(*)), 6)::DOUBLE AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a16_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.read(spark, sf_dir, "documents").select("doc_id", "source").join(views.read(spark, sf_dir, "labels"), "doc_id")
    return rated.groupBy("source").agg(F.round((1.0 + F.sum("quality")) / (2 + count()), 6).alias("quality"), count().alias("n"))


@query(
    "A18_infer_outcome",
    "WITH v AS (SELECT query_id, sum(CASE signal WHEN 'store' THEN 1.0 WHEN 'recall' THEN 0.5 ELSE -2.0 END)::DOUBLE AS vote FROM signals GROUP BY query_id) SELECT query_id, CASE WHEN vote > 0.5 THEN 'success' WHEN vote < -0.5 THEN 'failure' ELSE 'partial' END AS outcome FROM v",
)
def a18_infer_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.sum(F.when(F.col("signal") == "store", 1.0).when(F.col("signal") == "recall", 0.5).otherwise(-2.0))
    voted = views.signals(spark, sf_dir).groupBy("query_id").agg(vote.alias("vote"))
    return voted.select("query_id", F.when(F.col("vote") > 0.5, "success").when(F.col("vote") < -0.5, "failure").otherwise("partial").alias("outcome"))


def _label(cite, edit, dwell_ms, requery):
    """0.5, 0.4 for a citation, 0.25 for an edit, up to 0.15 for dwelling over 2 s, less 0.5 for asking again."""
    dwell = F.when(dwell_ms >= 2000, F.least(F.lit(0.15), 0.05 + (dwell_ms - 2000) / 80000)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.4 * cite.cast("int") + 0.25 * edit.cast("int") + dwell - 0.5 * requery.cast("int")))


SQL_LABEL = """least(1::DOUBLE, greatest(0::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * (event_type = 'purchase')::INT + 0.25::DOUBLE * (event_type = 'click')::INT
    + CASE WHEN floor(value * 20) >= 2000 THEN least(0.15::DOUBLE, 0.05::DOUBLE + (floor(value * 20) - 2000) / 80000::DOUBLE) ELSE 0::DOUBLE END
    - 0.5::DOUBLE * (event_type = 'error')::INT))"""


@query("A19_reward_label", f"SELECT event_id, {SQL_LABEL} AS reward FROM access")
def a19_reward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwell in whole milliseconds; rewards are multiples of 1 / 80000 and so are not rounded."""
    kind = F.col("event_type")
    label = _label(kind == "purchase", kind == "click", F.floor(F.col("value") * 20).cast("double"), kind == "error")
    return views.access(spark, sf_dir).select("event_id", label.alias("reward"))


@query(
    "A20_fact_reward_stats",
    """WITH s AS (SELECT fact_id, count(*) AS n, sum(CAST(reward AS DECIMAL(18, 12)))::DOUBLE AS total FROM outcomes GROUP BY fact_id),
    m AS (SELECT fact_id, n, total / n AS mean FROM s)
    SELECT fact_id, n, mean, CASE WHEN n >= 3 AND mean > 0.5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM m WHERE mean >= 0.4""",
)
def a20_fact_reward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards are summed as decimals, so the mean does not depend on the order of rows."""
    total = F.sum(F.col("reward").cast("decimal(18, 12)")).cast("double")
    stats = views.outcomes(spark, sf_dir).groupBy("fact_id").agg(count().alias("n"), total.alias("total"))
    stats = stats.select("fact_id", "n", (F.col("total") / F.col("n")).alias("mean")).where("mean >= 0.4")
    return stats.withColumn("boost", F.when((F.col("n") >= 3) & (F.col("mean") > 0.5), 0.1).otherwise(0.0))


@query(
    "A21_engagement",
    """WITH s AS (SELECT fact_id, count(*) AS n, count(DISTINCT date_trunc('day', accessed_at)) AS days FROM access GROUP BY fact_id)
    SELECT fact_id, n, days, round(n / (n + 20.0), 6)::DOUBLE AS score, CASE WHEN n >= 70 THEN 'healthy' WHEN n >= 50 THEN 'warning' ELSE 'idle' END AS health FROM s""",
)
def a21_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = views.access(spark, sf_dir).groupBy("fact_id").agg(count().alias("n"), F.countDistinct(F.to_date("accessed_at")).alias("days"))
    return stats.select("fact_id", "n", "days", F.round(F.col("n") / (F.col("n") + 20.0), 6).alias("score"), F.when(F.col("n") >= 70, "healthy").when(F.col("n") >= 50, "warning").otherwise("idle").alias("health"))


@query("A22_feedback_summary", "SELECT signal, count(*) AS n, max(seen_at) AS latest FROM signals GROUP BY signal")
def a22_feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.signals(spark, sf_dir).groupBy("signal").agg(count().alias("n"), F.max("seen_at").alias("latest"))


@query(
    "A24_bandit_posterior",
    "SELECT fact_id % 5 AS stratum, event_type AS arm, round(least(1000, 1 + sum(value / 500)), 6) AS alpha, round(least(1000, 1 + sum(1 - value / 500)), 6) AS beta, count(*) AS plays FROM access GROUP BY ALL",
)
def a24_bandit_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments are not negative, so one cap at the end equals a cap after each play."""
    r = F.col("value") / 500
    cap = lambda x: F.round(F.least(F.lit(1000.0), 1 + F.sum(x)), 6)
    return views.access(spark, sf_dir).groupBy((F.col("fact_id") % 5).alias("stratum"), F.col("event_type").alias("arm")).agg(cap(r).alias("alpha"), cap(1 - r).alias("beta"), count().alias("plays"))


@query(
    "A26_proxy_reward",
    """WITH p AS (SELECT event_id, fact_id, accessed_at FROM access WHERE event_type = 'view'), h AS (SELECT p.event_id, bool_or(e.event_type IN ('click', 'purchase')) AS used, bool_or(e.event_type = 'view') AS again
      FROM p JOIN access e ON e.fact_id = p.fact_id AND e.accessed_at > p.accessed_at AND e.accessed_at <= p.accessed_at + INTERVAL 6 HOUR GROUP BY p.event_id)
    SELECT p.event_id, CASE WHEN used THEN 1.0::DOUBLE WHEN again THEN 0.0 ELSE 0.5 END AS reward FROM p LEFT JOIN h USING (event_id)""",
)
def a26_proxy_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A play is worth 1 if its fact is used within six hours, 0 if it is only asked for again, else 0.5: one window by time."""
    events = views.access(spark, sf_dir).withColumn("t", F.unix_micros(F.col("accessed_at").cast("timestamp")))
    after = W.partitionBy("fact_id").orderBy("t").rangeBetween(1, 6 * 3600 * 1_000_000)
    seen = events.select("event_id", "event_type", F.bool_or(F.col("event_type").isin("click", "purchase")).over(after).alias("used"), F.bool_or(F.col("event_type") == "view").over(after).alias("again"))
    return seen.where("event_type = 'view'").select("event_id", F.when(F.col("used"), 1.0).when(F.col("again"), 0.0).otherwise(0.5).alias("reward"))


@query("A27_retention_sweep", f"SELECT event_id FROM access WHERE accessed_at >= TIMESTAMP '{views.NOW}' - INTERVAL 7 DAY")
def a27_retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.access(spark, sf_dir).where(F.col("accessed_at") >= views.now() - F.expr("INTERVAL 7 DAYS")).select("event_id")


def relevance(reward: Column, place: Column) -> Column:
    """0 to 4 by the reward of an outcome, or by the place at which a fact was shown (from 0) where there is none."""
    by_reward = F.when(reward >= 0.9, 4).when(reward >= 0.6, 3).when(reward >= 0.3, 2).when(reward > 0, 1).otherwise(0)
    by_place = F.when(place == 0, 4).when(place <= 2, 3).when(place <= 4, 2).when(place <= 9, 1).otherwise(0)
    return F.when(reward.isNotNull() & ~F.isnan(reward), by_reward).otherwise(by_place)


@query(
    "A28_position_label",
    """SELECT s.query_id, position, s.fact_id, (CASE WHEN reward >= 0.9 THEN 4 WHEN reward >= 0.6 THEN 3 WHEN reward >= 0.3 THEN 2 WHEN reward > 0 THEN 1 WHEN reward IS NOT NULL THEN 0
      WHEN position <= 1 THEN 4 WHEN position <= 3 THEN 3 WHEN position <= 5 THEN 2 WHEN position <= 10 THEN 1 ELSE 0 END)::INT AS relevance
    FROM signals s LEFT JOIN (SELECT outcome_id, fact_id, reward FROM outcomes WHERE status = 'F') o ON o.outcome_id = s.query_id AND o.fact_id = s.fact_id""",
)
def a28_position_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of what queries were shown; finished orders have a reward. Positions count from 1 here."""
    settled = views.outcomes(spark, sf_dir).where("status = 'F'").select(F.col("outcome_id").alias("query_id"), "fact_id", "reward")
    shown = views.signals(spark, sf_dir).select("query_id", "position", "fact_id").join(settled, ["query_id", "fact_id"], "left")
    return shown.select("query_id", "position", "fact_id", relevance(F.col("reward"), F.col("position") - 1).alias("relevance"))


@query(
    "A29_mrr_recall_at_k",
    """WITH r AS (SELECT query_id, position, fact_id % 3 = 0 AS good FROM signals), q AS (SELECT query_id, coalesce(1.0 / min(position) FILTER (good), 0) AS rr, count(*) FILTER (good) AS hits, count(*) AS n FROM r GROUP BY query_id)
    SELECT n, count(*) AS queries, round(avg(rr), 6)::DOUBLE AS mrr, round(avg(least(1, hits)), 6) AS recall FROM q GROUP BY n""",
)
def a29_mrr_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("fact_id") % 3 == 0
    by_query = views.signals(spark, sf_dir).groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(good, F.col("position"))), F.lit(0.0)).alias("rr"), F.count_if(good).alias("hits"), count().alias("n"))
    return by_query.groupBy("n").agg(count().alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.least(F.lit(1), "hits")), 6).alias("recall"))


@query(
    "A30_shadow_test",
    """WITH p AS (SELECT fact_id, avg(reward) FILTER (status = 'F') - avg(reward) FILTER (status = 'O') AS d FROM outcomes GROUP BY fact_id), s AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM p)
    SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / (sd / sqrt(n)), 4) AS t, n >= 100 AND mean > 0.02 AND mean / (sd / sqrt(n)) > 1.65 AS promote FROM s""",
)
def a30_shadow_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences of two arms on the same facts: mean, deviation, t and the decision."""
    arm = lambda s: F.avg(F.when(F.col("status") == s, F.col("reward")))
    stats = views.outcomes(spark, sf_dir).groupBy("fact_id").agg((arm("F") - arm("O")).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.col("m") / (F.col("s") / F.sqrt("n"))
    return stats.select("n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(t, 4).alias("t"), ((F.col("n") >= 100) & (F.col("m") > 0.02) & (t > 1.65)).alias("promote"))


@query(
    "A32_community_labels",
    f"""WITH w AS (SELECT session_id, word, count(*) AS tf FROM (SELECT session_id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word FROM facts) WHERE length(word) >= 4 AND NOT list_contains({sql_list(fixed.STOP_WORDS)}, word) GROUP BY ALL),
    d AS (SELECT word, count(*) AS df FROM w GROUP BY word), c AS (SELECT count(DISTINCT session_id) AS c FROM w), s AS (SELECT session_id, word, tf * ln(1 + c / (1.0 + df)) AS score FROM w JOIN d USING (word) CROSS JOIN c),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 6) DESC, word) AS rank FROM s) SELECT session_id, word, rank FROM r WHERE rank <= 3""",
)
def a32_community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three words of most tf * ln(1 + C / (1 + df)) of each community."""
    found = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))
    each = views.facts(spark, sf_dir).select("session_id", F.explode(found).alias("word")).where((F.length("word") >= 4) & ~F.col("word").isin(fixed.STOP_WORDS))
    tf = each.groupBy("session_id", "word").agg(count().alias("tf"))
    df = tf.groupBy("word").agg(count().alias("df"))
    c = tf.agg(F.countDistinct("session_id").alias("c"))
    scored = tf.join(df, "word").crossJoin(F.broadcast(c)).withColumn("score", F.col("tf") * F.log(1 + F.col("c") / (1.0 + F.col("df"))))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.round("score", 6).desc(), "word")).cast("long")
    return scored.withColumn("rank", rank).where("rank <= 3").select("session_id", "word", "rank")


@query(
    "A34_entity_profiles",
    "WITH r AS (SELECT l_partkey AS entity_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT entity_id, string_agg(l_orderkey || '-' || l_linenumber, ' | ' ORDER BY n) AS profile FROM r WHERE n <= 10 GROUP BY entity_id",
)
def a34_entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest facts of each entity in one text; only they are gathered."""
    order = W.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    last = views.read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber").withColumn("n", F.row_number().over(order)).where("n <= 10")
    got = last.groupBy(F.col("l_partkey").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("t")))).alias("x"))
    return got.select("entity_id", F.array_join(F.transform("x", lambda s: s["t"]), " | ").alias("profile"))


@query("A37_event_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def a37_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "events").groupBy("event_type").agg(count().alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("A38_trust_report", f"WITH {SQL_TRUST}, k AS (SELECT agent_id, signal, count(*) AS n FROM signals GROUP BY ALL) SELECT agent_id, signal, n, round(trust, 6) AS trust FROM k JOIN trust USING (agent_id)")
def a38_trust_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = views.signals(spark, sf_dir)
    kinds = signals.groupBy("agent_id", "signal").agg(count().alias("n"))
    return kinds.join(trust(signals).select("agent_id", F.round("trust", 6).alias("trust")), "agent_id")


@query("A40_retention_rules", f"SELECT fact_id FROM facts WHERE created_at < TIMESTAMP '{views.NOW}' - to_days((CASE profile_id WHEN 'en' THEN 20 WHEN 'de' THEN 10 ELSE 25 END)::INT)")
def a40_retention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts older than the strictest rule of their profile."""
    rules = spark.createDataFrame([("en", 20), ("en", 30), ("de", 10), ("fr", 25), ("es", 25)], "profile_id string, days int").groupBy("profile_id").agg(F.min("days").alias("days"))
    age = views.facts(spark, sf_dir).join(F.broadcast(rules), "profile_id")
    return age.where(F.col("created_at") < F.expr(f"TIMESTAMP '{views.NOW}' - make_interval(0, 0, 0, days)")).select("fact_id")


@query("A42_abac_filter", "SELECT event_id FROM access WHERE NOT ((fact_id = 3 AND event_type = 'click') OR (fact_id = 5 AND event_type = 'view'))")
def a42_abac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a policy that denies their exact pair."""
    denied = spark.createDataFrame([(3, "click"), (5, "view")], "fact_id long, event_type string")
    return views.access(spark, sf_dir).join(F.broadcast(denied), ["fact_id", "event_type"], "left_anti").select("event_id")


@query("A43_usage_mix", "WITH m AS (SELECT event_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY event_type), 1)::DOUBLE AS share FROM m")
def a43_usage_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = views.read(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(count().alias("n"))
    return mix.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("event_type")), 1))


@query(
    "A44_daily_series",
    "WITH d AS (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT accessed_at::DATE AS day, count(*) AS n FROM access GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day)",
)
def a44_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE '2023-12-20', DATE '2024-02-01')")).alias("day"))
    counted = views.access(spark, sf_dir).groupBy(F.to_date("accessed_at").alias("day")).agg(count().alias("n"))
    return days.join(counted, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("A48_zone_distribution", "SELECT lifecycle, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM facts GROUP BY lifecycle")
def a48_zone_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = views.facts(spark, sf_dir).groupBy("lifecycle").agg(count().alias("n"))
    return zones.crossJoin(F.broadcast(zones.agg(F.sum("n").alias("all")))).select("lifecycle", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("share"))


@query("A49_trust_alerts", f"WITH {SQL_TRUST} SELECT agent_id, round(trust, 6) AS trust FROM trust WHERE trust < 0.55")
def a49_trust_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust(views.signals(spark, sf_dir)).where("trust < 0.55").select("agent_id", F.round("trust", 6).alias("trust"))


@query("A50_cost_summary", "SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS calls, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY ALL")
def a50_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status")).agg(count().alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
