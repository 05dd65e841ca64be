"""Forgetting, tiers and precision: formulas over fact rows joined with their access statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.registry import query


def strength(accesses: Column, importance: Column, confirmations: Column, emotion: Column) -> Column:
    """2 ln(1 + accesses) + 1.5 importance + confirmations + 0.5 emotion, within 0.1 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.1), 2 * F.log1p(accesses) + 1.5 * importance + 1.0 * confirmations + 0.5 * emotion))


def zone(retention: Column) -> Column:
    return F.when(retention > 0.8, "active").when(retention > 0.5, "warm").when(retention > 0.2, "cold").when(retention > 0.05, "archive").otherwise("forgotten")


def retention(facts: DataFrame, access: DataFrame, now: Column) -> DataFrame:
    """fact_id, strength, retention, zone from the hours since the last access (creation, if there was none)."""
    used = access.groupBy("fact_id").agg(F.count("*").alias("n"), F.max("accessed_at").cast("timestamp").alias("last"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last", "created_at"))) / 3600
    joined = facts.join(used, "fact_id", "left").withColumn("hours", hours)
    joined = joined.withColumn("strength", strength(F.coalesce("n", F.lit(0)), F.col("importance"), F.col("evidence_count"), F.lit(0.0)))
    kept = F.exp(-F.col("hours") * (1 + 2 * (1 - F.col("confidence"))) / (24 * F.col("strength")))
    return joined.withColumn("retention", kept).withColumn("zone", zone(F.col("retention")))


SQL_RETENTION = f"""u AS (SELECT fact_id, count(*) AS n, max(accessed_at) AS last FROM access GROUP BY fact_id),
    h AS (SELECT f.*, coalesce(n, 0) AS n, date_diff('second', coalesce(last, created_at), TIMESTAMP '{views.NOW}') / 3600.0::DOUBLE AS hours FROM facts f LEFT JOIN u ON u.fact_id = f.fact_id),
    st AS (SELECT *, least(100.0, greatest(0.1, 2 * ln(1 + n) + 1.5 * importance + evidence_count)) AS strength FROM h),
    rt AS (SELECT *, exp(-hours * (1 + 2 * (1 - confidence)) / (24 * strength)) AS retention FROM st),
    ret AS (SELECT *, CASE WHEN retention > 0.8 THEN 'active' WHEN retention > 0.5 THEN 'warm' WHEN retention > 0.2 THEN 'cold' WHEN retention > 0.05 THEN 'archive' ELSE 'forgotten' END AS zone FROM rt)"""


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(views.facts(spark, sf_dir), views.access(spark, sf_dir), views.now())


@query("Y1_retention", f"WITH {SQL_RETENTION} SELECT fact_id, round(strength, 6)::DOUBLE AS strength, round(retention, 6)::DOUBLE AS retention, zone FROM ret")
def y1_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir).select("fact_id", F.round("strength", 6).alias("strength"), F.round("retention", 6).alias("retention"), "zone")


@query("Y2_decay_cycle", f"WITH {SQL_RETENTION} SELECT lifecycle AS before, zone AS after, count(*) AS n, count(*) FILTER (zone = 'forgotten' AND NOT pinned) AS deleted FROM ret GROUP BY ALL")
def y2_decay_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between zones, and how many facts are forgotten and not pinned."""
    gone = F.count_if((F.col("zone") == "forgotten") & ~F.col("pinned"))
    return _retention(spark, sf_dir).groupBy(F.col("lifecycle").alias("before"), F.col("zone").alias("after")).agg(F.count("*").alias("n"), gone.alias("deleted"))


@query(
    "Y3_spaced_repetition",
    "WITH g AS (SELECT fact_id, date_diff('second', lag(accessed_at) OVER (PARTITION BY fact_id ORDER BY accessed_at, event_id), accessed_at) / 3600.0::DOUBLE AS gap FROM access) SELECT fact_id, round(least(100.0, 1 + sum(coalesce(ln(1 + gap / 24), 0))), 6)::DOUBLE AS strength FROM g GROUP BY fact_id",
)
def y3_spaced_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength grows by ln(1 + hours / 24) with each gap between accesses; one cap at the end, as no increment is negative."""
    t = F.unix_timestamp(F.date_trunc("second", F.col("accessed_at")).cast("timestamp"))
    gap = (t - F.lag(t).over(W.partitionBy("fact_id").orderBy("accessed_at", "event_id"))) / 3600
    gaps = views.access(spark, sf_dir).select("fact_id", gap.alias("gap"))
    return gaps.groupBy("fact_id").agg(F.round(F.least(F.lit(100.0), 1 + F.sum(F.coalesce(F.log1p(F.col("gap") / 24), F.lit(0.0)))), 6).alias("strength"))


@query(
    "Y4_confidence_boost_decay",
    f"WITH {SQL_RETENTION} SELECT fact_id, round(CASE WHEN n > 0 THEN least(1.0, confidence + 0.02 * n) WHEN hours > 168 THEN greatest(0.1, confidence - 0.001) ELSE confidence END, 6)::DOUBLE AS confidence FROM ret",
)
def y4_confidence_boost_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col("confidence"), F.coalesce("n", F.lit(0))
    new = F.when(n > 0, F.least(F.lit(1.0), c + 0.02 * n)).when(F.col("hours") > 168, F.greatest(F.lit(0.1), c - 0.001)).otherwise(c)
    return _retention(spark, sf_dir).select("fact_id", F.round(new, 6).alias("confidence"))


_DAYS = f"date_diff('day', created_at, TIMESTAMP '{views.NOW}')"
_STRETCH = "(CASE WHEN importance >= 0.8 THEN 3 WHEN access_count >= 5 THEN 2 ELSE 1 END)"


@query("Y5_tier_demotion", f"SELECT fact_id, CASE WHEN pinned THEN 'active' WHEN {_DAYS} >= 28 * {_STRETCH} THEN 'archived' WHEN {_DAYS} >= 14 * {_STRETCH} THEN 'cold' WHEN {_DAYS} >= 7 * {_STRETCH} THEN 'warm' ELSE 'active' END AS tier FROM facts")
def y5_tier_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier by idle days, limits stretched by use and importance; pinned facts stay. Limits here: 7, 14 and 28 days."""
    idle = F.datediff(views.now(), "created_at")
    stretch = F.when(F.col("importance") >= 0.8, 3).when(F.col("access_count") >= 5, 2).otherwise(1)
    tier = F.when(F.col("pinned"), "active").when(idle >= 28 * stretch, "archived").when(idle >= 14 * stretch, "cold").when(idle >= 7 * stretch, "warm").otherwise("active")
    return views.facts(spark, sf_dir).select("fact_id", tier.alias("tier"))


@query("Y6_tier_promote", "SELECT fact_id FROM facts WHERE lifecycle <> 'active' AND fact_id IN (SELECT fact_id FROM access)")
def y6_tier_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).where("lifecycle <> 'active'").join(views.access(spark, sf_dir), "fact_id", "left_semi").select("fact_id")


@query("Y7_time_lifecycle", f"SELECT fact_id, CASE WHEN access_count > 10 OR {_DAYS} < 7 THEN 'active' WHEN {_DAYS} < 30 THEN 'warm' WHEN {_DAYS} < 90 THEN 'cold' ELSE 'archived' END AS state FROM facts")
def y7_time_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(views.now(), "created_at")
    state = F.when((F.col("access_count") > 10) | (age < 7), "active").when(age < 30, "warm").when(age < 90, "cold").otherwise("archived")
    return views.facts(spark, sf_dir).select("fact_id", state.alias("state"))


@query("Y10_precision_from_retention", f"WITH {SQL_RETENTION} SELECT fact_id, (CASE WHEN retention > 0.8 THEN 32 WHEN retention > 0.5 THEN 8 WHEN retention > 0.2 THEN 4 WHEN retention > 0.05 THEN 2 ELSE 0 END)::INT AS bits FROM ret")
def y10_precision_from_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("retention")
    return _retention(spark, sf_dir).select("fact_id", F.when(r > 0.8, 32).when(r > 0.5, 8).when(r > 0.2, 4).when(r > 0.05, 2).otherwise(0).alias("bits"))


@query("Y13_promote_facts", "SELECT fact_id, count(*) AS accesses FROM access JOIN facts USING (fact_id) WHERE confidence >= 0.5 GROUP BY fact_id HAVING count(*) >= 3")
def y13_promote_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    able = views.facts(spark, sf_dir).where("confidence >= 0.5").select("fact_id")
    return views.access(spark, sf_dir).groupBy("fact_id").agg(F.count("*").alias("accesses")).where("accesses >= 3").join(able, "fact_id")


@query(
    "Y14_prompt_lifecycle",
    f"""WITH s AS (SELECT user_id AS prompt_id, count(*) FILTER (event_type = 'click') AS pos, count(*) FILTER (event_type = 'error') AS neg, date_diff('second', max(ts), TIMESTAMP '{views.NOW}') / 3600.0::DOUBLE AS h FROM events GROUP BY user_id),
    e AS (SELECT *, 0.7 * pos / (pos + neg + 1) + 0.3 * 0.5 AS eff FROM s) SELECT prompt_id, round(eff, 6)::DOUBLE AS effectiveness, round(exp(-h / greatest(24, 2 * eff * 100)), 6)::DOUBLE AS retention FROM e""",
)
def y14_prompt_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stats = views.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("prompt_id")).agg(F.count_if(kind == "click").alias("pos"), F.count_if(kind == "error").alias("neg"), F.max("ts").cast("timestamp").alias("last"))
    h = (F.unix_timestamp(views.now()) - F.unix_timestamp("last")) / 3600
    eff = 0.7 * F.col("pos") / (F.col("pos") + F.col("neg") + 1) + 0.3 * 0.5
    return stats.select("prompt_id", F.round(eff, 6).alias("effectiveness"), F.round(F.exp(-h / F.greatest(F.lit(24.0), 2 * eff * 100)), 6).alias("retention"))


@query("Y15_event_tiering", f"SELECT event_id, CASE WHEN ts >= TIMESTAMP '{views.NOW}' - INTERVAL 7 DAY OR value >= 400 THEN 'hot' ELSE 'warm' END AS tier FROM events WHERE ts >= TIMESTAMP '{views.NOW}' - INTERVAL 20 DAY")
def y15_event_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda d: F.col("ts") >= views.now() - F.expr(f"INTERVAL {d} DAYS")
    return views.read(spark, sf_dir, "events").where(since(20)).select("event_id", F.when(since(7) | (F.col("value") >= 400), "hot").otherwise("warm").alias("tier"))
