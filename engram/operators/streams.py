"""Operators on event streams. Each takes a streaming or a batch table, so its batch form is its own test oracle.

Late rows are dropped behind a watermark in the streaming form; the batch form sees all rows. Sinks are idempotent:
`foreachBatch` writers overwrite by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.operators.codegraph import SQL_MATCH, code, match_mentions
from engram.operators.reports import _label
from engram.operators.sinks import MergedTable
from engram.operators.tagging import code_mentions, remarks
from engram.operators.text import SQL_TOPIC, sql_list, topic_signature
from engram.registry import query


def bursts(events: DataFrame, least: int = 20, length: str = "60 seconds", step: str = "10 seconds", late: str = "2 hours") -> DataFrame:
    """Windows in which one agent has `least` events or more."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "agent").agg(F.count("*").alias("n"))
    return windows.where(F.col("n") >= least).select("agent", F.col("w.start").alias("start"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("agent"), "event_type", "value")


@query(
    "T1_stream_burst",
    """WITH w AS (SELECT user_id AS agent, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT agent, start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3""",
)
def t1_stream_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events are hours apart: here three in an hour."""
    return bursts(_events(spark, sf_dir), 3, "1 hour", "30 minutes")


def access_counts(events: DataFrame) -> DataFrame:
    """Count and last access of each fact."""
    return events.groupBy("agent").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def merge_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("agent").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def keep_access_counts(events: DataFrame, path: str, checkpoint: str):
    """Merges the counts of each batch into the table at `path`; the stream itself holds no state, however many facts there
    are and however long it runs."""
    table = MergedTable(events.sparkSession, path, merge_counts)
    counted = lambda batch, number: table.put(access_counts(batch), number)
    return events.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("T2_stream_access_counts", "SELECT user_id AS agent, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def t2_stream_access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_counts(_events(spark, sf_dir))


def ingest_once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; a stream forgets ids older than the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


@query("T3_stream_ingest_dedup", "SELECT DISTINCT event_id, ts, event_type FROM events")
def t3_stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_once(_events(spark, sf_dir)).select("event_id", "ts", "event_type")


class Gate:
    """The last `keep` vectors that passed, in one array."""

    def __init__(self, keep: int, held: list | None = None):
        self.held = np.array(held, dtype=float) if held is not None and len(held) else None
        self.keep = keep

    def run(self, vectors, above: float) -> list[bool]:
        out = []
        for vec in vectors:
            v = np.asarray(vec, dtype=float)
            v = v / (np.linalg.norm(v) or 1.0)
            ok = self.held is None or float((self.held @ v).max()) <= above
            if ok:
                self.held = v[None, :] if self.held is None else np.concatenate((self.held, v[None, :]))[-self.keep :]
            out.append(ok)
        return out


def near_dup_gate(items: DataFrame, above: float = 0.95, keep: int = 50) -> DataFrame:
    """items: (profile, id, vec), a stream. (profile, id, passes): an item passes unless its cosine to one of the last
    `keep` passed items of its profile is over `above`. State: those vectors."""

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Gate(keep, [np.array(v) for v in state.get[0]] if state.exists else None)
        for rows in batches:
            yield pd.DataFrame({"profile": key[0], "id": rows["id"], "passes": held.run(rows["vec"], above)})
        state.update(([] if held.held is None else held.held.tolist(),))

    return items.groupBy("profile").applyInPandasWithState(gate, "profile long, id long, passes boolean", "held array<array<double>>", "append", "NoTimeout")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts, 40 seconds apart within a session but for every fifth, which comes five minutes later."""
    t = views.turns(spark, sf_dir)
    at = F.lit(views.EPOCH) + F.col("session_id") * 3600 + F.col("turn") * 40 + F.floor(F.col("turn") / 5) * 300
    return t.select("session_id", F.col("turn").cast("long").alias("turn"), "content", F.timestamp_seconds(at).alias("ts"))


_SQL_PROMPTS = f"pr AS (SELECT session_id, turn, content, {views.EPOCH} + session_id * 3600 + turn * 40 + (turn // 5) * 300 AS tm FROM turns)"


def requery(prompts: DataFrame, within: int = 60) -> DataFrame:
    """(session_id, turn, again): the topic signature of the session's prompt before, at most `within` seconds ago.

    A stream keeps the last signature of each session for an hour; a batch looks at the row before.
    """
    signed = prompts.select("session_id", "turn", "ts", topic_signature(F.col("content")).alias("sig"))
    if not prompts.isStreaming:
        w = W.partitionBy("session_id").orderBy("ts", "turn")
        near = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) <= within
        return signed.select("session_id", "turn", F.coalesce((F.col("sig") == F.lag("sig").over(w)) & near, F.lit(False)).alias("again"))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "turn"])
        out = []
        for turn, ts, sig in zip(rows["turn"], rows["ts"], rows["sig"], strict=True):
            now = int(ts.timestamp())
            out.append((key[0], turn, last == sig and now - at <= within))
            last, at = sig, now
        state.update((last, at))
        state.setTimeoutTimestamp(max(at * 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "turn", "again"])

    late = signed.withWatermark("ts", "10 minutes")
    return late.groupBy("session_id").applyInPandasWithState(follow, "session_id long, turn long, again boolean", "sig string, at long", "append", "EventTimeTimeout")


@query(
    "T6_stream_requery",
    f"WITH {_SQL_PROMPTS}, s AS (SELECT session_id, turn, tm, {SQL_TOPIC.format('content')} AS sig FROM pr), p AS (SELECT *, lag(sig) OVER w AS before, lag(tm) OVER w AS b FROM s WINDOW w AS (PARTITION BY session_id ORDER BY tm, turn)) SELECT session_id, turn, coalesce(sig = before AND tm - b <= 60, false) AS again FROM p",
)
def t6_stream_requery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requery(_prompts(spark, sf_dir))


def topic_shifts(prompts: DataFrame, back: int = 5, least_words: int = 5, least_prior: int = 2) -> DataFrame:
    """(session_id, turn, shift): a prompt of five content words or more that shares none with any of the last five prompts of
    its session, if there are two. A stream keeps the last five word sets of a session for 24 hours."""
    worded = prompts.select("session_id", "turn", "ts", content_words(F.col("content")).alias("w"))
    if not prompts.isStreaming:
        before = F.collect_list("w").over(W.partitionBy("session_id").orderBy("ts", "turn").rowsBetween(-back, -1))
        overlap = F.coalesce(F.array_max(F.transform("before", lambda x: F.size(F.array_intersect(x, F.col("w"))))), F.lit(0))
        shift = (F.size("w") >= least_words) & (F.size("before") >= least_prior) & (overlap == 0)
        return worded.withColumn("before", before).select("session_id", "turn", shift.alias("shift"))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [list(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "turn"])
        out = []
        for turn, found in zip(rows["turn"], rows["w"], strict=True):
            mine = set(found)
            out.append((key[0], turn, len(mine) >= least_words and len(held) >= least_prior and not any(mine & set(x) for x in held)))
            held = [*held, sorted(mine)][-back:]
        state.update((held,))
        last = int(rows["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "turn", "shift"])

    late = worded.withWatermark("ts", "10 minutes")
    return late.groupBy("session_id").applyInPandasWithState(follow, "session_id long, turn long, shift boolean", "held array<array<string>>", "append", "EventTimeTimeout")


def content_words(text):
    """Distinct words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(fixed.STOP_WORDS)))


_SQL_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z]{3,}'), lambda w: NOT list_contains(" + sql_list(fixed.STOP_WORDS) + ", w)))"


@query(
    "T7_stream_topic_shift",
    f"""WITH {_SQL_PROMPTS}, s AS (SELECT session_id, turn, {_SQL_CONTENT} AS w, row_number() OVER (PARTITION BY session_id ORDER BY tm, turn) AS i FROM pr),
    o AS (SELECT a.session_id, a.turn, a.w, count(b.i) AS n, coalesce(max(len(list_intersect(a.w, b.w))), 0) AS overlap FROM s a LEFT JOIN s b ON b.session_id = a.session_id AND b.i BETWEEN a.i - 5 AND a.i - 1 GROUP BY a.session_id, a.turn, a.w)
    SELECT session_id, turn, len(w) >= 5 AND n >= 2 AND overlap = 0 AS shift FROM o""",
)
def t7_stream_topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_shifts(_prompts(spark, sf_dir))


def settled(events: DataFrame, grace: int = 60, force: int = 3_600) -> DataFrame:
    """(outcome_id, agent, signals, reward): the outcome of every view of an agent.

    Signals of the agent attach while each comes at most `grace` seconds after the one before (or after the view), and at
    most `force` seconds after the view: a click is a citation, a purchase an edit, an error a new query, the largest
    value a dwell time. A stream holds open outcomes of each agent and closes them by event time; late events are dropped.
    """
    if not events.isStreaming:
        e = events.select("event_id", "agent", F.unix_micros("ts").alias("at"), "event_type", "value")
        opened = e.where("event_type = 'view'").select(F.col("event_id").alias("outcome_id"), "agent", F.col("at").alias("opened"))
        near = F.expr(f"o.agent = s.agent AND s.at > o.opened AND s.at <= o.opened + {force} * 1000000L")
        met = opened.alias("o").join(e.where("event_type <> 'view'").alias("s"), near, "left").select("outcome_id", "o.agent", "opened", "at", "event_type", "value")
        w = W.partitionBy("outcome_id").orderBy("at")
        met = met.withColumn("gap", F.col("at") - F.coalesce(F.lag("at").over(w), F.col("opened")))
        on = F.coalesce(F.max("gap").over(w.rowsBetween(W.unboundedPreceding, 0)) <= grace * 1_000_000, F.lit(False))
        kind = lambda k: F.max(F.when(on_ & (F.col("event_type") == k), 1).otherwise(0))
        met, on_ = met.withColumn("on", on), F.col("on")
        got = met.groupBy("outcome_id", "agent").agg(F.count_if("on").alias("signals"), kind("click").alias("cite"), kind("purchase").alias("edit"), kind("error").alias("again"), F.max(F.when(on_, F.col("value"))).alias("dwell"))
        reward = _label(F.col("cite"), F.col("edit"), F.floor(F.coalesce("dwell", F.lit(0.0)) * 20).cast("double"), F.col("again"))
        return got.select("outcome_id", "agent", "signals", reward.alias("reward"))

    def reward_of(o: list) -> float:
        ms = float(np.floor(o[7] * 20))
        dwell = min(0.15, 0.05 + (ms - 2000) / 80000) if ms >= 2000 else 0.0
        return min(1.0, max(0.0, 0.5 + 0.4 * o[4] + 0.25 * o[5] + dwell - 0.5 * o[6]))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # [outcome, opened, last, signals, cite, edit, again, dwell], times in microseconds
        held = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        done = []

        def close(now: int) -> None:
            nonlocal held
            over = lambda o: now > o[2] + grace * 1_000_000 or now > o[1] + force * 1_000_000
            done.extend(o for o in held if over(o))
            held = [o for o in held if not over(o)]

        if state.hasTimedOut:
            close(state.getCurrentWatermarkMs() * 1000)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for event, ts, kind, value in zip(rows["event_id"], rows["ts"], rows["event_type"], rows["value"], strict=True):
                now = ts.value // 1000
                close(now)
                for o in held if kind != "view" else []:
                    if now > o[1]:
                        o[2], o[3], o[7] = now, o[3] + 1, max(o[7], float(value))
                        o[4], o[5], o[6] = o[4] or kind == "click", o[5] or kind == "purchase", o[6] or kind == "error"
                if kind == "view":
                    held.append([event, now, now, 0, False, False, False, 0.0])
        if held:
            state.update(tuple([o[i] for o in held] for i in range(8)))
            ends = min(min(o[2] + grace * 1_000_000, o[1] + force * 1_000_000) for o in held) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(o[0], key[0], o[3], reward_of(o)) for o in done], columns=["outcome_id", "agent", "signals", "reward"])

    kept = "id array<long>, opened array<long>, last array<long>, n array<long>, cite array<boolean>, edit array<boolean>, again array<boolean>, dwell array<double>"
    late = events.withWatermark("ts", "10 minutes")
    return late.groupBy("agent").applyInPandasWithState(follow, "outcome_id long, agent long, signals long, reward double", kept, "append", "EventTimeTimeout")


@query(
    "T5_stream_outcome_settle",
    """WITH o AS (SELECT event_id AS outcome_id, user_id AS agent, epoch_us(ts) AS opened FROM events WHERE event_type = 'view'), s AS (SELECT user_id AS agent, epoch_us(ts) AS tm, event_type, value FROM events WHERE event_type <> 'view'),
    m AS (SELECT outcome_id, o.agent, opened, tm, event_type, value FROM o LEFT JOIN s ON o.agent = s.agent AND tm > opened AND tm <= opened + 86400000000), g AS (SELECT *, tm - coalesce(lag(tm) OVER (PARTITION BY outcome_id ORDER BY tm), opened) AS gap FROM m),
    h AS (SELECT *, coalesce(max(gap) OVER (PARTITION BY outcome_id ORDER BY tm ROWS UNBOUNDED PRECEDING) <= 21600000000, false) AS ok FROM g),
    a AS (SELECT outcome_id, agent, count(*) FILTER (ok) AS signals, coalesce(bool_or(ok AND event_type = 'click'), false)::INT AS cite, coalesce(bool_or(ok AND event_type = 'purchase'), false)::INT AS edit, coalesce(bool_or(ok AND event_type = 'error'), false)::INT AS again, floor(coalesce(max(value) FILTER (ok), 0) * 20) AS ms FROM h GROUP BY outcome_id, agent)
    SELECT outcome_id, agent, signals, least(1::DOUBLE, greatest(0::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * cite + 0.25::DOUBLE * edit + CASE WHEN ms >= 2000 THEN least(0.15::DOUBLE, 0.05::DOUBLE + (ms - 2000) / 80000::DOUBLE) ELSE 0::DOUBLE END - 0.5::DOUBLE * again)) AS reward FROM a""",
)
def t5_stream_outcome_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events are hours apart: here a grace of six hours and a day at most."""
    return settled(_events(spark, sf_dir), 6 * 3_600, 24 * 3_600)


def session_summary(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """One row for each session of an agent that a gap ends: number and value of its events, and its first five kinds."""
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent")
    got = sessions.agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    text = F.array_join(F.transform(F.slice("x", 1, 5), lambda z: z["event_type"]), " | ")
    return got.select("agent", F.col("w.start").alias("start"), "n", F.round("value", 4).alias("value"), text.alias("summary"))


@query(
    "T8_stream_session_summary",
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM s)
    SELECT user_id AS agent, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS value, string_agg(CASE WHEN i <= 5 THEN event_type END, ' | ' ORDER BY i) AS summary FROM r GROUP BY user_id, k""",
)
def t8_stream_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(_events(spark, sf_dir))


def event_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by type and hour."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("T9_stream_event_counts", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def t9_stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(_events(spark, sf_dir))


def once_each(keys: list[str], order: list[str]):
    """Keeps of rows of equal keys the one that comes last by `order`, whichever batches brought them."""

    def merge(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
        return rows.groupBy(*keys).agg(last).select("row.*")

    return merge


def drain(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str] | None = None):
    """Merges batches of signals into the table at `path`, each key once: a signal that comes again, in the same batch, in a
    later one or with a batch that is repeated, changes nothing. `MergedTable(...).read()` gives the table."""
    return MergedTable(stream.sparkSession, path, once_each(keys, order or stream.columns)).start(stream, checkpoint)


@query("T10_stream_signals", "SELECT query_id, fact_id, arg_max(signal, (seen_at, position, signal)) AS signal, count(*) AS n FROM signals GROUP BY query_id, fact_id")
def t10_stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `drain` leaves when its batches are read: the last signal of each (query, fact), however often it was written."""
    order = F.struct("seen_at", "position", "signal")
    return views.signals(spark, sf_dir).groupBy("query_id", "fact_id").agg(F.max_by("signal", order).alias("signal"), F.count("*").alias("n"))


def shown_flip(signals: DataFrame, flags: DataFrame, late: str = "2 hours", within: str = "1 hour") -> DataFrame:
    """(event_id, shown): the last flag of the agent within an hour after a signal, false without one.

    signals: (event_id, sa, st), flags: (fa, ft, flag). Both sides have a watermark, and the time bound of the join limits
    what a stream holds; a row comes when the watermark has passed its hour.
    """
    if signals.isStreaming:
        signals, flags = signals.withWatermark("st", late), flags.withWatermark("ft", late)
    met = signals.join(flags, F.expr(f"sa = fa AND ft > st AND ft <= st + INTERVAL {within}"), "left")
    return met.groupBy("event_id", "st").agg(F.coalesce(F.max_by("flag", "ft"), F.lit(False)).alias("shown")).select("event_id", "shown")


def signals_and_flags(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = e.where("event_type = 'view'").select("event_id", F.col("agent").alias("sa"), F.col("ts").alias("st"))
    return s, e.where("event_type IN ('click', 'error')").select(F.col("agent").alias("fa"), F.col("ts").alias("ft"), (F.col("event_type") == "click").alias("flag"))


@query(
    "T11_stream_shown_flip",
    "WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), f AS (SELECT user_id, ts, event_type = 'click' AS shown FROM events WHERE event_type IN ('click', 'error')) SELECT s.event_id, coalesce(arg_max(shown, f.ts), false) AS shown FROM s LEFT JOIN f ON f.user_id = s.user_id AND f.ts > s.ts AND f.ts <= s.ts + INTERVAL 1 HOUR GROUP BY s.event_id",
)
def t11_stream_shown_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_flip(*signals_and_flags(_events(spark, sf_dir)))


def graph_links(stored: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(fact_id, mention, node_id, confidence, stale): links of stored texts to code nodes, stale if the node is gone.

    stored: (fact_id, content); a stream hands each of its batches to this function (`link_stream`).
    """
    found = match_mentions(code_mentions(stored), nodes)
    flag = gone.select("node_id", F.lit(True).alias("gone"))
    return found.join(flag, "node_id", "left").select("fact_id", "mention", "node_id", F.round("confidence", 6).alias("confidence"), F.col("gone").isNotNull().alias("stale"))


def link_stream(stored: DataFrame, nodes: DataFrame, gone: DataFrame, path: str, checkpoint: str):
    """Writes the links of each batch to a folder of its own; a batch that comes again overwrites it."""

    def put(batch: DataFrame, number: int) -> None:
        graph_links(batch, nodes, gone).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query(
    "T12_stream_graph_links",
    "WITH l AS (" + SQL_MATCH + ") SELECT fact_id, mention, node_id, confidence, node_id % 3 = 0 AS stale FROM l",
)
def t12_stream_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with remarks on code; every third node is gone."""
    nodes = code(spark, sf_dir)
    return graph_links(remarks(spark, sf_dir), nodes, nodes.where("node_id % 3 = 0"))


@query("T4_near_dup_gate")
def t4_near_dup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all vectors in order of their ids, by label; greedy and in order, so without an SQL form."""
    items = views.vectors(spark, sf_dir).select(F.col("label").cast("long").alias("profile"), F.col("fact_id").alias("id"), "vec")
    above, keep = 0.3, 50

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"profile": key[0], "id": rows["id"], "passes": Gate(keep).run(rows["vec"], above)})

    return items.groupBy("profile").applyInPandas(run, "profile long, id long, passes boolean")
