"""Instants against intervals of time: what is near an instant, and what holds at it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import views
from engram.operators.lexical import best
from engram.registry import query


def near_spans(instants: DataFrame, spans: DataFrame, reach: int = 0, width: int = 32, parts: int = 1) -> DataFrame:
    """Each instant beside each span that lies within `reach` days of it, once, with `apart`: days to its nearer end, 0 inside.

    instants: (query_id, at date), spans: (first date, last date, ...), both ends counted, last null: open. Both sides are
    dealt into bands of `width` days and meet band by band, in the first band that they share; spans are cut to the range
    of the instants, so an open one takes no more bands than that. `parts` splits the spans of a band over more tasks, for
    which the instants, of which there are few, are repeated.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    ends = instants.agg(F.min(day("at")).alias("low"), F.max(day("at")).alias("high")).first()
    low, high = (ends.low or 0) - reach, (ends.high or 0) + reach
    band = lambda c: F.floor(c / width).cast("int")
    asked = instants.withColumn("_q", day("at")).withColumn("_qb", band(F.col("_q") - reach))
    asked = asked.withColumn("_band", F.explode(F.sequence("_qb", band(F.col("_q") + reach)))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = spans.withColumns({"_f": F.greatest(day("first"), F.lit(low)), "_l": F.least(F.coalesce(day("last"), F.lit(high)), F.lit(high))}).where("_f <= _l")
    held = held.withColumn("_fb", band(F.col("_f"))).withColumn("_band", F.explode(F.sequence("_fb", band(F.col("_l"))))).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    apart = F.greatest(F.col("_f") - F.col("_q"), F.col("_q") - F.col("_l"), F.lit(0))
    met = held.join(asked, ["_band", "_part"]).where(F.col("_band") == F.greatest("_fb", "_qb")).withColumn("apart", apart).where(F.col("apart") <= reach)
    return met.drop("_band", "_part", "_f", "_l", "_fb", "_q", "_qb")


# --- L5 --------------------------------------------------------------------------------------------------------------

#: Days that a fact may be away, and the width of the curve.
REACH, SIGMA = 365, 30.0
#: What a date is worth: the one a text refers to, the end of an interval, the one it was observed on.
WORTH = {"referenced": 1.0, "interval": 0.9, "observed": 0.8}

# Events of facts: the day of an order observes its parts; a third of the lines refers to a day, a third has an interval.
views.SQL["dated"] = """SELECT l_partkey AS fact_id, o_orderdate::DATE AS observed, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE END AS referenced,
    CASE WHEN l_linenumber % 3 = 1 THEN o_orderdate::DATE + 10 END AS begins, CASE WHEN l_linenumber % 3 = 1 THEN l_shipdate::DATE + 10 END AS ends FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
views.SQL["instants"] = "SELECT item_id AS query_id, DATE '1995-01-01' + (item_id * 37 % 2500)::INT AS asked_on FROM benchmark"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("observed"))
    third = F.col("l_linenumber") % 3
    return lines.join(orders, "l_orderkey").select(
        F.col("l_partkey").alias("fact_id"), "observed", F.when(third == 0, F.col("ship")).alias("referenced"), F.when(third == 1, F.date_add("observed", 10)).alias("begins"), F.when(third == 1, F.date_add("ship", 10)).alias("ends")
    )


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.read(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("item_id") * 37 % 2500).cast("int")).alias("at"))


def temporal_channel(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, fact_id, score): the best of a fact's events at an instant.

    An event's score is the largest of: exp(-days² / 1800) to its referenced date; 0.8 of that to its observation; 1 within
    its interval, else 0.9 of that to the nearer bound. Nothing counts beyond 365 days. An interval needs both bounds, in
    order. asked: (query_id, at), events: (fact_id, observed, referenced, begins, ends), dates, any of them null.
    """
    span = lambda kind, first, last: F.struct(F.lit(kind).alias("kind"), F.col(first).alias("first"), F.col(last).alias("last"))
    each = F.array(span("referenced", "referenced", "referenced"), span("observed", "observed", "observed"), span("interval", "begins", "ends"))
    spans = events.select("fact_id", F.explode(each).alias("z")).select("fact_id", "z.*").where("first <= last").distinct()
    near = near_spans(asked, spans, REACH)
    curve = F.exp(-F.pow("apart", 2) / (2 * SIGMA * SIGMA))
    worth = F.element_at(F.create_map(*[F.lit(x) for p in WORTH.items() for x in p]), F.col("kind"))
    score = F.when((F.col("kind") == "interval") & (F.col("apart") == 0), 1.0).otherwise(worth * curve)
    return near.groupBy("query_id", "fact_id").agg(F.max(score).alias("score"))


def _least(marks: DataFrame, k: int) -> DataFrame:
    """Of each (kind, place) the k least facts."""
    rank = F.dense_rank().over(W.partitionBy("kind", "place").orderBy("fact_id"))
    return marks.withColumn("_r", rank).where(F.col("_r") <= k).select("kind", "place", "fact_id")


#: Kinds of marks; those from 0 on are blocks of 2 ** kind days.
REFERENCED, OBSERVED, BEGINS, ENDS, BOUND = -1, -2, -3, -4, -5


def nearest_in_time(asked: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, score, rank): the k best facts of each query by `temporal_channel`, then by fact.

    All events of one kind and day score alike at an instant, so of these only the k least facts can be among its best; the
    same holds for the bounds of intervals, seen from outside. Inside all score 1: an interval is cut into blocks of 1, 2, 4,
    ... days, at most two of a size, of which again the k least facts are enough, and an instant is in one block of each
    size. So no event meets an instant, and instants of a day are looked up once. An interval with one bound only counts as
    a day that is worth as much as a bound.
    """
    ends = asked.agg(F.min(F.unix_date("at")).alias("low"), F.max(F.unix_date("at")).alias("high")).first()
    low, high = ends.low or 0, ends.high or 0
    sizes = (high - low + 1).bit_length()
    mark = lambda kind, place, when: F.when(when, F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place")))
    referenced, observed, begins, ends_ = (F.col(c) for c in ("referenced", "observed", "begins", "ends"))
    near = lambda c: c.between(low - REACH, high + REACH)
    points = [mark(REFERENCED, referenced, near(referenced)), mark(OBSERVED, observed, near(observed))]
    points += [mark(BEGINS, begins, (begins <= ends_) & near(begins)), mark(ENDS, ends_, (begins <= ends_) & near(ends_)), mark(BOUND, F.coalesce(begins, ends_), (begins.isNull() | ends_.isNull()) & near(F.coalesce(begins, ends_)))]
    blocks = []
    for i in range(sizes):  # [_first, _beyond) in blocks of 2**i days that are in no larger one of its own
        first, beyond = F.shiftright(F.col("_first") + (2**i - 1), i), F.shiftright(F.col("_beyond"), i)
        blocks += [mark(i, first, (first < beyond) & (first % 2 == 1)), mark(i, beyond - 1, (first < beyond) & (beyond % 2 == 1))]
    dates = [F.unix_date(c).alias(c) for c in ("observed", "referenced", "begins", "ends")]
    days = events.select("fact_id", *dates).withColumns({"_first": F.greatest(begins, F.lit(low)) - low, "_beyond": F.least(ends_, F.lit(high)) - low + 1})
    inside = F.when((begins <= ends_) & (begins <= high) & (ends_ >= low), F.array_compact(F.array(*blocks))).otherwise(F.array().cast("array<struct<kind:int,place:int>>"))
    marks = _least(days.select("fact_id", F.explode(F.concat(F.array_compact(F.array(*points)), inside)).alias("z")).select("fact_id", "z.*"), k)

    def look(kind: int, first: int, last: int, worth: float) -> Column:
        score = lambda x: worth * F.exp(-F.pow(x, F.lit(2)) / (2 * SIGMA * SIGMA))
        return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda x: F.struct(F.lit(kind).alias("kind"), (F.col("at") + x).alias("place"), score(x).alias("score")))

    held = WORTH["interval"]
    looks = [look(REFERENCED, -REACH, REACH, WORTH["referenced"]), look(OBSERVED, -REACH, REACH, WORTH["observed"]), look(BEGINS, 1, REACH, held), look(ENDS, -REACH, -1, held), look(BOUND, -REACH, REACH, held)]
    looks.append(F.array(*(F.struct(F.lit(i).alias("kind"), F.shiftright(F.col("at") - low, i).alias("place"), F.lit(1.0).alias("score")) for i in range(sizes))))
    instants = asked.select("query_id", F.unix_date("at").alias("at")).where("at IS NOT NULL").distinct()
    wanted = instants.select("at").distinct().select("at", F.explode(F.concat(*looks)).alias("z")).select("at", "z.*")
    scored = wanted.join(marks, ["kind", "place"]).groupBy("at", "fact_id").agg(F.max("score").alias("score"))
    found = best(scored.withColumnRenamed("at", "query_id"), k).withColumnRenamed("query_id", "at")
    return instants.join(found, "at").select("query_id", "fact_id", "score", "rank")


@query(
    "L5_temporal_channel",
    """WITH p AS (SELECT query_id, fact_id, abs(date_diff('day', referenced, asked_on)) AS r, abs(date_diff('day', observed, asked_on)) AS o, date_diff('day', begins, asked_on) AS b, date_diff('day', asked_on, ends) AS e FROM instants JOIN dated ON true),
    s AS (SELECT query_id, fact_id, greatest(CASE WHEN r <= 365 THEN exp(-r * r / 1800.0::DOUBLE) ELSE 0 END, CASE WHEN o <= 365 THEN 0.8 * exp(-o * o / 1800.0::DOUBLE) ELSE 0 END,
      CASE WHEN b + e < 0 THEN 0 WHEN b >= 0 AND e >= 0 THEN 1.0 WHEN least(abs(b), abs(e)) <= 365 THEN 0.9 * exp(-power(least(abs(b), abs(e)), 2) / 1800.0::DOUBLE) ELSE 0 END) AS s FROM p),
    m AS (SELECT query_id, fact_id, max(s) AS score FROM s WHERE s > 0 GROUP BY query_id, fact_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM m)
    SELECT query_id, fact_id, round(score, 6)::DOUBLE AS score, rank FROM k WHERE rank <= 50""",
)
def l5_temporal_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 facts nearest in time to each query's day."""
    found = nearest_in_time(instants(spark, sf_dir), dated(spark, sf_dir), 50)
    return found.select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


# --- J10 -------------------------------------------------------------------------------------------------------------

# Events hold from an order to its shipping; the system learns of them a week later and forgets some a month after the end.
views.SQL["known"] = """SELECT l_orderkey * 10 + l_linenumber AS fact_id, o_orderdate::DATE AS valid_from, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS valid_until,
    o_orderdate::DATE + 7 AS known_from, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE + 30 END AS known_until FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


#: What a day changes: facts valid and known at once (pairs of their rows), only valid, only known; sums of ids of both kinds.
CHANGES = pa.schema([("day", pa.int32()), ("paired", pa.int64()), ("valid_only", pa.int64()), ("known_only", pa.int64()), ("paired_ids", pa.int64()), ("single_ids", pa.int64())])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By day, how the counts of `counts_at` change, over whole facts; batches: (fact_id, valid_from, valid_until, known_from, known_until), days."""
    table = pa.Table.from_batches(list(batches), schema=HELD)
    fact = table["fact_id"].to_numpy()
    ids, days, steps = [], [], []
    for first, last, step in (("valid_from", "valid_until", (1, 0)), ("known_from", "known_until", (0, 1))):
        begins, ends = (table[c].to_numpy().astype(np.float64) for c in (first, last))  # unknown: NaN
        holds = ~np.isnan(begins) & ~(ends <= begins)
        for at, sign, some in ((begins, 1, holds), (ends, -1, holds & ~np.isnan(ends))):
            ids.append(fact[some])
            days.append(at[some].astype(np.int32))
            steps.append(np.tile(np.array(step, dtype=np.int64) * sign, (int(some.sum()), 1)))
    fact, day, step = np.concatenate(ids), np.concatenate(days), np.concatenate(steps)
    if not len(fact):
        return
    order = np.lexsort((day, fact))
    fact, day, state = fact[order], day[order], step[order].cumsum(axis=0)
    new = np.concatenate(([True], fact[1:] != fact[:-1]))
    start = np.nonzero(new)[0]
    before = np.concatenate((np.zeros((1, 2), dtype=np.int64), state))[start]
    state = state - np.repeat(before, np.diff(np.append(start, len(fact))), axis=0)
    last = np.append(new[1:] | (day[1:] != day[:-1]), True)  # of a fact's steps of one day
    fact, day, (valid, known) = fact[last], day[last], state[last].T
    paired, valid_only, known_only = valid * known, valid * (known == 0), known * (valid == 0)
    values = np.stack((paired, valid_only, known_only, fact * paired, fact * (valid_only + known_only)))
    same = np.concatenate(([False], fact[1:] == fact[:-1]))
    values[:, 1:] -= np.where(same[1:], values[:, :-1], 0)
    each, place = np.unique(day, return_inverse=True)
    out = np.zeros((len(each), len(values)), dtype=np.int64)
    np.add.at(out, place, values.T)
    yield pa.RecordBatch.from_arrays([pa.array(each), *map(pa.array, out.T.copy())], schema=CHANGES)


HELD = pa.schema([("fact_id", pa.int64()), *((c, pa.int32()) for c in ("valid_from", "valid_until", "known_from", "known_until"))])


def counts_at(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, valid, known, both, ids): how many rows hold at each instant, from their begin up to, not at, their end (null: open).

    asked: (query_id, at), facts: (fact_id, valid_from, valid_until, known_from, known_until), dates. Rows of a fact that are valid
    and rows of it that are known meet each other, as in a full join by query and fact; ids is the sum over what results. No
    fact meets an instant: rows of a fact come together once and say by day how the counts change, and an instant sums up the
    changes until then, of which there is a row a day.
    """
    dates = [F.unix_date(c).alias(c) for c in HELD.names[1:]]
    changes = facts.where("fact_id IS NOT NULL").select("fact_id", *dates).repartition("fact_id").mapInArrow(_changes, ", ".join(f"{f.name} {'int' if f.name == 'day' else 'long'}" for f in CHANGES))
    by_day = changes.groupBy("day").agg(*(F.sum(c).alias(c) for c in CHANGES.names[1:]))
    times = asked.groupBy("query_id", F.unix_date("at").alias("at")).agg(F.count("*").alias("n"))
    held = times.join(F.broadcast(by_day), F.col("day") <= F.col("at")).groupBy("query_id", "n").agg(*(F.sum(c).alias(c) for c in CHANGES.names[1:])).where("paired + valid_only + known_only > 0")
    both, once = F.col("n") * F.col("n") * F.col("paired"), lambda c: F.col("n") * F.col(c)  # an instant that comes n times
    return held.select("query_id", (both + once("valid_only")).alias("valid"), (both + once("known_only")).alias("known"), both.alias("both"), (F.col("n") * F.col("n") * F.col("paired_ids") + once("single_ids")).alias("ids"))


@query(
    "J10_valid_at",
    """WITH v AS (SELECT query_id, fact_id FROM instants JOIN known ON valid_from <= asked_on AND (valid_until IS NULL OR valid_until > asked_on)), k AS (SELECT query_id, fact_id FROM instants JOIN known ON known_from <= asked_on AND (known_until IS NULL OR known_until > asked_on))
    SELECT query_id, count(v.fact_id) AS valid, count(k.fact_id) AS known, count(CASE WHEN v.fact_id IS NOT NULL AND k.fact_id IS NOT NULL THEN 1 END) AS "both", sum(coalesce(v.fact_id, k.fact_id))::BIGINT AS ids
    FROM v FULL JOIN k USING (query_id, fact_id) GROUP BY query_id""",
)
def j10_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each instant of a table, how many facts are valid at it in event time, known to the system, and both."""
    lines = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"), (F.col("l_linestatus") == "F").alias("over"))
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("valid_from"))
    over = F.col("over")
    facts = lines.join(orders, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), "valid_from", F.when(over, F.col("ship")).alias("valid_until"), F.date_add("valid_from", 7).alias("known_from"), F.when(over, F.date_add("ship", 30)).alias("known_until")
    )
    return counts_at(instants(spark, sf_dir), facts)
