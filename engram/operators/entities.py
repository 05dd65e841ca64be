"""Entities: mentions, resolution, edges by shared entities, and the retrieval channels that walk from entity to fact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.operators.graph import FEW, cut, pageranks
from engram.operators.index import Index, look_up, places, stored
from engram.operators.lexical import SQL_BM25, SQL_TOKENS, best, bm25, tokens
from engram.operators.similarity import most_similar
from engram.operators.text import SQL_ENTITIES, entities, phrase_pattern, sql_list, sql_text
from engram.registry import query

#: A node with so many edges gets no further ones.
HUB_DEGREE = 200
CAUSAL = phrase_pattern(fixed.CAUSAL_CUES)

views.SQL["mentions"] = f"SELECT fact_id, unnest({SQL_ENTITIES}) AS name FROM facts"
views.SQL["asked"] = f"SELECT query_id, unnest({SQL_ENTITIES.replace('content', 'text')}) AS name FROM queries"
views.SQL["links"] = "SELECT src, dst, weight, CASE WHEN src * dst % 11 = 0 THEN 'contradiction' ELSE edge_type END AS kind FROM edges"
views.SQL["ends"] = "SELECT src, dst, weight FROM links UNION ALL SELECT dst, src, weight FROM links"
views.SQL["standing"] = """SELECT fact_id, session_id AS community, created_at, coalesce(rank, 0) AS pr FROM facts LEFT JOIN pageranks ON node = fact_id"""
#: Texts with a remark behind them: on a cause, on what lies ahead, or none.
REMARKS = (" It broke because of the release.", " The move is scheduled for tomorrow.", "")
views.SQL["annotated"] = f"SELECT fact_id, created_at, content || ({sql_list(REMARKS)})[(fact_id % 3 + 1)::INT] AS content FROM facts"
views.SQL["hubs"] = f"SELECT src AS fact_id FROM ends GROUP BY src HAVING count(*) >= {HUB_DEGREE}"


def mentions(facts: DataFrame) -> DataFrame:
    """(fact_id, name) of every name in every fact."""
    return facts.select("fact_id", F.explode(entities(F.col("content"))).alias("name"))


def name_index(facts: DataFrame) -> Index:
    """The stored inverted index of the facts' names."""
    return stored(facts, "names", entities(F.col("content")))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, REMARKS)), (F.col("fact_id") % 3 + 1).cast("int"))
    return views.facts(spark, sf_dir).select("fact_id", "created_at", F.concat("content", note).alias("content"))


def asked_names(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(entities(F.col("text"))).alias("name"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between facts; some of them contradictions."""
    kind = F.when(F.col("src") * F.col("dst") % 11 == 0, "contradiction").otherwise(F.col("edge_type"))
    return views.edges(spark, sf_dir).select("src", "dst", "weight", kind.alias("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def standing(facts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(fact_id, community, created_at, pr): PageRank of the fact's node; 0 without one."""
    known = facts.select("fact_id", F.col("session_id").alias("community"), "created_at").join(ranks.withColumnRenamed("node", "fact_id"), "fact_id", "left")
    return known.select("fact_id", "community", "created_at", F.coalesce("rank", F.lit(0.0)).alias("pr"))


# --- edges by shared entities ----------------------------------------------------------------------------------------


def earlier_mates(facts: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(fact_id, other): for each name of a fact the `most` facts last before it that share the name and are no hubs.

    A fact is a hub if it has 200 edges or more already. Facts know how many others of a name come before them, from
    which the places of their mates follow: these meet by name and place, so the facts of a name are never paired with
    each other and a name of many facts is in no one task.
    """
    ends = both_ways(edges)
    hubs = ends.groupBy(F.col("src").alias("fact_id")).agg(F.count("*").alias("n")).where(F.col("n") >= HUB_DEGREE).select("fact_id", F.lit(True).alias("hub"))
    found = mentions(facts).join(facts.select("fact_id", "created_at"), "fact_id").join(hubs, "fact_id", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    placed = cut(places(found, "name", ["created_at", "fact_id"], ~F.col("hub")))
    wanted = placed.where("place > 0").select("name", "fact_id", F.explode(F.expr(f"sequence(greatest(place - {most}, 0), place - 1)")).alias("place"))
    return wanted.join(placed.where("NOT hub").select("name", "place", F.col("fact_id").alias("other")), ["name", "place"]).select("fact_id", "other").distinct()


SQL_MATES = """m AS (SELECT fact_id, name, created_at, hubs.fact_id IS NOT NULL AS hub FROM mentions JOIN facts USING (fact_id) LEFT JOIN hubs USING (fact_id)),
    n AS (SELECT *, coalesce(sum((NOT hub)::INT) OVER (PARTITION BY name ORDER BY created_at, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM m),
    mates AS (SELECT DISTINCT a.fact_id, b.fact_id AS other FROM n a JOIN n b ON a.name = b.name AND NOT b.hub AND b.i BETWEEN a.i - 5 AND a.i - 1)"""


@query("J2_entity_edges", f"WITH {SQL_MATES} SELECT fact_id, other, 1.0::DOUBLE AS weight FROM mates")
def j2_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact to up to five earlier facts of every shared entity, facts of 200 edges or more left out; weight 1."""
    return earlier_mates(views.facts(spark, sf_dir), views.edges(spark, sf_dir)).withColumn("weight", F.lit(1.0))


@query(
    "J5_causal_edges",
    f"WITH {SQL_MATES} SELECT other AS src, fact_id AS dst, 0.8::DOUBLE AS weight FROM mates JOIN annotated USING (fact_id) WHERE regexp_matches(content, {sql_text(CAUSAL)})",
)
def j5_causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From up to five earlier facts of every shared entity to each fact that has a causal cue; weight 0.8."""
    cued = annotated(spark, sf_dir).where(F.col("content").rlike(CAUSAL)).select("fact_id")
    mates = earlier_mates(views.facts(spark, sf_dir), views.edges(spark, sf_dir))
    return mates.join(cued, "fact_id").select(F.col("other").alias("src"), F.col("fact_id").alias("dst"), F.lit(0.8).alias("weight"))


#: Pairs of a group are met block by block, so that a task holds the pairs of two blocks at most.
PAIR_BLOCK = 200


def pairs_within(groups: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """groups: (name, fact_id). (a, b) with a < b of all facts that share a name, each once.

    The facts of a name are dealt into blocks of about `block`; a fact goes to each pair of blocks that its own is part of.
    """
    size = groups.groupBy("name").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = groups.join(size, "name").withColumn("own", F.pmod(F.hash("fact_id"), F.col("blocks")))
    low = dealt.select("name", F.col("fact_id").alias("a"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"))
    high = dealt.select("name", F.col("fact_id").alias("b"), F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"))
    met = low.join(high, ["name", "i", "j"]).where("a <> b AND (i <> j OR a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(
    "J8_sheaf_batch",
    """WITH v AS (SELECT n.fact_id, name, vec FROM mentions n JOIN vectors ON vectors.fact_id = n.fact_id),
    p AS (SELECT a.fact_id AS a, b.fact_id AS b, any_value(a.vec) AS va, any_value(b.vec) AS vb FROM v a JOIN v b ON a.name = b.name AND a.fact_id < b.fact_id GROUP BY ALL),
    x AS (SELECT a, b, list_dot_product(va, va) AS aa, list_dot_product(vb, vb) AS bb, list_dot_product(va, vb) AS ab FROM p)
    SELECT a, b, round(sqrt(greatest(aa + bb - 2 * ab, 0)) / (sqrt(aa) + sqrt(bb)), 6) AS severity FROM x WHERE sqrt(aa) + sqrt(bb) > 0""",
)
def j8_sheaf_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|b - a| / (|a| + |b|) of all pairs of facts within an entity group, of any size.

    Facts are dealt into blocks that meet two by two, so a pair is found once, whatever its names, with both vectors at hand.
    """
    vectors = views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vec")).where("vec IS NOT NULL")
    known = cut(vectors.select("fact_id").distinct())
    known = F.broadcast(known) if known.count() <= FEW else known
    named = mentions(views.facts(spark, sf_dir).join(known, "fact_id", "left_semi"))
    return apart_within(named, vectors.dropDuplicates(["fact_id"])).select("a", "b", F.round("severity", 6).alias("severity"))


#: Facts of a block; a task holds two blocks and their pairs.
FACT_BLOCK = 4_500


def apart_within(named: DataFrame, vectors: DataFrame, block: int = FACT_BLOCK) -> DataFrame:
    """(a, b, severity): |vb - va| / (|va| + |vb|) of all pairs a < b of facts that share a name, each once, but for two zero vectors.

    named: (fact_id, name), vectors: (fact_id, vec), each fact once. Each fact goes to the pairs of blocks that its own is part of.
    """
    number = cut(named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.monotonically_increasing_id().alias("k")))
    sets = named.join(number, "name").groupBy("fact_id").agg(F.collect_set("k").alias("names"))
    held = cut(sets.join(vectors, "fact_id"))
    blocks = max(1, -(-held.count() // block))
    own = held.withColumn("own", F.pmod(F.xxhash64("fact_id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fact_id", "names", "vec")
    return met.groupBy("i", "j").applyInArrow(_apart, "a long, b long, severity double")


APART = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("severity", pa.float64())])


def _apart(table: pa.Table) -> pa.Table:
    """The pairs of two blocks, or within one."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    sides = []
    for own in (i, j):
        side = table.filter(pc.equal(table["own"], own)).combine_chunks()
        names, vec = side["names"].combine_chunks(), side["vec"].combine_chunks()
        ids, flat = side["fact_id"].to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(names).to_numpy())
        sides.append((ids, flat.reshape(len(ids), -1 if len(flat) else 0), row, names.flatten().to_numpy()))
    if not len(sides[0][0]) or not len(sides[1][0]):
        return APART.empty_table()
    (a, x, row_a, name_a), (b, y, row_b, name_b) = sides
    shared = np.zeros((len(a), len(b)), dtype=bool)
    order = np.argsort(name_b, kind="stable")
    row_b, name_b = row_b[order], name_b[order]
    by = np.argsort(name_a, kind="stable")
    each, start = np.unique(name_a[by], return_index=True)
    for name, rows in zip(each, np.split(row_a[by], start[1:]), strict=True):
        low, high = np.searchsorted(name_b, [name, name + 1])
        if low < high:
            shared[np.ix_(rows, row_b[low:high])] = True
    shared &= a[:, None] < b[None, :] if i == j else True
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    out = []
    for at in range(0, len(a), 256):
        r, c = np.nonzero(shared[at : at + 256])
        xy = (x[at : at + 256] @ y.T)[r, c]
        r += at
        size = np.sqrt(xx[r]) + np.sqrt(yy[c])
        some = size > 0
        r, c, xy, size = r[some], c[some], xy[some], size[some]
        severity = np.sqrt(np.maximum(xx[r] + yy[c] - 2 * xy, 0.0)) / size
        out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a[r], b[c])), pa.array(np.maximum(a[r], b[c])), pa.array(severity)], schema=APART))
    return pa.Table.from_batches(out, schema=APART)


# --- channels over entities ------------------------------------------------------------------------------------------


def facts_of(asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, fact_id) of all facts with a name of the query, each once; asked: (query_id, name)."""
    return look_up(asked.select("query_id", F.col("name").alias("key")), index).select("query_id", "fact_id").distinct()


@query("L7_profile_channel", "SELECT DISTINCT query_id, fact_id, 0.95::DOUBLE AS score FROM asked JOIN mentions USING (name)")
def l7_profile_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in the profile of any entity that a query names, all at 0.95; a profile is the facts of a name."""
    return facts_of(asked_names(views.queries(spark, sf_dir)), name_index(views.facts(spark, sf_dir))).withColumn("score", F.lit(0.95))


@query(
    "L6_entity_events",
    """WITH q AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY name) AS k FROM asked),
    e AS (SELECT query_id, fact_id, created_at FROM q JOIN mentions USING (name) JOIN facts USING (fact_id) WHERE k <= 3),
    o AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY min(created_at), fact_id) - 1 AS n FROM e GROUP BY query_id, fact_id)
    SELECT query_id, fact_id, round(greatest(0.3, 0.85 - 0.02 * n), 6)::DOUBLE AS score FROM o""",
)
def l6_entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with events of the first three entities of a query, in order of time: 0.85, 0.02 less for each, 0.3 at least.

    A place beyond the 27th changes nothing, so the order of a query is taken of its first facts only.
    """
    facts = views.facts(spark, sf_dir)
    first = asked_names(views.queries(spark, sf_dir)).withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("name"))).where("k <= 3")
    met = cut(facts_of(first, name_index(facts)).join(facts.select("fact_id", "created_at"), "fact_id"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("created_at", "fact_id"))
    early = met.withColumn("n", order).where("n <= 28").select("query_id", "fact_id", (F.col("n") - 1).alias("n"))
    n = F.coalesce("n", F.lit(28))
    return met.join(early, ["query_id", "fact_id"], "left").select("query_id", "fact_id", F.round(F.greatest(F.lit(0.3), 0.85 - 0.02 * n), 6).alias("score"))


#: Queries are numbered, and sets of them are words of 64 bits: a row stands for what up to 64 queries have reached.
def _word() -> Column:
    return F.expr("cast(q div 64 as int)")


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(q % 64 as int))")


def bit_sets(pairs: DataFrame, name: str = "bits") -> DataFrame:
    """(fact_id, w, bits) of pairs (q, fact_id)."""
    return pairs.groupBy("fact_id", _word().alias("w")).agg(F.bit_or(_bit()).alias(name))


def _members(bits: str) -> Column:
    return F.expr(f"explode(transform(filter(sequence(0, 63), i -> (shiftrightunsigned({bits}, i) & 1L) = 1L), i -> w * 64L + i))")


def activation(seeds: DataFrame, names: DataFrame, found: DataFrame, index: Index, edges: DataFrame, info: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, fact_id, a): seeds at 1, spread over edges and over entities that come in on the way.

    An edge passes a * 0.7 * weight * min(1 + 2 pr, 2) of its end, 0.1 at least; the facts of an entity first met in hop h
    get 0.7 ** h. The largest activation of a fact counts. In a hop only what the hop before has raised goes on, as all
    else has been passed on already.

    All queries walk together: a name or a fact has a set of the queries that reach it, so a hop over the names reads each
    mention once for 64 queries. An edge passes on to the queries that its far end can still gain from: those below
    0.7 ** h there, or, of the few edges that may pass more than that, those below what any can pass.
    """
    number = places(seeds.select("query_id").distinct().withColumn("all", F.lit(0)), "all", ["query_id"]).select("query_id", F.col("place").alias("q"))
    number = cut(number)
    found = found.select("fact_id", "name")
    known = cut(names.join(number, "query_id").groupBy("name", _word().alias("w")).agg(F.bit_or(_bit()).alias("seen")))
    ends = edges.join(info.select(F.col("fact_id").alias("dst"), "pr"), "dst")
    step = cut(ends.select("src", "dst", (0.7 * F.col("weight") * F.least(1 + 2 * F.col("pr"), F.lit(2.0))).alias("p")))
    most = step.agg(F.max("p").alias("p")).first().p or 0.0
    a = front = cut(seeds.join(number, "query_id").select("q", "fact_id", F.lit(1.0).alias("a")))
    for hop in range(1, hops + 1):
        least = 0.7**hop
        top = front.agg(F.max("a").alias("top")).first().top
        if top is None:
            break
        ahead = cut(bit_sets(front))
        met = found.join(ahead, "fact_id").groupBy("name", "w").agg(F.bit_or("bits").alias("bits")).join(known, ["name", "w"], "left")
        new = cut(met.select("name", "w", F.expr("bits & ~coalesce(seen, 0L)").alias("bits")).where("bits <> 0"))
        come = look_up(new.withColumnRenamed("name", "key"), index).groupBy("fact_id", "w").agg(F.bit_or("bits").alias("come"))
        known = cut(known.union(new.select("name", "w", "bits")).groupBy("name", "w").agg(F.bit_or("seen").alias("seen")))
        have = a.groupBy("fact_id", _word().alias("w")).agg(F.bit_or(F.when(F.col("a") >= least, _bit()).otherwise(F.lit(0).cast("long"))).alias("weak"), F.bit_or(F.when(F.col("a") >= top * most, _bit()).otherwise(F.lit(0).cast("long"))).alias("strong"))
        closed = cut(have.join(come, ["fact_id", "w"], "full").select("fact_id", "w", F.expr("coalesce(come, 0L) & ~coalesce(weak, 0L)").alias("come"), F.expr("coalesce(weak, 0L) | coalesce(come, 0L)").alias("weak"), F.expr("coalesce(strong, 0L)").alias("strong")))
        passed = step.join(ahead.withColumnRenamed("fact_id", "src"), "src").join(closed.select(F.col("fact_id").alias("dst"), "w", "weak", "strong"), ["dst", "w"], "left")
        shut = F.when(F.col("p") * top > least, F.coalesce("strong", F.lit(0).cast("long"))).otherwise(F.coalesce("weak", F.lit(0).cast("long")))
        open_ = passed.select("src", "dst", "p", "w", shut.alias("shut"), "bits").select("src", "dst", "p", "w", F.expr("bits & ~shut").alias("bits")).where("bits <> 0")
        sent = open_.select("src", "dst", "p", _members("bits").alias("q")).join(front.withColumnRenamed("fact_id", "src"), ["q", "src"])
        sent = sent.select("q", F.col("dst").alias("fact_id"), (F.col("a") * F.col("p")).alias("got")).where("got >= 0.1")
        come = closed.where("come <> 0").select(_members("come").alias("q"), "fact_id", F.lit(least).alias("got"))
        got = sent.union(come.select("q", "fact_id", "got")).groupBy("q", "fact_id").agg(F.max("got").alias("got"))
        both = a.join(got, ["q", "fact_id"], "full").select("q", "fact_id", F.greatest("a", "got").alias("a"), (F.coalesce("got", F.lit(0.0)) > F.coalesce("a", F.lit(0.0))).alias("raised"))
        both = cut(both)
        a, front = both.select("q", "fact_id", "a"), both.where("raised").select("q", "fact_id", "a")
    return a.join(number, "q").select("query_id", "q", "fact_id", "a")


def _sql_activation(hops: int = 3) -> str:
    parts = ["a0 AS (SELECT DISTINCT query_id, fact_id, 1.0::DOUBLE AS a FROM asked JOIN mentions USING (name))", "e0 AS (SELECT DISTINCT query_id, name FROM asked)"]
    parts.append("step AS (SELECT src, dst, 0.7::DOUBLE * weight * least(1 + 2 * pr, 2) AS p FROM ends JOIN standing ON fact_id = dst)")
    for h in range(1, hops + 1):
        b = h - 1
        parts.append(f"x{h} AS (SELECT query_id, name FROM a{b} JOIN mentions USING (fact_id) EXCEPT SELECT query_id, name FROM e{b})")
        parts.append(f"e{h} AS (SELECT * FROM e{b} UNION ALL SELECT * FROM x{h})")
        parts.append(
            f"""a{h} AS (SELECT query_id, fact_id, max(a) AS a FROM (SELECT * FROM a{b} UNION ALL SELECT query_id, dst, a * p FROM a{b} JOIN step ON src = fact_id WHERE a * p >= 0.1
            UNION ALL SELECT query_id, fact_id, {0.7**h!r}::DOUBLE FROM x{h} JOIN mentions USING (name)) GROUP BY query_id, fact_id)"""
        )
    return ", ".join(parts)


def entity_graph(queries: DataFrame, facts: DataFrame, edges: DataFrame, ranks: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, fact_id, score): activation, weighed by communities and corrections, over the largest of the query.

    Facts of a community that has a share s of the seeds get min(1 + 0.15 s, 1.3), all others 0.9. The older end of a
    contradiction between two reached facts is halved; what a reached fact supersedes (the target) keeps 0.3.
    """
    names, found, index = asked_names(queries), cut(mentions(facts)), name_index(facts)
    seeds = cut(facts_of(names, index))
    edges = cut(edges)
    info = cut(standing(facts, ranks))
    reached = cut(activation(seeds, names, found, index, both_ways(edges), info, hops).join(info, "fact_id"))
    total = seeds.groupBy("query_id").agg(F.count("*").alias("of"))
    share = seeds.join(info, "fact_id").groupBy("query_id", "community").agg(F.count("*").alias("n")).join(total, "query_id").select("query_id", "community", (F.col("n") / F.col("of")).alias("k"))
    boosted = reached.join(share, ["query_id", "community"], "left")
    boosted = boosted.withColumn("a", F.col("a") * F.when(F.col("k") > 0, F.least(1 + 0.15 * F.col("k"), F.lit(1.3))).otherwise(0.9))
    ends = edges.where("kind IN ('contradiction', 'supersedes')")
    sets = cut(bit_sets(reached))
    left, right = (sets.join(info.select("fact_id", "created_at"), "fact_id").select(F.col("fact_id").alias(c), "w", F.col("bits").alias(f"{c}_bits"), F.col("created_at").alias(f"{c}_at")) for c in ("src", "dst"))
    met = ends.join(left, "src").join(right, ["dst", "w"]).withColumn("bits", F.expr("src_bits & dst_bits"))
    older = F.when((F.col("src_at") < F.col("dst_at")) | ((F.col("src_at") == F.col("dst_at")) & (F.col("src") < F.col("dst"))), F.col("src")).otherwise(F.col("dst"))
    contra = F.col("kind") == "contradiction"
    none = F.lit(0).cast("long")
    worse = met.select(F.when(contra, older).otherwise(F.col("dst")).alias("fact_id"), "w", F.when(contra, F.col("bits")).otherwise(none).alias("c"), F.when(contra, none).otherwise(F.col("bits")).alias("s"))
    worse = worse.groupBy("fact_id", "w").agg(F.bit_or("c").alias("c"), F.bit_or("s").alias("s"))
    hit = lambda x, f: F.when(F.col(x).bitwiseAND(_bit()) != 0, f).otherwise(1.0)
    scored = boosted.withColumn("w", _word()).join(worse, ["fact_id", "w"], "left").select("query_id", "fact_id", (F.col("a") * hit("c", 0.5) * hit("s", 0.3)).alias("a"))
    top = scored.groupBy("query_id").agg(F.max("a").alias("top"))
    return scored.join(top, "query_id").select("query_id", "fact_id", (F.col("a") / F.col("top")).alias("score"))


SQL_ENTITY_GRAPH = f"""{_sql_activation()}, i AS (SELECT a3.*, community, created_at FROM a3 JOIN standing USING (fact_id)),
    sn AS (SELECT query_id, community, count(*) AS n FROM a0 JOIN standing USING (fact_id) GROUP BY query_id, community), sh AS (SELECT query_id, community, n / sum(n) OVER (PARTITION BY query_id)::DOUBLE AS k FROM sn),
    bo AS (SELECT i.query_id, fact_id, a * CASE WHEN k > 0 THEN least(1 + 0.15 * k, 1.3) ELSE 0.9 END AS a FROM i LEFT JOIN sh ON sh.query_id = i.query_id AND sh.community = i.community),
    me AS (SELECT x.query_id, src, dst, kind, x.created_at AS st, y.created_at AS dt FROM links JOIN i x ON x.fact_id = src JOIN i y ON y.fact_id = dst AND y.query_id = x.query_id WHERE kind IN ('contradiction', 'supersedes')),
    wo AS (SELECT DISTINCT query_id, CASE WHEN st < dt OR (st = dt AND src < dst) THEN src ELSE dst END AS fact_id FROM me WHERE kind = 'contradiction'),
    su AS (SELECT DISTINCT query_id, dst AS fact_id FROM me WHERE kind = 'supersedes'),
    gs AS (SELECT bo.query_id, bo.fact_id, a * CASE WHEN wo.fact_id IS NULL THEN 1.0 ELSE 0.5 END * CASE WHEN su.fact_id IS NULL THEN 1.0 ELSE 0.3 END AS a FROM bo
      LEFT JOIN wo ON wo.query_id = bo.query_id AND wo.fact_id = bo.fact_id LEFT JOIN su ON su.query_id = bo.query_id AND su.fact_id = bo.fact_id),
    eg AS (SELECT query_id, fact_id, a / max(a) OVER (PARTITION BY query_id) AS score FROM gs)"""


@query(
    "L8_entity_graph_channel",
    f"""WITH {SQL_ENTITY_GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM eg)
    SELECT query_id, fact_id, round(score, 6) AS score, rank FROM r WHERE rank <= 50""",
)
def l8_entity_graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entity_graph(views.queries(spark, sf_dir), views.facts(spark, sf_dir), links(spark, sf_dir), pageranks(spark, sf_dir))
    return best(found, 50).select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


@query(
    "L9_entity_rescore",
    f"""WITH {SQL_BM25}, {_sql_activation()}, c AS (SELECT query_id, fact_id, coalesce(a, 0) AS a FROM r LEFT JOIN a3 USING (query_id, fact_id) WHERE rank <= 30)
    SELECT query_id, fact_id, round(a / greatest(max(a) OVER (PARTITION BY query_id), 1e-9), 6) AS score FROM c""",
)
def l9_entity_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same activation for given candidates (the 30 best by keywords), over the largest among them; 0 if not reached."""
    asked, facts, edges = views.queries(spark, sf_dir), views.facts(spark, sf_dir), cut(links(spark, sf_dir))
    names, found, index = asked_names(asked), cut(mentions(facts)), name_index(facts)
    reached = activation(facts_of(names, index), names, found, index, both_ways(edges), standing(facts, pageranks(spark, sf_dir)))
    given = bm25(asked, facts, 30).select("query_id", "fact_id").join(reached, ["query_id", "fact_id"], "left")
    a = F.coalesce("a", F.lit(0.0))
    return given.select("query_id", "fact_id", F.round(a / F.greatest(F.max(a).over(W.partitionBy("query_id")), F.lit(1e-9)), 6).alias("score"))


@query(
    "L13_bridge_facts",
    f"""WITH {SQL_BM25}, top AS (SELECT query_id, fact_id, rank, lead(fact_id) OVER (PARTITION BY query_id ORDER BY rank) AS after FROM r WHERE rank <= 10),
    n AS (SELECT fact_id, list(DISTINCT name) AS names FROM mentions GROUP BY fact_id),
    br AS (SELECT query_id, top.fact_id AS a, after AS b, x.names AS xa, y.names AS xb FROM top JOIN n x ON x.fact_id = top.fact_id JOIN n y ON y.fact_id = after WHERE NOT list_has_any(x.names, y.names)),
    u AS (SELECT query_id, a, b, unnest(list_concat(xa, xb)) AS name FROM br),
    k AS (SELECT fact_id, name, row_number() OVER (PARTITION BY name ORDER BY fact_id) AS i FROM mentions),
    c AS (SELECT u.query_id, k.fact_id, u.a, u.b, count(DISTINCT u.name) AS overlap FROM u JOIN k ON k.name = u.name WHERE i <= 5 AND k.fact_id <> u.a AND k.fact_id <> u.b GROUP BY ALL),
    m AS (SELECT query_id, fact_id, max(least(1.0, 0.5 + 0.15 * overlap)) AS score FROM c WHERE (query_id, fact_id) NOT IN (SELECT (query_id, fact_id) FROM top) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS place FROM m) SELECT query_id, fact_id, round(score, 6)::DOUBLE AS score FROM o WHERE place <= 10""",
)
def l13_bridge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges between consecutive results without a common entity: up to five facts of each entity of either side,
    scored by how many of these entities they have; the ten best of a query that are not results already."""
    facts = views.facts(spark, sf_dir)
    results = bm25(views.queries(spark, sf_dir), facts, 10).select("query_id", "fact_id", "rank")
    return bridges(results, mentions(facts)).select("query_id", "fact_id", F.round("score", 6).alias("score"))


def bridges(results: DataFrame, named: DataFrame, most: int = 10) -> DataFrame:
    """The first five facts of a name are picked where it is read, before any shuffle (a limit on a rank within a key)."""
    named = named.select("fact_id", "name")
    ours = results.select("fact_id").distinct()
    sets = named.join(ours, "fact_id", "left_semi").groupBy("fact_id").agg(F.collect_set("name").alias("names"))
    pairs = results.select("query_id", F.col("fact_id").alias("a"), F.lead("fact_id").over(W.partitionBy("query_id").orderBy("rank")).alias("b")).where("b IS NOT NULL")
    pairs = pairs.join(sets.select(F.col("fact_id").alias("a"), F.col("names").alias("xa")), "a").join(sets.select(F.col("fact_id").alias("b"), F.col("names").alias("xb")), "b")
    open_ = pairs.where(~F.arrays_overlap("xa", "xb")).select("query_id", "a", "b", F.explode(F.array_distinct(F.concat("xa", "xb"))).alias("name"))
    few = named.withColumn("i", F.row_number().over(W.partitionBy("name").orderBy("fact_id"))).where("i <= 5").select("fact_id", "name")
    met = open_.join(few, "name").where("fact_id <> a AND fact_id <> b").groupBy("query_id", "fact_id", "a", "b").agg(F.countDistinct("name").alias("overlap"))
    scored = met.groupBy("query_id", "fact_id").agg(F.max(F.least(F.lit(1.0), 0.5 + 0.15 * F.col("overlap"))).alias("score"))
    return best(scored.join(results.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti"), most)


# --- query expansion -------------------------------------------------------------------------------------------------

SQL_EXPAND = f"""qe AS (SELECT query_id, text, {SQL_ENTITIES.replace('content', 'text')} AS e, {SQL_TOKENS.format('text')} AS t FROM queries),
    qw AS (SELECT query_id, lower(text) AS low, coalesce(e[1], '') AS entity, array_to_string(list_slice(list_filter(t, lambda w: NOT list_contains(list_transform(e, lambda x: lower(x)), w)), 1, 6), ' ') AS action FROM qe),
    ql AS (SELECT query_id, low, [trim(entity || ' ' || action), action, entity, trim(CASE WHEN entity <> '' THEN substr(entity, 1, 4) || '.' ELSE '' END || ' ' || action)] AS l FROM qw),
    qd AS (SELECT query_id, list_filter(l, lambda x, i: x <> '' AND lower(x) <> low AND list_position(l, x) = i) AS l FROM ql),
    qx AS (SELECT query_id, unnest(list_slice(l, 1, 3)) AS sub_query, generate_subscripts(list_slice(l, 1, 3), 1) AS n FROM qd)"""


def expand(queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, n, sub_query): up to three of: entity and action words, action words, entity, alias and action words.

    The entity is the first name of the query, its alias the name's abbreviation to four letters, and the action words
    are its first six other content words. Parts that are empty, repeated or the query itself are left out.
    """
    e, t = entities(F.col("text")), tokens("text")
    low = F.transform(e, lambda x: F.lower(x))
    action = F.array_join(F.slice(F.filter(t, lambda w: ~F.array_contains(low, w)), 1, 6), " ")
    entity = F.coalesce(F.get(e, F.lit(0)), F.lit(""))
    alias = F.when(entity != "", F.concat(F.substring(entity, 1, 4), F.lit("."))).otherwise("")
    forms = F.array_distinct(F.array(F.trim(F.concat_ws(" ", entity, action)), action, entity, F.trim(F.concat_ws(" ", alias, action))))
    kept = F.slice(F.filter(forms, lambda x: (x != "") & (F.lower(x) != F.lower("text"))), 1, most)
    return queries.select("query_id", F.posexplode(kept).alias("p", "sub_query")).select("query_id", (F.col("p") + 1).cast("long").alias("n"), "sub_query")


@query("E23_query_expand", f"WITH {SQL_EXPAND} SELECT query_id, n, sub_query FROM qx")
def e23_query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(views.queries(spark, sf_dir))


@query(
    "F19_agentic_merge",
    f"""WITH {SQL_BM25}, {SQL_EXPAND}, weak AS (SELECT query_id FROM r GROUP BY query_id HAVING max(score) < 60 OR count(*) < 5),
    q2 AS (SELECT DISTINCT query_id, n, unnest(list_distinct({SQL_TOKENS.format('sub_query')})) AS term FROM qx WHERE query_id IN (SELECT query_id FROM weak)),
    s2 AS (SELECT query_id, q2.n, p.fact_id, sum(ln(1 + (stats.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM q2 JOIN p ON q2.term = p.term JOIN df ON df.term = p.term JOIN l ON l.fact_id = p.fact_id CROSS JOIN stats GROUP BY query_id, q2.n, p.fact_id),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY round(score, 9) DESC, fact_id) AS rank FROM s2),
    u AS (SELECT query_id, fact_id, score FROM r WHERE rank <= 20 UNION ALL SELECT query_id, fact_id, score FROM r2 WHERE rank <= 20),
    m AS (SELECT query_id, fact_id, max(score) AS score FROM u GROUP BY query_id, fact_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM m)
    SELECT query_id, fact_id, round(score, 6) AS score, rank FROM o WHERE rank <= 20""",
)
def f19_agentic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round for queries whose first is weak (best score under 60, or under five hits): their expanded queries
    are searched too, and of both rounds the best score of a fact counts."""
    found = agentic_merge(views.queries(spark, sf_dir), views.facts(spark, sf_dir), 20)
    return found.select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


def agentic_merge(asked: DataFrame, facts: DataFrame, k: int, enough: float = 60.0, hits: int = 5) -> DataFrame:
    """(query_id, fact_id, score, rank): the k best of both rounds; asked: (query_id, text)."""
    first = cut(bm25(asked, facts, k))
    weak = first.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("hits")).where((F.col("top") < enough) | (F.col("hits") < hits)).select("query_id")
    more = expand(asked).join(weak, "query_id", "left_semi")
    again = bm25(more.select((F.col("query_id") * 4 + F.col("n")).alias("query_id"), F.col("sub_query").alias("text")), facts, k)
    again = again.select(F.floor(F.col("query_id") / 4).alias("query_id"), "fact_id", "score")
    both = first.select("query_id", "fact_id", "score").union(again).groupBy("query_id", "fact_id").agg(F.max("score").alias("score"))
    return best(both, k)


# --- resolution ------------------------------------------------------------------------------------------------------

#: Mentions are typed names of customers; entities are customers (their canonical names), aliases their short forms.
_MENTION = "CASE custkey % 5 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN 'Cust ' || custkey::VARCHAR WHEN 3 THEN replace(name, '00', '0') ELSE 'he' END"
NO_MENTION = ["he", "she", "it", "they", "we", "you", "i", "this", "that", "user", "assistant"]


def resolve(mentioned: DataFrame, canonical: DataFrame, aliases: DataFrame, least: float = 0.85) -> DataFrame:
    """(mention, entity_id, how): exact, else alias, else the most similar name by Jaro-Winkler >= `least`, else new.

    mentioned: (mention string), canonical: (entity_id, name), aliases: (entity_id, alias). Pronouns, names of up to two or
    over 100 letters and version numbers are no mentions. Names meet only those that by their letters can be the most
    similar ones; see `most_similar`.
    """
    low = F.lower(F.trim("mention"))
    asked = mentioned.select("mention", low.alias("key")).distinct()
    asked = asked.where((F.length("key") > 2) & (F.length("key") <= 100) & ~F.col("key").isin(NO_MENTION) & ~F.col("key").rlike(r"^v?[0-9]+(\.[0-9]+)*$"))
    exact = canonical.groupBy(F.lower("name").alias("key")).agg(F.min("entity_id").alias("exact"))
    by_alias = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min("entity_id").alias("alias"))
    known = asked.join(exact, "key", "left").join(by_alias, "key", "left")
    left = known.where("exact IS NULL AND alias IS NULL").select("key")
    names = canonical.groupBy(F.lower("name").alias("name")).agg(F.min("entity_id").alias("entity_id")).where("name <> ''")
    fuzzy = most_similar(left.select(F.col("key").alias("name")).distinct(), names, least).select(F.col("a").alias("key"), F.col("entity_id").alias("fuzzy"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("new")
    return known.join(fuzzy, "key", "left").select("mention", F.coalesce("exact", "alias", "fuzzy").alias("entity_id"), how.alias("how"))


@query(
    "J14_entity_resolve",
    f"""WITH RECURSIVE c AS (SELECT c_custkey AS custkey, c_name AS name FROM customer), m AS (SELECT DISTINCT {_MENTION} AS mention FROM c), k AS (SELECT mention, lower(trim(mention)) AS key FROM m),
    a AS (SELECT * FROM k WHERE length(key) > 2 AND length(key) <= 100 AND NOT list_contains({sql_list(NO_MENTION)}, key) AND NOT regexp_matches(key, '^v?[0-9]+(\\.[0-9]+)*$')),
    x AS (SELECT lower(name) AS key, min(custkey) AS exact FROM c GROUP BY 1), y AS (SELECT lower('cust ' || custkey::VARCHAR) AS key, min(custkey) AS alias FROM c GROUP BY 1),
    j AS (SELECT a.*, exact, alias FROM a LEFT JOIN x USING (key) LEFT JOIN y USING (key)),
    f0 AS (SELECT key, custkey, lower(name) AS name, jaro_winkler_similarity(key, lower(name)) AS s FROM (SELECT DISTINCT key FROM j WHERE exact IS NULL AND alias IS NULL) CROSS JOIN c),
    f1 AS (SELECT key, custkey, name, greatest(length(key), length(name)) // 2 - 1 AS r FROM f0 QUALIFY s >= max(s) OVER (PARTITION BY key) - 0.03),
    st AS (SELECT *, 1 AS i, []::BIGINT[] AS used, '' AS hits FROM f1 UNION ALL SELECT key, custkey, name, r, i + 1, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, CASE WHEN h IS NULL THEN hits ELSE hits || substr(key, i, 1) END
      FROM (SELECT *, list_filter(range(greatest(1, i - r), least(length(name), i + r) + 1), lambda x: substr(name, x::INT, 1) = substr(key, i, 1) AND NOT list_contains(used, x))[1] AS h FROM st WHERE i <= length(key))),
    f2 AS (SELECT key, custkey, name, len(used) AS m, list_sum(list_transform(range(1, len(used) + 1), lambda x: (substr(hits, x::INT, 1) <> substr(name, list_sort(used)[x]::INT, 1))::INT)) / 2 AS moved FROM st WHERE i = length(key) + 1 AND len(used) > 0),
    f3 AS (SELECT key, custkey, (m / length(key) + m / length(name) + (m - moved) / m) / 3 AS jaro, list_sum(list_transform([1, 2, 3, 4], lambda x: (x <= least(length(key), length(name)) AND substr(key, x, 1) = substr(name, x, 1))::INT)) AS same FROM f2),
    f AS (SELECT key, custkey, jaro + 0.1 * same * (1 - jaro) AS s FROM f3),
    b AS (SELECT key, custkey, row_number() OVER (PARTITION BY key ORDER BY round(s, 9) DESC, custkey) AS n FROM f WHERE s >= 0.85)
    SELECT mention, coalesce(exact, alias, b.custkey) AS entity_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' WHEN b.custkey IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS how FROM j LEFT JOIN b ON b.key = j.key AND n = 1""",
)
def j14_entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    aliases = people.select(F.col("custkey").alias("entity_id"), F.concat(F.lit("Cust "), F.col("custkey").cast("string")).alias("alias"))
    k = F.col("custkey") % 5
    form = F.when(k == 0, F.col("name")).when(k == 1, F.upper("name")).when(k == 2, F.concat(F.lit("Cust "), F.col("custkey").cast("string")))
    form = form.when(k == 3, F.replace("name", F.lit("00"), F.lit("0"))).otherwise("he")
    return resolve(people.select(form.alias("mention")), people.select(F.col("custkey").alias("entity_id"), "name"), aliases)


@query(
    "J15_merge_entities",
    """WITH k AS (SELECT name, min(name) OVER (PARTITION BY substr(lower(name), 1, 5)) AS keeper FROM (SELECT DISTINCT name FROM mentions)),
    f AS (SELECT fact_id, list_sort(list_distinct(list(keeper))) AS names, count(*) AS before FROM mentions JOIN k USING (name) GROUP BY fact_id)
    SELECT fact_id, array_to_string(names, '|') AS names, len(names)::BIGINT AS after, before FROM f""",
)
def j15_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts re-pointed from merged entities to their keeper, each keeper once. Here names that begin alike are one."""
    found = mentions(views.facts(spark, sf_dir))
    names = found.select("name").distinct().withColumn("stem", F.substring(F.lower("name"), 1, 5))
    keepers = names.join(names.groupBy("stem").agg(F.min("name").alias("keeper")), "stem").select("name", "keeper")
    merged = found.join(keepers, "name").groupBy("fact_id").agg(F.array_sort(F.collect_set("keeper")).alias("names"), F.count("*").alias("before"))
    return merged.select("fact_id", F.array_join("names", "|").alias("names"), F.size("names").cast("long").alias("after"), "before")


# --- compiled texts --------------------------------------------------------------------------------------------------

SQL_FIRST_SENTENCE = r"trim(coalesce(string_split_regex(content, '[.!?\n]+')[1], ''))"


@query(
    "A35_entity_compile",
    f"""WITH m AS (SELECT name, n.fact_id, session_id AS community, confidence, pr, {SQL_FIRST_SENTENCE} AS s FROM mentions n JOIN facts USING (fact_id) JOIN standing USING (fact_id) WHERE name IN (SELECT name FROM mentions GROUP BY name HAVING count(*) >= 3)),
    t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(pr, 12) DESC, confidence DESC, fact_id) AS k FROM m),
    c AS (SELECT *, row_number() OVER (PARTITION BY name, community ORDER BY k) AS nth FROM t WHERE k <= 50),
    d AS (SELECT *, row_number() OVER (PARTITION BY name, s ORDER BY k) AS seen FROM c WHERE nth <= 3 AND s <> ''),
    u AS (SELECT *, sum(length(s) + 2) OVER (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE seen = 1),
    x AS (SELECT name, string_agg(s || '.', ' ' ORDER BY k) AS text FROM u WHERE used <= 2000 GROUP BY name), y AS (SELECT name, avg(confidence) AS confidence, count(*) AS facts FROM t WHERE k <= 50 GROUP BY name)
    SELECT name, facts, round(confidence, 6) AS confidence, md5(coalesce(text, '')) AS text_md5 FROM y LEFT JOIN x USING (name)""",
)
def a35_entity_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled text of each entity with three facts or more: of its 50 facts by rank and confidence the first
    sentences, up to three of each community, each once, up to 2,000 characters at a sentence's end; mean confidence."""
    facts = views.facts(spark, sf_dir)
    named = mentions(facts)
    able = named.join(named.groupBy("name").agg(F.count("*").alias("n")).where("n >= 3"), "name")
    first = F.trim(F.get(F.split("content", r"[.!?\n]+"), F.lit(0)))
    info = standing(facts, pageranks(spark, sf_dir)).join(facts.select("fact_id", "confidence", F.coalesce(first, F.lit("")).alias("s")), "fact_id")
    by = lambda *keys, order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    top = able.join(info, "fact_id").withColumn("k", by("name", order=[F.round("pr", 12).desc(), F.desc("confidence"), "fact_id"])).where("k <= 50")
    spread = top.withColumn("nth", by("name", "community", order=["k"])).where("nth <= 3 AND s <> ''").withColumn("seen", by("name", "s", order=["k"])).where("seen = 1")
    used = spread.withColumn("used", F.sum(F.length("s") + 2).over(W.partitionBy("name").orderBy("k").rowsBetween(W.unboundedPreceding, 0))).where("used <= 2000")
    parts = used.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("s", F.lit(".")).alias("t")))).alias("x"))
    text = F.md5(F.coalesce(F.array_join(F.transform("x", lambda z: z["t"]), " "), F.lit("")))
    mean = top.groupBy("name").agg(F.count("*").alias("facts"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return mean.join(parts, "name", "left").select("name", "facts", "confidence", text.alias("text_md5"))


FORESIGHT = phrase_pattern(["will", "going to", "plan to", "next week", "next month", "tomorrow", "upcoming", "scheduled", "deadline"])


@query("E10_foresight", f"SELECT fact_id, unnest({SQL_ENTITIES}) AS entity, created_at AS observed_at FROM annotated WHERE regexp_matches(content, {sql_text(FORESIGHT)})")
def e10_foresight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event row for each entity of a text that speaks of the future."""
    ahead = annotated(spark, sf_dir).where(F.col("content").rlike(FORESIGHT))
    return ahead.select("fact_id", F.explode(entities(F.col("content"))).alias("entity"), F.col("created_at").alias("observed_at"))


@query(
    "A36_session_close",
    """WITH e AS (SELECT session_id, turn, content, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) AS entity FROM turns), d AS (SELECT DISTINCT session_id, entity, turn, content FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, entity ORDER BY turn) AS n FROM d)
    SELECT session_id, entity, count(*) AS turns, md5(string_agg(CASE WHEN n <= 5 THEN substr(content, 1, 80) END, ' | ' ORDER BY n)) AS summary_md5 FROM r GROUP BY session_id, entity""",
)
def a36_session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary event for each session and entity: the first five turns that name it, 80 characters each."""
    return session_summaries(views.turns(spark, sf_dir)).select("session_id", "entity", "turns", F.md5("summary").alias("summary_md5"))


def session_summaries(turns: DataFrame) -> DataFrame:
    names = F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Z][a-z]+"), F.lit(0)))
    each = turns.select("session_id", "turn", F.substring("content", 1, 80).alias("t"), F.explode(names).alias("entity"))
    got = each.groupBy("session_id", "entity").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("x"))
    return got.select("session_id", "entity", "turns", F.array_join(F.transform(F.slice("x", 1, 5), lambda z: z["t"]), " | ").alias("summary"))
