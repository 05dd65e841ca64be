"""The stored index, places in a group, pairs in blocks, and the codec that is searched, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram import views
from engram.catalog import QUERIES
from engram.operators import codec, entities, index, lexical, vectors

FACTS = "fact_id long, content string, created_at timestamp"


def test_index_splits_hot_keys(spark):
    rows = [(i, ["common"] * (1 + i % 2) + [f"rare{i % 7}"]) for i in range(100)] + [(200, [])]
    built = index.build(spark.createDataFrame(rows, "fact_id long, keys array<string>"), part_rows=10)
    got = {(r.key, r.fact_id): (r.tf, r.length) for r in built.postings.collect()}
    assert got == {(k, i): (keys.count(k), len(keys)) for i, keys in rows for k in set(keys)}
    assert {(r.key, r.df) for r in built.keys.collect()} == {("common", 100), *((f"rare{k}", 15 if k < 2 else 14) for k in range(7))}
    sizes = built.postings.where("key = 'common'").groupBy("part").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 25
    stats = built.stats.first()
    assert stats.n == 101 and stats.mean == pytest.approx(250 / 101)
    asked = spark.createDataFrame([(1, "common"), (1, "rare3"), (2, "none")], "query_id long, key string")
    assert index.look_up(asked, built).count() == 100 + 14


def test_postings_are_read_without_an_exchange(spark):
    rows = spark.createDataFrame([(i, [f"k{i % 50}", f"k{i % 9}"]) for i in range(400)], "fact_id long, keys array<string>")
    built = index.build(rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(i, f"k{i}") for i in range(60)], "query_id long, key string")
        plan = index.look_up(asked, built)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "engram_postings" in x)
    assert "Bucketed: true" in lines[scan]
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :|+-"))
    above = [x for i, x in enumerate(lines[:scan]) if len(x) - len(x.lstrip(" :|+-")) < depth]
    join = max(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[join:])  # between the join and the postings


def test_an_index_is_built_once(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    first = lexical.term_index(facts)
    assert lexical.term_index(views.facts(spark, sf_dir)) is first
    assert lexical.term_index(facts.where("fact_id < 50")) is not first
    assert "fact_id" in first.postings.columns


def test_keywords_of_small_tables(spark):
    """Scores by hand; parts of a hot term change none."""
    texts = [(1, "old bridge old"), (2, "the bridge"), (3, "river"), (4, ""), (5, None)]
    facts = spark.createDataFrame([(i, t, None) for i, t in texts], FACTS)
    asked = spark.createDataFrame([(9, "Old BRIDGE the"), (10, ""), (11, "nothing here")], "query_id long, text string")
    got = {(r.query_id, r.fact_id): r.score for r in lexical.bm25(asked, facts, 5).collect()}
    n, mean = 5, 5 / 4  # a null text counts, but has no length
    idf = lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    w = lambda tf, length, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == {(9, 1): pytest.approx(w(2, 3, 1) + w(1, 3, 2)), (9, 2): pytest.approx(w(1, 1, 2))}


@pytest.mark.parametrize("every", [1, 3])
def test_places_count_what_comes_before(spark, every):
    rng = np.random.default_rng(every)
    rows = [(f"g{int(g)}" if g < 5 else "hot", int(t), i) for i, (g, t) in enumerate(zip(rng.integers(0, 20, 400), rng.integers(0, 50, 400), strict=True))]
    frame = spark.createDataFrame(rows, "name string, at long, fact_id long").repartition(5)
    got = {r.fact_id: r.place for r in index.places(frame, "name", ["at", "fact_id"], F.col("fact_id") % every == 0).collect()}
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        n = 0
        for _, _, i in group:
            assert got[i] == n
            n += i % every == 0


def test_pairs_in_blocks_are_all_pairs(spark):
    rows = [("hot", i) for i in range(90)] + [("a", 3), ("a", 500), ("b", 3), ("lone", 7)]
    got = sorted((r.a, r.b) for r in entities.pairs_within(spark.createDataFrame(rows, "name string, fact_id long"), block=12).collect())
    assert got == sorted({*itertools.combinations(range(90), 2), (3, 500)})


def test_mates_skip_hubs_and_look_back_five(spark):
    facts = spark.createDataFrame([(i, "we saw Anna there." if i != 6 else "we saw nobody.", None) for i in range(12)], FACTS)
    facts = facts.withColumn("created_at", F.timestamp_seconds(F.col("fact_id") * 60))
    edges = spark.createDataFrame([(4, 1000 + i, 1.0) for i in range(250)], "src long, dst long, weight double")
    got = {}
    for r in entities.earlier_mates(facts, edges).collect():
        got.setdefault(r.fact_id, set()).add(r.other)
    assert got[11] == {10, 9, 8, 7, 5} and got[5] == {3, 2, 1, 0} and 6 not in got and 0 not in got


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_centroids_beat_a_uniform_grid(bits):
    x = np.random.default_rng(bits).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius, packed, signs, rest = codec.encode(3 * x, bits)
    assert packed.shape == (400, 8 * bits) and (signs is None) == (bits == 8) and np.allclose(radius, 3)
    mine = np.linalg.norm(codec.decode(np.ones(400), packed, bits, 64) - x, axis=1)
    assert np.allclose(mine, rest)
    flat, steps = x @ codec.projections(64)[0], (1 << bits) - 1
    for reach in np.linspace(1.5, 6, 10) / 8:  # whatever the width of the grid
        grid = np.linalg.norm((np.clip(np.rint((flat / reach + 1) / 2 * steps), 0, steps) / steps * 2 - 1) * reach - flat, axis=1)
        assert (mine**2).mean() < (grid**2).mean()
    book = codec.centroids(bits, 64)
    assert np.allclose(book, -book[::-1], atol=1e-3) and (np.diff(book) > 0).all()
    assert (codec.unpack(codec.pack(np.arange(64)[None] % (1 << bits), bits), bits, 64) == np.arange(64) % (1 << bits)).all()


def test_signs_correct_the_codes():
    x = np.random.default_rng(2).normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, packed, signs, rest = codec.encode(x, 2)
    true = x[:40] @ x.T
    plain, better = (codec.packed_similarity(x[:40], packed, 2, s, rest) for s in (None, signs))
    assert ((better - true) ** 2).mean() < 0.8 * ((plain - true) ** 2).mean()


def test_codes_of_odd_vectors(spark):
    rows = [(1, [0.0] * 8, 4), (2, [1e6] + [0.0] * 7, 2), (3, None, 4), (4, [1.0] * 8, 8)]
    got = {r.fact_id: r for r in codec.quantize(spark.createDataFrame(rows, "fact_id long, vec array<double>, bits int")).collect()}
    assert sorted(got) == [1, 2, 4] and got[1].radius == 0 and np.isfinite(got[2].radius) and got[4].signs is None
    assert codec.quantize(spark.createDataFrame([], "fact_id long, vec array<double>, bits int")).count() == 0


def exact(spark, sf_dir, factor=lambda i: 1.0):
    rows = views.vectors(spark, sf_dir).select("fact_id", "vec").orderBy("fact_id").collect()
    ids, x = np.array([r.fact_id for r in rows]), np.array([r.vec for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x[ids % 20 == 0] @ x.T) * np.array([factor(i) for i in ids.tolist()])
    return {(int(q), int(ids[j])) for q, row in zip(ids[ids % 20 == 0], s, strict=True) for j in np.argsort(-row, kind="stable")[:10]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_coarse_search(spark, sf):
    """A twentieth of the vectors is read for a query, and nine tenths of its ten nearest are among them."""
    at = f"/root/testdata/{sf}"
    facts, asked = views.vectors(spark, at).select("fact_id", "vec"), vectors.query_vectors(spark, at)
    codes = codec.quantize(facts.withColumn("bits", F.lit(2)))
    true = exact(spark, at)
    found = {(r.query_id, r.fact_id) for r in codec.coarse_topk(asked, facts, codes, 10, again=10 if sf == "sf0.1" else 5).collect()}
    assert len(found & true) >= 0.9 * len(true)
    assert (100 if sf == "sf0.1" else 50) < 0.2 * facts.count()


def test_recall_of_mixed_precision(spark):
    at = "/root/testdata/sf0.1"
    tier = {r.fact_id: r.lifecycle for r in views.facts(spark, at).select("fact_id", "lifecycle").collect()}
    zone = {r.fact_id: r.zone for r in codec._retention(spark, at).select("fact_id", "zone").collect()}
    def factor(i):
        if tier[i] in ("active", "warm"):
            return codec.FULL if tier[i] == "active" else codec.BYTE
        return -9.0 if zone.get(i) == "forgotten" else codec.PACKED
    true = exact(spark, at, factor)
    found = {(r.query_id, r.fact_id) for r in codec.mixed_search(vectors.query_vectors(spark, at), *codec.tiers(spark, at), 10).collect()}
    shown = {(q, f) for q, f in true if factor(f) > 0}
    assert len(found & shown) >= 0.85 * len(shown)


@pytest.mark.parametrize("block", [5, 17, 3000])
def test_apart_within_is_all_pairs_of_a_name(spark, block):
    rng = np.random.default_rng(block)
    rows = sorted({(f"n{int(k)}", int(f) * 10**12) for k, f in zip(rng.integers(0, 12, 150), rng.integers(-20, 40, 150), strict=True)} | {("all", f * 10**12) for f in range(6)})
    facts = sorted({f for _, f in rows})
    vec = {f: [0.0] * 3 if i % 9 == 0 else [float(x) for x in rng.integers(-3, 4, 3)] for i, f in enumerate(facts)}
    vec.pop(facts[4])
    got = {}
    for r in entities.apart_within(spark.createDataFrame(rows, "name string, fact_id long"), spark.createDataFrame(list(vec.items()), "fact_id long, vec array<float>"), block).collect():
        assert (r.a, r.b) not in got
        got[r.a, r.b] = r.severity
    want = {}
    for a, b in {(a, b) for n, a in rows for m, b in rows if n == m and a < b and a in vec and b in vec}:
        x, y = np.array(vec[a]), np.array(vec[b])
        size = np.linalg.norm(x) + np.linalg.norm(y)
        if size:
            want[a, b] = pytest.approx(np.linalg.norm(x - y) / size, abs=1e-7)
    assert got == want and want


def test_sheaf_batch_shuffles_facts_not_pairs(spark, sf_dir, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(entities, "pairs_within", refuse)
    assert QUERIES["J8_sheaf_batch"][0](spark, sf_dir).count() > 0
