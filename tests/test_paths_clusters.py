"""Similar names, intervals, chains, paths, scenes, clusters and draws against brute force and cases by hand."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import clusters, intervals, paths, similarity


def slow_jaro_winkler(s: str, t: str) -> float:
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    used, hit = [False] * len(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == c:
                used[j] = True
                hit.append(c)
                break
    if not hit:
        return 0.0
    moved = sum(x != y for x, y in zip(hit, (c for c, u in zip(t, used, strict=True) if u), strict=True)) / 2
    m = len(hit)
    jaro = (m / len(s) + m / len(t) + (m - moved) / m) / 3
    prefix = sum(x == y for x, y in zip(s[:4], t[:4], strict=False))
    return jaro + 0.1 * prefix * (1 - jaro)


def names(n: int) -> list[str]:
    rng = np.random.default_rng(n)
    base = ["martha jones", "dwayne", "o'neill", "ana", "x", "jean-luc picard", "élodie", "aaaa"]
    out = set(base)
    while len(out) < n:
        w = list(base[int(rng.integers(0, len(base)))])
        for _ in range(int(rng.integers(1, 4))):
            at = int(rng.integers(0, len(w) + 1))
            w[at : at + int(rng.integers(0, 2))] = "abcdexyz"[int(rng.integers(0, 8))]
        if w:
            out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_similar_names_lose_no_pair(spark, least):
    left, right = names(70), names(90)
    got = {(r.a, r.b): r.similarity for r in similarity.similar_names(*(spark.createDataFrame([(x,) for x in z], "name string") for z in (left, right)), least).collect()}
    want = {(a, b): s for a in left for b in right if (s := slow_jaro_winkler(a, b)) >= least}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 40


def test_similarity_of_nothing(spark):
    assert similarity.jaro_winkler([], []).size == 0
    assert similarity.jaro_winkler(["", "a", ""], ["a", "", ""]).tolist() == [0, 0, 0]
    none, one = spark.createDataFrame([], "name string"), spark.createDataFrame([("x",)], "name string")
    assert similarity.similar_names(none, one).count() == 0 == similarity.similar_names(one, none).count()


D = dt.date


@pytest.mark.parametrize(("reach", "width", "parts"), [(0, 32, 1), (40, 7, 3), (365, 32, 2)])
def test_spans_meet_instants_once(spark, reach, width, parts):
    rng = np.random.default_rng(reach)
    day = lambda k: D(2000, 1, 1) + dt.timedelta(int(k))
    asked = [(i, day(rng.integers(0, 900))) for i in range(25)]
    spans = [(i, day(a := rng.integers(-300, 1200)), None if i % 5 == 0 else day(a + rng.integers(0, 200))) for i in range(60)]
    got = sorted((r.query_id, r.fact_id, r.apart) for r in intervals.near_spans(spark.createDataFrame(asked, "query_id long, at date"), spark.createDataFrame(spans, "fact_id long, first date, last date"), reach, width, parts).collect())
    want = []
    for (q, at), (f, first, last) in itertools.product(asked, spans):
        apart = max((first - at).days, 0 if last is None else (at - last).days, 0)
        if apart <= reach:
            want.append((q, f, apart))
    assert got == sorted(want) and want


def test_temporal_scores_by_hand(spark):
    rows = [(1, D(2020, 1, 31), None, None, None), (2, None, D(2020, 1, 31), None, None), (3, None, None, D(2019, 12, 1), D(2020, 2, 1)), (4, None, None, D(2020, 1, 31), D(2020, 5, 1)), (5, D(2018, 1, 1), None, D(2021, 5, 1), D(2021, 4, 1)), (6, D(2020, 1, 1), D(2020, 1, 31), None, D(2020, 1, 1))]
    events = spark.createDataFrame(rows, "fact_id long, observed date, referenced date, begins date, ends date")
    got = {r.fact_id: r.score for r in intervals.temporal_channel(spark.createDataFrame([(7, D(2020, 1, 1))], "query_id long, at date"), events).collect()}
    e = np.exp(-0.5)
    assert got == {k: pytest.approx(v) for k, v in {1: 0.8 * e, 2: e, 3: 1.0, 4: 0.9 * e, 6: 0.8}.items()}


def chain_rows(spark, pairs):
    return sorted(tuple(r) for r in paths.collapse_chains(spark.createDataFrame(pairs, "src long, dst long")).collect())


def test_chains_collapse_to_their_heads(spark):
    assert chain_rows(spark, [(i, i + 1) for i in range(10)]) == [(0, i) for i in range(1, 11)]
    assert chain_rows(spark, [(1, 3), (2, 3), (3, 4), (4, 5), (3, 3)]) == [(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5)]
    assert chain_rows(spark, [(1, 2), (2, 3), (3, 2), (3, 4)]) == [(1, 2), (1, 3), (1, 4)]  # a ring behind a head
    assert chain_rows(spark, [(5, 6), (6, 5), (6, 7)]) == [(5, 6), (6, 5), (6, 7)]  # a ring without one
    assert chain_rows(spark, [(1, 1)]) == []
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(x)) for x in rng.integers(0, 40, (60, 2)).tolist() if x[0] != x[1]}
    heads, want = {a for a, _ in pairs} - {b for _, b in pairs}, set()
    for h in heads:
        todo = [h]
        while todo:
            x = todo.pop()
            new = {b for a, b in pairs if a == x} - {b for a, b in want if a == h}
            want |= {(h, b) for b in new}
            todo += new
    assert chain_rows(spark, sorted(pairs)) == sorted(want)


def test_shortest_paths_edge_by_edge(spark):
    rng = np.random.default_rng(9)
    edges = sorted({tuple(sorted(x)) for x in rng.integers(0, 60, (75, 2)).tolist() if x[0] != x[1]})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 62, (40, 2))] + [(3, 3)]
    want = {}
    for a, b in set(pairs):
        far, front = {a: 0}, [a]
        for x in front:
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    front.append(y)
        if far.get(b, 99) <= 5:
            want[a, b] = far[b]
    got = {(r.a, r.b): r for r in paths.shortest_paths(spark.createDataFrame(sorted(set(pairs)), "a long, b long"), spark.createDataFrame(edges, "src long, dst long"), 5).collect()}
    assert {k: r.hops for k, r in got.items()} == want and len(want) > 10
    for (a, b), r in got.items():
        assert r.path[0] == a and r.path[-1] == b and len(r.path) == r.hops + 1 and all(y in near[x] for x, y in itertools.pairwise(r.path))


def test_two_batches_give_the_scenes_of_one(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:5]
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(40)] + [(99, (-np.ones(8)).tolist())]
    frame = lambda some, name: spark.createDataFrame(some, f"{name} long, vec array<double>")
    themes = frame([(1000, centres[0].tolist())], "scene")
    whole = {r.fact_id: r.scene for r in clusters.assign_scenes(frame(rows, "fact_id"), themes).collect()}
    first = clusters.assign_scenes(frame(rows[:20], "fact_id"), themes).collect()
    vec = dict(rows)
    new = frame([(1000, centres[0].tolist()), *((s, vec[s]) for s in sorted({r.scene for r in first if not r.known}))], "scene")
    both = {r.fact_id: r.scene for r in first} | {r.fact_id: r.scene for r in clusters.assign_scenes(frame(rows[20:], "fact_id"), new).collect()}
    assert both == whole and whole[99] == 99 and whole[5] == 1000 and whole[6] == whole[11] == 1
    assert clusters.assign_scenes(frame(rows[:1], "fact_id"), themes).first().scene == 1000


@pytest.mark.parametrize("least", [1, 2])
def test_components_of_shared_names(spark, least):
    rng = np.random.default_rng(least)
    sets = {i: {f"n{int(k)}" for k in rng.integers(0, 40 if least == 2 else 150, int(rng.integers(1, 6)))} for i in range(40)}
    label = {i: i for i in sets}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least]
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    rows = [(i, n) for i, s in sets.items() for n in s]
    got = {r.fact_id: r.cluster for r in clusters.shared_components(spark.createDataFrame(rows, "fact_id long, name string"), least).collect()}
    assert got == {i: label[i] for i in {x for p in linked for x in p}} and 3 < len(got)


def test_sessions_part_at_gaps(spark):
    days = [0, 1, 8, 15.5, 16, 40, 40, 47.5]
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for i, d in enumerate(days)] + [(2, 50, dt.datetime(2024, 1, 1))]
    got = {r.fact_id: r.session for r in clusters.gap_sessions(spark.createDataFrame(rows, "cluster long, fact_id long, created_at timestamp")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 50: 0}


def test_draws_are_beta_and_the_same_everywhere(spark):
    ids, arms = np.arange(20_000), np.arange(3)
    alpha, beta = np.array([1.0, 3.0, 40.0]), np.array([1.0, 5.0, 10.0])
    draws = clusters.beta_draws(ids, arms, alpha, beta, 7)
    mean, var = alpha / (alpha + beta), alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1))
    assert np.allclose(draws.mean(axis=0), mean, atol=5 * np.sqrt(var / len(ids)).max()) and np.allclose(draws.var(axis=0), var, rtol=0.06)
    assert np.abs(np.corrcoef(draws.T) - np.eye(3)).max() < 0.03 and (draws != clusters.beta_draws(ids, arms, alpha, beta, 8)).all()
    table = spark.createDataFrame([(s, f"arm{a}", 1.0 + a, 2.0 + s) for s in range(2) for a in range(4)], "stratum long, arm string, alpha double, beta double")
    asked = spark.range(3000).select(F.col("id").alias("query_id"), (F.col("id") % 3).alias("stratum"))
    one, eight = (sorted(map(tuple, clusters.choose_arms(asked.repartition(n), table).collect())) for n in (1, 8))
    assert one == eight and len(one) == 2000 and len({r[1] for r in one}) == 4


@pytest.mark.parametrize(("least", "block"), [(0.7, 7), (0.85, 40), (0.95, 1000)])
def test_most_similar_is_the_best_of_all_pairs(spark, least, block):
    left, right = [*names(60), "anna", "nana", "ab", "𝔞na"], [*names(90), "anan", "naan", "ba", "𝔞an"]
    ids = {x: int(i) for x, i in zip(right, np.random.default_rng(7).permutation(len(right)), strict=True)}
    frames = spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame(list(ids.items()), "name string, entity_id long")
    got = {r.a: (r.similarity, r.entity_id) for r in similarity.most_similar(*frames, least, block).collect()}
    want = {}
    for a in left:
        s, i = max((round(slow_jaro_winkler(a, b), 9), -ids[b]) for b in right)
        if s >= least:
            want[a] = (pytest.approx(s), -i)
    assert got == want and len(want) > 20


def test_most_similar_compares_few_of_many_names_alike(spark, monkeypatch):
    seen, scored = [], similarity._scored
    monkeypatch.setattr(similarity, "_scored", lambda met, least: seen.append(met.count()) or scored(met, least))
    left = spark.range(200).select(F.format_string("customer#0%05d", F.col("id") * 37 % 10_000).alias("name"))
    right = spark.range(10_000).select(F.format_string("customer#0000%05d", "id").alias("name"), F.col("id").alias("entity_id"))
    rows = similarity.most_similar(left, right).collect()
    assert len(rows) == 200 and sum(seen) < 200_000  # all pairs: 2,000,000, nearly all of them alike enough
