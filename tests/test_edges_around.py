"""Edges near some nodes against all edges, and that queries which walk from a few nodes pair the lines of no others."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from engram import views
from engram.operators import codegraph, graph

CHAIN = [(o, p) for o in range(60) for p in (o, o + 1, o + 1)] + [(100 + o, p) for o in range(8) for p in (o, o + 1, 500 + o)]


@pytest.fixture
def sparse(tmp_path):
    """Parts in a chain of orders, some of them bought together again, and a few more beside them."""
    pq.write_table(pa.table({"l_orderkey": [o for o, _ in CHAIN], "l_partkey": [p for _, p in CHAIN]}), tmp_path / "lineitem.parquet")
    rng = np.random.default_rng(5)
    vectors = pa.array(rng.normal(size=(41, 4)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": range(41), "embedding": vectors, "label": [0] * 41}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def edge_rows(df):
    return sorted((r.src, r.dst, r.weight, r.edge_type) for r in df.collect())


@pytest.mark.parametrize("hops", [0, 1, 2, 5])
def test_edges_around_are_all_edges_near(spark, sparse, hops):
    every = edge_rows(views.edges(spark, sparse))
    near = {3, 40}
    for _ in range(hops):
        near |= {b for x in every for a, b in ((x[0], x[1]), (x[1], x[0])) if a in near}
    nodes = spark.createDataFrame([(3,), (40,), (40,), (999,)], "node long")
    got = edge_rows(graph.edges_around(spark, sparse, nodes, hops))
    assert got == [x for x in every if x[0] in near or x[1] in near] and len(got) < len(every)


def test_many_parts_take_all_edges(spark, sparse, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 5)
    got = graph.edges_around(spark, sparse, spark.createDataFrame([(3,), (40,)], "node long"), 2)
    assert edge_rows(got) == edge_rows(views.edges(spark, sparse))


def near_only(monkeypatch):
    """What the query hands to the walk, and an error where all edges are asked for."""

    def refuse(*_):
        raise AssertionError("all edges are read")

    monkeypatch.setattr(views, "edges", refuse)


def test_hop_decay_walks_near_edges(spark, sparse, monkeypatch):
    every = edge_rows(views.edges(spark, sparse))
    near_only(monkeypatch)
    want = {}
    for q in (0, 20, 40):
        front = {q}
        for hop in (1, 2, 3):
            step = {}
            for s, d, w, _ in every:
                for a, b in ((s, d), (d, s)):
                    if a in front:
                        step[b] = max(step.get(b, 0), 0.5**hop * w)
            for n, s in step.items():
                if n != q:
                    want[q, n] = max(want.get((q, n), 0), s)
            front = set(step)
    got = {(r.query_id, r.node): r.score for r in codegraph.l12_hop_decay_activation(spark, sparse).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} and len(want) > 10


def test_typed_activation_walks_near_edges(spark, sparse, monkeypatch):
    seeds = codegraph.nearest_seeds(spark, sparse, 3)
    want = codegraph.typed_activation(seeds, views.edges(spark, sparse)).select("query_id", "node", F.round("a", 6).alias("activation"))
    want = sorted(map(tuple, want.collect()))
    near_only(monkeypatch)
    assert sorted(map(tuple, codegraph.l11_typed_activation(spark, sparse).collect())) == want and want


def test_synapse_walks_near_edges(spark, sparse, monkeypatch):
    seeds = codegraph.nearest_seeds(spark, sparse, 10)
    want = sorted(map(tuple, codegraph.synapse(seeds, views.edges(spark, sparse)).withColumn("gate", F.round("gate", 6)).collect()))
    near_only(monkeypatch)
    assert sorted(map(tuple, codegraph.l10_synapse_activation(spark, sparse).collect())) == want and want
