"""Queries of the same words are answered once, from as many nodes of a class as can be among the best."""

import pyarrow as pa
import pyarrow.parquet as pq

from engram.operators import codegraph


def test_queries_and_nodes_that_are_alike_meet_once(spark, tmp_path, monkeypatch):
    n, names = 2000, ["old bolt", "large ring", "ring", "hot plate"]
    columns = {"p_partkey": range(n), "p_name": [names[i // 20 % 4] for i in range(n)], "p_brand": ["Brand#7"] * n, "p_size": [5 if i % 3 else 4 for i in range(n)]}
    pq.write_table(pa.table(columns), tmp_path / "part.parquet")
    seen, best = [], codegraph.best
    monkeypatch.setattr(codegraph, "best", lambda scored, k, *more: seen.append(scored.count()) or best(scored, k, *more))
    rows = codegraph.l15_code_keyword_search(spark, str(tmp_path)).collect()
    assert len(rows) == 100 * 10 and max(seen) < 1000  # all pairs: 75,000
    ring = [(r.node_id, r.score) for r in sorted((r for r in rows if r.query_id == 40), key=lambda r: r.rank)]
    assert ring == [(i, 6.825) for i in [x for x in range(n) if names[x // 20 % 4] == "ring" and x % 5 in (0, 1) and x % 3 == 0][:10]]
