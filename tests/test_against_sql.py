"""Queries against their own SQL on tables with odd rows, which the given ones lack at the smallest scale."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from engram.catalog import QUERIES
from engram.operators import intervals
from engram.operators.lexical import best
from test_oracles import TABLES, rows

#: Letters beyond ASCII beside names, white space and line ends that patterns of Java and of the SQL could tell apart.
ODD = [
    "Se que éLa Casañ Blanca del mar", "Üverü Achü Erü", "De í esie. Cióndo osgabo", "when\x0bdid it go", "all\x0b of it", "what has\rshe visited", "what has she visited",
    "what has\nshe visited", "DİSLIKE it", "Anna_ met Bob", "Anna met Bob", "ΑΣ Anna Σ Bob", "", None, "Anna\x0bBob x", "list all things",
]


def against_sql(name, spark, sf_dir, tmp_path, **tables):
    """Rows of a query and of its SQL where `tables` stand for those of sf_dir, as they are compared."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if t in tables:
            pq.write_table(tables[t], tmp_path / f"{t}.parquet")
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    query, sql = QUERIES[name]
    return rows(query(spark, str(tmp_path)).toPandas()), rows(con.execute(sql).df())


def test_channel_credit_of_odd_texts(spark, sf_dir, tmp_path):
    given = pq.read_table(f"{sf_dir}/documents.parquet")
    texts = pa.array([ODD[i // 20 % len(ODD)] for i in range(given.num_rows)], pa.string())
    documents = given.set_column(given.schema.get_field_index("text"), "text", texts)
    got, want = against_sql("A12_channel_credit", spark, sf_dir, tmp_path, documents=documents)
    assert got == want and len({r[0] for r in got}) == 3


def odd_queries():
    return pa.table({"item_id": pa.array(range(len(ODD)), pa.int64()), "text": pa.array(ODD, pa.string())})


def test_query_habits_of_odd_queries(spark, sf_dir, tmp_path):
    got, want = against_sql("B16_query_habits", spark, sf_dir, tmp_path, benchmark=odd_queries())
    assert got == want


def test_query_terms_of_odd_queries(spark, sf_dir, tmp_path):
    got, want = against_sql("E21_query_terms", spark, sf_dir, tmp_path, benchmark=odd_queries())
    assert got == want and len(got) == len(ODD)


def test_skill_effectiveness_of_parts_of_seconds_and_unknown_times(spark, sf_dir, tmp_path):
    noon = dt.datetime(2024, 1, 10, 12)
    # Session, seconds after noon (None: unknown) and tool; that lie within a second by one way to round and not by the other.
    cases = [(1, 0.4, "view"), (1, 0.6, "view"), (2, 0.5, "view"), (2, 1.5, "view"), (3, 0.6, "view"), (3, 3600.7, "view"), (4, 0.4, "click"), (4, 3600.6, "click"), (5, None, "view"), (5, 1.0, "error"), (5, 2.0, "signup")]
    cases += [(6, None, "error"), (6, 7.0, "click"), (6, None, "click"), (7, 1.0, None), (7, 2.0, "purchase"), (8, 10.6, "click"), (8, 10.9, "click"), (9, None, "view"), (9, 5.0, "view"), (9, 6.0, "purchase")]
    at = [None if s is None else noon + dt.timedelta(seconds=s) for _, s, _ in cases]
    n = len(cases)
    events = pa.table({"event_id": range(n), "ts": pa.array(at, pa.timestamp("us")), "user_id": [s for s, _, _ in cases], "event_type": pa.array([t for *_, t in cases], pa.string()), "value": [1.0] * n, "props": ["{}"] * n})
    got, want = against_sql("B7_skill_effectiveness", spark, sf_dir, tmp_path, events=events)
    assert got == want


def odd_orders(sf_dir):
    """lineitem and orders with repeated keys, unknown dates and states, and lines that ship before their order."""
    rng = np.random.default_rng(3)
    lines, orders = pq.read_table(f"{sf_dir}/lineitem.parquet").slice(0, 3000), pq.read_table(f"{sf_dir}/orders.parquet")
    hole = lambda column, share: pc.if_else(pa.array(rng.random(len(column)) < share), pa.scalar(None, column.type), column)
    put = lambda table, name, column: table.set_column(table.schema.get_field_index(name), name, column)
    shift = pc.add(lines["l_shipdate"], pa.array(rng.integers(-200, 30, len(lines)) * 86_400_000_000, pa.duration("us")))
    lines = put(put(lines, "l_shipdate", hole(shift, 0.05)), "l_linestatus", hole(lines["l_linestatus"], 0.05))
    lines = put(lines, "l_linenumber", pa.array(rng.integers(1, 14, len(lines)), lines["l_linenumber"].type))
    orders = pa.concat_tables([orders, orders.slice(0, 200)])
    return {"lineitem": lines, "orders": put(orders, "o_orderdate", hole(orders["o_orderdate"], 0.05))}


def test_valid_at_of_repeated_facts_and_unknown_dates(spark, sf_dir, tmp_path):
    items = pq.read_table(f"{sf_dir}/benchmark.parquet")
    got, want = against_sql("J10_valid_at", spark, sf_dir, tmp_path, benchmark=pa.concat_tables([items, items.slice(0, 5)]), **odd_orders(sf_dir))
    assert got == want and want


def test_temporal_channel_of_unknown_dates_and_intervals_with_one_bound(spark, sf_dir, tmp_path):
    got, want = against_sql("L5_temporal_channel", spark, sf_dir, tmp_path, **odd_orders(sf_dir))
    assert got == want and want


def test_nearest_in_time_is_the_best_of_the_channel(spark):
    rng = np.random.default_rng(11)
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(int(k))
    some = lambda k: None if rng.random() < 0.4 else day(k)
    events = [(int(rng.integers(0, 90)), some(rng.integers(-500, 900)), some(rng.integers(-500, 900)), *((day(a), day(a + rng.integers(-5, 300))) if (a := rng.integers(-500, 900)) % 3 else (None, None))) for _ in range(400)]
    asked = spark.createDataFrame([(i, day(rng.integers(0, 300))) for i in range(12)] + [(50, day(5000)), (51, None)], "query_id long, at date")
    frame = spark.createDataFrame(events, "fact_id long, observed date, referenced date, begins date, ends date")
    got = sorted((r.query_id, r.fact_id, r.rank, r.score) for r in intervals.nearest_in_time(asked, frame, 7).collect())
    want = sorted((r.query_id, r.fact_id, r.rank, r.score) for r in best(intervals.temporal_channel(asked, frame), 7).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want]) and len(want) == 84


def test_code_keyword_search_of_repeated_nodes_and_words_across_parts(spark, sf_dir, tmp_path):
    names = ["large ring", "large ring", "ring", "7.large ring", "hot_bolt", "hot bolt bolt", "", " ", None, "bolt", "Large RING", "old.plate x"]
    n = 400
    part = pq.read_table(f"{sf_dir}/part.parquet").slice(0, 1)
    columns = {"p_partkey": [*range(n), 0, 20, 21], "p_name": [names[i * 7 % 12] for i in range(n)] + ["old bolt", "ring", "ring"], "p_brand": [None if i % 31 == 0 else f"Brand#{i % 3 + 6}" for i in range(n + 3)], "p_size": [i % 10 if i < n else i % n * 20 % 10 for i in range(n + 3)]}
    columns["p_size"][n + 2] = 21 % 10  # as of its namesake: the SQL takes any of them
    table = pa.table({f.name: pa.array(columns.get(f.name, part[f.name].to_pylist() * (n + 3)), f.type) for f in part.schema})
    got, want = against_sql("L15_code_keyword_search", spark, sf_dir, tmp_path, part=table)
    assert got == want and len(got) > 100
