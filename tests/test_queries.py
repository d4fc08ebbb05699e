"""Every registered query without data of its own is held against its SQL, in DuckDB."""

import importlib

import pytest

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(values):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in values)


def test_all(spark, sf):
    from plexmatch.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, query in QUERIES.items():
        got = query(spark, sf)
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall()
        assert rows(map(tuple, got.select(columns).collect())) == rows(want), name


def test_whole_graph(spark, sf):
    from plexmatch.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    size = {t: con.execute(f"select count(*) from {t}").fetchone()[0] for t in TABLES}
    got = QUERIES["v_least_reachable_whole"](spark, sf).select("vid", "least").collect()
    assert len(got) == sum(size[t] for t in ("region", "nation", "customer", "supplier", "orders", "part"))
    assert rows(map(tuple, got)) == rows(con.execute(f"select vid, least from ({ORACLES['v_least_reachable_whole']})").fetchall())
    assert [r["place"] for r in QUERIES["p_prefix_counts_whole"](spark, sf).orderBy("place").collect()] == [0, 1, 2, 3]


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
