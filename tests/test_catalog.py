"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import pytest
from oracle import assert_same, duck

from quarry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small), duck(small).sql(SQL[name]))


def test_entry_runs(spark, small):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and abs(sum(r["pr"] for r in rows) - 1) < 1e-6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_graphs_leave_no_row_out(spark, small):
    con = duck(small)
    events, days = con.sql("SELECT count(*), count(DISTINCT ts::DATE) FROM events").fetchall()[0]
    assert catalog.all_event_graph(spark, small).edges.count() == events - days
    sales = con.sql("""SELECT DISTINCT s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                       JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""").fetchall()
    found = {(r["src"], r["dst"]) for r in catalog.all_nation_edges(spark, small).collect()}
    assert found == set(sales) and any(a == b for a, b in found) and any(a % 5 == 4 for a, _ in found)


def test_entry_covers_all_events(spark, small):
    import __spark_entry__

    assert_same(__spark_entry__.entry(spark), duck(small).sql(SQL["pagerank_all_events_k5"]))


def test_large_matrices_are_compressed_on_disk(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.B, "RAW", 1000)
    monkeypatch.setattr(catalog, "fresh_path", lambda spark, name: str(tmp_path / name))
    found = catalog.edge_file_roundtrip(spark, small)
    assert_same(found, duck(small).sql(SQL["edge_file_roundtrip"]))
    parts = list((tmp_path / "matrix-files").glob("part-*"))
    assert parts and all(p.name.endswith(".rows.zstd") for p in parts)
    assert sum(p.stat().st_size for p in parts) < 2 * found.count()  # raw cells take 4 bytes
    assert catalog.B.matrix_codec(15) is None and catalog.B.matrix_codec(90_000) == "zstd"
