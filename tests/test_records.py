"""Sinks that lose no row and sources that read by ranges."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import catalog
from quarry.sources import binary, ranges


def floats_of(spark, path):
    return [(r["pos"], r["value"]) for r in binary.read_float_parts(spark, path).orderBy("pos").collect()]


@pytest.mark.parametrize("pos", ["0", "-id", "id * 1000003", "CASE WHEN id % 3 > 0 THEN id - 15000 END"])
def test_ties_nulls_negatives_and_gaps_lose_no_row(spark, tmp_path, pos):
    rows = spark.range(30_000).select(F.expr(pos).cast("long").alias("pos"), F.col("id").cast("float").alias("value"), F.lit(1).alias("src"), F.lit(2).alias("dst"), F.col("id").cast("int").alias("weight"))
    binary.write_float_parts(rows.repartition(7), str(tmp_path / "floats"))
    found = floats_of(spark, str(tmp_path / "floats"))
    assert [p for p, _ in found] == list(range(30_000)) and sorted(v for _, v in found) == list(range(30_000))
    binary.write_edge_parts(rows.repartition(7), str(tmp_path / "edges"), 3)
    edges = binary.read_edge_parts(spark, str(tmp_path / "edges")).orderBy("first", "pos").collect()
    assert sorted(r["weight"] for r in edges) == list(range(30_000))
    assert [r["first"] + r["pos"] for r in edges] == list(range(30_000))
    if pos != "0":  # the order of the column, nulls first
        by = {r["weight"]: r["pos"] for r in rows.collect()}
        keys = [(by[r["weight"]] is not None, by[r["weight"]] or 0) for r in edges]
        assert keys == sorted(keys)


def test_a_query_on_events_of_one_id_keeps_all_of_them(spark, tmp_path):
    rows = spark.range(25_000).select(F.lit(7).cast("long").alias("event_id"), (F.col("id") * 37 % 25_000).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.float_file_sort(spark, str(tmp_path)).orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(k, float(k)) for k in range(25_000)]


def test_small_parts_follow_one_another(spark, tmp_path):
    values = spark.range(50_000).select(F.col("id").cast("float").alias("value")).orderBy("value")
    files = binary._write(values, str(tmp_path), "floats", part=20_000, suffix=".floats")
    assert files > 4 and len(list(tmp_path.glob("part-*"))) == files
    assert np.concatenate([np.fromfile(p, "<f4") for p in sorted(tmp_path.glob("part-*"))]).tolist() == list(range(50_000))
    assert [r["value"] for r in binary.read_floats(spark, str(tmp_path), 49_000, 49_003).orderBy("value").collect()] == [49_000, 49_001, 49_002]
    assert binary._read(spark, str(tmp_path), "floats", range=4000).count() == 50_000


def test_a_failed_job_leaves_no_file_and_a_failed_attempt_no_row(spark, tmp_path):
    def fail_late(batches):
        for batch in batches:
            if 4999 in batch.column("id").to_pylist():
                raise ValueError("lost on the way")
            yield batch

    rows = spark.range(5000, numPartitions=5).mapInArrow(fail_late, "id long").select(F.col("id").cast("float").alias("value"))
    with pytest.raises(Exception, match="lost on the way"):
        binary._write(rows, str(tmp_path / "a"), "floats", part=400)
    assert os.listdir(tmp_path / "a") == []
    with pytest.raises(Exception, match="no files"):
        binary.read_floats(spark, str(tmp_path / "a")).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-00000000-000000-stray").write_bytes(np.arange(9, dtype="<f4").tobytes())  # of a lost executor
    binary.write_float_parts(spark.range(3).select(F.col("id").alias("pos"), F.col("id").alias("value")), str(tmp_path / "b"))
    assert floats_of(spark, str(tmp_path / "b")) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert not (tmp_path / "b" / "part-00000000-000000-stray").exists()


def test_a_large_file_is_read_by_many_tasks_and_only_where_asked(spark, tmp_path):
    with open(tmp_path / "sparse", "wb") as out:
        out.truncate(3 << 30)
        out.seek((3 << 30) - 40)
        out.write(np.arange(1, 11, dtype="<f4").tobytes())
    whole = binary.read_floats(spark, str(tmp_path / "sparse"))
    assert whole.rdd.getNumPartitions() == (3 << 30) // ranges.RANGE
    n = (3 << 30) // 4
    tail = binary.read_floats(spark, str(tmp_path / "sparse"), n - 12, n)
    assert tail.rdd.getNumPartitions() == 1
    assert [(r["pos"], r["value"]) for r in tail.orderBy("pos").collect()] == [(n - 12 + k, max(0, k - 1)) for k in range(12)]
    across = binary.read_floats(spark, str(tmp_path / "sparse"), ranges.RANGE // 4 - 2, ranges.RANGE // 4 + 70_000)
    assert across.agg(F.count(F.lit(1)), F.sum("value")).head() == (70_002, 0.0)


def test_wrong_lengths_are_errors(spark, tmp_path):
    (tmp_path / "floats").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole floats"):
        binary.read_floats(spark, str(tmp_path / "floats")).collect()
    (tmp_path / "short").write_bytes(b"1234")
    for read in (binary.read_edges, binary.read_edge_header):
        with pytest.raises(Exception, match="no header"):
            read(spark, str(tmp_path / "short")).collect()
    (tmp_path / "long").write_bytes(binary.edge_bytes(4, [(0, 1, 2)] * 4) + b"123456789012")
    with pytest.raises(Exception, match="4 edges announced, 5 found"):
        binary.read_edges(spark, str(tmp_path / "long")).collect()


def test_nothing_is_written_and_read(spark, tmp_path):
    none = spark.range(0).select(F.col("id").alias("pos"), F.col("id").cast("float").alias("value"))
    binary.write_float_parts(none, str(tmp_path / "floats"))
    assert json.loads((tmp_path / "floats" / ranges.MANIFEST).read_text())["files"] == []
    assert binary.read_float_parts(spark, str(tmp_path / "floats")).collect() == []
    (tmp_path / "none").write_bytes(b"")
    assert binary.read_floats(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "edges").write_bytes(binary.edge_bytes(4, []))
    assert binary.read_edges(spark, str(tmp_path / "edges")).collect() == []
    assert tuple(binary.read_edge_header(spark, str(tmp_path / "edges")).head())[1:] == (4, 0)


def test_matrix_rows_are_raw_and_wide_rows_are_read_in_pieces(spark, tmp_path):
    cells = spark.createDataFrame([(0, 2, 4), (1, 0, 5)], "i int, j int, dist long")
    assert binary.write_matrix_parts(cells, str(tmp_path / "small"), 3, unreachable=9, cells=3) == 3
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "small").glob("part-*"))) == np.array([[9, 9, 4], [5, 9, 9], [9, 9, 9]], "<i4").tobytes()
    n = ranges.STEP + 5
    np.arange(2 * n, dtype="<i4").tofile(tmp_path / "wide")
    found = binary.read_matrix_parts(spark, str(tmp_path / "wide"), n)
    assert found.agg(F.count(F.lit(1)), F.sum((F.col("dist") == F.col("i") * n + F.col("j")).cast("int"))).head() == (2 * n, 2 * n)
