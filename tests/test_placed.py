"""Rows placed by partitioners (R1 to R4, K1), files merged as bytes (K2), and weights that no path search allows for."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import counting as C
from quarry.operators import paths as P
from quarry.sources import text as S


def test_each_number_is_a_file_and_lines_know_their_places(spark, tmp_path):
    rows = spark.range(9000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("key"), (F.col("id") % 7).cast("int").alias("n"))
    S.write_placed(rows.repartition(5), F.when(F.col("n") < 6, F.col("n") % 3).otherwise(4), 6, str(tmp_path / "out"), order=[F.col("key").desc()])
    files = {int(p.name.split("-")[1]): p.read_text().splitlines() for p in (tmp_path / "out").glob("part-*")}
    want = {k: [f"{r['key']}\t{r['n']}" for r in rows.orderBy(F.col("key").desc()).collect() if (4 if r["n"] == 6 else r["n"] % 3) == k] for k in (0, 1, 2, 4)}
    assert {k: v for k, v in files.items() if v} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several tasks read a file
    try:
        read = S.read_placed(spark, str(tmp_path / "out"))
        found = {}
        for r in read.collect():
            found.setdefault(r["file"], {})[r["place"]] = r["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {k: dict(enumerate(v)) for k, v in want.items()}


@pytest.mark.parametrize("number", ["3", "-1", "CAST(NULL AS INT)"])
def test_a_number_without_a_part_is_an_error(spark, tmp_path, number):
    with pytest.raises(Exception, match="no part of 3"):
        S.write_placed(spark.range(3), F.expr(number), 3, str(tmp_path / "out"), order=[F.col("id")])


def test_no_rows_make_no_lines(spark, tmp_path):
    S.write_placed(spark.range(0), F.lit(0), 3, str(tmp_path / "out"), order=[F.col("id")])
    assert S.read_placed(spark, str(tmp_path / "out")).collect() == []


def test_a_sorted_frame_is_merged_as_bytes_and_sorted_by_many_tasks(spark, tmp_path):
    rows = C.by_average(spark.range(4000).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("key"), (F.col("id") * 31 % 97).cast("double").alias("average")).repartition(3))
    parts = tmp_path / "parts"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_key_values(rows, str(parts))
        S.write_merged(rows, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(parts.glob("part-*"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["part-00000"]
    assert (tmp_path / "out" / "part-00000").read_text() == "".join(f"{r['key']}\t{r['average']}\n" for r in rows.collect())


def test_parts_are_merged_by_number_not_by_name(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for k in (2, 100000, 10, 0, 99999):
        (tmp_path / "parts" / f"part-{k:05d}-x").write_text(f"{k}\n")
    S.merge_files(spark, str(tmp_path / "parts"), str(tmp_path))
    assert (tmp_path / "part-00000").read_text() == "0\n2\n10\n99999\n100000\n"
    assert not (tmp_path / "parts").exists()


@pytest.mark.parametrize("weight", [-5, None])
def test_a_negative_or_missing_weight_is_an_error_in_every_form(spark, weight):
    edges = spark.createDataFrame([(0, 1, weight), (1, 0, 2)], "src int, dst int, weight int")
    ids = spark.range(2).select(F.col("id").cast("int").alias("id"))
    for search in (lambda: P.all_pairs(edges, ids), lambda: P.all_pairs_blocked(edges, ids, size=2), lambda: P.single_source(edges, 0)):
        with pytest.raises(Exception, match="edge 0 to 1 has the weight"):
            search().collect()
