"""Text sources and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.ranges import opened

BUFFER = 8 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` for each line."""
    return spark.read.text(path)


def split_key_value(lines: DataFrame) -> DataFrame:
    """``key, value`` of lines cut at their first tab. Later tabs belong to the value; without a tab it is empty."""
    cut = F.instr("value", "\t")
    key = F.when(cut > 0, F.substr("value", F.lit(1), cut - 1)).otherwise(F.col("value"))
    value = F.when(cut > 0, F.substr("value", cut + 1)).otherwise(F.lit(""))
    return lines.select(key.alias("key"), value.alias("value"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    return split_key_value(read_lines(spark, path))


def write_key_values(df: DataFrame, path: str, *columns: str) -> None:
    """K1: tab-separated lines, one part for each partition."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns or df.columns]).alias("value")).write.text(path)


def write_placed(rows: DataFrame, number: Column, parts: int, path: str, *columns: str, order: list[Column]) -> None:
    """K1 by a partitioner (R1 to R4): each row goes to the part that ``number`` (0 to ``parts - 1``) names, where rows are
    sorted, and the part becomes the file of that number. Empty parts make no file, but the first may make an empty one. A number
    outside is an error, as it would be another part's file."""
    inside = F.when((number >= 0) & (number < parts), number).otherwise(F.raise_error(F.concat(F.lit(f"no part of {parts}: "), F.coalesce(number.cast("string"), F.lit("null")))).cast("int"))
    dealt = rows.withColumn("_number", inside.cast("int")).repartitionById(parts, "_number").sortWithinPartitions(*order)
    write_key_values(dealt, path, *(columns or rows.columns))


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, value``: each line with the number of its part file and its place in it (from 0). Large files are read
    by several tasks; a task's lines of a file count on from those of the tasks before it, of which there is one row each."""
    from quarry.store import materialise

    at = [F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block")]
    lines = materialise(read_lines(spark, path).select("value", *at, F.monotonically_increasing_id().alias("id")), "placed-lines")
    blocks = lines.groupBy("name", "block").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("name", "block", "least", before.alias("before"))
    number = F.regexp_extract("name", "part-([0-9]+)", 1).cast("int")
    return lines.join(blocks, ["name", "block"]).select(number.alias("file"), (F.col("before") + F.col("id") - F.col("least")).alias("place"), "value")


def write_merged(df: DataFrame, path: str, *columns: str) -> None:
    """K2: the parts of a sorted frame in one file, by its order of partitions. The parts are sorted and written in parallel; one
    task then strings their bytes together, a buffer at a time, and the file gets its name when it is whole."""
    write_key_values(df, f"{path}/_parts", *columns)
    merge_files(df.sparkSession, f"{path}/_parts", path)


def merge_files(spark: SparkSession, parts: str, path: str, name: str = "part-00000") -> None:
    """String the part files of ``parts`` together into one file of ``path``, in the order of their numbers, and delete them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            store, at = opened(parts)
            files = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")]
            held = f"{os.path.dirname(at)}/_merging-{uuid.uuid4().hex}"
            with store.open_output_stream(held) as out:
                for file in sorted(files, key=lambda f: (int(os.path.basename(f).split("-")[1]), f)):
                    with store.open_input_stream(file) as part:
                        while data := part.read(BUFFER):
                            out.write(data)
            yield pa.RecordBatch.from_pydict({"held": [held]})

    made = [r["held"] for r in spark.range(1, numPartitions=1).mapInArrow(run, "held string").collect()]
    store, at = opened(path)
    store.move(made[0], f"{at}/{name}")
    store.delete_dir(opened(parts)[1])
