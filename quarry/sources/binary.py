"""Binary sources and sinks.

Files are read by byte ranges and written as folders of parts through the data source of ``ranges``: a task holds no more than
its own batches or one part, and a folder counts only with the manifest of a finished job. The parts, by name, make the whole
one after another. ``write_floats`` and ``write_matrix`` make a single local file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import ranges

#: Fixed value: how "unreachable" is written into a distance matrix.
UNREACHABLE = 999999999
#: Bytes up to which a matrix lies on disk as raw rows.
RAW = 1 << 28


def _read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(ranges.registered(spark)).options(path=path, kind=kind, **given).load()


def _write(rows: DataFrame, path: str, kind: str, **options) -> int:
    """The rows in the order of their partitions; how many files they make."""
    given = {k: str(v) for k, v in options.items() if v is not None}
    rows.write.format(ranges.registered(rows.sparkSession)).mode("append").options(path=path, kind=kind, **given).save()
    return len(ranges.listed(path))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``path, pos, src, dst, weight`` of edge lists: counts of vertices and edges, then triples, all 32-bit
    little-endian. A file whose length does not fit its edge count is an error (S3a). A path is a file, a folder or a pattern
    of names."""
    return _read(spark, path, "edges").drop("first")


def read_edge_parts(spark: SparkSession, path: str) -> DataFrame:
    """``first, pos, src, dst, weight`` of a written folder of edge lists; ``first`` is how many edges stand before the file."""
    return _read(spark, path, "edges").drop("path")


def read_edge_header(spark: SparkSession, path: str) -> DataFrame:
    """``path, v, e`` of edge lists, of which only the first eight bytes are read."""
    return _read(spark, path, "header")


def read_floats(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """``path, pos, value`` of files of 32-bit little-endian floats; of all files' values only those from ``begin`` to
    before ``end``, if given. A length that is no whole number of floats is an error."""
    return _read(spark, path, "floats", begin=begin, end=end).drop("first")


def write_floats(values: DataFrame, path: str, order: str = "pos", column: str = "value") -> None:
    """K5: one local file of 32-bit floats in order. Partitions reach the driver one at a time."""
    with open(path, "wb") as out:
        for row in values.orderBy(order).select(column).toLocalIterator():
            out.write(np.float32(row[0]).tobytes())


def write_matrix(distances: DataFrame, path: str, vertices: int, unreachable: int = UNREACHABLE) -> None:
    """K4: one local row-major file of 32-bit integers from ``i, j, dist``; absent pairs are ``unreachable``. The driver
    holds one row of the matrix at a time."""
    at, row = 0, np.full(vertices, unreachable, "<i4")
    with open(path, "wb") as out:
        for i, j, dist in distances.select("i", "j", "dist").orderBy("i", "j").toLocalIterator():
            while at < i:
                out.write(row.tobytes())
                at, row = at + 1, np.full(vertices, unreachable, "<i4")
            row[j] = dist
        while at < vertices:
            out.write(row.tobytes())
            at, row = at + 1, np.full(vertices, unreachable, "<i4")


def edge_bytes(vertices: int, edges: list[tuple[int, int, int]]) -> bytes:
    """An edge list in the format of ``read_edges``."""
    return np.array([vertices, len(edges), *(x for e in edges for x in e)], "<i4").tobytes()


# -- folders of parts, written in parallel ----------------------------------------------------------------------------


def write_edge_parts(edges: DataFrame, path: str, vertices: int) -> int:
    """``pos, src, dst, weight`` as edge lists in the order of ``pos``, each with a header of its own; their number. Nothing is
    taken from ``pos`` but the order: ties, gaps, nulls (which come first) and negative ones all keep their edges."""
    return _write(edges.orderBy("pos").select(*(F.col(c).cast("int").alias(c) for c in ("src", "dst", "weight"))), path, "edges", vertices=vertices, suffix=".edges")


def write_float_parts(values: DataFrame, path: str, order: str = "pos", column: str = "value") -> int:
    """K5: 32-bit floats in the order of a column, from which nothing else is taken; the number of files. A null value is written
    as NaN."""
    return _write(values.orderBy(order).select(F.col(column).cast("float").alias("value")), path, "floats", suffix=".floats")


def read_float_parts(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value`` of such a folder; positions run on from file to file."""
    return _read(spark, path, "floats").select((F.col("first") + F.col("pos")).alias("pos"), "value")


def matrix_codec(vertices: int) -> str | None:
    """How to write a matrix of so many vertices: raw up to ``RAW`` bytes, else with each file's raw rows compressed by ``zstd``,
    as the square of the vertices outgrows any disk while few of its cells are reached."""
    return "zstd" if 4 * vertices * vertices > RAW else None


def write_matrix_parts(distances: DataFrame, path: str, vertices: int, unreachable: int = UNREACHABLE, cells: int = 1 << 22, codec: str | None = None) -> int:
    """K4: the row-major matrix of ``i, j, dist`` in blocks of rows of about ``cells`` cells, each a file of its own; absent
    pairs are ``unreachable``. Cells are dealt by ranges of blocks and sorted, so a task fills one block at a time. With a
    ``codec`` (``zstd``) files are compressed as a whole, and their names end in it. The number of blocks."""
    high = max(1, min(vertices, cells // max(vertices, 1)))
    count = -(-vertices // high)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, None

        def filled() -> pa.RecordBatch:
            data = rows.tobytes()
            return pa.RecordBatch.from_pydict({"data": [pa.Codec(codec, 1).compress(data, asbytes=True) if codec else data], "records": [len(rows)]})

        for batch in batches:
            of, i, j, dist = (np.asarray(batch.column(c)) for c in ("block", "i", "j", "dist"))
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of[a] != block:
                    if block is not None:
                        yield filled()
                    block = of[a]
                    rows = np.full((min(high, vertices - block * high), vertices), unreachable, "<i4")
                held = np.arange(a, b)[i[a:b] >= 0]
                rows[i[held] - block * high, j[held]] = dist[held]
        if block is not None:
            yield filled()

    spark = distances.sparkSession
    held = distances.select(F.floor(F.col("i") / high).cast("long").alias("block"), *(F.col(c).cast("long").alias(c) for c in ("i", "j", "dist")))
    every = spark.range(count).select(F.col("id").alias("block"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).cast("long").alias("dist"))
    parts = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = held.unionByName(every).repartitionByRange(parts, "block").sortWithinPartitions("block")
    return _write(dealt.mapInArrow(fill, "data binary, records long"), path, "blocks", suffix=".rows" + (f".{codec}" if codec else ""))


def read_matrix_parts(spark: SparkSession, path: str, vertices: int, codec: str = "zstd") -> DataFrame:
    """``i, j, dist`` of all cells of such a folder. A file whose name ends in ``codec`` is opened as a whole, any other by
    ranges; one that is no whole rows is an error."""
    return _read(spark, path, "matrix", vertices=vertices, codec=codec)
