"""Tables that cut the lineage of loops.

A loop's state is written as Parquet below ``spark.checkpoint.dir``, the folder that driver and executors share, and
read again. A lost executor then costs a re-read; ``localCheckpoint`` would lose the only copy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_scopes: list[str] = []
_tables: dict[str, str] = {}  # by the folder of their files


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only in local mode and only where it is unset."""
    given = spark.conf.get(KEY, None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = "/".join(["quarry", *_scopes[-1:]])
    return f"{shared_dir(spark).rstrip('/')}/{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table (same columns and types)."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int | None) -> tuple[str, str]:
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    count, table = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"quarry_{uuid.uuid4().hex}"
    dealt = df.repartition(count, *keys)  # Spark leaves this out where rows lie so already
    dealt.write.bucketBy(count, *keys).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    _tables[path] = table
    return path, table


def in_buckets(df: DataFrame, name: str, *keys: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once, dealt into buckets by ``keys``, and return the table. Joins and groupings by the keys take it as
    it lies, without an exchange; ``buckets`` are as many as shuffles have partitions, unless given. The table is known to this
    session only; its files lie where all executors reach them."""
    return df.sparkSession.table(_bucketed(df, name, keys, buckets)[1])


def _forget(spark: SparkSession, folder: str) -> None:
    for path in [p for p in _tables if p.startswith(folder)]:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Rolling:
    """The state of a loop: each round's table is written, and once it is there, the one before the last is deleted. The
    last two stay, so a lost executor re-reads what its task needs. With ``keys`` the tables are bucketed by them."""

    def __init__(self, name: str, *keys: str, buckets: int | None = None):
        self.name, self.keys, self.buckets, self.held = name, keys, buckets, []

    def counted(self, df: DataFrame, **counters: Column) -> tuple[DataFrame, dict]:
        """As ``step``, with aggregates of the rows that are gathered by the same job that writes them."""
        seen = Observation()
        held = self.step(df.observe(seen, *(c.alias(k) for k, c in counters.items())))
        return held, seen.get

    def step(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        if self.keys:
            path, table = _bucketed(df, self.name, self.keys, self.buckets)
            held = spark.table(table)
        else:
            path = fresh_path(spark, self.name)
            df.write.option("compression", "zstd").parquet(path)
            held = spark.read.schema(df.schema).parquet(path)
        self.held.append(path)
        while len(self.held) > 2:
            old = self.held.pop(0)
            _forget(spark, old)
            _delete(spark, old)
        return held


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside lie in a folder of their own, which goes at the end. Results must be written or collected
    before, as they may read those tables."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = f"{shared_dir(spark).rstrip('/')}/quarry/{_scopes.pop()}"
        _forget(spark, folder)
        _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables written here. Results that still read them must have been written elsewhere before."""
    _forget(spark, f"{shared_dir(spark).rstrip('/')}/quarry")
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/quarry")
