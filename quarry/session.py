"""Session settings and table loading shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults. Settings already made by the cluster win over ``DEFAULTS``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in {**DEFAULTS, **given}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, with the scan left to Spark (pushdown and pruning apply)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
