"""Operator 3: exact deduplication by a content sort, in DataFrame functions only.

Texts are normalised (``A-Z`` lower-cased, null as empty), range-partitioned by sampled splitters and sorted
externally; equal texts are then neighbours and a window over the full text compares them. The range key is a short
head of the normalised bytes and, among equal heads, their 64-bit hash, so splitters stay small however long texts are; the
sort inside a range and the comparison of neighbours use the whole text. A text held by many rows would fill one range: hashes are counted first (partial
aggregation, 16 bytes a row) and the rows of a frequent one are salted into several ranges, whose winners are merged by the
text's SHA-256. At most
``4 * shuffle partitions`` hashes can be that frequent, which bounds both broadcast tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.store import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = 16


def normalised(text: str) -> F.Column:
    """Null as empty, ``A-Z`` in lower case and every other character as it is."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. Null text equals empty text. A null id ranks below every
    other; among rows that tie on text and id exactly one is kept. Empty input gives an empty result; further
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    total = docs.count()
    share = max(64, -(-total // (4 * parts)))
    hot = (
        base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)
        .select("h", F.ceil(F.col("n") / share).alias("ways"))
    )
    placed = base.join(F.broadcast(hot), "h", "left").select(
        "doc_id",
        "norm",
        "h",
        F.coalesce("ways", F.lit(1)).alias("ways"),
        F.pmod(F.xxhash64("doc_id"), F.coalesce("ways", F.lit(1))).alias("salt"),
        F.substring("norm", 1, HEAD).alias("head"),
    )
    ranged = placed.repartitionByRange(parts, "head", "h", "salt")
    same = Window.partitionBy("head", "h", "salt", "norm")
    by_id = same.orderBy(F.col("doc_id").desc_nulls_last())
    local = ranged.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        (F.col("ways") > 1).alias("salted"),
        F.row_number().over(by_id).alias("rn"),
        F.max("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    local = materialise(local, "exact")
    merged = (
        local.filter(F.col("salted") & (F.col("rn") == 1))
        .groupBy("text_sha256")
        .agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    )
    found = F.col("all_size").isNotNull()
    return (
        local.join(F.broadcast(merged), "text_sha256", "left")
        .withColumn("top", F.when(found, F.col("all_keep")).otherwise(F.col("keep_id")))
        .select(
            "doc_id",
            F.col("top").alias("keep_id"),
            F.coalesce("all_size", "group_size").alias("group_size"),
            ((F.col("rn") == 1) & F.col("keep_id").eqNullSafe(F.col("top"))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger id replaces; all columns stay, whatever their names. Null
    text equals empty text and a null id ranks below every other. Repeated rows with one id keep one row; an empty table
    stays empty."""
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept"))
    twin = F.col("doc_id").eqNullSafe(F.col("keep_id"))  # the row that stays has this id too
    key = ["doc_id", "text_sha256"]
    others, twins = gone.filter(~twin).select(*key).distinct(), gone.filter(twin).select(*key).distinct()
    boxed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.sha2(normalised(text_col), 256).alias("sha"))
    same = lambda t: (F.col("sha") == F.col("text_sha256")) & F.col("own").eqNullSafe(F.col("doc_id"))
    left = boxed.join(others, same(others), "left_anti")
    if twins.limit(1).count():
        left = left.join(twins, same(twins), "left_anti").unionByName(left.join(twins, same(twins), "left_semi").dropDuplicates(["own", "sha"]))
    return left.select("row.*")
