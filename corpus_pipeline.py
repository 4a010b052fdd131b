"""A corpus pipeline of five operators. Each stage reads the documents its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import store
from quarry.llm.queries import word_tokenizer

#: Tokenization cannot be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their columns.

    Null texts, texts without words and documents with a posterior below one half go; null hosts and languages are sites of
    their own; rows that repeat fare alike; without labels of both classes nothing but blank texts goes; an empty table
    stays empty.
    """
    from quarry.llm.quality import keep_good, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts (``A-Z`` in lower case), that with the largest id.

    Null texts equal empty ones; a null id ranks below every other; of rows that tie on text and id one stays; an empty
    table stays empty.
    """
    from quarry.llm.exact import drop_exact

    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five words a shingle, Jaccard similarity of 0.8 or more.

    The smallest id of a class stays. Null ids, null texts and texts without words are linked with nothing and stay; rows
    that repeat a kept id stay all; an empty table stays empty.
    """
    from quarry.llm.neardup import drop_near

    return drop_near(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document in the mix; a document that the mix cuts keeps the words taken.

    Sources stand in code-point order, null last. Texts without words are never taken; rows that repeat id and text are cut
    together; a document is read at most twice; an empty table stays empty.
    """
    from quarry.llm.mixing import apply_mix

    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every row. Null text is empty, null ids and repeated rows stay, an empty
    table gives an empty one."""
    from quarry.llm.bpe import bpe

    coded = bpe(docs, word_tokenizer())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("bpe encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
