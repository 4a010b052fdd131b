"""PageRank with fixed steps or until convergence.

State is one table ``id, degree, old, rank``, bucketed by id, of which the last two stay (K3); edges are bucketed by source, with as
many buckets. So a step joins ranks to edges and sums to ranks where they lie, and shuffles nothing but sums by target, which
Spark adds in part before. The dangling mass and the error are counters of the job that writes the state: a step is the job of
that shuffle and this one. The edges of very large sources are a table of their own, in no buckets, whose few ranks are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.counting import rank_bucket
from quarry.operators.linkgraph import LinkGraph, out_degree
from quarry.store import Rolling, in_buckets, materialise

#: Damping and the error at which iteration stops.
DAMPING, TOLERANCE = 0.85, 0.001
#: From so many edges on, a source whose edges would fill a bucket is joined apart.
HOT = 1 << 16


@dataclass
class Ranks:
    """``ranks(id, rank)`` and the error of each step's input, the first of which compares with nothing (all zero)."""

    ranks: DataFrame
    errors: list[float]


def pagerank(graph: LinkGraph, steps: int | None = None, tolerance: float = TOLERANCE, most: int = 1000) -> Ranks:
    """``steps`` updates, or, if None, updates until the reported error falls below ``tolerance``.

    The error that a step reports is that of its input, and the converged result is the input of the last step: the step
    that finds convergence is not applied; ranks that have not converged after ``most`` steps are an error. Page counts, not title
    counts, enter the formula, so ranks sum to one only
    where titles are unique. ``steps`` of zero or less returns the initial ranks.
    """
    n = graph.pages
    if not n:
        return Ranks(graph.nodes.withColumn("rank", F.lit(0.0)), [])
    degrees = out_degree(graph.edges)
    nodes = graph.nodes.join(degrees.withColumnRenamed("src", "id"), "id", "left")
    counters = {"error": F.sum(F.abs(F.col("rank") - F.col("old"))), "mass": F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), "nodes": F.count(F.lit(1))}
    rolling = Rolling("ranks", "id")
    state, seen = rolling.counted(nodes.select("id", "degree", F.lit(0.0).alias("old"), F.lit(1.0 / n).alias("rank")), **counters)
    edges, hot = _dealt(graph.edges, degrees)
    error, mass, errors = (seen["nodes"] or 0) / n, graph.dangling / n, []
    for _ in range(most if steps is None else max(steps, 0)):
        errors.append(error)
        if steps is None and error < tolerance:
            break
        state, seen = rolling.counted(next_ranks(state, edges, hot, n, mass), **counters)
        error, mass = seen["error"] or 0.0, seen["mass"] or 0.0
    else:
        if steps is None:
            raise RuntimeError(f"ranks have not converged after {most} steps; the last error was {errors[-1]:g}")
    return Ranks(state.select("id", "rank"), errors)


def _dealt(edges: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``src, dst, times`` bucketed by source, and those of sources so large that they would fill a bucket by themselves. Of
    these there are four a bucket at most; with the number of their ranks that bounds what is broadcast."""
    spark = edges.sparkSession
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = degrees.agg(F.sum("degree")).head()[0] or 0
    large = degrees.filter((F.col("degree") >= HOT) & (F.col("degree") * 4 * buckets > total)).select("src")
    if large.limit(1).count() == 0:
        return in_buckets(pairs, "edges", "src"), None
    pairs, large = materialise(pairs, "pairs"), materialise(large, "large-sources")
    rest = pairs.join(F.broadcast(large), "src", "left_anti")
    return in_buckets(rest, "edges", "src"), materialise(pairs.join(F.broadcast(large), "src", "left_semi"), "large-edges")


def next_ranks(state: DataFrame, edges: DataFrame, hot: DataFrame | None, n: int, mass: float) -> DataFrame:
    """G2 with A7: one step from bucketed ``state`` and ``edges``. The hints keep Spark from broadcasting small tables, which lie as
    the joins need them anyway, and from sorting the edges."""
    shares = state.select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
    given = edges.join(shares.hint("shuffle_hash"), "src").select("dst", (F.col("share") * F.col("times")).alias("part"))
    if hot is not None:
        few = shares.join(F.broadcast(hot.select("src").distinct()), "src", "left_semi")
        given = given.unionByName(hot.join(F.broadcast(few), "src").select("dst", (F.col("share") * F.col("times")).alias("part")))
    received = given.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("sum"))
    fresh = (1 - DAMPING) / n + DAMPING * (F.coalesce("sum", F.lit(0.0)) + mass / n)
    return state.join(received.hint("shuffle_hash"), "id", "left").select("id", "degree", F.col("rank").alias("old"), fresh.alias("rank"))


def by_rank(ranks: DataFrame) -> DataFrame:
    """Rank descending, id ascending, as one global order."""
    return ranks.orderBy(F.col("rank").desc(), F.col("id").asc())


def bucketed(ranks: DataFrame, buckets: int = 32) -> DataFrame:
    """R4 for each node."""
    return ranks.withColumn("bucket", rank_bucket(F.col("rank"), buckets))
