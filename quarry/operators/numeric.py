"""Numeric reductions."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pi_riemann(spark: SparkSession, n: int) -> DataFrame:
    """One row ``pi``, the left Riemann sum of a quarter circle over exactly ``n`` steps, times 4."""
    x = F.col("id") / F.lit(float(n))
    return spark.range(n).agg((4 * F.sum(F.sqrt(1 - x * x)) / n).alias("pi"))


def primes(spark: SparkSession, n: int, segment: int = 1 << 20) -> DataFrame:
    """The primes below ``n``, sieved in segments by the primes up to the square root of ``n``."""
    base = _small_primes(isqrt(max(n - 1, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf.id:
                low, high = max(2, int(k) * segment), min(n, (int(k) + 1) * segment)
                flags = np.ones(max(0, high - low), bool)
                for p in base:
                    first = max(p * p, -(-low // p) * p)
                    if first < high:
                        flags[first - low :: p] = False
                yield pd.DataFrame({"prime": np.flatnonzero(flags) + low})

    return spark.range(-(-max(n, 0) // segment)).mapInPandas(run, "prime long")


def _small_primes(n: int) -> list[int]:
    flags = np.ones(n + 1, bool)
    flags[:2] = False
    for p in range(2, isqrt(n) + 1):
        if flags[p]:
            flags[p * p :: p] = False
    return np.flatnonzero(flags).tolist()


def prime_count(spark: SparkSession, n: int) -> DataFrame:
    """One row ``n_primes``."""
    return primes(spark, n).agg(F.count(F.lit(1)).alias("n_primes"))
