"""Grid kernels: Mandelbrot iterations and Sobel edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import to_byte

#: Fixed value: iterations after which a point counts as inside.
INSIDE = 10_000
#: The horizontal 5 x 5 edge mask; the vertical one is its transpose. The magnitude is divided by SCALE.
MASK = ((-1, -4, -6, -4, -1), (-2, -8, -12, -8, -2), (0, 0, 0, 0, 0), (2, 8, 12, 8, 2), (1, 4, 6, 4, 1))
SCALE = 8


def grid(spark: SparkSession, width: int, height: int, left: float, right: float, lower: float, upper: float) -> DataFrame:
    """``x, y, cx, cy`` of all points. Points near each other cost alike, so they are dealt out at random."""
    points = spark.range(width * height).repartition(spark.sparkContext.defaultParallelism * 4)
    x, y = F.col("id") % width, F.floor(F.col("id") / width)
    return points.select(
        x.cast("int").alias("x"), y.cast("int").alias("y"),
        (F.lit(float(left)) + x * F.lit((right - left) / width)).alias("cx"), (F.lit(float(lower)) + y * F.lit((upper - lower) / height)).alias("cy"),
    )


def escape(cx: np.ndarray, cy: np.ndarray, most: int = INSIDE) -> np.ndarray:
    """H1: how often ``z = z * z + c`` is applied before the squared length, tested after each time, exceeds 4."""
    out, live = np.full(len(cx), most, np.int32), np.arange(len(cx))
    zx, zy = np.zeros(len(cx)), np.zeros(len(cx))
    for i in range(1, most + 1):
        zx, zy = zx * zx - zy * zy + cx[live], 2 * zx * zy + cy[live]
        gone = zx * zx + zy * zy > 4
        if gone.any():
            out[live[gone]] = i
            live, zx, zy = live[~gone], zx[~gone], zy[~gone]
            if not len(live):
                break
    return out


def mandelbrot(points: DataFrame, most: int = INSIDE) -> DataFrame:
    """``x, y, iter`` for a grid of points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": pdf.x, "y": pdf.y, "iter": escape(pdf.cx.to_numpy(), pdf.cy.to_numpy(), most)})

    return points.mapInPandas(run, "x int, y int, iter int")


def coloured(iterations: DataFrame, height: int, inside: int = INSIDE) -> DataFrame:
    """H3: pixels ``x, y, r, g, b`` with rows flipped."""
    p = F.col("iter")
    low = p % 16 * 16
    bright = p.bitwiseAND(16) != 0
    pick = lambda a, b: F.when(p == inside, 0).when(bright, a).otherwise(b).cast("int")
    return iterations.select("x", (F.lit(height - 1) - F.col("y")).cast("int").alias("y"), pick(240, low).alias("r"), pick(low, 0).alias("g"), pick(low, 0).alias("b"))


def _magnitude(gx: Column, gy: Column) -> Column:
    return to_byte(F.sqrt((gx * gx + gy * gy).cast("double")) / SCALE)


def sobel(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``x, y, r, g, b`` edges. Every pixel gives its weighted value to its 25 neighbours inside the image, and sums
    are merged before the shuffle; pixels outside count as 0."""
    weights = [(u - 2, v - 2, MASK[u][v], MASK[v][u]) for u in range(5) for v in range(5)]
    steps = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(a).alias("wx"), F.lit(b).alias("wy")) for u, v, a, b in weights])
    given = pixels.select("x", "y", "r", "g", "b", F.explode(steps).alias("w")).select(
        (F.col("x") - F.col("w.u")).alias("x"), (F.col("y") - F.col("w.v")).alias("y"), "w.wx", "w.wy", "r", "g", "b"
    )
    given = given.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    sums = given.groupBy("x", "y").agg(*[F.sum(F.col(c) * F.col(m)).alias(f"{c}{m}") for c in "rgb" for m in ("wx", "wy")])
    return sums.select("x", "y", *[_magnitude(F.col(f"{c}wx"), F.col(f"{c}wy")).alias(c) for c in "rgb"])


def sobel_bands(pixels: DataFrame, width: int, height: int, band: int = 128) -> DataFrame:
    """The same result by bands of rows: a pixel goes to its band and, near an edge, to the next one as well, so about
    ``1 + 4 / band`` rows are shuffled for each pixel instead of 25."""
    own = F.floor(F.col("y") / band)
    near = F.array_distinct(F.array(own, F.floor((F.col("y") - 2) / band), F.floor((F.col("y") + 2) / band)))
    dealt = pixels.withColumn("band", F.explode(near)).filter(F.col("band").between(0, (height - 1) // band))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf.band.iloc[0]) * band
        rows = min(band, height - top)
        field = np.zeros((rows + 4, width + 4, 3), np.int64)
        field[pdf.y.to_numpy() - top + 2, pdf.x.to_numpy() + 2] = pdf[["r", "g", "b"]].to_numpy()
        gx, gy = np.zeros((rows, width, 3), np.int64), np.zeros((rows, width, 3), np.int64)
        for u in range(5):
            for v in range(5):
                part = field[v : v + rows, u : u + width]
                gx += MASK[u][v] * part
                gy += MASK[v][u] * part
        out = np.minimum(255, np.floor(np.sqrt((gx * gx + gy * gy).astype(float)) / SCALE)).astype(np.int32)
        y, x = np.mgrid[top : top + rows, 0:width]
        return pd.DataFrame({"x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), **{c: out[:, :, k].ravel() for k, c in enumerate("rgb")}})

    return dealt.groupBy("band").applyInPandas(run, "x int, y int, r int, g int, b int")
