"""Image sources and sinks (S5, S6, K6, K7): pixels as rows ``x, y, r, g, b``."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.ranges import registered
from quarry.sources.text import merge_files
from quarry.store import materialise

ROWS = 64


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``path, x, y, r, g, b`` of BMP and PNG files, decoded by Spark's image source; row padding is honoured."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("image").to_pylist():
                h, w, c = image["height"], image["width"], image["nChannels"]
                data = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)
                for a in range(0, h, ROWS):
                    part = data[a : a + ROWS].astype(np.int32)
                    blue, green, red = (part[:, :, min(k, c - 1)] for k in (0, 1, 2))
                    y, x = np.mgrid[a : a + len(part), 0:w]
                    cols = {"x": x, "y": y, "r": red, "g": green, "b": blue}
                    yield pa.RecordBatch.from_pydict({"path": pa.array([image["origin"]] * part[:, :, 0].size), **{k: pa.array(v.ravel().astype(np.int32)) for k, v in cols.items()}})

    return spark.read.format("image").load(path).select("image").mapInArrow(unpack, "path string, x int, y int, r int, g int, b int")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _bands(pixels: DataFrame, width: int, height: int, line: str, rows: int = ROWS) -> DataFrame:
    """``band, data, sum, size``: bands of ``rows`` rows from the top as the file wants them (``line``: ``png`` compressed as a
    chunk, or ``bmp``), with the check sum and size of the bytes before compression, in a written table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band, pdf = int(pdf.band.iloc[0]), pdf.dropna()
        if not 0 <= band * rows < height or ((pdf.x < 0) | (pdf.x >= width) | (pdf.y >= height)).any():
            raise ValueError(f"pixels outside an image of {width} x {height}")
        field = np.zeros((min(rows, height - band * rows), width, 3), np.uint8)
        field[pdf.y.to_numpy(int) - band * rows, pdf.x.to_numpy(int)] = pdf[["r", "g", "b"]].to_numpy()
        if line == "bmp":
            data = np.pad(field[:, :, ::-1].reshape(len(field), -1), ((0, 0), (0, -width * 3 % 4))).tobytes()
            return pd.DataFrame({"band": [band], "data": [data], "sum": [0], "size": [len(data)]})
        raw = np.pad(field.reshape(len(field), -1), ((0, 0), (1, 0))).tobytes()
        pack = zlib.compressobj(wbits=-15)  # blocks that end on a byte may follow one another
        data = pack.compress(raw) + pack.flush(zlib.Z_FULL_FLUSH)
        return pd.DataFrame({"band": [band], "data": [_chunk(b"IDAT", data)], "sum": [zlib.adler32(raw)], "size": [len(raw)]})

    own = pixels.select(F.floor(F.col("y") / rows).cast("long").alias("band"), *(F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "g", "b")))
    none = [F.lit(None).cast("int").alias(c) for c in ("x", "y", "r", "g", "b")]
    every = pixels.sparkSession.range(-(-height // rows)).select(F.col("id").alias("band"), *none)
    return materialise(own.unionByName(every).groupBy("band").applyInPandas(run, "band long, data binary, sum long, size long"), "bands")


def _strung(bands: DataFrame, head: bytes, tail: bytes, path: str) -> None:
    """One file of a head, all bands and a tail. Tasks write the bands in order as parts, and a task strings their bytes together."""
    spark = bands.sparkSession
    ends = spark.createDataFrame([(-1, head), (1 << 62, tail)], "band long, data binary")
    parts = bands.select("band", "data").unionByName(ends).orderBy("band").select("data", F.lit(1).cast("long").alias("records"))
    folder, name = path.rsplit("/", 1)
    held = f"{folder}/_{name}-{uuid.uuid4().hex}"
    parts.write.format(registered(spark)).mode("append").options(path=held, kind="blocks").save()
    merge_files(spark, held, folder, name)


def _adler(first: int, second: int, size: int) -> int:
    """The Adler-32 sum of two byte strings from their sums and the second's size."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (a + c - 1) % 65521 | (b + d + size * (a - 1)) % 65521 << 16


def write_png(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """K6, K7: an 8-bit RGB PNG, compressed by the tasks that hold its bands. The driver sees the sums of the bands only."""
    bands, total = _bands(pixels, width, height, "png"), 1
    for r in bands.select("band", "sum", "size").orderBy("band").collect():
        total = _adler(total, r["sum"], r["size"])
    head = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c")
    tail = _chunk(b"IDAT", zlib.compressobj(wbits=-15).flush() + struct.pack(">I", total)) + _chunk(b"IEND", b"")
    _strung(bands, head, tail, path)


def write_bmp(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """K7: a 24-bit BMP, rows padded to four bytes, stored from the top (negative height)."""
    size = (width * 3 + -width * 3 % 4) * height
    head = struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 24, 0, size, 2835, 2835, 0, 0)
    _strung(_bands(pixels, width, height, "bmp"), head, b"", path)
