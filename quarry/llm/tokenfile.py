"""Operator 10: token ids in a binary file format with Simple-8b word-aligned coding.

The codec packs ids into 64-bit words: the top 4 bits select how many values of which width the other 60 bits hold.
Values come in blocks of ``BLOCK``; each block starts on a word and its word offset is stored, so blocks decode
independently and all words of a selector decode in one NumPy pass. A value that does not fit 60 bits is an escape:
its word holds the all-ones mark and the value stands in the escape list.

A token file is a folder of Parquet parts, which serve as the container (atomic commit, any store Spark can write).
Each row is a segment, a self-describing byte string:
``b"QS8B"``, then unsigned 32-bit counts of documents, blocks, words and escapes; document ids (64 bit), null flags
(8 bit), tokens of each document (64 bit), word offset of each block (32 bit, one more than blocks), words, escapes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import store
from quarry.llm.arrow import pieces

BLOCK = 256
#: Selector: (values, bits each). Selectors 0 and 1 stand for runs of zeros.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_SINGLE = len(SELECTORS) - 1
_ESCAPE = np.uint64((1 << 60) - 1)
_U = np.uint64
_COUNT = np.array([c for c, _ in SELECTORS], dtype=np.int64)
MAGIC = b"QS8B"
ENCODE_BLOCKS = 2048


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for zero."""
    if v.size and int(v.max()) < 1 << 52:
        return np.frexp(v.astype(np.float64))[1].astype(np.int8)
    high, low = v >> _U(32), v & _U(0xFFFFFFFF)
    top = np.frexp(high.astype(np.float64))[1]
    return np.where(high > 0, top + 32, np.frexp(low.astype(np.float64))[1]).astype(np.int8)


def _reach(widths: np.ndarray) -> np.ndarray:
    """For each position of each block the first selector, hence the most values, that holds what stands from there."""
    rows, n = widths.shape
    span = np.zeros((rows, n + SELECTORS[0][0]), dtype=np.int8)
    span[:, :n] = widths
    best = np.full((rows, n), _SINGLE, dtype=np.int8)
    size = 1
    for k in range(_SINGLE - 1, -1, -1):
        count, bits = SELECTORS[k]
        while size < count:  # span[i] is the largest width of size values from i on
            step = min(size, count - size)
            span[:, : span.shape[1] - step] = np.maximum(span[:, : span.shape[1] - step], span[:, step:])
            size += step
        best[span[:, :n] <= bits] = k
    return best


def encode_blocks(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, escapes. ``lengths`` cut ``values`` into blocks of 1 to ``BLOCK``."""
    outs = [_encode_some(values, lengths, a) for a in range(0, len(lengths), ENCODE_BLOCKS)]
    if not outs:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _encode_some(values: np.ndarray, lengths: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = int(lengths[:a].sum())
    lengths = lengths[a : a + ENCODE_BLOCKS]
    flat = values[start : start + int(lengths.sum())].astype(_U)
    rows = len(lengths)
    grid = np.zeros((rows, BLOCK + 60), dtype=_U)
    inside = np.arange(BLOCK)[None, :] < lengths[:, None]
    grid[:, :BLOCK][inside] = flat
    large = grid >= _ESCAPE
    escapes = grid[large]
    grid[large] = _ESCAPE
    best = _reach(_widths(grid[:, :BLOCK]))
    row, pos, at = np.arange(rows), np.zeros(rows, dtype=np.int64), []
    while len(row):
        k = best[row, pos]
        at.append((row, pos, k))
        pos = pos + _COUNT[k]
        go = pos < lengths[row]
        row, pos = row[go], pos[go]
    row, pos, k = (np.concatenate(x) for x in zip(*at, strict=True))
    order = np.argsort(row, kind="stable")
    row, pos, k = row[order], pos[order], k[order]
    words = k.astype(_U) << _U(60)
    flat_at = row * grid.shape[1] + pos
    grid = grid.ravel()
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(own := np.flatnonzero(k == s)):
            first = flat_at[own]
            total = words[own]
            for j in range(count):
                total |= grid[first + j] << _U(j * bits)
            words[own] = total
    return words, np.bincount(row, minlength=rows), escapes


def decode_blocks(words: np.ndarray, per_block: np.ndarray, lengths: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of consecutive blocks, one after another."""
    k = (words >> _U(60)).astype(np.int64)
    count = _COUNT[k]
    first = np.concatenate([[0], np.cumsum(per_block)])[:-1]
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], np.cumsum(count)])
    base = np.repeat(ends - lengths - before[first], per_block)
    at = before[:-1] + base
    limit = np.repeat(ends, per_block)
    out = np.zeros(int(lengths.sum()), dtype=_U)
    body = words & _U((1 << 60) - 1)
    for s, (n, bits) in enumerate(SELECTORS):
        if bits and len(own := np.flatnonzero(k == s)):
            mask = _U((1 << bits) - 1)
            for j in range(n):
                to = at[own] + j
                fits = to < limit[own]
                out[to[fits]] = (body[own[fits]] >> _U(j * bits)) & mask
    marked = np.flatnonzero(out == _ESCAPE)
    if len(marked):
        out[marked] = escapes
    return out


def _block_lengths(tokens: np.ndarray) -> np.ndarray:
    blocks = -(-tokens // BLOCK)
    out = np.full(int(blocks.sum()), BLOCK, dtype=np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    out[last] = (tokens - (blocks - 1) * BLOCK)[blocks > 0]
    return out


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment of consecutive documents."""
    tokens = np.array([len(x) for x in ids], dtype=np.int64)
    values = np.concatenate(ids) if ids else np.zeros(0, _U)
    words, per_block, escapes = encode_blocks(values, _block_lengths(tokens))
    offsets = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
    return b"".join(
        [
            MAGIC,
            struct.pack("<4I", len(doc_ids), len(per_block), len(words), len(escapes)),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
            tokens.astype("<i8").tobytes(),
            offsets.tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        ]
    )


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each document, all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, blocks, words, escapes = struct.unpack_from("<4I", data, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    ids, null, tokens = take("<i8", docs), take("u1", docs), take("<i8", docs)
    offsets = take("<u4", blocks + 1).astype(np.int64)
    packed, more = take("<u8", words), take("<u8", escapes)
    values = decode_blocks(packed, np.diff(offsets), _block_lengths(tokens), more)
    return [None if z else int(d) for d, z in zip(ids, null, strict=True)], tokens, values


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = 1 << 20,
) -> None:
    """Encode every text, append ``end_id`` and write the ids below ``path`` in ascending id order.

    Null text is empty. Documents with a null id come first; documents that tie on the id are ordered by a hash of their
    token ids and then by these. Empty input writes a folder without segments. Parts hold equal ranges of ids, found from
    the id column alone (approximate percentiles); an id, or null, that many rows share has several parts, by ranges of that
    hash. Texts are encoded before the shuffle, which moves compressed ids only.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col(id_col), [i / parts for i in range(1, parts)], 10_000)).head()[0] if parts > 1 else []
    # Where a part ends: (not null, id, hash). An id that is a cut more than once is hot: each of its repeats is a cut inside.
    nulls, total = docs.agg(F.count(F.when(F.col(id_col).isNull(), 1)), F.count(F.lit(1))).head()
    times = Counter((1, int(c)) for c in cuts or [])
    if nulls:
        times[0, 0] = -(-nulls * parts // total)
    whole = 1 << 62
    bounds = sorted((*key, whole * j // n) for key, n in times.items() for j in range(1, n + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from quarry.llm.vocab import Encoder

        encoder, squeeze = Encoder.of(tokenizer), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in pieces(whole, "text"):
                end = np.array([] if end_id is None else [end_id], dtype=encoder.dtype).tobytes()
                ids = [x.tobytes() + end for x in encoder.encode(batch.column("text"))]
                keys = batch.column("doc_id").to_pylist()
                ties = [int.from_bytes(blake2b(x, digest_size=8).digest()) >> 2 for x in ids]
                part = [bisect_left(bounds, (0, 0, t) if k is None else (1, k, t)) for k, t in zip(keys, ties, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(part, pa.int32()),
                        "doc_id": pa.array(keys, pa.int64()),
                        "tie": pa.array(ties, pa.int64()),
                        "width": pa.array([encoder.dtype.itemsize] * len(ids), pa.int32()),
                        "ids": pa.array([squeeze.compress(x) for x in ids], pa.binary()),
                    }
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        part, held, keys, ids, start, segment = None, 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            row = {"part": [part], "segment": [segment], "start": [start], "tokens": [held], "data": [pack_segment(keys, ids)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for p, k, w, z in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "width", "ids")), strict=True):
                if keys and (p != part or held >= segment_tokens):
                    yield flush()
                    start, segment, keys, ids, held = (start + held, segment + 1, [], [], 0) if p == part else (0, 0, [], [], 0)
                part = p
                x = np.frombuffer(open_.decompress(z), dtype=f"<u{w}")
                keys.append(k)
                ids.append(x)
                held += len(x)
        if keys:
            yield flush()

    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "part int, doc_id long, tie long, width int, ids binary"
    )
    dealt = coded.repartitionById(max(parts, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    dealt.mapInArrow(pack, "part int, segment long, start long, tokens long, data binary").write.option(
        "compression", "zstd"
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of token files: ``doc_id, start`` (ids of all documents before), ``n_tokens, ids_crc32`` (of the ids
    as little-endian 32-bit integers) and, if asked for, ``ids``."""
    schema = "part int, segment long, start long, tokens long, data binary"
    files = spark.read.schema(schema).parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(totals):  # as many rows as parts
        before.append((part, at))
        at += totals[part]
    offsets = spark.createDataFrame(before, "part int, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "data")), strict=True):
                keys, tokens, values = unpack_segment(data)
                plain = values.astype("<u4")
                ends = np.cumsum(tokens)
                out = {
                    "part": pa.array([part] * len(keys), pa.int32()),
                    "doc_id": pa.array(keys, pa.int64()),
                    "local": pa.array(start + ends - tokens, pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(plain[e - n : e]) for e, n in zip(ends, tokens, strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(plain, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    fields = "part int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.select("part", "start", "data").mapInArrow(read, fields)
    rows = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("local"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write token files into the shared folder and return them as read back, without the ids."""
    path = store.fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path, with_ids=False)
