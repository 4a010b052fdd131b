"""Operator 6: exact top-k search by inner product with pivot-table elimination.

Vectors are scaled to integers. Pivots are vectors of the table itself: half of them farthest-first, half at random, out of
a bounded sample (``sample_rows``, by a hash of the id); the index covers every row. Every candidate's distance to each
pivot is computed once, when candidates are packed into blocks. For a query the triangle inequality gives
``|d(q, p) - d(x, p)| <= d(q, x)``; the largest of these over the pivots is the lower bound of the distance, and
``(|q|^2 + |x|^2 - bound^2) / 2`` the upper bound of the inner product. Candidates are evaluated in the order of that bound
until it falls below the k-th best score: the rest cannot enter. The search starts from the k-th best score among the
pivots, which are candidates themselves. A block stands in the order of its vectors' nearest pivots, and runs of it are
passed over as a whole where the least and largest distances to the pivots allow no vector of theirs.

Queries are packed into blocks too and each meets every candidate block, so no task holds more than a block of either.
Meetings lie in a grid whose cells have about ``SIDE`` rows of either side (fewer candidates where there are few), so cells
grow with the data and both sides are copied as little as cells of that work allow. Each meeting returns at most k rows a
query; a window over those rows gives the result. ``elimination`` tells what share of the candidates was evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-6
RUN = 256
PIVOTS = 256
SIDE = 1 << 17
_KEPT = ("dim", "ids", "vectors", "far", "least", "most")


def _scaled(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        if x is None or any(v is None for v in x):
            out.append(None)
            continue
        v = np.floor(np.asarray(x, dtype=np.float64) * scale)
        out.append(v if np.isfinite(v).all() else None)
    return out


def choose_pivots(x: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Rows of distinct ``x``: the first half farthest-first, the others at random."""
    order = np.random.default_rng(seed).permutation(len(x))
    chosen: list[int] = [int(order[0])] if len(x) else []
    near = _distances(x, x[chosen])[:, 0] if chosen else np.zeros(0)
    while len(chosen) < min(count // 2, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    held = set(chosen)
    return np.array((chosen + [int(i) for i in order if int(i) not in held])[:count], dtype=np.int64)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        sq = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
        return np.sqrt(np.maximum(sq, 0))


def _bounded(score: int) -> int:
    return max(-(1 << 63) + 1, min((1 << 63) - 1, score))


class Found:
    """The best scores of one query, and how many candidates were evaluated."""

    __slots__ = ("best", "floor", "evaluated")

    def __init__(self, floor: float = -np.inf):
        self.best: list[tuple[int, int]] = []
        self.floor, self.evaluated = floor, 0  # no score below floor can be among the best

    def least(self, k: int) -> float:
        return max(self.floor, -self.best[-1][0]) if len(self.best) == k else self.floor


def _farthest(by_pivot: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each column of ``by_pivot`` the largest difference from ``of``, with one row in the processor's cache at a time."""
    far, some = np.zeros(by_pivot.shape[1], np.float32), np.empty(by_pivot.shape[1], np.float32)
    for row, x in zip(by_pivot, of, strict=True):
        np.subtract(row, x, out=some)
        np.abs(some, out=some)
        np.maximum(far, some, out=far)
    return far


def search_block(
    qid: np.ndarray, q: np.ndarray, qd: np.ndarray, floor: np.ndarray,
    xid: np.ndarray, x: np.ndarray, xd: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, step: int = 512,
) -> list[Found]:
    """Exact top ``k`` of one block for each query, less what lies below its ``floor``. Candidates of the query's own id are
    left out; ties go to the smaller id. Integer components keep float64 products exact up to 2**53; beyond, Python's
    integers take over. ``xd`` holds distances to the pivots, a row each; ``least`` and ``most`` those of runs of ``RUN``."""
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < 2.0**53
    with np.errstate(over="ignore", invalid="ignore"):
        xn, qn = (x * x).sum(1), (q * q).sum(1)
    top = np.array([xn[a : a + RUN].max() for a in range(0, len(xn), RUN)])
    by_pivot = np.ascontiguousarray(xd.T)
    out = []
    for i in range(len(qid)):
        found = Found(floor[i])
        with np.errstate(over="ignore", invalid="ignore"):
            error = 4e-7 * (qd[i].max(initial=0) + most.max(initial=0)) + SLACK  # distances are rounded to 32 bits

            def high(low: np.ndarray, norm: np.ndarray, i: int = i, error: float = error) -> np.ndarray:
                low = np.nan_to_num(np.maximum(low - error, 0), nan=0, posinf=0)
                bound = 0.5 * (qn[i] + norm - low * low)
                return bound + SLACK * (np.abs(bound) + qn[i] + norm) + 1

            if qd.shape[1]:
                runs = np.flatnonzero(~(high(np.maximum(least - qd[i], qd[i] - most).max(axis=1), top) < found.floor))
                if 3 * len(runs) > len(least):
                    at = np.arange(len(xid))
                    far = _farthest(by_pivot, qd[i])
                else:
                    at = (runs[:, None] * RUN + np.arange(RUN)[None, :]).ravel()
                    at = at[at < len(xid)]
                    far = np.abs(xd[at] - qd[i]).max(axis=1) if len(at) else np.zeros(0)
                bound = high(far.astype(np.float64), xn[at])
            else:
                at = np.arange(len(xid))
                bound = high(np.zeros(len(at)), xn)
        near = np.flatnonzero(~(bound < found.floor))
        near = near[np.argsort(-bound[near], kind="stable")]
        for a in range(0, len(near), step):
            if bound[near[a]] < found.least(k):
                break
            some = at[near[a : a + step]]
            some = some[xid[some] != qid[i]]
            found.evaluated += len(some)
            if exact:
                score = x[some] @ q[i]
                enters = score >= found.least(k)
                some, score = some[enters], score[enters]
                if len(some) > k:
                    first = np.lexsort((xid[some], -score))[:k]
                    some, score = some[first], score[first]
                listed = [(-int(s), int(j)) for s, j in zip(score, xid[some], strict=True)]
            else:
                whole = [int(v) for v in q[i]]
                listed = [(-_bounded(sum(a * int(b) for a, b in zip(whole, x[r], strict=True))), int(xid[r])) for r in some]
            found.best = sorted(found.best + listed)[:k]
        out.append(found)
    return out


def _pack(rows: DataFrame, scale: float, pivots, size: int) -> DataFrame:
    """Blocks of up to ``size`` scaled vectors of one length, in the order of their nearest pivots, with their distances to
    the pivots and the least and largest of these in each run of ``RUN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            ids, x = np.array(ids, "<i8"), np.array(vectors, dtype=np.float64).reshape(len(ids), dim)
            p = pivots.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))[1]
            with np.errstate(over="ignore"):
                far = _distances(x, p).astype("<f4")
            if len(p):
                order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
                ids, x, far = ids[order], x[order], far[order]
            ends = [np.array([f(far[a : a + RUN], axis=0) for a in range(0, len(ids), RUN)], "<f4") for f in (np.min, np.max)]
            row = [pa.array([dim], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x.astype("<f8"), far, *ends))]
            return pa.RecordBatch.from_arrays(row, names=list(_KEPT))

        for batch in batches:
            for key, v in zip(batch.column("vec_id").to_pylist(), _scaled(batch.column("embedding"), scale), strict=True):
                if v is None or key is None:
                    continue
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(key)
                vectors.append(v)
                if len(ids) >= size:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary, far binary, least binary, most binary")


def _pivots(candidates: DataFrame, scale: float, count: int, sample_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the sample the ids and vectors of its pivots."""
    sample = candidates.filter("vec_id IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(sample_rows).toArrow()
    held: dict[int, dict[bytes, tuple[int, np.ndarray]]] = {}
    for key, v in zip(sample["vec_id"].to_pylist(), _scaled(sample["embedding"], scale), strict=True):
        if v is not None:
            held.setdefault(len(v), {}).setdefault(v.tobytes(), (key, v))
    out = {}
    for dim, kinds in held.items():
        ids, x = np.array([i for i, _ in kinds.values()], dtype=np.int64), np.array([v for _, v in kinds.values()]).reshape(len(kinds), dim)
        if dim and np.abs(x).max() < 1e12:  # larger components are compared without pivots
            chosen = choose_pivots(x, count)
            out[dim] = ids[chosen], x[chosen]
    return out


def _floors(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best reaches at least: the k-th best among the pivots, which are candidates."""
    if len(p) <= k or np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, p.shape[1]) >= 2.0**53:
        return np.full(len(q), -np.inf)
    scores = np.where(qid[:, None] == pid[None, :], -np.inf, q @ p.T)
    return np.partition(scores, -k, axis=1)[:, -k]


def _met(queries: DataFrame, candidates: DataFrame, k: int, scale: float, pivots: int, block: int, buckets: int | None, sample_rows: int, id_col: str, vector_col: str):
    """Meetings of query and candidate blocks, and a function that searches them."""
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    shared = queries.sparkSession.sparkContext.broadcast(_pivots(pick(candidates), scale, pivots, sample_rows))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, asks = candidates.count(), queries.count()
    columns = buckets or max(1, -(-rows // SIDE), min(parts, -(-rows // block)))
    lines = max(1, -(-asks // SIDE))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    side = _pack(pick(candidates), scale, shared, block).withColumn("column", own(columns)).withColumn("line", every(lines))
    asked = _pack(pick(queries), scale, shared, block // 8).withColumn("qline", own(lines)).select(
        F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.col("far").alias("qfar"), "qline", every(columns).alias("qcolumn")
    )
    met = asked.join(side, (F.col("qcolumn") == F.col("column")) & (F.col("qline") == F.col("line")) & (F.col("qdim") == F.col("dim")))

    def searched(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[Found], int]]:
        for dim, *data in zip(*(batch.column(c).to_pylist() for c in ("dim", "qids", "ids", "qvectors", "vectors", "qfar", "far", "least", "most")), strict=True):
            qid, xid = (np.frombuffer(d, "<i8") for d in data[:2])
            q, x = (np.frombuffer(d, "<f8").reshape(-1, dim) if dim else np.zeros((n, 0)) for d, n in zip(data[2:4], (len(qid), len(xid)), strict=True))
            pid, p = shared.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            qd, xd, least, most = (np.frombuffer(d, "<f4").reshape(-1, len(p)) if len(p) else np.zeros((n, 0), np.float32) for d, n in zip(data[4:], (len(qid), len(xid), 0, 0), strict=True))
            yield qid, search_block(qid, q, qd, _floors(qid, q, pid, p, k), xid, x, xd, least, most, k), len(xid)

    return met.select("dim", "qids", "qvectors", "qfar", "ids", "vectors", "far", "least", "most"), searched


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    pivots: int = PIVOTS,
    block: int = 8192,
    buckets: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products of every query, or all if fewer.

    Components become ``floor(scale * component)``. Vectors that are null or hold a null or non-finite component, and
    rows with a null id, take no part; only vectors of equal length meet. Rows that repeat an id are candidates each.
    Scores beyond 64 bits are set to the nearest 64-bit value. Queries without candidates and empty tables give no rows.
    ``sample_rows`` bounds the rows among which pivots are chosen; ``buckets`` sets the columns of the grid.
    """
    met, searched = _met(queries, candidates, k, scale, pivots, block, buckets, sample_rows, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, found, _ in searched(batch):
                listed = [(int(i), j, -s) for i, f in zip(qid, found, strict=True) for s, j in f.best]
                cols = list(zip(*listed, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def elimination(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    pivots: int = PIVOTS,
    block: int = 8192,
    buckets: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 4096,
) -> DataFrame:
    """``query_id, evaluated, candidates``: of how many candidates ``top_k`` computes the score for each query."""
    met, searched = _met(queries, candidates, k, scale, pivots, block, buckets, sample_rows, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, found, n in searched(batch):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid), "evaluated": pa.array([f.evaluated for f in found], pa.int64()), "candidates": pa.array([n] * len(qid), pa.int64())})

    rows = met.mapInArrow(run, "query_id long, evaluated long, candidates long")
    return rows.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"), F.sum("candidates").alias("candidates"))
