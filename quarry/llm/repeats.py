"""Operator 7: repeated passages by a sparse suffix array.

Suffixes of the corpus start at words; only those at content-selected minimisers are kept. A position is kept when its
``seed``-word hash is the smallest among the ``window`` seeds of some window, so any two equal passages of
``seed + window - 1 = min_words`` words keep at least one suffix at the same place. Suffixes are sorted by their seed and
then by the hash of their next ``min_words`` words (sampled splitters, external sort); equal content is then adjacent.
Each suffix is compared with its neighbour from another document; the pair's texts are joined and the match is extended
word by word to the left and to the right. Extensions of ``min_words`` words or more are repeats.

A passage that many documents share gives one pair a document, with its neighbour, never all pairs. The splitters include
the document, so the suffixes of one hot passage spread over several tasks; suffixes whose neighbours lie in other
partitions meet one of the rows (four for each partition) that stand at the partitions' borders.

A neighbour shares the seed, but where several documents hold it, another one may share more. So where a seed has more than
two suffixes, the windows of ``min_words`` words around it that the match with the neighbour does not cover are listed with
a 128-bit hash, and those that another document lists too are repeats as well. Every window that two documents hold is
found by one of the two ways: a shared window has its minimiser in both, and there it is covered or listed in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import pieces
from quarry.llm.store import materialise
from quarry.llm.words import Words, mix, scan

SEED_WORDS, MIN_WORDS = 40, 50
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, dtype=_U)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def rolling(hashes: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Hashes of the next ``size`` words from each word on, for each size; 0 where fewer follow in the buffer."""
    n = len(hashes)
    power, inverse = _tables(n + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * power[:n])])
    out = []
    for size in sizes:
        h = np.zeros(n, _U)
        if n >= size:
            h[: n - size + 1] = mix((sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1])
        out.append(h)
    return out


def seeds(w: Words, seed: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes: text, word position, seed hash, hash of the next ``min_words`` words (0 if fewer follow)."""
    window = min_words - seed + 1
    short, long = rolling(w.hashes, [seed, min_words])
    n = len(short)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(0, _U)
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)  # words from here to the end of the text
    starts = np.flatnonzero(left[: n - window + 1] >= min_words)
    view = np.lib.stride_tricks.sliding_window_view(short, window)
    at = np.unique(starts + view[starts].argmin(axis=1))
    text = np.searchsorted(w.first, at, side="right") - 1
    return text, at - w.first[text], short[at], np.where(left[at] >= min_words, long[at], _U(0))


def _thinned(doc: np.ndarray, pos: np.ndarray, short: np.ndarray, long: np.ndarray, step: int) -> np.ndarray:
    """Indices of the suffixes to emit. Where one word repeats, every position is a minimiser; of such a run of equal
    suffixes each ``step``-th and the last are enough, since extension covers what lies between."""
    n = len(doc)
    new = np.ones(n, dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (short[1:] != short[:-1]) | (long[1:] != long[:-1])
    place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero((place % step == 0) | np.append(new[1:], True)[:n])


def _suffixes(docs: DataFrame, seed: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
                for w in scan(batch.column("text"), lower=True):
                    text, pos, short, long = seeds(w, seed, min_words)
                    doc = ids[w.row + text]
                    one = _thinned(doc, pos, short, long, min_words - seed + 1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "seed": pa.array(short[one].view(np.int64)), "next": pa.array(long[one].view(np.int64)),
                            "doc_id": pa.array(doc[one]), "pos": pa.array(pos[one], pa.int32()),
                        }
                    )

    return docs.mapInArrow(run, "seed long, next long, doc_id long, pos int")


def _compare_sorted(rows: pa.Table) -> pa.RecordBatch:
    """Pairs of each row with the nearest row above it that has the same seed and another document, or the nearest below
    if there is none above. Suffixes whose next words no other document shares stand in the order of documents, not of
    their hashes, so that documents alike in many places meet the same neighbour in each. ``crowd`` marks seeds with more
    than two rows and those at the ends of the batch."""
    seed, nxt, doc, pos = (np.asarray(rows[c], dtype=np.int64) for c in ("seed", "next", "doc_id", "pos"))
    n = len(seed)
    turn = np.ones(n, dtype=bool)
    turn[1:] = (seed[1:] != seed[:-1]) | (nxt[1:] != nxt[:-1])
    run = np.cumsum(turn) - 1
    other = np.zeros(n, dtype=np.int64)
    other[1:] = ~turn[1:] & (doc[1:] != doc[:-1])
    shared = np.bincount(run, weights=other)[run] > 0
    nxt = np.where(shared, nxt, 0)
    order = np.lexsort((pos, doc, nxt, seed))
    seed, doc, pos = seed[order], doc[order], pos[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = seed[1:] != seed[:-1]
    group = np.cumsum(fresh) - 1
    crowd = (np.bincount(group) > 2)[group] | (group == 0) | (group == group[-1])
    change = fresh.copy()
    change[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(change)
    which = np.cumsum(change) - 1
    above, below = at[which] - 1, np.append(at[1:], n)[which]
    good_above = (above >= 0) & (seed[above] == seed)
    good_below = (below < n) & (seed[np.minimum(below, n - 1)] == seed)
    i = np.flatnonzero(good_above | good_below)
    j = np.where(good_above, above, below)[i]
    swap = doc[j] > doc[i]
    a, b = np.where(swap, i, j), np.where(swap, j, i)
    return _rows(0, pa.array(seed[i]), pa.array(doc[a]), pa.array(pos[a], pa.int32()), pa.array(doc[b]), pa.array(pos[b], pa.int32()), pa.array(crowd[i]))


_PAIR = "kind int, seed long, a long, pos_a int, b long, pos_b int, crowd boolean"


def _rows(kind: int, seed: pa.Array, a: pa.Array, pos_a: pa.Array, b: pa.Array = None, pos_b: pa.Array = None, crowd: pa.Array = None) -> pa.RecordBatch:
    n = len(seed)
    none = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()))
    b, pos_b, crowd = (y if x is None else x for x, y in zip((b, pos_b, crowd), none, strict=True))
    columns = (pa.array(np.full(n, kind, np.int32)), seed, a, pos_a, b, pos_b, crowd)
    return pa.RecordBatch.from_arrays(list(columns), names=["kind", "seed", "a", "pos_a", "b", "pos_b", "crowd"])


def _neighbours(ranged: DataFrame) -> DataFrame:
    """From each sorted partition pairs of neighbours (``kind`` 0), of its first and its last seed the outermost suffixes of
    two documents (1), and of a first or last seed that one document alone has there, all suffixes (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, opening, top = None, None, []  # rows of the seed last seen; the partition's first seed, while it lasts

        def some(kind: int, rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            return _rows(kind, *(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows["seed"], rows["doc_id"], rows["pos"])))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if carried is not None:
                rows = pa.concat_tables([carried, rows])
            seed, doc = (np.asarray(rows[c], dtype=np.int64) for c in ("seed", "doc_id"))
            yield _compare_sorted(rows)
            if carried is None:
                opening, top = seed[0], [doc[0]]
                yield some(1, rows.slice(0, 1))
            if opening is not None:
                own = seed == opening
                if len(top) == 1 and (own & (doc != top[0])).any():
                    at = int(np.argmax(own & (doc != top[0])))
                    top.append(doc[at])
                    yield some(1, rows.slice(at, 1))
                if not own.all():
                    if len(top) == 1:
                        yield some(2, rows.slice(0, int(np.argmin(own))))
                    opening = None
            begin = len(seed) - int(np.argmin((seed == seed[-1])[::-1])) if (seed != seed[-1]).any() else 0
            others = np.flatnonzero(doc[begin:] != doc[-1])
            if len(others):
                carried = pa.concat_tables([rows.slice(begin + int(others[-1]), 1), rows.slice(len(seed) - 1, 1)])
            else:
                carried = rows.slice(begin)
        if carried is not None:
            docs = np.asarray(carried["doc_id"], dtype=np.int64)
            if (docs != docs[-1]).any():
                yield some(1, carried)
            else:
                yield some(1, carried.slice(carried.num_rows - 1, 1))
                yield some(2, carried)

    return ranged.mapInArrow(run, _PAIR)


def extend(
    a: np.ndarray, b: np.ndarray, seeds_: list[tuple[int, int]], min_words: int, more: tuple[np.ndarray, np.ndarray] | None = None
) -> list[tuple[int, int, int]]:
    """Maximal matches ``(start in a, start in b, words)`` of at least ``min_words`` words through the seeds. ``more`` holds
    second hashes of the words, which must agree too."""
    out = []
    by_shift: dict[int, list[int]] = {}
    for x, y in seeds_:
        by_shift.setdefault(x - y, []).append(x)
    for shift, at in by_shift.items():
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        unlike = a[lo:hi] != b[lo - shift : hi - shift]
        if more is not None:
            unlike |= more[0][lo:hi] != more[1][lo - shift : hi - shift]
        differ = np.flatnonzero(unlike) + lo
        edges = np.concatenate([[lo - 1], differ, [hi]])
        k = np.unique(np.searchsorted(edges, np.array(at), side="right"))
        for i in k:
            s, e = int(edges[i - 1]) + 1, int(edges[i])
            if e - s >= min_words:
                out.append((s, s - shift, e - s))
    return out


def open_windows(hashes: np.ndarray, second: np.ndarray, at: np.ndarray, spans: list[tuple[int, int]], min_words: int, reach: int) -> tuple[np.ndarray, ...]:
    """Starts and two hashes of the windows of ``min_words`` words that begin at most ``reach`` words before a place of
    ``at`` and lie in none of ``spans``."""
    n = len(hashes) - min_words + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none.astype(_U)
    listed = np.zeros(n, dtype=bool)
    starts = (at[:, None] - np.arange(reach + 1)[None, :]).ravel()
    listed[starts[(starts >= 0) & (starts < n)]] = True
    for s, e in spans:
        listed[s : max(s, e - min_words + 1)] = False
    starts = np.flatnonzero(listed)
    if not len(starts):
        return starts, starts.astype(_U), starts.astype(_U)
    return starts, rolling(hashes, [min_words])[0][starts], rolling(second, [min_words])[0][starts]


def merged_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching ``(start, end, other)`` joined, each with its smallest ``other``."""
    out: list[tuple[int, int, int]] = []
    for s, e, other in sorted(spans):
        if out and s <= out[-1][1]:
            a, b, o = out[-1]
            out[-1] = (a, max(b, e), min(o, other))
        else:
            out.append((s, e, other))
    return out


def _columns(rows: list[tuple], names: tuple[str, ...], empty: tuple[str, ...] = ()) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    held = {c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)}
    return pa.RecordBatch.from_pydict(held | {c: pa.nulls(len(rows), pa.int64()) for c in empty})


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS
) -> DataFrame:
    """One row for each passage of a document that another document repeats: ``doc_id, start_word, end_word, n_words,
    other_id, removable``.

    Words are maximal runs outside ASCII white space, compared with ``A-Z`` in lower case. Overlapping matches of a
    document are merged; ``other_id`` is the smallest of the documents met there and ``removable`` tells that it is
    smaller than ``doc_id``, so that dropping removable passages keeps the first copy. Rows with a null id or text take
    no part; repeated rows of one id count as one document and only one of them is compared. Texts shorter than
    ``min_words`` and empty tables give no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    suffixes = _suffixes(texts, seed_words, min_words)
    ranged = suffixes.repartitionByRange(parts, "seed", "next", "doc_id").sortWithinPartitions("seed", "next", "doc_id", "pos")
    found = materialise(_neighbours(ranged), "neighbours")
    pairs = found.filter("kind = 0").select("a", "b", "pos_a", "pos_b", "crowd")
    borders = found.filter("kind = 1").select("seed", "a", "pos_a").distinct().collect()  # four a partition
    by_seed: dict[int, dict[int, int]] = {}
    for r in borders:
        held = by_seed.setdefault(r["seed"], {})
        if len(held) < 2:  # two documents are enough for any third, and for each other
            held.setdefault(r["a"], r["pos_a"])
    rows = [(s, d, p) for s, held in by_seed.items() if len(held) > 1 for d, p in held.items()]
    border = F.broadcast(spark.createDataFrame(rows, "seed long, other long, other_pos int"))
    alone = found.filter("kind = 2").select("seed", F.col("a").alias("own"), F.col("pos_a").alias("own_pos")).distinct()
    alone = alone.join(border, "seed").filter("own <> other")
    first = F.col("own") < F.col("other")
    across = alone.select(
        F.when(first, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("b"),
        F.when(first, F.col("own_pos")).otherwise(F.col("other_pos")).alias("pos_a"), F.when(first, F.col("other_pos")).otherwise(F.col("own_pos")).alias("pos_b"),
        F.lit(True).alias("crowd"),
    )
    pairs = pairs.unionByName(across)
    pairs = materialise(pairs.groupBy("a", "b").agg(F.collect_set(F.struct("pos_a", "pos_b", "crowd")).alias("at")), "repeat-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = texts.join(wanted, "doc_id", "left_semi")
    reach = min_words - seed_words

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text_b", 2 << 20):
                sides = []
                for c in ("text_a", "text_b"):
                    sides.append([(w.hashes[i:j], w.second[i:j]) for w in scan(batch.column(c), lower=True) for i, j in zip(w.first[:-1], w.first[1:], strict=True)])
                found: dict[int, list[tuple[int, int, int]]] = {}
                crowd: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
                for a, b, at, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "at")), *sides, strict=True):
                    for s, t, n in extend(wa[0], wb[0], [(x["pos_a"], x["pos_b"]) for x in at], min_words, (wa[1], wb[1])):
                        found.setdefault(a, []).append((s, s + n, b))
                        found.setdefault(b, []).append((t, t + n, a))
                    if any(x["crowd"] for x in at):
                        crowd.setdefault(a, (*wa, []))[2].extend(x["pos_a"] for x in at if x["crowd"])
                        crowd.setdefault(b, (*wb, []))[2].extend(x["pos_b"] for x in at if x["crowd"])
                spans = {doc: merged_spans(listed) for doc, listed in found.items()}
                yield _columns([(doc, *x) for doc, listed in spans.items() for x in listed], ("doc_id", "start", "end", "other_id"), ("one", "two"))
                for doc, (one, two, at) in crowd.items():
                    covered = [(s, e) for s, e, _ in found.get(doc, [])]  # each match alone: a window may straddle two
                    starts, h, g = open_windows(one, two, np.unique(at), covered, min_words, reach)
                    if len(starts):
                        out = {"doc_id": pa.array(np.full(len(starts), doc)), "start": pa.array(starts)}
                        out |= {c: pa.nulls(len(starts), pa.int64()) for c in ("end", "other_id")}
                        yield pa.RecordBatch.from_pydict(out | {"one": pa.array(h.view(np.int64)), "two": pa.array(g.view(np.int64))})

    left = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "at", "text_a", "text_b")
    compared = materialise(joined.mapInArrow(compare, "doc_id long, start long, end long, other_id long, one long, two long"), "repeat-matches")
    windows = compared.filter("one IS NOT NULL").select("doc_id", "start", "one", "two").distinct()
    both = windows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
    again = windows.join(both, ["one", "two"]).select(
        "doc_id", "start", (F.col("start") + min_words).alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other_id")
    )
    spans = compared.filter("one IS NULL").select("doc_id", "start", "end", "other_id").unionByName(again)
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("other_id").alias("other_id"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, listed in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                out += [(doc, *x) for x in merged_spans([(y["start"], y["end"], y["other_id"]) for y in listed])]
            yield _columns(out, ("doc_id", "start_word", "end_word", "other_id"))

    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other_id"))).alias("spans"))
    out = listed.mapInArrow(merge, "doc_id long, start_word long, end_word long, other_id long")
    return out.select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id",
        (F.col("other_id") < F.col("doc_id")).alias("removable"),
    )
