"""Operator 12: vectors as codes of the nearest entries of trained codebooks (product quantisation in whole numbers).

Vectors are scaled to whole numbers and cut into parts. A round broadcasts a kd-tree of each part's codebook (``entries`` of them at
most, so of a fixed size); tasks find the nearest entry of every part by branch and bound, add up the parts of each
entry, and Spark adds these sums by part, entry and position. Only those sums, as many numbers as the codebooks have, come to
the driver, which divides them. The search goes through a whole batch of vectors at once: the points at a node go on to its
nearer child first, and then to the other one where its box is not farther than the best so far. Boxes at the same distance
are visited, so of entries equally near the one with the lowest index is found.

The table is read once a round and once for the codes; no vector is shuffled. Label sums reach the rows by a join; labels that
hold more than a 256th of the rows are broadcast (256 rows at most), so no task gets all rows of one label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import materialise

LEAF = 8
CHUNK = 4096
MOST_LENGTHS = 64
HOT = 256

Codebooks = dict[int, list[np.ndarray]]  # for each length of vectors the entries of each part


@dataclass
class Node:
    """A box of entries: a leaf holds their indices, ascending, any other node two halves."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray | None = None
    halves: tuple[Node, Node] | None = None


def tree(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """A kd-tree cut at the median of the widest side, down to ``LEAF`` entries or equal ones."""
    at = np.arange(len(entries)) if at is None else at
    held = entries[at]
    node = Node(held.min(axis=0), held.max(axis=0))
    wide = node.high - node.low
    if len(at) <= LEAF or not wide.any():
        node.at = np.sort(at)
        return node
    order = at[np.argsort(held[:, int(wide.argmax())], kind="stable")]
    node.halves = tree(entries, order[: len(at) // 2]), tree(entries, order[len(at) // 2 :])
    return node


def _gap(node: Node, x: np.ndarray) -> np.ndarray:
    """Squared distance of each point from the node's box."""
    off = np.maximum(node.low - x, 0) + np.maximum(x - node.high, 0)
    return (off * off).sum(axis=1)


def nearest(root: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry, the lowest of equal ones, and its squared distance."""
    index, best = np.full(len(x), len(entries), np.int64), np.full(len(x), np.iinfo(np.int64).max, np.int64)

    def visit(node: Node, at: np.ndarray, gap: np.ndarray) -> None:
        open_ = gap <= best[at]
        at = at[open_]
        if not len(at):
            return
        points = x[at]
        if node.halves is None:
            off = points[:, None, :] - entries[node.at][None, :, :]
            far = (off * off).sum(axis=2)
            first = far.argmin(axis=1)
            far, found = far[np.arange(len(at)), first], node.at[first]
            better = (far < best[at]) | (far == best[at]) & (found < index[at])
            best[at[better]], index[at[better]] = far[better], found[better]
            return
        gaps = [_gap(half, points) for half in node.halves]
        left = gaps[0] <= gaps[1]
        for half, own in ((0, left), (1, ~left), (1, left), (0, ~left)):
            visit(node.halves[half], at[own], gaps[half][own])

    for a in range(0, len(x), CHUNK):
        at = np.arange(a, min(a + CHUNK, len(x)))
        visit(root, at, _gap(root, x[at]))
    return index, best


def bound(width: int) -> int:
    """The largest component by size for which a vector's squared distances surely fit 64 bits."""
    return (1 << 29) // max(1, int(np.ceil(np.sqrt(width))))


def cut(length: int, parts: int) -> list[slice]:
    """``parts`` consecutive parts; if they cannot be equal, the first ones have one component more."""
    small, extra = divmod(length, parts)
    ends = np.cumsum([0, *(small + (k < extra) for k in range(parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _scaled(values: np.ndarray, scale: float, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -bound(width), bound(width)).astype(np.int64)


def _by_length(batch: pa.RecordBatch, scale: float, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the batch's vectors: the length, the rows that have it, and their scaled vectors."""
    vectors = batch.column("_vector")
    lengths = np.asarray(pc.list_value_length(vectors))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64)
        yield length, rows, _scaled(flat, scale, -(-length // parts)).reshape(len(rows), length)


def _initial(kept: DataFrame, parts: int, entries: int, scale: float) -> Codebooks:
    """The parts of the vectors with the smallest ids, for each length."""
    lengths = [r[0] for r in kept.select(F.size("_vector")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths; each would need codebooks of its own")
    out = {}
    for length in lengths:
        some = kept.filter((F.size("_vector") == length) & F.col("_id").isNotNull()).orderBy("_id", "_vector").limit(entries)
        rows = [r["_vector"] for r in some.select("_vector").collect()]
        x = _scaled(np.array(rows, np.float64).reshape(len(rows), length), scale, -(-length // parts))
        out[length] = [x[:, part] for part in cut(length, parts)]
    return out


class _Coder:
    """Trees of all codebooks, as tasks get them."""

    def __init__(self, books: Codebooks, parts: int, scale: float):
        self.parts, self.scale = parts, scale
        self.books = {length: [(part, b, tree(b) if len(b) else None) for part, b in zip(cut(length, parts), own, strict=True)] for length, own in books.items()}

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """Length, rows, and for each part its vectors, indices and squared distances; nothing where there are no entries."""
        for length, rows, x in _by_length(batch, self.scale, self.parts):
            book = self.books[length]
            if all(root is not None for _, _, root in book):
                yield length, rows, [(x[:, part], *nearest(root, b, x[:, part])) for part, b, root in book]


def _summed(kept: DataFrame, books: Codebooks, parts: int, scale: float) -> Codebooks:
    """One round: every part goes to its nearest entry; used entries become the floor of their parts' mean."""
    coder = kept.sparkSession.sparkContext.broadcast(_Coder(books, parts, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, _, coded in coder.value.of(batch):
                for k, (x, index, _) in enumerate(coded):
                    n = len(books_sizes[length][k])
                    if (length, k) not in counts:
                        counts[length, k], sums[length, k] = np.zeros(n, np.int64), np.zeros((n, x.shape[1]), np.int64)
                    counts[length, k] += np.bincount(index, minlength=n)
                    np.add.at(sums[length, k], index, x)
        for (length, k), n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "length": pa.array([length] * len(used), pa.int32()), "part": pa.array([k] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()),
                    "n": pa.array(n[used]), "sums": pa.array(list(sums[length, k][used]), pa.list_(pa.int64())),
                }
            )

    books_sizes = {length: [range(len(b)) for b in own] for length, own in books.items()}
    each = kept.select("_vector").mapInArrow(run, "length int, part int, entry int, n long, sums array<long>")
    by = ["length", "part", "entry"]
    total = each.select(*by, "n", F.posexplode_outer("sums").alias("place", "value")).groupBy(*by, "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    fresh = {length: [b.copy() for b in own] for length, own in books.items()}
    for r in total.collect():  # as many rows as the codebooks have components
        if r["place"] is not None:
            fresh[r["length"]][r["part"]][r["entry"], r["place"]] = r["value"] // r["n"]
    coder.unpersist()
    return fresh


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and position, with commas between them."""
    return sha256(",".join(str(v) for b in book for v in b.ravel().tolist()).encode()).hexdigest()


@dataclass
class Codes:
    """``rows`` (id, label, code, error, label_error, codebooks_sha256) and the ``codebooks`` by length of vectors."""

    rows: DataFrame
    codebooks: Codebooks


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> Codes:
    """Codes of all vectors after ``rounds`` rounds of training on all of them.

    A code has two hex digits for each part. Rows whose vector is null or holds a null or non-finite component are left
    out. Components become ``floor(scale * x)``; those beyond ``bound`` of a part's width (2**27 for 16 components) are taken as the
    bound, so that errors fit 64 bits. Each length of vectors has codebooks of its own (64 lengths at most); parts that
    cannot be equal differ by one component. The first entries are the vectors with the smallest ids, by vector where ids
    repeat; rows with a null id are no entries but train and are coded. Without any id, code and error are null. Fewer vectors than
    ``entries`` make smaller codebooks. Rows that repeat count each; null labels are one label; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell 256 entries apart at most")
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), F.col(label_col).alias("_label"))
    kept = own.filter(F.col("_vector").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    books = _initial(kept, parts, entries, scale)
    for _ in range(rounds):
        books = _summed(kept, books, parts, scale)

    coder = vectors.sparkSession.sparkContext.broadcast(_Coder(books, parts, scale))
    digests = {length: digest(book) for length, book in books.items()}
    hexed = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error, book = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, None, object)
            for length, rows, coded in coder.value.of(batch):
                code[rows] = ["".join(x) for x in zip(*(hexed[index].tolist() for _, index, _ in coded), strict=True)]
                error[rows] = sum(far for _, _, far in coded)
                book[rows] = digests[length]
            columns = [batch.column("_id"), batch.column("_label"), pa.array(code, pa.string()), pa.array(error, mask=np.equal(code, None)), pa.array(book, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_label", "code", "error", "codebooks_sha256"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    shape = f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long, codebooks_sha256 string"
    coded = materialise(kept.mapInArrow(run, shape), "vector-codes")
    return Codes(_with_label_errors(coded).select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error", "codebooks_sha256"), books)


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """The error summed over the rows of a label, on each of them."""
    sums = materialise(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    rows = sums.agg(F.sum("_n")).head()[0] or 0
    hot = F.col("_n") * HOT > rows
    same = F.col("_label").eqNullSafe(F.col("_of"))
    met = coded.join(F.broadcast(sums.filter(hot)), same, "left")
    rest = met.filter("_n IS NULL").select(*coded.columns).join(sums.filter(~hot), same)
    columns = [*coded.columns, "label_error"]
    return met.filter("_n IS NOT NULL").select(columns).unionByName(rest.select(columns))
