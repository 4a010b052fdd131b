"""Operator 13: approximate nearest neighbours by cosine, on a neighbour graph built by NN-descent.

Equal vectors are one node, which knows the smallest ids that hold it, so copies crowd out nobody. A node's code is its unit
vector in 16-bit numbers with a scale; codes steer the work, and final scores come from the original vectors in double precision.

Building. A few passes sort nodes by the signs of random projections and compare consecutive ``BLOCK`` nodes; that gives each
node a first list of ``degree`` neighbours. Then each round joins neighbours of neighbours: every node is a centre whose list
are its neighbours (``sample`` new and as many old ones) and the nodes that have it as a neighbour, new ones first, three samples
in all, drawn anew each round by a hash. What is not drawn comes up through other centres or later. Lists meet the codes by a join,
pairs of a list with a new member are compared, and what betters a node's list goes to it by a second join. A pair is new once.
Rounds end when few lists change.

Searching. A query begins at the best of ``ENTRIES`` nodes spread over the index (a fixed number, broadcast) and, where the
index holds its vector, at that node's list. Each round joins its best ``width`` open nodes with their lists and these with
their codes; the ``beam`` best stay, until all of them have been opened, or for ``most`` rounds (a query then has opened several
hundred lists). The best of the beam are compared as they are.

No list is longer than three samples, no beam longer than ``beam``; what goes to a popular node is cut to its best ``degree``
in each task before it is shuffled. All rounds' tables are written, and of each loop's the last two stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.arrow import release
from quarry.llm.store import Rolling, in_buckets, materialise
from quarry.llm.words import mix

NEAR = np.dtype([("id", "<i8"), ("sim", "<f4"), ("new", "u1")])
BLOCK, ENTRIES, HELD, ROWS = 512, 1024, 1 << 19, 256
ARRIVED = 2  # an entry's ``new`` is 0 once it was drawn, 1 before, and this while it comes in
_U = np.uint64


# -- vectors and codes ------------------------------------------------------------------------------------------------


def encode(vector: np.ndarray) -> bytes:
    """A scale and two bytes for each component of the unit vector, enough to rank near copies."""
    unit = vector / np.abs(vector).max(initial=1e-300)
    unit = unit / np.sqrt((unit * unit).sum()) if len(unit) else unit
    scale = np.float32(np.abs(unit).max(initial=1e-30) / 32767)
    return scale.tobytes() + np.rint(unit / scale).astype("<i2").tobytes()


def decoded(codes: list[bytes]) -> np.ndarray:
    """Unit vectors, nearly, of codes of one length."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].copy().view("<i2").astype(np.float32) * raw[:, :4].copy().view("<f4")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row of ``x`` in double precision. Scaling by powers of two keeps squares in range."""
    fit = lambda v: np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])
    q, x = fit(q), fit(x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _vector`` of the rows that take part, each pair once."""
    picked = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector")).filter("_id IS NOT NULL AND _vector IS NOT NULL")
    fine = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0)
    return picked.filter(fine).dropDuplicates()


def _with_codes(rows: DataFrame) -> DataFrame:
    """``rows`` with the column ``code`` of ``_vector``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [encode(np.asarray(v, np.float64)) for v in batch.column("_vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes, pa.binary())], names=[*names, "code"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, code binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` rows at a time; memory goes back to the system at the end, as idle workers would keep it."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)
    release()


def _unnested(lists: pa.ListArray, ident: str) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], pa.StructArray]]:
    """Of lists of structs with a ``code`` and an id, for each length of codes: the unit vectors, which of all structs they
    are, the number of their list and their id, and the structs."""
    held = lists.flatten()
    if len(held):
        row = np.asarray(pc.list_parent_indices(lists))
        codes, ids = held.field("code").to_pylist(), np.asarray(held.field(ident))
        for at in _by_width(codes):
            yield decoded([codes[i] for i in at]), at, (row[at], ids[at]), held


def _each(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal numbers."""
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
    return zip(cuts, [*cuts[1:], len(row)], strict=True)


def _by_width(codes: list[bytes]) -> Iterator[np.ndarray]:
    """Places of the codes of each length."""
    widths = np.fromiter((len(c) for c in codes), np.int64, len(codes))
    for width in np.unique(widths):
        yield np.flatnonzero(widths == width)


# -- lists ------------------------------------------------------------------------------------------------------------


def best_of(node: np.ndarray, near: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries ``near`` of the nodes beside them, those of each node's ``degree`` most similar (ties: smaller id), by node.
    Of entries that repeat an id the one that is not new stays."""
    order = np.lexsort((near["new"], near["id"], node))
    node, near = node[order], near[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (near["id"][1:] != near["id"][:-1])
    node, near = node[first], near[first]
    order = np.lexsort((near["id"], -near["sim"], node))
    node, near = node[order], near[order]
    starts = np.searchsorted(node, node)
    kept = np.arange(len(node)) - starts < degree
    return node[kept], near[kept]


def _packed(node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """One row of bytes for each node; entries stand by node."""
    if not len(node):
        return node, []
    cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return node[cuts], [near[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(node)], strict=True)]


def _lists(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of packed lists, and the number of the row of each."""
    near = np.frombuffer(b"".join(r or b"" for r in rows), NEAR)
    return np.repeat(np.arange(len(rows)), [len(r or b"") // NEAR.itemsize for r in rows]), near


def _entries(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), NEAR)
    out["id"], out["sim"], out["new"] = ids, sims, ARRIVED
    return out


class _Combiner:
    """Collects entries of any nodes and gives them out as packed lists, cut to ``degree``, when there are many."""

    def __init__(self, degree: int):
        self.degree, self.held, self.size = degree, [], 0

    def add(self, node: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((node, near))
        self.size += len(node)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            nodes, lists = _packed(*best_of(np.concatenate([n for n, _ in self.held]), np.concatenate([x for _, x in self.held]), self.degree))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.binary())], names=["node", "near"])
        self.held, self.size = [], 0


def _drawn(near: np.ndarray, centre: np.ndarray, sample: int, turn: int) -> np.ndarray:
    """Which entries of the lists of ``centre`` (one number an entry, by centre) are drawn: of each list, ``sample`` new
    and ``sample`` old ones by a hash."""
    key = mix(mix(near["id"].astype(_U) + _U(turn)) ^ mix(centre.astype(_U)))
    order = np.lexsort((key, near["new"], centre))
    group = centre[order] * 2 + near["new"][order]
    taken = np.zeros(len(near), bool)
    taken[order] = np.arange(len(near)) - np.searchsorted(group, group) < sample
    return taken


# -- building ---------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """``nodes`` (node, _vector, ids, code), ``graph`` (node, code, near, ids; bucketed by node) and what the rounds changed."""

    nodes: DataFrame
    graph: DataFrame
    changes: list[int]
    size: int


def _nodes(rows: DataFrame, copies: int) -> DataFrame:
    """Distinct vectors with their ``copies`` smallest ids; rows beyond them go before the shuffle, so no vector is hot."""
    least = Window.partitionBy("_vector").orderBy("_id")
    few = rows.withColumn("_at", F.row_number().over(least)).filter(F.col("_at") <= copies)
    nodes = few.groupBy("_vector").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    return materialise(_with_codes(nodes).withColumn("node", F.monotonically_increasing_id()), "ann-nodes")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _first_lists(nodes: DataFrame, size: int, degree: int, passes: int, block: int) -> DataFrame:
    """``node, code, near, changed, worst`` after comparing the nodes of blocks."""
    bits = min(max(0, int(np.ceil(np.log2(max(1, size / block)))) + 3), 40)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_pylist()
            for turn in range(passes):
                cell, width = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int32)
                for at in _by_width(codes):
                    x = decoded([codes[i] for i in at])
                    planes = np.random.default_rng((turn, x.shape[1])).standard_normal((x.shape[1], bits)).astype(np.float32)
                    cell[at], width[at] = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1]), x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([turn] * len(codes), pa.int32()), pa.array(width), pa.array(cell), batch.column("node"), batch.column("code")], names=["turn", "width", "cell", "node", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, codes = None, [], []

        def compared() -> pa.RecordBatch:
            x, own = decoded(codes), np.array(ids, np.int64)
            sims = x @ x.T
            np.fill_diagonal(sims, -9)
            k = min(degree, len(own) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(own), 0), np.int64)
            lists = [_entries(own[b], s[b]).tobytes() for b, s in zip(best, sims, strict=True)]
            given = pa.array(codes if kind[0] == 0 else [None] * len(codes), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(own), given, pa.array(lists, pa.binary())], names=["node", "code", "near"])

        for batch in batches:
            for turn, width, node, code in zip(*(batch.column(c).to_pylist() for c in ("turn", "width", "node", "code")), strict=True):
                if ids and ((turn, width) != kind or len(ids) == block):
                    yield compared()
                    ids, codes = [], []
                kind = turn, width
                ids.append(node)
                codes.append(code)
        if ids:
            yield compared()

    keys = ("turn", "width", "cell", "node")
    placed = nodes.select("node", "code").mapInArrow(place, "turn int, width int, cell long, node long, code binary")
    parts = max(1, min(_parts(nodes.sparkSession), passes * size // (4 * block)))
    found = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, code binary, near binary")
    empty = F.lit(None).cast("binary").alias("own")
    return _bettered(found.groupBy("node").agg(F.max("code").alias("code"), F.collect_list("near").alias("more")).select("node", "code", empty, "more"), degree, 0, 0)


def _bettered(rows: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """Lists from the ``own`` list and the lists ``more``. Of the own entries those that were drawn in this turn are not new
    any longer. ``changed`` counts the entries that came in, ``worst`` is the least similarity that would have to be beaten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, own = _lists(batch.column("own").to_pylist())
            if sample and len(own):
                own = own.copy()
                nodes = np.asarray(batch.column("node"))[row]
                own["new"][_drawn(own, nodes, sample, turn) if (np.diff(nodes) >= 0).all() else _drawn_unordered(own, nodes, sample, turn)] = 0
            joined = [b"".join(x for x in more if x) for more in batch.column("more").to_pylist()]
            other_row, other = _lists(joined)
            rows_, near = np.concatenate([row, other_row]), np.concatenate([own, other])
            loops = near["id"] == np.asarray(batch.column("node"))[rows_]
            rows_, near = best_of(rows_[~loops], near[~loops], degree)
            changed = np.bincount(rows_[near["new"] == ARRIVED], minlength=batch.num_rows).astype(np.int32)
            near["new"] = np.minimum(near["new"], 1)
            lists: list[bytes] = [b""] * batch.num_rows
            worst = np.full(batch.num_rows, -9, np.float32)
            for r, data in zip(*_packed(rows_, near), strict=True):
                lists[r] = data
                if len(data) == degree * NEAR.itemsize:
                    worst[r] = np.frombuffer(data, NEAR)["sim"].min()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(lists, pa.binary()), pa.array(changed), pa.array(worst)], names=["node", "code", "near", "changed", "worst"])

    return rows.mapInArrow(run, "node long, code binary, near binary, changed int, worst float")


def _drawn_unordered(near: np.ndarray, centre: np.ndarray, sample: int, turn: int) -> np.ndarray:
    order = np.argsort(centre, kind="stable")
    taken = np.zeros(len(near), bool)
    taken[order] = _drawn(near[order], centre[order], sample, turn)
    return taken


def _round(graph: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """Neighbours of neighbours: the graph's next state."""

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, near = _lists(batch.column("near").to_pylist())
            node = np.asarray(batch.column("node"))[row]
            taken = _drawn_unordered(near, node, sample, turn)
            centre, member = np.concatenate([node[taken], near["id"]]), np.concatenate([near["id"][taken], node])
            new = np.concatenate([near["new"][taken], near["new"]]).astype(bool)
            draw = mix(mix(member.astype(_U) + _U(turn)) ^ mix(centre.astype(_U))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(member), pa.array(new), pa.array(draw)], names=["centre", "member", "new", "draw"])

    listed = graph.select("node", "near").mapInArrow(list_members, "centre long, member long, new boolean, draw long")
    by = Window.partitionBy("centre").orderBy(F.col("new").desc(), "draw", "member")
    drawn = listed.withColumn("_at", F.row_number().over(by)).filter(F.col("_at") <= 3 * sample)
    members = drawn.groupBy("centre", "member").agg(F.max("new").alias("new"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner(degree)
        for batch in _slices(batches):
            for x, part, ids, held in _unnested(batch.column("held"), "member"):
                fresh, worst = (np.asarray(held.field(c))[part] for c in ("new", "worst"))
                for a, b in _each(ids[0]):
                    new, own = fresh[a:b], ids[1][a:b]
                    if not new.any():
                        continue
                    sims = x[a:b] @ x[a:b].T
                    np.fill_diagonal(sims, -9)
                    i, j = np.nonzero((sims > worst[a:b, None]) & (new[:, None] | new[None, :]))
                    yield from out.add(own[i], _entries(own[j], sims[i, j]))
        yield from out.flush()

    codes = graph.select(F.col("node").alias("member"), "code", "worst")
    lists = members.join(codes.hint("shuffle_hash"), "member").groupBy("centre").agg(F.collect_list(F.struct("member", "new", "worst", "code")).alias("held"))  # three samples at most
    found = lists.select("held").mapInArrow(compare, "node long, near binary")
    more = found.groupBy("node").agg(F.collect_list("near").alias("more"))
    rows = graph.select("node", "code", F.col("near").alias("own")).join(more.hint("shuffle_hash"), "node", "left").select("node", "code", "own", F.coalesce("more", F.array()).alias("more"))
    return _bettered(rows, degree, sample, turn)


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, near = _lists(batch.column("near").to_pylist())
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(near["id"].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "code", "near")), ids], names=["node", "code", "near", "ids"])


def build(rows: DataFrame, k: int = 5, degree: int = 32, sample: int = 20, passes: int = 6, enough: float = 0.02, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """The index of all usable rows. Blocks of ``block`` nodes are compared in ``passes`` passes before the rounds, of which there are three
    or half the binary logarithm of the number of blocks. They end sooner if fewer than ``enough`` of all entries changed."""
    nodes = _nodes(_usable(rows, id_col, vector_col), k + 1)
    size = nodes.count()
    rolling = Rolling("ann-graph", "node")
    graph, changes = rolling.step(_first_lists(nodes, size, degree, passes, block)), []
    most = max(3, int(np.ceil(np.log2(max(1, size / block)) / 2)))
    for turn in range(1, most + 1 if size > 1 else 1):
        graph, seen = rolling.counted(_round(graph, degree, sample, turn), changed=F.sum("changed"))
        changes.append(seen["changed"] or 0)
        if changes[-1] < enough * degree * size:
            break
    return Index(nodes, in_buckets(graph.select("node", "code", "near").mapInArrow(_with_ids, "node long, code binary, near binary, ids array<long>"), "ann-lists", "node"), changes, size)


# -- searching --------------------------------------------------------------------------------------------------------


def search(index: Index, queries: DataFrame, k: int = 5, width: int = 128, beam: int = 128, most: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found for each query, itself left out by its id."""
    spark = queries.sparkSession
    asked = _usable(queries, id_col, vector_col)
    points = materialise(_with_codes(asked.select("_vector").distinct()).withColumn("q", F.monotonically_increasing_id()), "ann-points")
    few = index.nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "code").collect()
    entries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at in _by_width([bytes(r["code"]) for r in few]):
        x = decoded([bytes(few[i]["code"]) for i in at])
        entries[x.shape[1]] = np.array([few[i]["node"] for i in at], np.int64), x
    shared = spark.sparkContext.broadcast(entries)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, beams = batch.column("code").to_pylist(), []
            for code, node, near in zip(codes, batch.column("node").to_pylist(), batch.column("near").to_pylist(), strict=True):
                x = decoded([code])
                ids, held = shared.value.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.float32)))
                start = [_entries(ids, held @ x[0]), np.frombuffer(near or b"", NEAR)]
                if node is not None:
                    start.append(_entries(np.array([node]), np.ones(1)))
                start = np.concatenate(start)
                start["new"] = 1
                if node is not None:
                    start["new"][start["id"] == node] = 0  # its list is here already
                beams.append(best_of(np.zeros(len(start), np.int64), start, beam // 2)[1].tobytes())
            yield stated(batch, beams)

    def stated(batch: pa.RecordBatch, beams: list[bytes]) -> pa.RecordBatch:
        """A row of the state for each query: ``open`` are the ``width`` best of the beam whose lists have not been met."""
        row, near = _lists(beams)
        row, near = best_of(row[near["new"] > 0], near[near["new"] > 0], width)
        ends = np.searchsorted(row, np.arange(len(beams) + 1)).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(near["id"].astype(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("q"), batch.column("code"), pa.array(beams, pa.binary()), ids], names=["q", "code", "beam", "open"])

    own = points.join(index.nodes.select("_vector", "node"), "_vector", "left").join(index.graph.select("node", "near"), "node", "left")
    rolling, shape, still = Rolling("ann-beams"), "q long, code binary, beam binary, open array<long>", F.sum(F.size("open"))
    state, seen = rolling.counted(own.select("q", "code", "node", "near").mapInArrow(begin, shape), still=still)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes = batch.column("code").to_pylist()
            row, near = _lists(batch.column("beam").to_pylist())
            near = near.copy()
            open_ = np.flatnonzero(near["new"])
            rank = np.lexsort((near["id"][open_], -near["sim"][open_], row[open_]))
            first = np.arange(len(open_)) - np.searchsorted(row[open_][rank], row[open_][rank]) < width
            near["new"][open_[rank[first]]] = 0  # their lists are here
            rows_, lists_ = [row], [near]
            for x, _, (at, ids), _ in _unnested(batch.column("met"), "node"):
                for a, b in _each(at):
                    if len(codes[at[a]]) == 2 * x.shape[1] + 4:
                        rows_.append(at[a:b])
                        lists_.append(_entries(ids[a:b], x[a:b] @ decoded([codes[at[a]]])[0]))
            beams = [b""] * batch.num_rows
            for r, data in zip(*_packed(*best_of(np.concatenate(rows_), np.concatenate(lists_), beam)), strict=True):
                beams[r] = data
            yield stated(batch, beams)

    codes = index.graph.select("node", F.col("code").alias("met"))
    nothing = lambda kind: F.lit(None).cast(kind)
    buckets = _parts(spark)
    for _ in range(most):
        if not seen["still"]:
            break
        frontier = state.select("q", F.explode("open").alias("node"))
        pairs = frontier.join(index.graph.select("node", "ids"), "node").select("q", F.explode("ids").alias("node"))
        met = pairs.repartition(buckets, "node").distinct().join(codes.hint("shuffle_hash"), "node")
        met = met.select("q", nothing("binary").alias("code"), nothing("binary").alias("beam"), F.struct("node", F.col("met").alias("code")).alias("met"))
        held = state.select("q", "code", "beam", nothing("struct<node:long,code:binary>").alias("met")).unionByName(met)
        held = held.groupBy("q").agg(F.max("code").alias("code"), F.max("beam").alias("beam"), F.collect_list("met").alias("met"))  # width times degree at most
        state, seen = rolling.counted(held.mapInArrow(go_on, shape), still=still)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, near = best_of(*_lists(batch.column("beam").to_pylist()), 4 * k + 12)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("q"))[row]), pa.array(near["id"].astype(np.int64))], names=["q", "node"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            q, found, score = [], [], []
            for at, vector, held in zip(*(batch.column(c).to_pylist() for c in ("q", "_vector", "held")), strict=True):
                held = [h for h in held if len(h["x"]) == len(vector)]
                if held:
                    s = cosines(np.asarray(vector, np.float64), np.array([h["x"] for h in held], np.float64))
                    for value, h in zip(s.tolist(), held, strict=True):
                        q += [at] * len(h["ids"])
                        found += h["ids"]
                        score += [value] * len(h["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["q", "vec_id", "score"])

    best = state.select("q", "beam").mapInArrow(nearest, "q long, node long")
    held = best.join(index.nodes.select("node", F.struct(F.col("_vector").alias("x"), "ids").alias("h")), "node").groupBy("q").agg(F.collect_list("h").alias("held"))
    scores = held.join(points, "q").select("q", "_vector", "held").mapInArrow(scored, "q long, vec_id long, score double")
    named = asked.join(points.select("_vector", "q"), "_vector").select(F.col("_id").alias("query_id"), "q")
    rows = scores.join(named, "q").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` nearest found of the candidates by cosine, nearest first,
    ties to the smaller id; all of them where there are fewer.

    Vectors that are null, all zero, or hold a null or non-finite component, and rows with a null id, take no part; only vectors of
    equal length meet. Rows that repeat id and vector count once; an id with several vectors is found by its nearest and asks
    for each. Copies tie: the ``k + 1`` smallest ids of a vector are kept. A query without candidates and empty
    tables give no rows.
    """
    return search(build(candidates, k, id_col=id_col, vector_col=vector_col), queries, k, id_col=id_col, vector_col=vector_col)
