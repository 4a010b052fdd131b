"""Operator 5: near-duplicate classes with HyperMinHash signatures.

One pass hashes the five-word shingles of each text. The distinct hashes fall into ``BUCKETS`` buckets; of each
bucket's smallest hash the leading-zero count (6 bits) and the next 10 bits are kept as a 16-bit register. Consecutive
registers form a band; for bands, empty buckets borrow a full one's register. A band is as long as the threshold allows
with two texts just reaching it sharing none with a probability below ``MISS``: 48 bands of 8 at a similarity of 0.85
(3e-7), 54 of 7 at 0.80 (3e-6), 96 of 4 at 0.60 (2e-6). Thresholds below 0.03, which no band serves, are refused.

1. Texts with equal sets collapse into one class; only its smallest id goes on.
2. Each member of the first six bands' buckets is compared with one bucket's smallest id, the one it meets most often
   (a star, never all pairs), then in the buckets of all bands the members of the smallest and the largest component.
3. Registers give a Jaccard estimate, corrected for chance collisions; pairs five standard errors too low go (of pairs
   at the threshold, fewer than one in a million). The rest is verified on the full sets, with two independent 64-bit
   hashes a shingle, and links are closed into components.
4. Buckets that still hold several components are the only places where a link can hide. Their members are paired
   across components; where a bucket holds many members or components, a prefix filter takes over (texts that reach
   the threshold must share one of their rarest shingles), which is exact: texts that share one are compared in chunks
   on their full sets. Links found here join components again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import pieces, release
from quarry.llm.components import components
from quarry.llm.store import materialise
from quarry.llm.words import mix, scan, shingle_sets

BUCKETS = 384
MISS = 1e-5
STAR_BANDS = 6
CROWD = 12
MEMBERS = 24
HOT_CLASSES = 1 << 14
_U = np.uint64


def band_shape(percent: int) -> tuple[int, int]:
    """Registers in a band, and bands, for a threshold: the longest band that keeps the chance of a miss below ``MISS``."""
    for rows in range(BUCKETS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (BUCKETS // rows) <= MISS:
            return rows, BUCKETS // rows
    raise ValueError(f"no bands of {BUCKETS} registers find pairs at {percent} %")


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set of 64-bit hashes; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if not len(hashes):
        return out
    low, high = hashes & _U(0xFFFFFFFF), hashes >> _U(32)
    bucket = ((high * _U(BUCKETS) + ((low * _U(BUCKETS)) >> _U(32))) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = hashes[first] * _U(BUCKETS)  # what follows the bucket number, 64 bits
    rest = np.maximum(rest, _U(4))
    bits = np.frexp(rest.astype(np.float64))[1]
    bits -= (rest >> np.minimum(bits - 1, 63).astype(_U)) == 0  # a float may round up to the next power
    bits = np.minimum(bits, 64)
    zeros = (64 - bits).astype(_U)
    shifted = np.where(zeros < 63, rest << np.minimum(zeros + _U(1), _U(63)), _U(0))
    out[bucket[first]] = ((zeros << _U(10)) | (shifted >> _U(54))).astype(np.uint16) + np.uint16(1)
    return out


_ORDER = np.random.default_rng(17).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets borrow from the first full one in an order of their own (the same for every text).
    A register then agrees between two texts as often as they are similar, for short texts too, and a band of a short
    text tells as much as that of a long one."""
    full, empty = np.flatnonzero(regs), np.flatnonzero(regs == 0)
    if not len(full) or not len(empty):
        return regs
    out = regs.copy()
    out[empty] = regs[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray, rows: int, bands: int) -> list[int | None]:
    """A 64-bit key for each band of ``rows`` registers; None for a band without a shingle."""
    grid = regs[: rows * bands].reshape(bands, rows).astype(_U)
    key = np.arange(1, bands + 1, dtype=_U)
    for j in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + grid[:, j])
    full = grid.any(axis=1)
    return [int(k) if f else None for k, f in zip(key.view(np.int64), full, strict=True)]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of registers the Jaccard similarities, corrected for registers that agree by chance, and how many
    buckets each of them rests on."""
    used = (a > 0) | (b > 0)
    total = used.sum(axis=1)
    same = ((a == b) & used).sum(axis=1)
    level = 2.0 ** -np.arange(1, 60)[:, None]
    p, q = (np.exp(-n / BUCKETS * level) - np.exp(-n / BUCKETS * 2 * level) for n in (n_a, n_b))
    chance = total * (p * q).sum(axis=0) / 1024
    return np.maximum(0.0, (same - chance) / np.maximum(1.0, total - chance)), total


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers, bands``; the last three are null for an empty set."""
    rows, count = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                n, key, regs, bands = [], [], [], []
                for w in scan(batch.column("text"), lower=True):
                    for s, t in zip(shingle_sets(w, words), shingle_sets(w, words, second=True), strict=True):
                        n.append(len(s))
                        if len(s):
                            r = registers(s)
                            with np.errstate(over="ignore"):
                                ends = [s.sum(dtype=_U), mix(s + _U(0x632BE59BD9B4E019)).sum(dtype=_U), t.sum(dtype=_U), _U(len(s))]
                            key.append(np.array(ends, dtype=_U).tobytes())
                            regs.append(r.tobytes())
                            bands.append(band_keys(filled(r), rows, count))
                        else:
                            key.append(None), regs.append(None), bands.append(None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array(n, pa.int64()),
                        "set_key": pa.array(key, pa.binary()),
                        "registers": pa.array(regs, pa.binary()),
                        "bands": pa.array(bands, pa.list_(pa.int64())),
                    }
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, full``, ``more``: the sorted 64-bit shingle hashes of the documents whose id is in ``wanted(doc_id)``, and
    the sorted second hashes of the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                full, more = [], []
                for w in scan(batch.column("text"), lower=True):
                    full += [s.tobytes() for s in shingle_sets(w, words)]
                    more += [s.tobytes() for s in shingle_sets(w, words, second=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "full": pa.array(full, pa.binary()), "more": pa.array(more, pa.binary())})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, full binary, more binary")


def _reaches(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sorted sets of hashes reach the threshold."""
    left, right = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
    short, long = sorted((len(left), len(right)))
    if not short or 100 * short < percent * long:
        return False
    both = np.concatenate([left, right])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (short + long - common)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold, by the first and by the second hashes."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("full").alias(f"full_{x}"), F.col("more").alias(f"more_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y, z, w) in enumerate(zip(*(batch.column(c) for c in ("full_a", "full_b", "more_a", "more_b")), strict=True)):
                if _reaches(x.as_py(), y.as_py(), percent) and _reaches(z.as_py(), w.as_py(), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})
            release()

    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "full_a", "full_b", "more_a", "more_b").mapInArrow(run, "a long, b long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and registers allow the threshold."""
    t = percent / 100
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (np.asarray(batch.column(c), dtype=np.int64) for c in ("n_a", "n_b"))
            r_a, r_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("r_a", "r_b"))
            found, used = estimate(r_a, r_b, n_a, n_b)
            error = np.sqrt(t * (1 - t) / np.maximum(used, 1))
            near = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (found >= t - 5 * error)
            at = pa.array(np.flatnonzero(near), pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _across(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``key, node, comp``: pairs of nodes under one key but in different components, and the keys with more than
    ``CROWD`` components or ``MEMBERS`` nodes, which give no pairs here."""
    held = keyed.groupBy("key").agg(F.count_distinct("comp").alias("n"), F.count(F.lit(1)).alias("m")).filter("n > 1")
    crowded = (F.col("n") > CROWD) | (F.col("m") > MEMBERS)
    rows = keyed.join(held.filter(~crowded).select("key"), "key")
    left = rows.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    right = rows.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    pairs = left.join(right, "key").filter("comp_a < comp_b").select("a", "b").distinct()
    return pairs, held.filter(crowded).select("key")


def _frequent(sets: DataFrame, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in many of ``sets`` with their counts, sorted by shingle. Only those in at least
    ``shingles / most`` sets are listed, which bounds the list by ``most``; a batch reports what it holds twice. Counts
    only order shingles: they bear on how much is compared, not on what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, n = np.unique(np.frombuffer(b"".join(batch.column("full").to_pylist()), np.int64), return_counts=True)
                twice = n > 1
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[twice]), "n": pa.array(n[twice].astype(np.int64))})

    total = sets.agg(F.sum(F.octet_length("full"))).head()[0] or 0
    least = max(2, -(-total // 8 // most))
    counted = sets.select("full").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    key, n = np.asarray(counted["key"], dtype=np.int64), np.asarray(counted["n"], dtype=np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``key, node, comp``: each set's rarest shingles, so many that similar sets must share one. Frequent shingles rank
    by how many of ``sets`` hold them, all others come before them; ties go by hash."""
    frequent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for node, comp, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "comp", "full")), strict=True):
                s = np.frombuffer(raw, dtype=np.int64)
                rank = np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, counts[at], 0)
                need = len(s) - -(-percent * len(s) // 100) + 1
                found.append((s[np.lexsort((s, rank))[:need]], np.full(need, node), np.full(need, comp)))
            if found:
                yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x)) for c, x in zip(("key", "node", "comp"), zip(*found, strict=True), strict=True)})
            release()

    return sets.mapInArrow(run, "key long, node long, comp long")


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, by products of 0/1 matrices over slices
    of the shingles they hold."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    kinds, place = np.unique(flat, return_inverse=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for k in range(0, len(kinds), columns):
        lo, hi = np.searchsorted(place, [k, k + columns])
        grid = np.zeros((len(a) + len(b), min(columns, len(kinds) - k)), dtype=np.float32)
        grid[owner[lo:hi], place[lo:hi] - k] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out.astype(np.int64)


def _linked(rows: DataFrame, sets: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """Links ``(a, b)`` between nodes that share a key of ``key, node, comp`` but no component, enough to join the
    components. Nodes of a key are dealt into chunks of about ``chunk``; each pair of chunks is compared in one place,
    so no group is ever held whole and no pair is written that is not a link."""
    held = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    near = rows.join(held.select("key", F.ceil(F.col("m") / chunk).alias("ways")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("ways")))
    spread = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    placed = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node")
    full = placed.join(sets.select(F.col("doc_id").alias("node"), "comp", "full"), "node")
    dealt = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def verify(group: list[tuple]) -> list[tuple[int, int]]:
        nodes, comps, sets_ = [g[4] for g in group], [g[5] for g in group], [np.frombuffer(g[6], np.int64) for g in group]
        inside = group[0][1] == group[0][2]
        left = [k for k, g in enumerate(group) if inside or not g[3]]
        right = [k for k, g in enumerate(group) if inside or g[3]]
        if not left or not right:
            return []
        size = np.array([len(x) for x in sets_])
        common = intersections([sets_[k] for k in left], [sets_[k] for k in right])
        close = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while c in top:
                c = top[c]
            return c

        out = []
        for x, y in zip(*np.nonzero(close), strict=True):
            p, q = left[x], right[y]
            r, t = root(comps[p]), root(comps[q])
            if r != t:
                top[max(r, t)] = min(r, t)
                out.append((min(nodes[p], nodes[q]), max(nodes[p], nodes[q])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, group, links = ("key", "i", "j", "second", "node", "comp", "full"), [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group and row[:3] != group[0][:3]:
                    links += verify(group)
                    group = []
                group.append(row)
            yield _pairs_batch(links)
            links = []
            release()
        if group:
            yield _pairs_batch(verify(group))

    return dealt.mapInArrow(run, "a long, b long")


def _pairs_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles
    (``A-Z`` in lower case). A text of fewer words is one shingle; null text and text without words have none and are
    linked with nothing. ``component_id`` is the smallest id reachable; ``kept`` marks the row with that id. A row with
    a null id is linked with nothing and kept, its component is null. Repeated rows share their component. Empty input
    gives an empty result; further columns are not read.
    """
    sig = materialise(signatures(docs, id_col, text_col, words, percent), "signatures")
    classes = sig.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "classes")
    rep = classes.select(F.col("rep").alias("doc_id"), "set_key")
    nodes = sig.join(rep, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    nodes = materialise(nodes, "nodes")
    sets = lambda pairs: full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), id_col, text_col, words)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        close = materialise(_estimated(pairs, nodes, percent), f"{name}-pairs")
        return materialise(_similar(close, sets(close), percent).distinct(), f"{name}-links")

    first = nodes.select(F.col("doc_id").alias("node"), F.explode(F.slice("bands", 1, STAR_BANDS)).alias("key")).filter("key IS NOT NULL")
    shared = first.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("key", "a")
    star = first.join(shared, "key").filter("a <> node").groupBy(F.col("node").alias("b")).agg(F.mode("a", True).alias("a")).select("a", "b")
    links = verified(star, "star")
    comps = components(links)

    def keyed() -> DataFrame:
        at = nodes.select(F.col("doc_id").alias("node"), "bands").join(comps, "node", "left")
        return at.select("node", F.coalesce("comp", "node").alias("comp"), F.explode("bands").alias("key")).filter("key IS NOT NULL")

    ends = keyed().groupBy("key").agg(F.min(F.struct("comp", "node")).alias("lo"), F.max(F.struct("comp", "node")).alias("hi"))
    ends = ends.filter("lo.comp <> hi.comp").select(F.least("lo.node", "hi.node").alias("a"), F.greatest("lo.node", "hi.node").alias("b"))
    links = links.unionByName(verified(ends.distinct(), "ends"))
    comps = components(links)

    open_ = materialise(keyed().groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "open")
    held = materialise(keyed().join(open_, "key"), "held")
    pairs, crowded = _across(held)
    more = verified(pairs, "rest")
    crowd = materialise(held.join(crowded, "key", "left_semi").select(F.col("node").alias("doc_id"), "comp").distinct(), "crowd")
    if crowd.limit(1).count():
        own = full_sets(docs, crowd.select("doc_id"), id_col, text_col, words).dropDuplicates(["doc_id"]).join(crowd, "doc_id")
        own = materialise(own, "crowd-sets")
        rare = materialise(_prefixes(own, percent), "prefixes")
        joined = materialise(_linked(rare, own, percent).distinct(), "crowd-pairs")
        more = more.unionByName(materialise(_similar(joined, own, percent), "crowd-links"))
    if more.limit(1).count():
        comps = components(links.unionByName(more))

    top = classes.join(comps, classes["rep"] == comps["node"], "left").select("set_key", F.coalesce("comp", "rep").alias("component"), "n")
    # A class with a great share of the rows would be an unsplit join key: there are at most HOT_CLASSES of them, so they
    # are broadcast. Rows without a set take no part in the join.
    share = max(1 << 12, (classes.agg(F.sum("n")).head()[0] or 0) // HOT_CLASSES)
    top = materialise(top, "tops")
    slim = sig.select("doc_id", "n_shingles", "set_key")
    full = slim.filter("set_key IS NOT NULL")
    hot = F.broadcast(top.filter(F.col("n") > share).select("set_key", "component"))
    out = full.join(hot, "set_key").unionByName(full.join(hot, "set_key", "left_anti").join(top.select("set_key", "component"), "set_key", "left"))
    out = out.unionByName(slim.filter("set_key IS NULL").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id; all columns stay, whatever their names. Rows
    with a null id, null text or no words stay; rows that repeat a kept id stay all; an empty table stays empty."""
    gone = near_groups(docs, id_col, text_col, **options).filter(~F.col("kept")).select("doc_id").distinct()
    boxed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"))
    return boxed.join(gone, boxed["own"] == gone["doc_id"], "left_anti").select("row.*")
