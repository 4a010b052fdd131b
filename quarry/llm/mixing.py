"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment.

Documents of a source are dealt by a seeded hash of their id and text into shards; inside a shard they stand in seeded order
as one stream of words, cut into equal blocks. Seats (blocks) go to sources by highest quotient ``target / (2k + 1)``
and then to each source's shards in the same way. A shard with quota ``q`` of ``n`` blocks is read ``q // n`` times in
full, and once more over a run of ``q % n`` blocks that starts at a seeded block. A run of a seeded order is a random
set of documents, of which only the two at its ends are cut.

Only totals of sources and shards reach the driver: at most ``shards + 2 * sources`` rows, whatever the corpus size. A
mix takes weights for sources, so there are few; beyond ``MOST_SOURCES`` it refuses to run.
A source with a third of the rows has a third of the shards, so no window holds more than its part; a shard has at
least 64 blocks, which keeps the rounding of its quota small.
"""

from __future__ import annotations

import hashlib
import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
ORDER = ("place", "doc_id", "size")
MOST_SOURCES = 1 << 16


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets in proportion to ``weights`` that sum to ``share`` of all sizes, none above ``most`` times its size."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return [float(x) for x in out]


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients ``vote / (2k + 1)``, earlier entries first on ties, never above ``caps``.

    The quotient rule equals rounding ``vote / divisor``: rounding with the mean price of a seat comes within one
    seat an entry, and a heap of quotients gives or takes the rest.
    """
    total = sum(map(Fraction, votes))
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    if not seats or not total:
        return [0] * len(votes)
    got = [min(c, int(Fraction(v) * seats / total + Fraction(1, 2))) for v, c in zip(votes, caps, strict=True)]
    spare = seats - sum(got)
    if spare > 0:
        heap = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if v > 0 and g < c]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(Fraction(v) / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            i = -i
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (Fraction(votes[i]) / (2 * got[i] - 1), -i))
    return got


def _start(seed: int, source: str | None, shard: int, blocks: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{source!r}|{shard}".encode()).digest()[:8]) % blocks


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` boxed as ``row``, with ``doc_id, source, size`` and the seeded hash ``place`` of id and text."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("place"),
    )


class _Plan:
    """What a mix takes: a row for each source, and one for each shard that holds words."""

    def __init__(self, sized: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int, shards: int, block_words: int):
        spark = sized.sparkSession
        rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
        rows = rows.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: weights are given to sources, so map hosts or paths to sources first")
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        names, sizes = [r["source"] for r in rows], [r["size"] for r in rows]
        targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
        count, total = sum(r["rows"] for r in rows), sum(targets)
        block = max(1, min([block_words, *(int(t) // 64 for t in targets if t > 0)]))
        ways = [max(1, min(shards * r["rows"] // count, r["size"] // (64 * block))) for r in rows]
        self.seed = seed
        self.sources = spark.createDataFrame(
            [(n, i, w, s, t) for i, (n, w, s, t) in enumerate(zip(names, ways, sizes, targets, strict=True))],
            "name string, src int, ways int, source_size long, target double",
        )
        held = self.dealt(sized).groupBy("src", "shard").agg(F.sum("size").alias("size")).collect()
        held.sort(key=lambda r: (r["src"], r["shard"]))
        by_src: dict[int, list] = {}
        for r in held:
            by_src.setdefault(r["src"], []).append(r)
        blocks = {(r["src"], r["shard"]): max(1, round(r["size"] / block)) if r["size"] else 0 for r in held}
        room = [most * sum(blocks[r["src"], r["shard"]] for r in by_src.get(i, [])) for i in range(len(names))]
        # A source's own block is its size over its count of blocks, so that rounding blocks does not move its words.
        unit = [most * s / c if c else 1.0 for s, c in zip(sizes, room, strict=True)]
        seats = round(sum(t / u for t, u in zip(targets, unit, strict=True)))
        quotas = sainte_lague([t / u for t, u in zip(targets, unit, strict=True)], seats, room) if total else [0] * len(names)
        plan = []
        for i, own in by_src.items():
            caps = [most * blocks[i, r["shard"]] for r in own]
            for r, q in zip(own, sainte_lague([float(c) for c in caps], quotas[i], caps), strict=True):
                n, words = blocks[i, r["shard"]], r["size"]
                if not n:
                    continue
                k = _start(seed, names[i], r["shard"], n)
                edge = lambda b, n=n, words=words: b * words // n
                end = k + q % n
                a = (edge(k), edge(min(end, n)))
                b = (0, edge(end - n)) if end > n else (0, 0)
                plan.append((i, r["shard"], q // n, *a, *b))
        self.shards = spark.createDataFrame(plan, "src int, shard int, passes int, a0 long, a1 long, b0 long, b1 long")

    def dealt(self, sized: DataFrame) -> DataFrame:
        """``sized`` with its source's figures and its shard."""
        joined = sized.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("name")))
        return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(self.seed + 1), F.col("place")), F.col("ways")).cast("int"))

    def streams(self, dealt: DataFrame) -> DataFrame:
        """Dealt rows with the word of their shard's stream at which they stop, and their shard's part of the plan."""
        stream = Window.partitionBy("src", "shard").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        return dealt.withColumn("stop", F.sum("size").over(stream)).join(F.broadcast(self.shards), ["src", "shard"], "left")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    shards: int = 4096,
    block_words: int = 64,
) -> DataFrame:
    """One row for each input row: ``doc_id, size, source_size, target, taken`` and what the mix takes:
    ``passes`` (whole readings) and the word spans ``[from1, to1)``, ``[from2, to2)`` read once more.

    ``weights`` repeat over the sources in code-point order, null last. Null text has size 0 and is never taken; a
    source without words has target 0. The seeded order is by a hash of id and text, so rows of one id (null too) are dealt
    apart; rows that repeat both are separate documents that follow one another. The block is ``block_words`` words, or
    less where the smallest target would have fewer than 64 blocks. Empty input gives an empty result. The same input and
    seed give the same result. More than ``MOST_SOURCES`` sources are refused.
    """
    sized = materialise(_sized(docs, id_col, text_col, source_col, seed).drop("row"), "mix-sizes")
    plan = _Plan(sized, weights, share, most, seed, shards, block_words)
    placed = plan.streams(plan.dealt(sized))
    begin = F.col("stop") - F.col("size")
    cut = lambda edge: F.coalesce(F.least(F.greatest(F.col(edge) - begin, F.lit(0)), F.col("size")), F.lit(0))
    spans = placed.select(
        "doc_id", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"),
        cut("a0").alias("from1"), cut("a1").alias("to1"), cut("b0").alias("from2"), cut("b1").alias("to2"),
    )
    taken = F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return spans.withColumn("taken", taken.cast("long"))


def apply_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    shards: int = 4096,
    block_words: int = 64,
) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, whatever their names: a row for each reading of a document. A document
    that a run cuts has a row with the words taken, joined by blanks; words taken twice make two rows.

    Texts are not shuffled: of each shard only the documents at which a run begins or ends are looked up (four a shard at
    most) and broadcast, and every document then tells from its own place in the seeded order whether it stands before,
    at or behind them. Rows that repeat id and text share one place: they are cut together, as the first of them is.
    Documents without words are never taken; empty input gives an empty result.
    """
    boxed = _sized(docs, id_col, text_col, source_col, seed)
    sized = materialise(boxed.drop("row"), "mix-sizes")
    plan = _Plan(sized, weights, share, most, seed, shards, block_words)
    begin, edges = F.col("stop") - F.col("size"), ("a0", "a1", "b0", "b1")
    placed = plan.streams(plan.dealt(sized.filter("size > 0"))).filter("passes IS NOT NULL")
    at = lambda e: (F.col(e) >= begin) & (F.col(e) < F.col("stop"))
    near = placed.filter(at("a0") | at("a1") | at("b0") | at("b1"))
    spot = lambda e: F.min(F.when(at(e), F.struct(*ORDER, begin.alias("begin")))).alias(f"at_{e}")
    spots = near.groupBy("src", "shard").agg(*map(spot, edges))
    spots = materialise(plan.shards.join(spots, ["src", "shard"], "left"), "mix-spots")

    def offset(e: str):
        """Words of the document before the edge ``e``: all if it stands before the document there, none if behind it."""
        there = F.col(f"at_{e}")
        own, other = F.struct(*ORDER), F.struct(*(there[c].alias(c) for c in ORDER))
        cut = F.when(own < other, F.col("size")).when(own > other, F.lit(0)).otherwise(F.least(F.col(e) - there["begin"], F.col("size")))
        # An edge at the shard's end lies in no document: all stand before it.
        return F.when(there.isNull(), F.col("size")).otherwise(cut).cast("long")

    found = plan.dealt(boxed.filter("size > 0")).join(F.broadcast(spots), ["src", "shard"])
    one = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    spans = "array<struct<a:bigint,b:bigint>>"
    some = lambda a, b: F.when(b > a, F.array(one(a, b))).otherwise(F.array().cast(spans))
    whole = F.array_repeat(one(F.lit(0).cast("long"), F.col("size")), F.col("passes"))
    readings = found.select("row", "size", F.explode(F.concat(whole, some(offset("a0"), offset("a1")), some(offset("b0"), offset("b1")))).alias("span"))
    text, length = F.col("row")[text_col], F.col("span.b") - F.col("span.a")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.col("span.a").cast("int") + 1, length.cast("int")), " ")
    held = F.when(length >= F.col("size"), text).otherwise(part)
    return readings.select(F.col("row").withField(f"`{text_col}`", held).alias("row")).select("row.*")
