"""Operator 11: maximal periodic runs of words.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Every run has a Lyndon root: under one
of the two orders of words (any order and its reverse) each whole root inside the run is the longest Lyndon word that begins
at its place. A stack scanned from right to left gives these words: what stands above the next smaller suffix is popped. Two
suffixes are compared word by word and, where they agree for longer, by the number of words they share from there on
(LCE), found by galloping and binary search over prefix sums of two rolling hashes modulo primes. Where a root is followed
by its like, the same search extends the stretch to the left. Only the leftmost root of a run is taken, so a run comes
up once for each order.

Words are compared as words (a text's own dictionary numbers them), never as hashes. Each run found is verified by a direct
comparison of its words; if one fails, the text is done again with other hashes.

A task holds a slice of about 2 MB of texts, or one longer text. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import pieces

WORD = r"[^\x20\x09-\x0D]+"
DIRECT = 8
#: Primes below 2**31 and bases of the rolling hashes, in the order in which pairs of them are tried.
PRIMES = 2147483647, 2147483629, 2147483587, 2147483579
BASES = 1103515245, 1664525017, 1812433253, 1566083941

_RUNS = "array<struct<start:long,length:long,period:long>>"


class Prefixes:
    """How many words two places of a text share, onwards or backwards. Hashes are made when first asked for."""

    def __init__(self, ids: list[int], trial: int = 0):
        self.ids, self.n, self.trial, self.sums = ids, len(ids), trial, None

    def _hashed(self) -> list[tuple[memoryview, memoryview, int]]:
        if self.sums is None:
            self.sums = []
            for k in (2 * self.trial, 2 * self.trial + 1):
                p, power = PRIMES[k % len(PRIMES)], np.ones(self.n + 1, np.int64)
                have, by = 1, (BASES[k % len(BASES)] + k) % p
                while have <= self.n:  # powers by doubling
                    more = min(have, self.n + 1 - have)
                    power[have : have + more] = power[:more] * by % p
                    have, by = have + more, by * by % p
                terms = (np.asarray(self.ids, np.int64) + 1) * power[:-1] % p
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % p])
                self.sums.append((memoryview(total), memoryview(power), p))
        return self.sums

    def _same(self, a: int, b: int, size: int) -> bool:
        """Whether the ``size`` words from ``a`` and from ``b > a`` on have equal hashes."""
        return all((s[a + size] - s[a]) * w[b - a] % p == (s[b + size] - s[b]) % p for s, w, p in self._hashed())

    def _longest(self, low: int, most: int, agree: Callable[[int], bool]) -> int:
        """The largest size up to ``most`` that agrees; ``low`` does."""
        step = max(low, 1)
        while low + step <= most and agree(low + step):
            low, step = low + step, 2 * step
        high = min(low + step, most + 1)  # agrees below, not at high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if agree(middle) else (low, middle)
        return low

    def onwards(self, i: int, j: int) -> int:
        """Words shared by the suffixes at ``i < j``, whose first words are equal."""
        ids, most, size = self.ids, self.n - j, 1
        while size < most and size < DIRECT:
            if ids[i + size] != ids[j + size]:
                return size
            size += 1
        return size if size >= most else self._longest(size, most, lambda m: self._same(i, j, m))

    def backwards(self, i: int, j: int, most: int) -> int:
        """Words shared before ``i < j``, ``most`` at most."""
        ids, most, size = self.ids, min(most, i), 0
        while size < most and size < DIRECT:
            if ids[i - size - 1] != ids[j - size - 1]:
                return size
            size += 1
        return size if size >= most else self._longest(size, most, lambda m: self._same(i - m, j - m, m))


def _scan(order: list[int], shared: Prefixes, found: set[tuple[int, int, int]], shortest: int, exponent: int) -> None:
    """Adds to ``found`` the runs that have their roots under this order of words, as start, length and period."""
    stack: list[int] = []
    n = len(order)
    after, ahead, shares = -1, 0, 0  # the last pair of suffixes compared: place, distance, words shared
    for i in range(n - 1, -1, -1):
        word = order[i]
        while stack:
            j = stack[-1]
            other = order[j]
            if other > word:
                stack.pop()
            elif other < word:
                break
            else:
                size = shares + 1 if (after, ahead) == (i + 1, j - i) else shared.onwards(i, j)
                after, ahead, shares = i, j - i, size
                if j + size < n and order[j + size] > order[i + size]:
                    stack.pop()
                    continue
                q = j - i  # the suffix at j is the next smaller one, so the q words at i are the longest Lyndon word there
                if size > (exponent - 2) * q and q + size >= shortest - q:
                    left = shared.backwards(i, j, q)
                    if left < q and left + q + size >= max(shortest, exponent * q):
                        found.add((i - left, left + q + size, q))
                break
        stack.append(i)


def _verified(ids: list[int], found: set[tuple[int, int, int]]) -> bool:
    words = np.asarray(ids, np.int64)
    for start, length, q in found:
        end = start + length
        if not np.array_equal(words[start : end - q], words[start + q : end]):
            return False
        if start and words[start - 1] == words[start - 1 + q] or end < len(words) and words[end] == words[end - q]:
            return False
    return True


def runs_of(words: list, shortest: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the maximal runs of ``words`` with a length of at least ``shortest`` and
    ``exponent`` (2 or more) periods, by start and period."""
    if len(words) < max(shortest, 2):
        return []
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(ids):
        return []
    for trial in range(len(PRIMES)):
        shared, found = Prefixes(ids, trial), set()
        _scan(ids, shared, found, shortest, exponent)
        _scan([-x for x in ids], shared, found, shortest, exponent)
        if _verified(ids, found):
            return sorted(found, key=lambda r: (r[0], r[2]))
    raise RuntimeError("no pair of hashes told the words of a text apart")


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, exponent: int = 3) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` of every row: ``runs`` are structs ``start, length, period`` by start and
    period, ``collapsed`` the words that stay, joined by one space.

    Words are maximal stretches of other characters than space and ``\\t`` to ``\\r``, compared as they are. A null text is
    empty; an empty one has no runs and collapses to an empty text. Null ids and rows that repeat are rows like others;
    other columns are not looked at; an empty table gives no rows. ``exponent`` is 2 at least.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, "_text"):
                counts, listed, kept = [], [], []
                for text in part.column("_text").cast(pa.large_binary()).fill_null(b"").to_pylist():
                    words = text.split()  # of bytes: at the six ASCII blanks
                    found = runs_of(words, shortest, exponent)
                    counts.append(len(words))
                    listed.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    kept.append(b" ".join(collapsed(words, found)))
                columns = [part.column("_id"), pa.array(counts, pa.int64()), pa.array(listed, shape), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "runs", "collapsed"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, n_words long, runs {_RUNS}, collapsed string").withColumnRenamed("_id", id_col)


def with_loops(text: Column, key: Column) -> Column:
    """``text`` with loops of words that its key decides upon. With ``h`` the crc32 of the key in decimal digits and ``g`` its
    tenth rounded down, a text of ``n`` words whose ``h`` ends in 0 repeats, from word ``a = g % n`` on, its next
    ``1 + floor((n - a) / (3 + g % 8))`` words to the end. A null text is empty; a null key changes nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = (g % n).cast("int")
        period = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        turns = F.ceil((n - a) / period).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), turns)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise("")

    # As a variable of a lambda the words are found once, not wherever they are named.
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(F.array(found), looped), F.lit(0)), F.lit(""))).otherwise(F.coalesce(text, F.lit("")))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From ``periodic_runs``: how many runs there are, that of greatest exact length by period (ties: smallest start, then
    period), and SHA-256 sums of the list of runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.reduce("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
