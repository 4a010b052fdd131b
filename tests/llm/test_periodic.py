"""Operator 11 against brute force, and its digests from the contract's words."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import corpus
import pytest
from pyspark.sql import functions as F

from quarry.llm.periodic import Prefixes, collapsed, periodic_runs, run_digests, runs_of, with_loops


def brute(words, shortest=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            held = words[i : j + q]
            if j > i and len(held) >= max(shortest, exponent * q) and not any(held[p:] == held[:-p] for p in range(1, q)):
                out.append((i, len(held), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest, exponent", [(24, 3), (2, 2), (6, 3), (10, 4)])
def test_runs_of_random_words_are_those_of_brute_force(shortest, exponent):
    rng = random.Random(shortest)
    for _ in range(400):
        words, letters = [], rng.choice([1, 2, 2, 3, 5])
        for _ in range(rng.randint(0, 8)):
            words += [rng.randrange(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 12)
        assert runs_of(words, shortest, exponent) == brute(words, shortest, exponent)


def test_long_texts_need_hashes_and_get_whole_runs():
    rng = random.Random(3)
    root = [rng.randrange(50) for _ in range(700)]
    words = [99, 98] + root * 5 + root[:13] + [97] + ["a"] * 5000 + ["b", "a"] * 2000
    assert runs_of(words) == [(2, 3513, 700), (3516, 5000, 1), (8515, 4001, 2)]
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 900:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs_of(fibonacci[1]) == brute(fibonacci[1])


def test_shared_words_onwards_and_backwards_are_those_counted():
    rng = random.Random(4)
    ids = ([rng.randrange(3) for _ in range(40)] * 4 + [7]) * 3
    shared = Prefixes(ids)
    for _ in range(500):
        i, j = sorted(rng.sample(range(len(ids)), 2))
        if ids[i] == ids[j]:
            want = next((k for k in range(len(ids) - j) if ids[i + k] != ids[j + k]), len(ids) - j)
            assert shared.onwards(i, j) == want
        most = rng.randint(0, i)
        assert shared.backwards(i, j, most) == next((k for k in range(most) if ids[i - 1 - k] != ids[j - 1 - k]), most)


def test_a_word_goes_if_any_run_holds_it_after_its_first_period():
    words = ["x"] + ["a", "b", "c"] * 9 + ["y"]
    assert runs_of(words) == [(1, 27, 3)]
    assert collapsed(words, [(1, 27, 3)]) == ["x", "a", "b", "c", "y"]


def expected(key, text):
    words = corpus.words(text)
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    digest = lambda x: sha256(x.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *row, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_querys_rows_on_awkward_documents(spark):
    rows = corpus.messy(11)
    rows += [(5000 + k, t, None, None, None) for k, t in enumerate(["a b " * 20, "a b c " * 9 + "a b d " * 9, "x " * 24, "x " * 23, "é z q " * 30, "a\x0bb\x1fc " * 12])]
    rows += [(9000 + k, " ".join(str(i % 211) for i in range(150)), None, None, None) for k in range(60)]
    docs = corpus.frame(spark, rows).select("doc_id", with_loops(F.col("text"), F.col("doc_id")).alias("text"), "n_words" if "n_words" in corpus.CLASHING else "key")
    got = [tuple(r) for r in run_digests(periodic_runs(docs)).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r[:1]) + r[6:]
    assert sorted(got, key=order) == sorted((expected(r[0], r[1]) for r in rows), key=order)
    assert sum(r[1] > 0 for r in got) > 8


def test_an_empty_table_and_other_thresholds(spark):
    docs = spark.createDataFrame([(1, "a a a a b")], "doc_id long, text string")
    assert run_digests(periodic_runs(docs.limit(0))).collect() == []
    row = periodic_runs(docs, shortest=3, exponent=2).head()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (5, [(0, 4, 1)], "a b")
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=1)
