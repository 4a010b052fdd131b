"""Operator 12 against brute force over all entries."""

import math
import random

import numpy as np
import pytest

from quarry.llm.vectorcodes import cut, digest, nearest, tree, vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """``(id, code, error, label_error, sha)`` of rows ``id, vector, label``, of one length."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    spans = cut(len(kept[0][1]), parts)
    books = [[r[1][s] for r in first] for s in spans]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for k, s in enumerate(spans):
            held = {}
            for _, v, _ in kept:
                held.setdefault(pick(v[s], books[k])[1], []).append(v[s])
            books[k] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if i in held else e for i, e in enumerate(books[k])]
    out, sums = [], {}
    for i, v, lab in kept:
        best = [pick(v[s], books[k]) for k, s in enumerate(spans)]
        error = sum(d for d, _ in best)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, lab))
    sha = digest([np.array(b, np.int64).reshape(len(b), -1) for b in books])
    return [(i, c, e, sums[lab], sha) for i, c, e, lab in out]


def rows_of(found):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in found.rows.collect()), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, n int").repartition(3)


def test_nearest_is_that_of_all_entries_and_ties_go_to_the_lowest_index():
    rng = np.random.default_rng(0)
    for width, count, span in ((1, 40, 5), (2, 200, 6), (5, 256, 3), (16, 256, 900), (3, 1, 4)):
        entries, x = rng.integers(-span, span, (count, width)), rng.integers(-span, span, (9000, width))
        index, far = nearest(tree(entries), entries, x)
        want = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def test_codes_errors_and_codebooks_are_those_of_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() ** 2 for _ in range(8)], rng.choice([0, 1, 2, None])) for i in rng.sample(range(5000), 400)]
    rows += [(k, rows[0][1], 7) for k in range(9000, 9060)]  # copies
    rows += [(6001, None, 1), (6002, [None] * 8, 1), (6003, [math.nan] * 8, 1), (6004, [math.inf] + [0.0] * 7, None), (6005, [0.0] * 8, None)]
    rows += [rows[3], rows[3], (None, rows[4][1], None), (None, None, None), (6006, [1e-9] * 8, None), (6007, [-1e-9] * 8, None)]
    assert rows_of(vector_codes(vectors(spark, rows))) == sorted(brute(rows), key=repr)


def test_many_ties_few_rows_and_other_parameters(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 1.0]) for _ in range(6)], i % 2) for i in range(90)]
    assert rows_of(vector_codes(vectors(spark, rows), entries=16, rounds=2)) == sorted(brute(rows, entries=16, rounds=2), key=repr)
    few = rows[:3]
    assert rows_of(vector_codes(vectors(spark, few), parts=3)) == sorted(brute(few, parts=3), key=repr)
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, few), entries=300)


def test_lengths_apart_empty_vectors_huge_components_and_no_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 0), (2, [5.0] * 4, 0), (3, [1.0] * 8, 0), (4, [], None), (5, [1e300] * 4, 1)]
    got = {r["vec_id"]: r for r in vector_codes(vectors(spark, rows)).rows.collect()}
    assert {k: r["error"] for k, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert [got[k]["code"] for k in (1, 2, 5, 3, 4)] == ["00000000", "01010101", "02020202", "00000000", "00000000"]
    assert got[1]["codebooks_sha256"] == got[2]["codebooks_sha256"] != got[3]["codebooks_sha256"]
    empty = vector_codes(vectors(spark, rows).limit(0))
    assert empty.rows.collect() == [] and empty.codebooks == {}
    nameless = vector_codes(vectors(spark, [(None, [1.0] * 4, 1)])).rows.collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in nameless] == [(None, None, None)]
