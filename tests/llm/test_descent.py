"""Operator 13 against brute force: recall, exact scores, copies, ties and rows that take no part."""

import math
import random

import numpy as np

from quarry.llm.descent import NEAR, best_of, build, cosines, decoded, encode, nearest_neighbours, search


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, node string, code string").repartition(3)


def brute(queries, rows, k=5):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = {(i, tuple(v)) for i, v in rows if i is not None and fine(v)}
    out = {}
    for i, v in {(i, tuple(v)) for i, v in queries if i is not None and fine(v)}:
        for j, w in kept:
            if j != i and len(w) == len(v):
                s = float(cosines(np.array(v, np.float64), np.array([w], np.float64))[0])
                out.setdefault(i, {})[j] = max(s, out.get(i, {}).get(j, -9))
    return {i: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] for i, found in out.items()}


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_codes_keep_directions_and_lists_keep_the_best():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 24)) * 10.0 ** rng.integers(-200, 200, (50, 1))
    unit = decoded([encode(v) for v in x])
    assert (np.abs((unit * unit).sum(axis=1) - 1) < 1e-4).all()
    near = np.array([(3, 0.5, 2), (3, 0.5, 0), (1, 0.5, 1), (2, 0.9, 1), (7, 0.1, 1)], NEAR)
    node, kept = best_of(np.array([4, 4, 4, 4, 9]), near, 2)
    assert node.tolist() == [4, 4, 9] and kept["id"].tolist() == [2, 1, 7]
    assert best_of(np.array([4, 4]), near[:2], 5)[1]["new"].tolist() == [0]


def test_recall_of_random_and_clustered_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((1600, 16)), rng.standard_normal((1, 16)) + 0.01 * rng.standard_normal((400, 16))])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    vectors = frame(spark, rows)
    index = build(vectors, block=64, passes=3, degree=24, sample=12)
    assert len(index.changes) > 1 and index.changes[0] > index.changes[-1]
    asked = [r for r in rows if r[0] % 20 == 0]
    outside = [(100_000 + i, v) for i, v in enumerate(rng.standard_normal((40, 16)).tolist())]
    got, want = listed(search(index, frame(spark, asked + outside))), brute(asked + outside, rows)
    recall = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(recall) >= 0.9 and np.mean(recall[-40:]) >= 0.85
    assert all(len(got[q]) == 5 for q in want)
    truth = dict(rows)
    for q, v in asked[:30]:
        for i, s in got[q]:
            assert s == float(cosines(np.array(v), np.array([truth[i]]))[0])


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(300)] + [(2000, [2.0, 4.0, 6.0]), (2001, [1e-200, 2e-200, 3e-200]), (2002, [1e200, 2e200, 3e200])]
    rows += [(3000, None), (3001, [None] * 3), (3002, [math.nan, 1.0, 1.0]), (3003, [math.inf, 1.0, 1.0]), (3004, [0.0] * 3), (3005, []), (None, [1.0, 2.0, 3.0]), (None, None)]
    rows += [(4000, [1.0, 0.0]), (4001, [0.0, 1.0]), (4002, [1.0, 1.0]), (4003, [5.0]), rows[70], rows[70], (7, [3.0, 2.0, 1.0])]
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 2000]
    assert listed(nearest_neighbours(frame(spark, asked), frame(spark, rows))) == brute(asked, rows)


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1])]
    assert listed(nearest_neighbours(frame(spark, rows), frame(spark, rows))) == brute(rows, rows)
    nothing = frame(spark, rows).limit(0)
    assert nearest_neighbours(nothing, frame(spark, rows)).collect() == [] == nearest_neighbours(frame(spark, rows), nothing).collect()
    assert nearest_neighbours(frame(spark, rows[:1]), frame(spark, rows[:1])).collect() == []
