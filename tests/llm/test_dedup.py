import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from corpus import frame, lower, messy, near_components, repeated_words, shingles

from quarry.llm import components, exact, neardup, repeats


@pytest.fixture(scope="module")
def rows():
    return messy()


def test_exact_groups(spark, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    found = exact.exact_groups(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_text = defaultdict(list)
    for r in found:
        by_text[r["text_sha256"]].append(r)
    assert len(by_text) == len(groups)
    for text, ids in groups.items():
        own = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r["doc_id"]) for r in own) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(best, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [best]


def test_exact_hot_group_is_salted(spark):
    rows = [(i, "Same Text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(3000)]
    found = exact.exact_groups(frame(spark, rows, 5))
    same = [r for r in found.collect() if r["group_size"] > 1]
    assert len(same) == 2000 and {(r["keep_id"], r["group_size"]) for r in same} == {(2999, 2000)}
    assert [r["doc_id"] for r in same if r["kept"]] == [2999]


def test_drop_exact_keeps_columns(spark, rows):
    docs = frame(spark, rows)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [lower(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r[1]) for r in rows})


def test_exact_empty(spark):
    assert exact.exact_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("members", [neardup.MEMBERS, 0])
def test_near_groups(spark, rows, members, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    for percent in (85, 60):
        want = near_components(rows, percent)
        found = neardup.near_groups(frame(spark, rows), percent=percent).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
            assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        sizes = sorted((str(r["doc_id"]), r["n_shingles"]) for r in found)
        assert sizes == sorted((str(r[0]), len(shingles(r[1]))) for r in rows)


def test_near_empty(spark):
    assert neardup.near_groups(frame(spark, [])).count() == 0
    assert neardup.near_groups(frame(spark, [(1, None, None, None, None)])).collect()[0]["component_id"] == 1


def test_drop_near_keeps_one_of_each_class(spark, rows):
    docs = frame(spark, rows)
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns
    want = near_components(rows, 80)
    assert {r["doc_id"] for r in kept.collect()} == {None, *(d for d, c in want.items() if d == c)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for common, own in ((900, 50), (500, 250), (100, 450)):
        base = rng.integers(0, 2**64, common, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(2))
        found, _ = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(found[0] - common / (common + 2 * own)) < 0.1


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(9)]
    found = neardup.intersections(sets[:4], sets[4:], columns=7)
    assert found.tolist() == [[len(set(a) & set(b)) for b in sets[4:]] for a in sets[:4]]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["comp"]) for r in found} == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 160)}


@pytest.mark.parametrize("seed", [0, 3, 7])
def test_repeats_cover_what_other_documents_hold(spark, seed):
    rows = [r for r in messy(seed) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    found = repeats.repeated_passages(frame(spark, rows)).collect()
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["removable"] == (r["other_id"] < r["doc_id"])
    want = repeated_words(rows, 50)
    assert set(got) == set(want)
    for d, at in got.items():
        assert at <= want[d]
    assert got == want


def test_repeats_across_partitions_and_nulls(spark):
    passage = " ".join(f"w{i}" for i in range(64))
    rows = [(i, f"a{i} b{i} {passage.upper() if i % 2 else passage} c{i}", "en", "s", 1) for i in range(120)]
    rows += [(None, passage, None, None, None), (500, None, None, None, None), (501, "", None, None, None), rows[3]]
    found = repeats.repeated_passages(frame(spark, rows, 6)).collect()
    assert {r["doc_id"] for r in found} == set(range(120))
    assert all((r["start_word"], r["end_word"]) == (2, 66) for r in found)
    assert sum(not r["removable"] for r in found) >= 1
    assert repeats.repeated_passages(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_repeats_hidden_between_documents_that_share_a_part(spark, parts):
    """Copies of 50 words whose 40-word inner parts, with more or less on either side, stand in many other documents."""
    rng, rows = random.Random(parts), []
    core = [f"w{i}" for i in range(60)]
    for i in range(80):
        a, b = rng.randint(0, 12), rng.randint(48, 60)
        own = lambda k: [f"x{i}-{k}-{j}" for j in range(rng.randint(1, 30))]  # noqa: B023, E731
        rows.append((i, " ".join([*own(0), *core[a:b], *own(1), *(core[:45] if i % 7 == 0 else []), *own(2), *(core[a:b] if i % 11 == 0 else [])]), "en", "s", 1))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = repeats.repeated_passages(frame(spark, rows, 5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == repeated_words(rows, 50)


def thue_morse(n):
    """Two texts of n letters that every polynomial hash modulo 2^64 confuses."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_unlike_words_stay_apart(spark):
    texts = [*thue_morse(1024), *thue_morse(64), "a" * 8 + "b" * 8, "b" * 8 + "a" * 8, "x" * 65, "x" * 66, "q", "q\0"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(frame(spark, rows, 1)).collect()}
    assert found == {k: k for k in range(len(texts))}
    body = [f"v{i}" for i in range(24)]
    one, two = thue_morse(1024)
    rows = [(k, " ".join([*body, w, *(f"z{i}" for i in range(25))]), "en", "s", 1) for k, w in enumerate((one, two))]
    assert repeats.repeated_passages(frame(spark, rows, 1)).count() == 0


@pytest.mark.parametrize("percent", [60, 70, 85])
def test_near_links_just_above_the_threshold(spark, percent):
    """Pairs of texts whose similarity is the threshold or a little more: all links must be found."""
    rng, rows = random.Random(percent), []
    for i in range(120):
        n = rng.choice([30, 80, 400])
        base = [f"{i}w{j}" for j in range(n)]
        other = list(base)
        at, best = rng.sample(range(n), n), list(base)
        for k in at:
            other[k] = f"{i}x{k}"
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            if 100 * len(a & b) < percent * len(a | b):
                break
            best = list(other)
        rows += [(2 * i, " ".join(base), "en", "s", 1), (2 * i + 1, " ".join(best), "en", "s", 1)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(frame(spark, rows), percent=percent).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(120)) == 120


def test_extension():
    a, b = np.array([9, 1, 2, 3, 4, 8, 5]), np.array([1, 2, 3, 4, 7, 5])
    assert repeats.extend(a, b, [(2, 1)], 3) == [(1, 0, 4)]
    assert repeats.extend(a, b, [(2, 1)], 5) == []
