import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import frame, messy, words
from pyspark.sql import functions as F

from quarry.llm import licences, mixing, quality, topk, webtext


# -- mixing ---------------------------------------------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 10], [3, 1]) == [0, 15]


@pytest.mark.parametrize("seed", range(5))
def test_sainte_lague_equals_one_seat_at_a_time(seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 5, 7.5, 100, 333]) for _ in range(6)]
    caps = [rng.randint(0, 20) for _ in votes]
    seats, got = rng.randint(0, 60), [0] * 6
    for _ in range(seats):
        best = max(((v / (2 * g + 1), -i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if v and g < c), default=None)
        if best is None:
            break
        got[-best[1]] += 1
    assert mixing.sainte_lague(votes, seats, caps) == got


def level(sizes, weights):
    """The targets by bisection of the level up to which sources are filled in proportion to their weights."""
    low, high = 0.0, 4.0 * sum(sizes) + 1
    fill = lambda u: [min(2 * s, w * u) for s, w in zip(sizes, weights, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(fill(mid)) < 1.5 * sum(sizes) else (low, mid)
    return fill(high)


def test_mix(spark):
    rows = messy(n=200)
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    key = lambda s: (s is None, s or "")
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=key)
    targets = dict(zip(names, level([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    source = defaultdict(list)
    for r in rows:
        source[r[0]].append(r[3])
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(words(r[1]))) for r in rows)
    by_target = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[r["source_size"], r["target"]] += r["taken"]
    for (size, target), taken in by_target.items():
        assert any(size == sizes[s] and math.isclose(target, targets[s], rel_tol=1e-9) for s in names)
        assert abs(taken - target) <= max(3, 0.01 * target)
    again = mixing.mix(frame(spark, rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_apply_mix(spark):
    rows = [r for r in {r[0]: r for r in messy(n=120)}.values() if r[0] is not None]
    docs = frame(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({d: t for d, t in taken.items() if t})


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None, None), (2, " ", None, "s", None)])).collect()] == [0, 0]


# -- top-k ----------------------------------------------------------------------------------------------------------


def brute_top(rows, asked, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(20)]  # ties
    rows += [(400, None), (450, [1.0, None] * 4), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.5, 0.25]), (650, [0.5, 1.0]), (None, rows[0][1]), (700, []), (750, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, score int").repartition(5)
    found = topk.top_k(df.filter("vec_id % 50 = 0"), df, block=64, buckets=3).collect()
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in found} == brute_top(rows32, lambda i: i % 50 == 0) and len(found) == len(set(found))


def test_top_k_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(topk, "SIDE", 32)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6).astype(np.float32)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = [tuple(r) for r in topk.top_k(df.filter("vec_id % 2 = 0"), df, block=16).collect()]
    assert set(found) == brute_top(rows, lambda i: i % 2 == 0) and len(found) == 500


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df.filter("vec_id = 0"), df).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    none = df.filter("vec_id > 9")
    assert topk.top_k(none, df).count() == topk.top_k(df, none).count() == 0


def test_elimination(spark, small):
    """On vectors in clusters most candidates are never evaluated; on those of the tables, which lie all about, some."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    share = lambda v: topk.elimination(v.filter("vec_id % 50 = 0"), v).selectExpr("sum(evaluated) / sum(candidates)").head()[0]
    assert share(df) < 0.3
    assert share(spark.read.parquet(f"{small.replace('0.001', '0.1')}/embeddings.parquet")) < 0.8
    found = topk.top_k(df.filter("vec_id % 50 = 0"), df, block=512).collect()
    rows32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i % 3 == 0 or i % 50 == 0]
    part = df.filter("vec_id % 3 = 0 OR vec_id % 50 = 0")
    assert len(found) == 60 * 5
    assert {tuple(r) for r in topk.top_k(part.filter("vec_id % 1000 = 0"), part, block=128).collect()} == brute_top(rows32, lambda i: i % 1000 == 0)


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [3e5 + 1, 1.0]), (1, [3e5, 5.0]), (2, [3e5, 4.0]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df.filter("vec_id = 0"), df).collect()}
    exact = lambda b: math.floor(256 * (3e5 + 1)) * math.floor(256 * b[0]) + 256 * math.floor(256 * b[1])
    assert got == {(0, 1, 3, (1 << 63) - 1), (0, 2, 1, exact([3e5, 5.0])), (0, 3, 2, exact([3e5, 4.0]))}


# -- quality --------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, small):
    import pyarrow.parquet as pq

    base = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = labels.filter("doc_id % 3 = 0")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    found = {r["doc_id"]: r["kept"] for r in quality.classify(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in held.collect()}
    good, bad = [d for d, q in truth.items() if q == 1], [d for d, q in truth.items() if q == 0]
    assert sum(found[d] for d in good) >= 0.98 * len(good)
    assert sum(not found[d] for d in bad) >= 0.9 * len(bad)
    assert len(found) == pq.read_table(f"{base}/documents.parquet").num_rows


def test_quality_edges(spark):
    rows = messy()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(i % 2), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample_rows=30)
    found = quality.classify(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["p_good"] <= 1 and r["kept"] == (r["p_good"] >= 0.5)
    blank = {r[0] for r in rows if not words(r[1])}
    assert all(not r["kept"] for r in found if r["doc_id"] in blank - {None})
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if r["kept"])


def test_quality_without_labels_or_documents(spark):
    docs = frame(spark, [(1, "some text", "en", "s", 1)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.train(docs, none)).head()["kept"]
    assert quality.classify(frame(spark, []), quality.train(docs, none)).count() == 0


def brute_quality(model, rows):
    """``(p_text, site_rate, p_good, kept)`` of each row by plain loops over the formulas of the docstrings."""
    import pyarrow as pa

    evidence = model.log_odds(quality.features(pa.array([r[1] for r in rows], pa.string())))
    blank = [not words(r[1]) for r in rows]
    p = [0.0 if b else 1 / (1 + math.exp(-e)) for b, e in zip(blank, evidence, strict=True)]
    sites, hosts = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        sites[r[3], r[2]].append(x)
        hosts[r[3]].append(x)
    n, bound = len(rows), lambda x: min(1 - 1e-6, max(1e-6, x))
    rate = bound(sum(p) / n)
    strength = lambda v: 1e6 if v <= 0 else min(1e6, max(1.0, rate * (1 - rate) / v - 1))
    k = strength(sum(len(x) * (sum(x) / len(x) - rate) ** 2 for x in hosts.values()) / n - rate * (1 - rate) * len(hosts) / n)
    host = {h: (sum(x) + k * rate) / (len(x) + k) for h, x in hosts.items()}
    k = strength(sum(len(x) * (sum(x) / len(x) - host[s[0]]) ** 2 for s, x in sites.items()) / n - rate * (1 - rate) * len(sites) / n)
    site = {s: (sum(x) + k * host[s[0]]) / (len(x) + k) for s, x in sites.items()}
    odds = lambda x: math.log(bound(x) / (1 - bound(x)))
    out = []
    for r, b, e, x in zip(rows, blank, evidence, p, strict=True):
        good = 0.0 if b else 1 / (1 + math.exp(-(e + odds(site[r[3], r[2]]) - odds(rate))))
        out.append((x, site[r[3], r[2]], good, good >= 0.5))
    return out


def test_quality_by_brute_force(spark):
    rows = messy(n=150)
    labels = spark.createDataFrame([(r[0], int((r[0] or 0) % 2), "x") for r in rows], "doc_id long, quality int, own string")
    docs = frame(spark, rows)
    model = quality.train(docs, labels)
    got = sorted((str(r["doc_id"]), r["p_text"], r["site_rate"], r["p_good"], r["kept"]) for r in quality.classify(docs, model).collect())
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_quality(model, rows), strict=True))
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and np.allclose(g[1:4], w[1:4], atol=1e-9) and g[4] == w[4]


def test_operators_of_pipeline_stages_on_nothing(spark):
    from quarry.llm import exact, neardup

    none, null = frame(spark, []), frame(spark, [(None, None, None, None, None)])
    model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    for docs, left in ((none, 0), (null, 1)):
        assert exact.drop_exact(docs).count() == left == neardup.drop_near(docs).count()
        assert quality.keep_good(docs, model).count() == mixing.apply_mix(docs).count() == 0
    named = frame(spark, [(None, "some words here", "en", "s", 1), (None, "other words there", None, None, 1)])
    assert exact.drop_exact(named).count() == neardup.drop_near(named).count() == quality.keep_good(named, model).count() == 2
    assert all(d.columns == none.columns for d in (exact.drop_exact(none), neardup.drop_near(none), quality.keep_good(none, model), mixing.apply_mix(none)))


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("big", "p", 2.0)] * 400 + [("bad", "p", -2.0)] * 400 + [("tiny", "p", -2.0)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _evidence double").withColumn("_blank", F.lit(False))
    rate = {r["host"]: r["site_rate"] for r in quality.site_rates(scored).collect()}
    assert rate["bad"] < rate["tiny"] < rate["big"]


# -- licences -------------------------------------------------------------------------------------------------------

APACHE, MIT = licences.TEMPLATES["Apache-2.0"][0], licences.TEMPLATES["MIT"][0]
FILES = [
    (1, "a/LICENSE", APACHE), (2, "a/x.py", "plain words"), (3, "a/b/y.py", "# " + MIT + "\ncode"), (4, "a/b/c/z.py", "more words"), (5, "d/w.py", "words"),
    (6, "a/b/COPYING.txt", MIT), (7, None, APACHE), (8, "e/n.py", None), (9, "a/b/c/z.py", "more words"), (10, "top.py", "x"), (11, "d/q.py", "the license of a license"),
]


def brute_licences(rows, threshold=0.6):
    counts = lambda t: Counter(re.findall(licences.TERM, (t or "").lower()))
    known = {t for texts in licences.TEMPLATES.values() for x in texts for t in counts(x)}
    df = Counter(t for r in rows for t in set(counts(r[2])) & known)
    idf = lambda t: math.log((len(rows) + 1) / (df[t] + 1)) + 1
    vector = lambda c: {t: n * idf(t) for t, n in c.items()}
    out = {}
    for r in rows:
        best = None
        whole = bool(r[1] and re.search(licences.LICENCE_FILE, r[1]))
        units = [*(r[2] or "").split("\n"), *([r[2] or ""] if whole else [])]
        for u in units:
            v = vector(counts(u))
            for name, texts in sorted(licences.TEMPLATES.items()):
                for t in texts:
                    w = vector(counts(t))
                    norm = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
                    cosine = round(sum(x * w.get(k, 0) for k, x in v.items()) / norm, 9) if norm else 0
                    if cosine >= threshold and (best is None or cosine > best[1]):
                        best = (name, cosine)
        out[r[0]] = best
    return out


def test_licences(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in FILES], "doc_id long, path string, text string, term string, at int").repartition(3)
    found = {r["doc_id"]: r for r in licences.licence_scan(df).collect()}
    want = brute_licences(FILES)
    for r in FILES:
        got = found[r[0]]
        assert (got["licence"], got["cosine"] and round(got["cosine"], 6)) == ((want[r[0]][0], round(want[r[0]][1], 6)) if want[r[0]] else (None, None))
    inherited = {d: (r["inherited"], r["inherited_from"]) for d, r in found.items() if r["inherited"]}
    assert inherited == {2: ("Apache-2.0", "a/LICENSE"), 4: ("MIT", "a/b/COPYING.txt"), 9: ("MIT", "a/b/COPYING.txt")}
    assert {d for d, r in found.items() if r["licence_file"]} == {1, 6}


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


@pytest.mark.parametrize("text", [MIT_TEXT, MIT_TEXT.replace("\n", "\r\n"), re.sub(r"(?<=\S)\n(?=\S)", " ", MIT_TEXT)], ids=["wrapped", "crlf", "unwrapped"])
@pytest.mark.parametrize("others", [3, 300])
def test_complete_licence_texts_count_for_their_directory(spark, text, others):
    rows = [(1, "a/LICENSE", text), (2, "b/readme.txt", text), *((10 + k, f"{'ab'[k % 2]}/src/f{k}.py", f"plain words of file {k}") for k in range(others))]
    found = {r["doc_id"]: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert (found[1]["licence"], found[1]["licence_file"], found[2]["licence_file"]) == ("MIT", True, False)
    for k in range(others):
        want = ("MIT", "a/LICENSE") if k % 2 == 0 else (None, None)
        assert (found[10 + k]["inherited"], found[10 + k]["inherited_from"]) == want


TITLES = {
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n\n"
    "    This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n    LEGAL SERVICES.\n",
    "BSD-2-Clause": "Copyright (c) 2020, Somebody\n\n" + licences.FILE_TEMPLATES["BSD-2-Clause"][0],
    "BSD-3-Clause": "Copyright (c) 2020, Somebody\n\n" + licences.FILE_TEMPLATES["BSD-3-Clause"][0],
}


def test_titles_and_short_licences_count_for_their_directory(spark):
    rows = [(i, f"{n}/COPYING", t) for i, (n, t) in enumerate(TITLES.items())] + [(100 + i, f"{n}/x/y.py", "words") for i, n in enumerate(TITLES)]
    found = {r["doc_id"]: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, n in enumerate(TITLES):
        assert (found[i]["licence"], found[i]["licence_file"], found[100 + i]["inherited"], found[100 + i]["inherited_from"]) == (n, True, n, f"{n}/COPYING")


def test_whole_licences_count_and_versions_stay_apart(spark, small):
    """Every whole licence, wrapped anew, with another holder and a line of its own, beside the documents of the tables."""
    texts = {n: "Copyright (c) 2021 Some Body\n\nSome project\n" + re.sub(r"\s+", " ", t) for n, t in licences.full_texts().items()}
    names = sorted(texts)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.concat(F.lit("docs/"), "doc_id").alias("path"), "text")
    rows = [(100_000 + i, f"p{i}/LICENSE", texts[n]) for i, n in enumerate(names)] + [(200_000 + i, f"p{i}/src/a.py", "words of a file") for i in range(len(names))]
    found = {r["doc_id"]: r for r in licences.licence_scan(docs.unionByName(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()}
    for i, n in enumerate(names):
        assert (found[100_000 + i]["licence"], found[100_000 + i]["licence_file"]) == (n, True)
        assert (found[200_000 + i]["inherited"], found[200_000 + i]["inherited_from"]) == (n, f"p{i}/LICENSE")


def test_the_root_and_the_nearest_directory(spark):
    rows = [(1, "LICENSE", MIT_TEXT), (2, "a/LICENSE", APACHE), (3, "x.py", "words"), (4, "b/c/d.py", "words"), (5, "a/b/c.py", None), (6, None, "words"), (7, "/e.py", "words")]
    rows += [(10 + k, f"a/n/f{k}.py", "words") for k in range(40)]
    found = {r["doc_id"]: (r["inherited"], r["inherited_from"]) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    root, near = ("MIT", "LICENSE"), ("Apache-2.0", "a/LICENSE")
    assert found == {1: (None, None), 2: (None, None), 3: root, 4: root, 5: near, 6: (None, None), 7: root, **{10 + k: near for k in range(40)}}


def test_licences_of_nothing(spark):
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_telling_terms_never_lose_a_match():
    rng = random.Random(4)
    vectors = [{f"t{j}": rng.random() + 0.01 for j in range(8)} for _ in range(5)]
    telling = licences.telling_terms(vectors, 0.6)
    for v in vectors:
        rest = math.sqrt(sum(w * w for t, w in v.items() if t not in telling))
        assert rest < 0.6 * math.sqrt(sum(w * w for w in v.values())) + 1e-12


# -- web text -------------------------------------------------------------------------------------------------------

STORY = "<h1>The title</h1><p>First paragraph, long enough to be text.</p><p>Second &amp; <b>bold</b>\n line<br>here.</p><p>Ok.</p>"
TEXT = "The title\nFirst paragraph, long enough to be text.\nSecond & bold line here.\nOk."
FRAME = "<nav><ul><li><a href=x>Home</a></li></ul></nav>{}<footer>&copy; Someone. All rights reserved, every one.</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{FRAME.format(f'<article>{STORY}</article>')}</body></html>",
        FRAME.format(f"<div class=ad>Buy this now, it is cheap.</div><article>{STORY}</article>"),
        FRAME.format(f"<main>{STORY}<section class='comments'><p>What a story, said a reader, and more.</p></section></main>"),
        FRAME.format(f"<div id=content class='post-body'>{STORY}</div><div class=sidebar><p>Other news, of today.</p></div>"),
        FRAME.format(f"<article>{STORY}<form><p>Your mail, please.</p><input></form><aside>Aside, for once.</aside></article>"),
        FRAME.format(f"<div class='cookie-notice'>We use cookies, as everybody does.</div><article class='has-sidebar'>{STORY}"),
        FRAME.format(f"<article><header>{STORY[:STORY.index('<p>')]}<p>By me</p></header>{STORY[STORY.index('<p>'):]}</article>"),
        FRAME.format(f"<article>{STORY.replace('</p>', '')}</article>"),
        FRAME.format(f"<article>{STORY}<div class='post-comments'><p>First, wrote somebody, at once.</p></div></article>"),
        FRAME.format(f"<div class=wrap><div class=sideBar><p>Teaser, with some more words.</p></div><div class=text>{STORY}</div></div>"),
    ],
)
def test_main_text(page):
    assert webtext.main_text(page) == TEXT


LEAD = ("A lead, of some words. " * 9).strip()
BODY = [("Body text goes on, and on; it says much. " * 8).strip() + f" {k}." for k in range(20)]
DIVS = "<div class=body>" + "".join(f"<p>{x}</p>" for x in BODY) + "</div>"
LINKS = "<div class=more><ul>" + "".join(f"<li><a href=/{k}>Another story {k}</a></li>" for k in range(5)) + "</ul></div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=post><h1>T</h1><p class=lead>{LEAD}</p>{DIVS}</div>", ["T", LEAD, *BODY]),
        (f"<div class=post><h1>T</h1>{DIVS}<p>The end.</p></div>", ["T", *BODY, "The end."]),
        (f"<div class=post><div class=top><h1>T</h1></div><div class=date>1 May</div>{DIVS}</div>{LINKS}", ["T", "1 May", *BODY]),
        (f"<div class=wrap><div class=post><div class=lead>{LEAD}</div>{DIVS}</div>{LINKS}</div>", [LEAD, *BODY]),
        (f"<div class=post>{DIVS}</div><div class=box><div>Weather</div><div>Mild</div></div>", BODY),
        (f"<article><h1>T</h1>{DIVS}</article><div class=box><p>{LEAD}</p></div>", ["T", *BODY]),
    ],
)
def test_title_and_lead_beside_a_long_body(page, want):
    assert webtext.main_text(FRAME.format(page)) == "\n".join(want)


@pytest.mark.parametrize(
    "inner",
    [
        f"{STORY}<p class='discussion'>The discussion, part of the paper, of results.</p>",
        f"{STORY}<ol><li><a href=/1>Smith, A paper</a></li><li><a href=/2>Jones, a book</a></li></ol>",
        f"{STORY}<p class=note id=legal>Second <span class='share'>bold</span> line, of it.</p>",
        f"<div class=intro>{STORY}</div><section><h2>More</h2><ul><li>One</li><li>Two</li></ul></section>",
    ],
)
def test_nothing_of_an_article_is_lost(inner):
    plain = re.sub(r"</?(p|h[12]|li|ol|ul|div|section)[^>]*>", "\n", inner.replace("<br>", " ").replace("&amp;", "&").replace("\n", " "))
    want = [" ".join(x.split()) for x in re.sub(r"<[^>]*>", "", plain).split("\n")]
    assert webtext.main_text(FRAME.format(f"<article>{inner}</article>")) == "\n".join(x for x in want if x)


def test_names_are_not_needed():
    """With class names and ids that say nothing, the frames of the tests above lose no word and let few others in."""
    frames = [m.args[1] for m in test_main_text.pytestmark if m.name == "parametrize"][0]
    shares = []
    for page in frames:
        page = re.sub(r"(class|id)=('[^']*'|[^\s>]+)", lambda m: f"{m[1]}=q{len(m[2])}", page)
        got, want = Counter(webtext.main_text(page).split()), Counter(TEXT.split())
        assert not want - got
        shares.append(sum((got & want).values()) / sum(got.values()))
    assert sum(shares) / len(shares) >= 0.8


def test_ratios_decide(monkeypatch, small):
    """On the table's pages, names taken away, the ratios find the article; without them menus or adverts come along."""
    import pyarrow.parquet as pq

    pages = [re.sub(" class=\"[^\"]*\"", "", x).replace("article>", "div>") for x in pq.read_table(f"{small}/pages.parquet")["html"].to_pylist()]
    inside = lambda x: re.sub(r"<[^>]*>", " ", html.unescape(x[x.index("<h1>") : x.rindex("</div><footer>")]).replace("&", " ")).split()
    clean = lambda x: x.replace("&", " ").split()
    got = [clean(webtext.main_text(x)) for x in pages]
    want = [inside(x) for x in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.7 * len(pages)
    monkeypatch.setattr(webtext, "path_scores", lambda path, *rest: np.ones(len(path)))
    without = [clean(webtext.main_text(x)) for x in pages]
    assert sum(a == b for a, b in zip(without, want, strict=True)) <= 0.1 * len(pages)


def test_path_scores_by_brute_force(small):
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{small}/pages.parquet")["html"].to_pylist():
        own = webtext._Kept(page).blocks
        sums = defaultdict(lambda: [0, 0, 0])
        for b in own:
            s = sums[b.element.path]
            s[0] += len(b.text) - min(b.links, len(b.text))
            s[1] += len(webtext._PUNCTUATION.findall(b.text))
            s[2] += 1
        ratio = lambda k: [sums[b.element.path][k] / sums[b.element.path][2] for b in own]  # noqa: B023, E731
        smooth = lambda x: [0.25 * x[max(0, i - 1)] + 0.5 * x[i] + 0.25 * x[min(len(x) - 1, i + 1)] for i in range(len(x))] if len(x) > 2 else x
        fused = [a * (1 + b) for a, b in zip(smooth(ratio(0)), smooth(ratio(1)), strict=True)]
        means = defaultdict(list)
        for b, f in zip(own, fused, strict=True):
            means[b.element.path].append(f)
        column = lambda f: np.array([f(b) for b in own], dtype=float)  # noqa: B023, E731
        got = webtext.path_scores(
            column(lambda b: b.element.path), column(lambda b: len(b.text)), column(lambda b: min(b.links, len(b.text))),
            column(lambda b: len(webtext._PUNCTUATION.findall(b.text))), column(lambda b: b.element.prior),
        )
        assert np.allclose(got, [np.mean(means[b.element.path]) * b.element.prior for b in own])


@pytest.mark.parametrize(
    "part", ['<a "x ', "<div>", "<span>x", "<a", "<", '<p class="a>x</p>', "<ul><li>x", "<p>x, y.", "<a \"'>", "</b><i>", "<!--", "<table><tr><td>x", "<script>x</script>"]
)
def test_hostile_pages_take_linear_time(part):
    import time

    page, began = part * (1_000_000 // len(part)), time.process_time()
    webtext.main_text(page)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- <p>x</p>", "<script>x", "<nav><p>Menu, only.</p></nav>"])
def test_pages_without_text(page):
    assert webtext.main_text(page) in ("", "<", "<p")


def test_extract(spark):
    rows = [(1, "u", f"<article>{STORY}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<article>{STORY}</article>", "x"), (3, "w", "<p>" + "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    found = sorted(((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in webtext.extract(df).collect()), key=str)
    long = ("word " * 50000).strip()
    assert found == sorted([("1", "u", TEXT, len(TEXT))] * 2 + [("2", None, "", 0), ("None", "v", "", 0), ("3", "w", long, len(long))], key=str)
    assert webtext.extract(df.limit(0)).count() == 0
