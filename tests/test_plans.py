"""What plans and jobs look like: edges that stay in place, counters of the writing job, filters before shuffles, salts, chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import linkgraph as L
from quarry.operators import pagerank as R
from quarry.operators import paths as P
from quarry.store import in_buckets


def graph(spark, edges, n):
    nodes = spark.range(n).select(F.col("id"))
    frame = spark.createDataFrame(edges, "src long, dst long")
    lone = n - len({a for a, _ in edges})
    return L.LinkGraph(nodes, frame, n, lone)


def by_hand(edges, n, steps):
    rank, degree, errors = [1 / n] * n, [0] * n, []
    for a, _ in edges:
        degree[a] += 1
    old = [0.0] * n
    for _ in range(steps):
        errors.append(sum(abs(x - y) for x, y in zip(rank, old, strict=True)))
        mass = sum(r for r, d in zip(rank, degree, strict=True) if not d)
        got = [0.0] * n
        for a, b in edges:
            got[b] += rank[a] / degree[a]
        old, rank = rank, [0.15 / n + 0.85 * (g + mass / n) for g in got]
    return rank, errors


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_ranks_with_and_without_large_sources(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT", hot)
    rng = random.Random(hot)
    edges = [(rng.choice([0, 0, 0, 1, 2, 5, 6, 7, 8]), rng.randrange(12)) for _ in range(120)]
    found = R.pagerank(graph(spark, edges, 12), 4)
    rank, errors = by_hand(edges, 12, 4)
    assert {r["id"]: round(r["rank"], 12) for r in found.ranks.collect()} == {k: round(x, 12) for k, x in enumerate(rank)}
    assert found.errors == pytest.approx(errors)


def test_a_step_shuffles_sums_only_and_takes_two_jobs(spark, monkeypatch):
    seen, step = [], R.next_ranks
    monkeypatch.setattr(R, "next_ranks", lambda *a: seen.append(step(*a)) or seen[-1])
    ring = graph(spark, [(k, (k + 1) % 30) for k in range(30)] + [(k, 0) for k in range(1, 20)], 30)
    one, five = (jobs(spark, f"steps-{k}", lambda k=k: R.pagerank(ring, k)) for k in (1, 5))
    assert five - one <= 4 * 2
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(dst" in exchanges[0]
    above = plan[: plan.index("times")]  # the edges' scan is the one that reads times
    assert above.count("Exchange") == 1 and "partial_sum" in plan[plan.index("Exchange") : plan.index("FileScan", plan.index("Exchange"))]


def test_bucketed_tables_join_as_they_lie(spark):
    left = in_buckets(spark.range(1000).withColumn("a", F.col("id") * 2), "left", "id")
    right = in_buckets(spark.range(500, 1500).withColumn("b", F.col("id") * 3), "right", "id")
    met = left.hint("merge").join(right, "id")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 500


def metric(plan, name):
    """Rows that each exchange of a finished plan wrote."""
    out, stack = [], [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.nodeName() == name:
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return out


def test_links_without_a_title_do_not_reach_the_exchange(spark):
    titles = spark.range(3000).select(F.col("id").alias("page"), F.concat(F.lit("T"), "id").alias("title"))
    found = spark.range(60_000).select((F.col("id") % 3000).alias("page"), F.lit("x").alias("title"), F.concat(F.lit("T"), F.col("id") * 5).alias("link"))
    found = found.unionByName(found.limit(10).withColumn("link", F.lit(None).cast("string")))
    want = {(k % 3000, f"T{5 * k}") for k in range(600)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        valid = L.valid_links(found, titles)
        rows = valid.collect()
        written = metric(valid._jdf.queryExecution().executedPlan(), "Exchange")
        few = L.maybe_known(found, titles.select(F.col("title").alias("known")), most=1)  # a filter much too small lets more pass, but none go
        assert {(r["page"], r["link"]) for r in few.collect()} >= want and few.count() < 60_000
        assert L.valid_links(found, titles.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {(r["page"], r["link"]) for r in rows} == want and len(rows) == 600
    assert max(written) <= 6000  # 600 links and few strangers, or the 3000 titles; not 60,000
    assert {(r["page"], r["link"]) for r in L.valid_links(found, titles).collect()} == want


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_adjacency_in_chunks(spark, most):
    rng = random.Random(most)
    edges = [("hub", f"t{rng.randrange(40):02d}") for _ in range(300)] + [("a", "b"), ("a", "a"), (None, "z")]
    chunks = L.adjacency_chunks(spark.createDataFrame(edges, "src string, dst string").repartition(3), most).collect()
    held = {}
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        assert 0 < len(r["links"]) <= most
        held.setdefault(r["src"], []).extend(r["links"])
    assert held == {"hub": sorted(d for s, d in edges if s == "hub"), "a": ["a", "b"], None: ["z"]}
    assert all(len(r["links"]) == most for r in chunks if (r["src"], r["chunk"] + 1) in {(x["src"], x["chunk"]) for x in chunks})


def closed(edges, n):
    far = [[float("inf")] * n for _ in range(n)]
    for k in range(n):
        far[k][k] = 0
    loops = {}
    for a, b, w in edges:
        if a == b:
            loops[a] = min(w, loops.get(a, w))
        else:
            far[a][b] = min(far[a][b], w)
    for a, w in loops.items():
        far[a][a] = w
    for k in range(n):
        for i in range(n):
            for j in range(n):
                far[i][j] = min(far[i][j], far[i][k] + far[k][j])
    return {(i, j, int(far[i][j])) for i in range(n) for j in range(n) if far[i][j] < float("inf")}


@pytest.mark.parametrize("salted", [1 << 22, 3])
def test_doubling_from_pairs_of_the_last_hops(spark, salted):
    rng = random.Random(salted)
    ids = lambda n: spark.range(n).select(F.col("id").cast("int").alias("id"))
    frame = lambda edges: spark.createDataFrame(edges, "src int, dst int, weight int")
    hub = [(k, 0, 3) for k in range(1, 20)] + [(0, k, k) for k in range(1, 20)] + [(4, 5, 1), (6, 6, 2), (7, 7, 0), (0, 0, 9)]
    ring = [(k, (k + 1) % 23, rng.randint(0, 3)) for k in range(23)]
    some = [(rng.randrange(18), rng.randrange(18), rng.randint(0, 9)) for _ in range(40)]
    for edges, n in ((hub, 20), (ring, 23), (some, 18)):
        found = {tuple(r) for r in P.all_pairs(frame(edges), ids(n), salted=salted).collect()}
        assert found == closed(edges, n)
        assert {tuple(r) for r in P.all_pairs_blocked(frame(edges), ids(n), size=4).collect()} == found


def test_heavy_paths_take_wider_blocks(spark):
    edges = spark.createDataFrame([(k, k + 1, 2_000_000_000) for k in range(6)], "src int, dst int, weight int")
    ids = spark.range(7).select(F.col("id").cast("int").alias("id"))
    found = {(r["i"], r["j"]): r["dist"] for r in P.all_pairs_blocked(edges, ids, size=2).collect()}
    assert found == {(i, j): (j - i) * 2_000_000_000 for i in range(7) for j in range(i, 7)}


def chained(hubs, length, links, rng):
    """Edges between chains: chain ``c`` is ``c, c + hubs, c + 2 hubs``, and its last member leads to other chains' first."""
    edges = [(c + k * hubs, c + (k + 1) * hubs, rng.randint(0, 5)) for c in range(hubs) for k in range(length - 1)]
    return edges + [(c + (length - 1) * hubs, d, rng.randint(0, 9)) for c in range(hubs) for d in rng.sample(range(hubs), links)]


def test_chains_are_one_vertex_of_the_matrix(spark, monkeypatch):
    lines, step = [], P.Rolling.step

    def counted(self, df):
        lines.append(self.name)
        return step(self, df)

    monkeypatch.setattr(P.Rolling, "step", counted)
    monkeypatch.setattr(P, "_PIECE", 4)
    edges = chained(5, 11, 3, random.Random(1))
    frame, ids = spark.createDataFrame(edges, "src long, dst long, weight int"), spark.range(58)
    found = [tuple(r) for r in P.all_pairs_blocked(frame, ids, size=4).collect()]
    assert len(found) == len(set(found)) and set(found) == closed(edges, 58)
    assert lines.count("pivot-lines") == 2  # five chains; the 55 vertices would be 14


def test_chains_with_loops_rings_and_trees(spark, monkeypatch):
    monkeypatch.setattr(P, "_PIECE", 3)
    rng = random.Random(7)
    ring = [(k, (k + 1) % 9, rng.randint(0, 4)) for k in range(9)]
    cases = {
        "two rings": (ring + [(k + 9, 9 + (k + 1) % 2, 3) for k in range(2)] + [(11, 12, 1)], 14),
        "a ring with a loop": (ring + [(4, 4, 99), (7, 7, 0)], 9),
        "a ring with a way in and out": (ring + [(9, 10, 2), (10, 3, 5), (6, 11, 1), (11, 12, 1), (12, 13, 0)], 14),
        "trees": ([((k - 1) // 2, k, rng.randint(0, 5)) for k in range(1, 9)] + [(k + 9, 9 + k // 2, rng.randint(0, 5)) for k in range(1, 9)] + [(18, 19, 1), (19, 20, 2), (8, 18, 3)], 21),
        "back to its head": ([(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (3, 4, 1), (4, 5, 2), (5, 3, 2), (0, 0, 7), (6, 0, 1)], 7),
        "loops with nothing else": ([(0, 0, 3), (1, 2, 3), (2, 2, 8), (2, 3, 0), (3, 4, 0)], 6),
    }
    for k in range(3):
        cases[f"random {k}"] = ([(rng.randrange(24), rng.randrange(24), rng.randint(0, 9)) for _ in range(26)], 24)
    for name, (edges, n) in cases.items():
        frame, ids = spark.createDataFrame(edges, "src int, dst int, weight int"), spark.range(n).select(F.col("id").cast("int").alias("id"))
        found = [tuple(r) for r in P.all_pairs_blocked(frame, ids, size=4).collect()]
        assert len(found) == len(set(found)) and set(found) == closed(edges, n), name


def test_many_vertices_are_searched_by_sources(spark, monkeypatch):
    lines, step = [], P.Rolling.step

    def counted(self, df):
        lines.append(self.name)
        return step(self, df)

    monkeypatch.setattr(P.Rolling, "step", counted)
    monkeypatch.setattr(P, "_PIVOTS", 8)
    rng = random.Random(3)
    some = lambda weights: [(rng.randrange(30), rng.randrange(30), rng.choice(weights)) for _ in range(120)]
    cases = {
        "apart": [(a + 10 * k, b + 10 * k, rng.randint(0, 9)) for k in range(3) for a in range(10) for b in rng.sample(range(10), 3)],
        "chains": chained(10, 3, 3, rng),
        "long paths of small weights": some([9000, 16000, 16001]),
        "wide": some([0, 5, 20_000, 2_000_000_000]),
        "hub": [(k, 0, 3) for k in range(1, 30)] + [(0, k, k) for k in range(1, 30)] + [(4, 5, 1), (6, 6, 2), (0, 0, 9)],
    }
    monkeypatch.setattr(P, "_STRIP", 200)
    monkeypatch.setattr(P, "_LIGHT", 1)
    for name, edges in cases.items():
        frame, ids = spark.createDataFrame(edges, "src int, dst int, weight long"), spark.range(33).select(F.col("id").cast("int").alias("id"))
        found = [tuple(r) for r in P.all_pairs_blocked(frame, ids, size=4).collect()]
        assert len(found) == len(set(found)) and set(found) == closed(edges, 33), name
    assert "pivot-lines" not in lines  # 33 vertices in blocks of 4 would take up to nine rounds over the whole matrix
