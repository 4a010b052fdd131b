"""Hand-checkable cases, one for each rule that is easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import counting as C
from quarry.operators import grid as G
from quarry.operators import linkgraph as L
from quarry.operators import numeric as N
from quarry.operators import pagerank as R
from quarry.operators import paths as P
from quarry.sources import binary, images
from quarry.sources import text as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


def test_first_letters(spark):
    lines = spark.createDataFrame([("Apple banana Ant 9x aardvark Éa",)], "value string")
    found = C.first_letter_count(lines).orderBy(*C.case_paired(F.col("ch"))).withColumn("p", C.letter_partition(F.col("ch"))).collect()
    assert [(r["ch"], r["n"], r["p"]) for r in found] == [("A", 2, 0), ("a", 1, 0), ("b", 1, 0), ("É", 1, 1)]


def test_unescape_replaces_in_order(spark):
    assert one(spark, T.xml_unescape(F.col("v")), v="&lt; &amp;lt; &amp;quot;") == '< &lt; "'


@pytest.mark.parametrize("given, want", [("alpha beta", "Alpha beta"), ("Alpha", "Alpha"), ("éa", "éa"), ("", "")])
def test_only_the_first_ascii_letter_is_capitalised(spark, given, want):
    assert one(spark, T.capitalised(F.col("v")), v=given) == want


WIKI = ["<title>Alpha</title> [[beta|b]] [[Gamma#x]] [[Nope]] [[beta]]", "<title>Beta</title>", "&lt;title&gt;Gamma&lt;/title&gt; [[Alpha]]", "no title [[Alpha]]"]


def test_links(spark):
    graph = L.graph_of_pages(spark.createDataFrame([(x,) for x in WIKI], "value string"))
    assert sorted(map(tuple, graph.edges.collect())) == [("Alpha", "Beta"), ("Alpha", "Beta"), ("Alpha", "Gamma"), ("Gamma", "Alpha")]
    assert (graph.pages, graph.dangling, graph.nodes.count()) == (3, 1, 3)
    assert {tuple(r) for r in L.out_degree(graph.edges).collect()} == {("Alpha", 3), ("Gamma", 1)}
    assert L.adjacency(graph.edges).filter("src = 'Alpha'").head()["links"] == ["Beta", "Beta", "Gamma"]


def test_pages_are_counted_before_titles_are_distinct(spark):
    lines = spark.createDataFrame([("<title>A</title>",), ("<title>A</title> [[A]]",)], "value string")
    graph = L.graph_of_pages(lines)
    assert (graph.pages, graph.dangling, graph.nodes.count()) == (2, 1, 1)


def triangle(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    return L.LinkGraph(spark.createDataFrame([(x,) for x in "ABC"], "id string"), edges, 3, 1)


def test_one_step(spark):
    found = R.pagerank(triangle(spark), 1)
    ranks = [(r["id"], round(r["rank"], 6)) for r in R.by_rank(found.ranks).collect()]
    assert ranks == [("C", 0.569444), ("B", 0.286111), ("A", 0.144444)]
    assert found.errors == [1.0]


def test_zero_steps_give_initial_ranks(spark):
    assert {r["rank"] for r in R.pagerank(triangle(spark), 0).ranks.collect()} == {1 / 3}


def test_converged_ranks_are_the_last_input(spark):
    found = R.pagerank(triangle(spark), None)
    assert found.errors[-1] < R.TOLERANCE <= found.errors[-2]
    same = R.pagerank(triangle(spark), len(found.errors) - 1)
    assert sorted(map(tuple, same.ranks.collect())) == sorted(map(tuple, found.ranks.collect()))
    assert abs(sum(r["rank"] for r in found.ranks.collect()) - 1) < 1e-9


def test_average_sort(spark):
    rows = spark.createDataFrame([("x", 9), ("x", 11), ("y", 10), ("z", 12)], "key string, value int")
    assert [tuple(r) for r in C.by_average(C.average(rows)).collect()] == [("z", 12.0), ("x", 10.0), ("y", 10.0)]


@pytest.mark.parametrize("avg, want", [(9.0, 2), (10.0, 1), (11.0, 0), (11.05, 0), (99.0, 0), (1.0, 2), (float("nan"), 2)])
def test_range_partition(spark, avg, want):
    assert one(spark, C.range_partition(F.col("v"), 3), v=avg) == want


@pytest.mark.parametrize("rank, want", [(0.1, 0), (0.5, 1), (15.4, 30), (15.5, 31), (100.0, 31), (-0.1, 31)])
def test_rank_bucket(spark, rank, want):
    assert one(spark, C.rank_bucket(F.col("v")), v=rank) == want


def test_key_modulo(spark):
    assert [one(spark, C.key_modulo(F.col("v"), 3), v=k) for k in ("a", "b", "c")] == [1, 2, 0]
    with pytest.raises(Exception, match="empty key"):
        one(spark, C.key_modulo(F.col("v"), 3), v="")


@pytest.mark.parametrize("n, parts", [(10, 4), (3, 5), (12, 4), (1, 1)])
def test_blocks(spark, n, parts):
    found = [r["block"] for r in C.blocks(spark.range(n).withColumnRenamed("id", "pos"), parts).orderBy("pos").collect()]
    sizes = [n // parts + (k < n % parts) for k in range(parts)]
    assert found == [k for k, s in enumerate(sizes) for _ in range(s)]


def test_positions_sort_and_number(spark):
    values = [3.5, float("nan"), -1.0, 2.0, 2.0, 7.25] * 50
    found = C.positions(spark.createDataFrame([(v,) for v in values], "value float"), F.col("value").asc()).orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(300))
    assert [r["value"] for r in found][:250] == sorted(v for v in values if v == v)[:250]
    assert all(r["value"] != r["value"] for r in found[250:])


def test_positional_difference(spark):
    left = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "pos long, value int")
    right = spark.createDataFrame([(0, 5), (1, 9), (3, 7)], "pos long, value int")
    found = {tuple(r) for r in C.positional_difference(left, right).collect()}
    assert found == {(1, 6, 9), (2, 7, None), (3, None, 7)}


EDGES = [(0, 1, 3), (1, 2, 4), (0, 2, 10), (2, 3, 1)]


def edges_of(spark, edges):
    return spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "pos long, src int, dst int, weight int")


def vertices_of(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("id"))


def test_shortest_paths(spark):
    edges, vertices = P.last_edges(edges_of(spark, EDGES)), vertices_of(spark, 4)
    inf = binary.UNREACHABLE
    want = [0, 3, 7, 8, inf, 0, 4, 5, inf, inf, 0, 1, inf, inf, inf, 0]
    for found in (P.all_pairs(edges, vertices), P.all_pairs_blocked(edges, vertices, size=3)):
        assert [r["dist"] for r in P.dense(found, vertices).orderBy("i", "j").collect()] == want
    assert sorted(map(tuple, P.single_source(edges, 0).collect())) == [(0, 0), (1, 3), (2, 7), (3, 8)]


def test_last_edge_wins_and_loops_stay(spark):
    assert P.last_edges(edges_of(spark, [(0, 1, 5), (0, 1, 9)])).head()["weight"] == 9
    assert [tuple(r) for r in P.all_pairs(P.last_edges(edges_of(spark, [(0, 0, 4)])), vertices_of(spark, 1)).collect()] == [(0, 0, 4)]


def test_random_graph_equals_triple_loop(spark):
    rng = np.random.default_rng(3)
    n = 14
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 30), rng.integers(0, n, 30), rng.integers(1, 50, 30), strict=True) if a != b]
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    want = {(i, j): d[i, j] for i in range(n) for j in range(n) if np.isfinite(d[i, j])}
    last = P.last_edges(edges_of(spark, edges))
    for found in (P.all_pairs(last, vertices_of(spark, n)), P.all_pairs_blocked(last, vertices_of(spark, n), size=4)):
        assert {(r["i"], r["j"]): r["dist"] for r in found.collect()} == want


def test_only_inner_vertices_are_pivots(spark, monkeypatch):
    """Vertices that edges only leave or only enter cost rows or columns of blocks, not rounds over the square of all."""
    rng = np.random.default_rng(5)
    inner, outer, size = 6, 40, 4
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, inner, 15), rng.integers(0, inner, 15), rng.integers(1, 50, 15), strict=True)]
    edges += [(a, int(rng.integers(0, inner)), int(rng.integers(1, 50))) for a in range(inner, outer) for _ in range(2)]
    edges += [(int(rng.integers(0, inner)), b, 7) for b in range(outer, outer + 5)] + [(inner, inner, 3), (outer, outer, 4), (outer + 9, outer + 9, 5)]
    n, held, step = outer + 10, [], P.Rolling.step

    def counted(self, df):
        out = step(self, df)
        held.append((self.name, out.count()))
        return out

    monkeypatch.setattr(P.Rolling, "step", counted)
    last = P.last_edges(edges_of(spark, edges))
    found = {(r["i"], r["j"]): r["dist"] for r in P.all_pairs_blocked(last, vertices_of(spark, n), size=size).collect()}
    rounds, blocks = sum(name == "pivot-lines" for name, _ in held), max(rows for _, rows in held)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in last.select("src", "dst", "weight").collect():
        d[a, b] = w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    assert found == {(i, j): d[i, j] for i in range(n) for j in range(n) if np.isfinite(d[i, j])}
    assert rounds == 2 and blocks <= 44  # the square of all blocks would be 13 * 13, in 13 rounds


def test_edge_parts_follow_one_another(spark, tmp_path):
    rows = [(k * 3, k % 7, k % 5, k) for k in range(100)]
    binary.write_edge_parts(spark.createDataFrame(rows, "pos long, src int, dst int, weight int").repartition(5), str(tmp_path), 7)
    read = binary.read_edge_parts(spark, str(tmp_path))
    assert [r["weight"] for r in read.orderBy("first", "pos").collect()] == list(range(100))
    last = P.last_edges(read.withColumn("pos", F.struct("first", "pos")))
    assert {(r["src"], r["dst"]): r["weight"] for r in last.collect()} == {(k % 7, k % 5): k for k in range(100)}


def test_no_edges(spark):
    edges, vertices = P.last_edges(edges_of(spark, EDGES)).filter("src > 99"), vertices_of(spark, 3)
    assert sorted(map(tuple, P.all_pairs(edges, vertices).collect())) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert [tuple(r) for r in P.single_source(edges, 0).collect()] == [(0, 0)]


def test_escape_counts():
    assert G.escape(np.array([-2.0, 0.0]), np.array([-2.0, 0.0])).tolist() == [1, 10_000]


def test_colours(spark):
    found = G.coloured(spark.createDataFrame([(0, 0, 10_000), (1, 0, 1), (2, 0, 17)], "x int, y int, iter int"), 3).orderBy("x").collect()
    assert [tuple(r) for r in found] == [(0, 2, 0, 0, 0), (1, 2, 16, 0, 0), (2, 2, 240, 16, 16)]


def test_sobel_forms_agree_and_constant_images_have_no_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(x, y, *map(int, rng.integers(0, 256, 3))) for x in range(9) for y in range(11)]
    image = spark.createDataFrame(rows, "x int, y int, r int, g int, b int")
    a, b = G.sobel(image, 9, 11), G.sobel_bands(image, 9, 11, band=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    flat = image.withColumns({c: F.lit(77) for c in "rgb"})
    inner = G.sobel(flat, 9, 11).filter("x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 8")
    assert {tuple(r)[2:] for r in inner.collect()} == {(0, 0, 0)}


def test_pi_and_primes(spark):
    assert abs(N.pi_riemann(spark, 1000).head()["pi"] - 3.1435554669) < 1e-9
    assert N.prime_count(spark, 1000).head()["n_primes"] == 168
    assert [r["prime"] for r in N.primes(spark, 30, segment=7).orderBy("prime").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert N.prime_count(spark, 2).head()["n_primes"] == 0


@pytest.mark.parametrize("line, want", [("a|b||c||", ["a", "b", "", "c"]), ("", []), ("||", []), ("x", ["x"]), ("|x", ["", "x"])])
def test_split_fields(spark, line, want):
    assert one(spark, T.split_fields(F.col("v"), "|"), v=line) == want


@pytest.mark.parametrize("vertices, parts", [(10, 4), (3, 5), (12, 4), (1, 1)])
def test_source_ranges_and_local_order(spark, vertices, parts):
    found = [one(spark, P.source_range(F.col("v"), vertices, parts), v=v) for v in range(vertices)]
    assert found == [k for k in range(parts) for _ in range(vertices // parts + (k < vertices % parts))]
    edges = edges_of(spark, [(v % vertices, 0, v) for v in (5, 3, 9, 1, 0, 7)])
    for rows in P.by_source(edges, vertices, parts).rdd.glom().collect():
        assert [r["src"] for r in rows] == [r["src"] for r in sorted(rows, key=lambda r: (r["part"], r["src"]))]


def test_token_average_equals_pairs(spark):
    lines = spark.createDataFrame([("a b a",), ("a c",), ("",), (None,), ("b b b",)], "value string")
    assert {tuple(r) for r in C.token_average(lines).collect()} == {("a", 1.5), ("b", 2.0), ("c", 1.0)}


def test_whole_numbers(spark):
    rows = spark.createDataFrame([("7",), ("-3",), ("+12",)], "v string")
    assert [r[0] for r in rows.select(C.whole_number(F.col("v"))).collect()] == [7, -3, 12]
    for wrong in ("", "x", "1.5", "99999999999", None):
        with pytest.raises(Exception, match="whole number|CAST|INVALID"):
            spark.createDataFrame([(wrong,)], "v string").select(C.whole_number(F.col("v"))).collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_successors(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(g), int(k), int(rng.integers(0, 9))) for k, g in enumerate(rng.integers(0, 5, 400))]
    df = spark.createDataFrame(rows, "g int, k int, u int").repartition(parts)
    found = sorted(map(tuple, C.successors(df, F.col("g"), F.col("u"), F.col("k")).collect()))
    held = sorted(rows)
    assert found == sorted((a[2], b[2]) for a, b in zip(held, held[1:], strict=False) if a[0] == b[0])
    assert C.successors(df.limit(0), F.col("g"), F.col("u"), F.col("k")).count() == 0


def test_dangling_nodes_give_their_rank_to_all(spark):
    """Every third of a ring has no way out: the mass of these nodes goes to all, in each step."""
    n = 30
    edges = [(i, (i * 7 + 1) % n) for i in range(n) if i % 3] + [(i, (i + 1) % n) for i in range(n) if i % 3]
    graph = L.LinkGraph(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), n, n // 3)
    rank, degree = [1 / n] * n, [sum(a == i for a, _ in edges) for i in range(n)]
    for step in range(4):
        mass = n // 3 / n if not step else sum(r for r, d in zip(rank, degree, strict=True) if not d)
        rank = [0.15 / n + 0.85 * (sum(rank[a] / degree[a] for a, b in edges if b == i) + mass / n) for i in range(n)]
    found = {r["id"]: r["rank"] for r in R.pagerank(graph, 4).ranks.collect()}
    assert np.allclose([found[i] for i in range(n)], rank)


def test_ranks_that_do_not_converge_are_an_error(spark):
    with pytest.raises(RuntimeError, match="not converged"):
        R.pagerank(triangle(spark), None, tolerance=0.0, most=3)


def test_loops_keep_their_last_two_tables(spark, tmp_path):
    import os

    from quarry import store

    def held():
        root = store.shared_dir(spark).removeprefix("file://") + "/quarry"
        return {x for x in os.listdir(root) if x.startswith(("ranks", "blocks", "paths", "distances"))} if os.path.isdir(root) else set()

    before = held()
    R.pagerank(triangle(spark), 6)
    assert len(held() - before) == 2
    before = held()
    with store.scope(spark):
        rows = P.all_pairs(P.last_edges(edges_of(spark, EDGES)), vertices_of(spark, 9)).collect()
    assert len(rows) == 9 + 6 and held() == before


def test_folders_of_parts(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=500).astype("<f4")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos long, value double").repartition(6)
    binary.write_float_parts(df, str(tmp_path / "floats"))
    assert [r["value"] for r in binary.read_float_parts(spark, str(tmp_path / "floats")).orderBy("pos").collect()] == values.tolist()
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "floats").glob("part-*")))
    assert whole == values.tobytes()
    pairs = spark.createDataFrame([(0, 3, 5), (4, 1, 7)], "i int, j int, dist long")
    assert binary.write_matrix_parts(pairs, str(tmp_path / "matrix"), 5, cells=10) == 3
    found = {(r["i"], r["j"]): r["dist"] for r in binary.read_matrix_parts(spark, str(tmp_path / "matrix"), 5).collect()}
    assert found == {(i, j): {(0, 3): 5, (4, 1): 7}.get((i, j), binary.UNREACHABLE) for i in range(5) for j in range(5)}
    binary.write_edge_parts(edges_of(spark, EDGES * 20), str(tmp_path / "edges"), 4)
    read = binary.read_edges(spark, str(tmp_path / "edges" / "part-*")).orderBy("path", "pos").collect()
    assert [tuple(r)[2:] for r in read] == EDGES * 20
    assert not list(tmp_path.glob("*/_part*"))


def test_compressed_matrices(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 3, 5), (4, 1, 7), (4, 4, 0)], "i int, j int, dist long")
    assert binary.write_matrix_parts(pairs, str(tmp_path), 5, cells=10, codec="zstd") == 3
    want = np.full((5, 5), binary.UNREACHABLE, "<i4")
    want[[0, 4, 4], [3, 1, 4]] = 5, 7, 0
    assert len(list(tmp_path.glob("part-*.rows.zstd"))) == 3
    assert sorted(map(tuple, binary.read_matrix_parts(spark, str(tmp_path), 5).collect())) == [(i, j, int(want[i, j])) for i in range(5) for j in range(5)]
    with pytest.raises(Exception, match="no whole rows"):
        binary.read_matrix_parts(spark, str(tmp_path), 7).collect()


def test_large_images(spark, tmp_path):
    rows = spark.range(130 * 150).select(*[(F.expr(e)).cast("int").alias(c) for c, e in zip("xyrgb", ("id % 130", "id div 130", "id % 256", "id * 7 % 256", "id * 13 % 251"), strict=True)])
    for write, name in ((images.write_png, "i.png"), (images.write_bmp, "i.bmp")):
        write(rows.filter("y <> 70"), str(tmp_path / name), 130, 150)
        found = {tuple(r) for r in images.read_pixels(spark, str(tmp_path / name)).drop("path").collect()}
        assert found == {tuple(r) if r["y"] != 70 else (r["x"], 70, 0, 0, 0) for r in rows.collect()}


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\t1\t2\nb\nc\t\n")
    found = S.read_key_values(spark, str(tmp_path / "in.txt"))
    assert [tuple(r) for r in found.collect()] == [("a", "1\t2"), ("b", ""), ("c", "")]
    S.write_merged(found.orderBy("key"), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*")] == ["a\t1\t2\nb\t\nc\t\n"]


def test_binary_round_trips(spark, tmp_path):
    (tmp_path / "g.in").write_bytes(binary.edge_bytes(4, EDGES))
    edges = binary.read_edges(spark, str(tmp_path / "g.in"))
    assert [tuple(r)[1:] for r in edges.orderBy("pos").collect()] == [(k, *e) for k, e in enumerate(EDGES)]
    assert tuple(binary.read_edge_header(spark, str(tmp_path / "g.in")).head())[1:] == (4, 4)
    binary.write_matrix(P.all_pairs(P.last_edges(edges), vertices_of(spark, 4)), str(tmp_path / "m.out"), 4)
    assert np.fromfile(tmp_path / "m.out", "<i4")[:4].tolist() == [0, 3, 7, 8]
    np.array([2.5, -1.0, 7.0], "<f4").tofile(tmp_path / "v.in")
    values = binary.read_floats(spark, str(tmp_path / "v.in"))
    binary.write_floats(C.positions(values.drop("pos"), F.col("value").asc()), str(tmp_path / "v.out"))
    assert np.fromfile(tmp_path / "v.out", "<f4").tolist() == [-1.0, 2.5, 7.0]
    (tmp_path / "bad.in").write_bytes(binary.edge_bytes(4, EDGES)[:-4])
    with pytest.raises(Exception, match="announced"):
        binary.read_edges(spark, str(tmp_path / "bad.in")).collect()


@pytest.mark.parametrize("write, name", [(images.write_png, "i.png"), (images.write_bmp, "i.bmp")])
def test_image_round_trip(spark, tmp_path, write, name):
    rows = [(x, y, x * 40, y * 50, (x + y) * 10) for x in range(5) for y in range(3)]
    write(spark.createDataFrame(rows, "x int, y int, r int, g int, b int"), str(tmp_path / name), 5, 3)
    found = images.read_pixels(spark, str(tmp_path / name)).drop("path").collect()
    assert sorted(map(tuple, found)) == sorted(rows)


def test_store_follows_the_session_and_clears(spark):
    from quarry import store

    table = store.materialise(spark.range(5), "five")
    assert sorted(r[0] for r in table.collect()) == [0, 1, 2, 3, 4]
    assert store.fresh_path(spark, "x").startswith(store.shared_dir(spark))
    store.clear(spark)
    with pytest.raises(Exception, match="exist|FAILED_READ_FILE|PATH"):
        table.collect()
