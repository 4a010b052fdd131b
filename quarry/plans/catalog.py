"""Registered queries of the library and the SQL that gives the same rows.

Queries that take a graph build it from the driver's whole tables: ``events`` gives a user-to-user graph (each user's row
points to the next row's user of that day), ``pages`` a graph of titles' first words linked by ``href="/word"``, the order
tables a nation graph weighted by the cheapest line item, and ``customer`` wiki pages. Queries of sources and sinks write
files into the shared folder and read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import counting as C
from quarry.operators import grid as G
from quarry.operators import linkgraph as L
from quarry.operators import numeric as N
from quarry.operators import pagerank as R
from quarry.operators import paths as P
from quarry.session import table
from quarry.sources import binary as B
from quarry.sources import images as I
from quarry.sources import text as S
from quarry.store import fresh_path, materialise

Query = Callable[[SparkSession, str], DataFrame]
HREF = 'href="/([^"]+)"'
STEPS = 5


# -- words ----------------------------------------------------------------------------------------------------------


def first_letter_count(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_letter_count(table(spark, sf, "documents"), "text")


def first_letter_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    return first_letter_count(spark, sf).withColumn("part", C.letter_partition(F.col("ch")))


def first_letter_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return C.ranked(first_letter_count(spark, sf), *C.case_paired(F.col("ch")))


def word_average(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_average(table(spark, sf, "documents"), "text").select("key", F.round("average", 9).alias("average"))


def word_average_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return C.positions(word_average(spark, sf), F.col("average").desc(), F.col("key").asc()).withColumn("pos", F.col("pos") + 1)


def key_mod_partition(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("key")).distinct()
    return keys.select("key", C.key_modulo(F.col("key"), 3).alias("part"))


def average_range_partition(spark: SparkSession, sf: str) -> DataFrame:
    averages = C.average(table(spark, sf, "lineitem"), "l_partkey", "l_quantity")
    return averages.select("key", F.round("average", 9).alias("average"), C.range_partition(F.round("average", 9), 8, 10.0, 30.0).alias("part"))


# -- rows placed by a partitioner ---------------------------------------------------------------------------------------


def _placed(rows: DataFrame, number: Column, parts: int, order: list[Column]) -> DataFrame:
    """``file, place`` and the fields of the lines of ``rows``, written by a partitioner and read back."""
    path = fresh_path(rows.sparkSession, "placed")
    S.write_placed(rows, number, parts, path, order=order)
    read = S.read_placed(rows.sparkSession, path)
    field = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    return read.select("file", "place", *(field(k).cast(kind).alias(c) for k, (c, kind) in enumerate(rows.dtypes)))


def placed_letters(spark: SparkSession, sf: str) -> DataFrame:
    """First letters in the two files of R1, in the order A a B b ... inside each."""
    return _placed(first_letter_count(spark, sf), C.letter_partition(F.col("ch")), 2, C.case_paired(F.col("ch")))


def placed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct words in the three files of R2."""
    keys = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("key")).distinct()
    return _placed(keys, C.key_modulo(F.col("key"), 3), 3, [F.col("key").asc()])


def placed_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Average quantities of all parts in the eight files of R3, the highest first, so that files by number are one order."""
    averages = C.average(table(spark, sf, "lineitem"), "l_partkey", "l_quantity").select("key", F.round("average", 9).alias("average"))
    return _placed(averages, C.range_partition(F.col("average"), 8, 10.0, 30.0), 8, [F.col("average").desc(), F.col("key").asc()])


def placed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all users in the files of R4."""
    return _placed(pagerank_all_events_k5(spark, sf), C.rank_bucket(F.col("pr"), 32, 0.001), 32, [F.col("pr").desc(), F.col("id").asc()])


# -- pages ----------------------------------------------------------------------------------------------------------


def xml_unescape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.xml_unescape(F.col("html")).alias("body"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    body = xml_unescape(spark, sf).withColumn("whole_title", T.page_title(F.col("body"))).filter("whole_title <> ''")
    return body.select(F.col("page_id").alias("page"), F.regexp_extract("whole_title", "^[^ ]*", 0).alias("title"), "body")


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("title").distinct()


def title_count(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).agg(F.count(F.lit(1)).alias("n_pages"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.links(_pages(spark, sf), HREF).groupBy("page", "title", "link").agg(F.count(F.lit(1)).alias("n"))


def _valid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, sf)
    return pages, L.valid_links(L.links(pages, HREF), pages)


def valid_links(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf)[1].groupBy("page", "title", "link").agg(F.count(F.lit(1)).alias("n"))


def dangling_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages, valid = _valid(spark, sf)
    return L.dangling_pages(pages, valid)


def _page_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf)[1].select(F.col("title").alias("src"), F.col("link").alias("dst"))


def out_degree(spark: SparkSession, sf: str) -> DataFrame:
    return L.out_degree(_page_edges(spark, sf))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return L.adjacency(_page_edges(spark, sf)).select("src", F.array_join("links", "|").alias("links"))


def adjacency_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's targets as lines of text with bars between them, a line for each chunk, written, read back, split and
    counted."""
    lines = fresh_path(spark, "adjacency")
    chunks = L.adjacency_chunks(_page_edges(spark, sf), most=1 << 16)
    S.write_key_values(chunks.select("src", F.array_join("links", "|").alias("links")), lines, "src", "links")
    read = S.read_key_values(spark, lines).select(F.col("key").alias("src"), T.split_fields(F.col("value"), "|").alias("links"))
    return L.joined_chunks(read).select("src", F.col("degree").cast("int").alias("degree"))


def wiki_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all customers in wiki text, with links that have labels or anchors, begin in lower case, or lead nowhere."""
    key, text = F.col("c_custkey").cast("string"), []
    for part in ("&lt;title&gt;Customer-", key, "&lt;/title&gt; of [[nation ", F.col("c_nationkey").cast("string"), "]], see [[customer-",
                 (F.col("c_custkey") + 1).cast("string"), "|the next]], [[Customer-", F.floor(F.col("c_custkey") / 2).cast("string"), "#top]] &amp; [[customer-", key, "]]"):
        text.append(F.lit(part) if isinstance(part, str) else part)
    lines = table(spark, sf, "customer").select(F.concat(*text).alias("value"))
    found = L.parsed(L.titled_pages(lines))
    return found.filter("link IS NOT NULL").groupBy("title", "link").agg(F.count(F.lit(1)).alias("n"))


# -- PageRank -------------------------------------------------------------------------------------------------------


def page_graph(spark: SparkSession, sf: str) -> L.LinkGraph:
    return L.graph_of(L.parsed(_pages(spark, sf), HREF))


def all_event_graph(spark: SparkSession, sf: str) -> L.LinkGraph:
    """Every event of every user."""
    events = table(spark, sf, "events")
    edges = C.successors(events, F.to_date("ts"), F.col("user_id"), F.col("ts"), F.col("event_id"))
    return _event_graph(spark, sf, materialise(edges, "event-edges"))


def _event_graph(spark: SparkSession, sf: str, edges: DataFrame) -> L.LinkGraph:
    nodes = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    lone = nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").count()
    return L.LinkGraph(nodes, edges, nodes.count(), lone)


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", 9).alias("pr"))


def pagerank_pages_k5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.pagerank(page_graph(spark, sf), STEPS).ranks)


def pagerank_all_events_k5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.pagerank(all_event_graph(spark, sf), STEPS).ranks)


def pagerank_all_events_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return C.positions(pagerank_all_events_k5(spark, sf), F.col("pr").desc(), F.col("id").asc()).withColumn("pos", F.col("pos") + 1)


def pagerank_all_events_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return pagerank_all_events_k5(spark, sf).withColumn("bucket", C.rank_bucket(F.col("pr"), 32, 0.001))


def pagerank_all_events_error_trace(spark: SparkSession, sf: str) -> DataFrame:
    errors = R.pagerank(all_event_graph(spark, sf), STEPS).errors
    rows = spark.createDataFrame(list(enumerate(errors)), "step int, error double")
    return rows.select("step", F.round("error", 9).alias("error"))


def pagerank_all_events_converged(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.pagerank(all_event_graph(spark, sf), None).ranks)


# -- paths ----------------------------------------------------------------------------------------------------------


def all_nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier nation to customer nation of all orders, by the smallest whole price of a line item; sales within a nation
    are self loops. Spark joins the small tables by broadcast where their size allows."""
    return _cheapest(_sales(spark, sf))


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    item, order = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return (
        item.join(order, item["l_orderkey"] == order["o_orderkey"])
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _cheapest(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.min(F.floor("l_extendedprice")).cast("long").alias("weight"))


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))


def apsp_all_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.all_pairs(all_nation_edges(spark, sf), _nations(spark, sf))


def apsp_all_orders_dense(spark: SparkSession, sf: str) -> DataFrame:
    return P.dense(apsp_all_orders(spark, sf), _nations(spark, sf))


def apsp_all_orders_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return P.all_pairs_blocked(all_nation_edges(spark, sf), _nations(spark, sf), size=16).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "dist")


def user_edges(spark: SparkSession, sf: str) -> DataFrame:
    """From each user to the one of the next event of the day, for all events, weighed by the two of them."""
    steps = C.successors(table(spark, sf, "events"), F.to_date("ts"), F.col("user_id"), F.col("ts"), F.col("event_id"))
    weight = (F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(997)) + 1).cast("long").alias("weight")
    return steps.select("src", "dst", weight).distinct()


def apsp_all_events_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """All users, in blocks of 128, so that there are several pivot blocks."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return P.all_pairs_blocked(user_edges(spark, sf), users, size=128).select("i", "j", "dist")


def sssp_all_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.single_source(all_nation_edges(spark, sf), 0)


def _event_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``pos, src, dst, weight``: from each event's user to its kind's number among users, every event an edge, so edges
    repeat and some are loops."""
    return table(spark, sf, "events").select(
        F.col("event_id").cast("long").alias("pos"), F.col("user_id").cast("int").alias("src"),
        F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(USERS)).cast("int").alias("dst"),
        (F.pmod(F.col("event_id") * 31, F.lit(997)) + 1).cast("int").alias("weight"),
    )


USERS = 61


def edges_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """All event edges in eight ranges of sources, sorted by source inside each: edges and weights of each source."""
    edges = _event_edges(spark, sf)
    vertices = (edges.agg(F.max(F.greatest("src", "dst"))).head()[0] or 0) + 1
    return P.by_source(edges, vertices, 8).groupBy("part", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def edge_file_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All events as edge lists in files, read back (a wrong length is an error), of repeated edges the last, loops on the
    diagonal; shortest paths of all pairs; their matrix written in blocks of rows, raw or, if it is large, compressed file by
    file, and all its cells read back."""
    graph, matrix = fresh_path(spark, "edge-files"), fresh_path(spark, "matrix-files")
    edges = _event_edges(spark, sf)
    most = edges.agg(F.max(F.greatest("src", "dst"))).head()[0]
    vertices = 0 if most is None else most + 1
    if not vertices:
        return spark.createDataFrame([], "i int, j int, dist int")
    B.write_edge_parts(edges, graph, vertices)
    read = B.read_edge_parts(spark, graph).withColumn("pos", F.struct("first", "pos"))
    ids = spark.range(vertices).select(F.col("id").cast("int").alias("id"))
    B.write_matrix_parts(P.all_pairs_blocked(P.last_edges(read), ids), matrix, vertices, codec=B.matrix_codec(vertices))
    return B.read_matrix_parts(spark, matrix, vertices)


# -- sorting --------------------------------------------------------------------------------------------------------


def float_file_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Values of all events as files of floats, read back, sorted, written in order and read again."""
    given, done = fresh_path(spark, "float-files"), fresh_path(spark, "sorted-files")
    B.write_float_parts(table(spark, sf, "events"), given, "event_id", "value")
    B.write_float_parts(B.read_float_parts(spark, given), done, "value")
    return B.read_float_parts(spark, done).select("pos", F.col("value").cast("double").alias("value"))


def kv_text_average(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of all line items as lines of key and value, read back, parsed (what is no number is an error), averaged
    by key, sorted, merged into one file of lines and read again."""
    lines, merged = fresh_path(spark, "key-values"), fresh_path(spark, "averages")
    items = table(spark, sf, "lineitem").select(F.concat(F.lit("part "), "l_partkey").alias("key"), F.floor("l_quantity").cast("int").alias("value"))
    S.write_key_values(items, lines)
    read = S.read_key_values(spark, lines).select("key", C.whole_number(F.col("value")).alias("value"))
    S.write_merged(C.by_average(C.average(read).select("key", F.round("average", 9).alias("average"))), merged)
    return S.read_key_values(spark, merged).select("key", F.col("value").cast("double").alias("average"))


def float_sort(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select(F.col("value").cast("float").alias("value"))
    return C.positions(values, F.col("value").asc()).select("pos", F.col("value").cast("double").alias("value"))


def block_assign(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(float_sort(spark, sf), 7).select("pos", "block")


def position_diff_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Two orderings of all parts."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("value"), "p_size")
    first = C.positions(part, F.col("p_size").asc(), F.col("value").asc())
    second = C.positions(part, F.col("p_size").asc(), F.col("value").desc())
    return C.positional_difference(first.select("pos", "value"), second.select("pos", "value"))


# -- grids and numbers ----------------------------------------------------------------------------------------------

WIDTH, HEIGHT, MOST = 48, 32, 60


def mandelbrot_iters(spark: SparkSession, sf: str) -> DataFrame:
    return G.mandelbrot(G.grid(spark, WIDTH, HEIGHT, -2.0, 1.0, -1.0, 1.0), MOST)


def mandelbrot_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return G.coloured(mandelbrot_iters(spark, sf), HEIGHT, MOST)


def _image(spark: SparkSession) -> DataFrame:
    x, y = F.col("id") % WIDTH, F.floor(F.col("id") / WIDTH)
    value = lambda a, b: ((x * a + y * b + x * y) % 256).cast("int")
    return spark.range(WIDTH * HEIGHT).select(x.cast("int").alias("x"), y.cast("int").alias("y"), value(7, 3).alias("r"), value(2, 11).alias("g"), value(5, 5).alias("b"))


def image_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as pixels of an image ``WIDTH`` wide, written as PNG and as BMP, and both read back."""
    at = F.col("p_partkey")
    pixels = table(spark, sf, "part").select(
        (at % WIDTH).cast("int").alias("x"), F.floor(at / WIDTH).cast("int").alias("y"), (F.col("p_size") * 5 % 256).cast("int").alias("r"),
        (at * 3 % 256).cast("int").alias("g"), (F.floor(F.col("p_retailprice")) % 256).cast("int").alias("b"),
    )
    height = (pixels.agg(F.max("y")).head()[0] or 0) + 1
    out = None
    for kind, write in (("png", I.write_png), ("bmp", I.write_bmp)):
        path = f"{fresh_path(spark, 'images')}.{kind}"
        write(pixels, path, WIDTH, height)
        read = I.read_pixels(spark, path).select(F.lit(kind).alias("kind"), "x", "y", "r", "g", "b")
        out = read if out is None else out.unionByName(read)
    return out


def sobel_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.sobel_bands(_image(spark), WIDTH, HEIGHT, band=8)


def sobel_join(spark: SparkSession, sf: str) -> DataFrame:
    return G.sobel(_image(spark), WIDTH, HEIGHT)


def pi_riemann(spark: SparkSession, sf: str) -> DataFrame:
    return N.pi_riemann(spark, 1_000_000).select(F.round("pi", 9).alias("pi"))


def prime_count(spark: SparkSession, sf: str) -> DataFrame:
    return N.prime_count(spark, 20_000)


def primes(spark: SparkSession, sf: str) -> DataFrame:
    return N.primes(spark, 20_000, segment=4096)


def queries() -> dict[str, Query]:
    listed = [
        first_letter_count, first_letter_partitioned, first_letter_ordered, word_average, word_average_sorted, key_mod_partition,
        average_range_partition, placed_letters, placed_keys, placed_averages, placed_ranks, kv_text_average, xml_unescape, page_titles, title_count, page_links, valid_links, dangling_pages,
        out_degree, adjacency, adjacency_lines, wiki_links, pagerank_pages_k5,
        pagerank_all_events_k5, pagerank_all_events_ranked, pagerank_all_events_buckets, pagerank_all_events_error_trace, pagerank_all_events_converged,
        apsp_all_orders, apsp_all_orders_dense, apsp_all_orders_blocked, apsp_all_events_blocked, sssp_all_orders, edges_by_range, edge_file_roundtrip,
        float_sort, float_file_sort, block_assign, position_diff_whole,
        mandelbrot_iters, mandelbrot_rgb, sobel_edges, sobel_join, image_roundtrip, pi_riemann, prime_count, primes,
    ]
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    from quarry.plans import oracles

    return oracles.sql()
