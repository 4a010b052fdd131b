"""From page lines to a link graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import LINK, capitalised, page_links, page_title, xml_unescape
from quarry.operators.counting import positions


@dataclass
class LinkGraph:
    """``nodes(id)``; ``edges(src, dst)`` with repeats; how many pages there are and how many of them dangle."""

    nodes: DataFrame
    edges: DataFrame
    pages: int
    dangling: int


def titled_pages(lines: DataFrame, column: str = "value") -> DataFrame:
    """``page, title, body`` of the lines that hold a title."""
    body = lines.select(xml_unescape(F.col(column)).alias("body")).withColumn("title", page_title(F.col("body")))
    return body.filter("title <> ''").withColumn("page", F.monotonically_increasing_id())


def links(pages: DataFrame, pattern: str = LINK) -> DataFrame:
    """``page, title, link`` for each link of each page, repeats kept."""
    return pages.select("page", "title", F.explode(page_links(F.col("body"), pattern)).alias("link")).withColumn("link", capitalised(F.col("link")))


def valid_links(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target is a title. The title side is distinct. Spark broadcasts it below its size threshold; beyond, both
    sides are shuffled, and links that a filter of all titles does not know do not even get there."""
    titles = pages.select(F.col("title").alias("known")).distinct()
    if _shuffled(titles):
        found = maybe_known(found, titles)
    return found.join(titles, found["link"] == titles["known"], "left_semi")


def _shuffled(side: DataFrame) -> bool:
    """Whether Spark estimates a side of a join as too large for a broadcast."""
    most = side.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most


#: Fixed value: bits in a bitmap of Spark's bitmap functions.
BITMAP = 1 << 15


def _bits(title: Column, buckets: int) -> tuple[Column, Column, Column]:
    """A title's bitmap and its two bits there, from two hashes."""
    place = F.xxhash64(title, F.lit(2))
    return F.pmod(F.xxhash64(title), F.lit(buckets)), F.pmod(place, F.lit(BITMAP)), F.pmod(F.shiftright(place, 20), F.lit(BITMAP))


def title_filter(titles: DataFrame, most: int = 1 << 12) -> DataFrame:
    """``bucket, bitmap``: a Bloom filter of the column ``known``, 16 bits a title in bitmaps of 4 KB. There are ``most`` of them
    at most (16 MB), so it may be broadcast whatever the number of titles; beyond that it lets more of the others pass."""
    buckets = min(most, max(1, -(-titles.agg(F.approx_count_distinct("known")).head()[0] * 16 // BITMAP)))
    bucket, one, two = _bits(F.col("known"), buckets)
    marked = titles.select(bucket.alias("bucket"), F.explode(F.array(one, two)).alias("bit"))
    return marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).withColumn("buckets", F.lit(buckets))


def maybe_known(found: DataFrame, titles: DataFrame, most: int = 1 << 12) -> DataFrame:
    """The rows of ``found`` whose ``link`` may be in ``titles``: all that are, and few others."""
    from quarry.store import materialise

    held = materialise(title_filter(titles, most), "title-filter")
    buckets = (held.select(F.max("buckets")).head()[0]) or 1
    bucket, one, two = _bits(F.col("link"), buckets)

    def marked(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) > 0

    few = F.broadcast(held.select(F.col("bucket").alias("_bucket"), "bitmap"))
    # A link that comes out of the filter keeps Spark from putting a later semi-join before it.
    passed = F.when(marked(one) & marked(two), F.col("link")).alias("link")
    return found.join(few, bucket == F.col("_bucket")).select(*(passed if c == "link" else F.col(c) for c in found.columns)).filter("link IS NOT NULL")


def dangling_pages(pages: DataFrame, valid: DataFrame) -> DataFrame:
    """Pages, not titles, without a valid link."""
    return pages.join(valid.select("page"), "page", "left_anti").select("page", "title")


def parsed(pages: DataFrame, pattern: str = LINK) -> DataFrame:
    """``page, title, link`` of each valid link, and one row with a null link for each dangling page: the pages parsed once
    and kept as a written table, from which nodes, edges and counts are read."""
    from quarry.store import materialise

    listed = materialise(pages.select("page", "title", F.transform(page_links(F.col("body"), pattern), capitalised).alias("links")), "pages")
    valid = valid_links(listed.select("page", "title", F.explode("links").alias("link")), listed)
    lone = listed.select("page", "title").join(valid.select("page").distinct(), "page", "left_anti")
    return materialise(valid.unionByName(lone.withColumn("link", F.lit(None).cast("string"))), "links")


def graph_of(links_: DataFrame) -> LinkGraph:
    """The graph of ``parsed`` links."""
    held = links_.agg(F.count_distinct("page").alias("pages"), F.count(F.when(F.col("link").isNull(), 1)).alias("lone")).head()
    edges = links_.filter("link IS NOT NULL").select(F.col("title").alias("src"), F.col("link").alias("dst"))
    return LinkGraph(links_.select(F.col("title").alias("id")).distinct(), edges, held["pages"], held["lone"])


def out_degree(edges: DataFrame) -> DataFrame:
    """A10: repeated edges count."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """The sorted targets of each source."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("links"))


def adjacency_chunks(edges: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A4, P11 for sources of any size: ``src, chunk, links``, the sorted targets of a source in numbered pieces of ``most``, of which
    all but the last are full. Edges are sorted by ranges of source and target, so a hub is dealt over tasks too."""
    placed = positions(edges.select("src", "dst"), F.col("src").asc(), F.col("dst").asc(), name="at")
    first = placed.groupBy(F.col("src").alias("of")).agg(F.min("at").alias("least"))
    numbered = placed.join(first, F.col("src").eqNullSafe(F.col("of"))).withColumn("chunk", F.floor((F.col("at") - F.col("least")) / most).cast("int"))
    return numbered.groupBy("src", "chunk").agg(F.array_sort(F.collect_list("dst")).alias("links"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """``src, degree`` of sources whose links come in chunks."""
    return chunks.groupBy("src").agg(F.sum(F.size("links")).alias("degree"))


def graph_of_pages(lines: DataFrame, column: str = "value", pattern: str = LINK) -> LinkGraph:
    """Distinct titles are nodes, but pages are counted before titles are made distinct."""
    return graph_of(parsed(titled_pages(lines, column), pattern))
