"""Keyed counts and averages, their orders and their partition assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import first_char, starts_with_letter, tokens


def first_letter_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """A1 over P1 to P3: ``ch, n`` of the first letters of all tokens that start with a letter."""
    words = lines.select(F.explode(tokens(F.col(column))).alias("word")).filter(starts_with_letter(F.col("word")))
    return words.groupBy(first_char(F.col("word")).alias("ch")).agg(F.count(F.lit(1)).alias("n"))


def letter_partition(ch: Column) -> Column:
    """``a`` to ``g`` in either case go to 0, everything else to 1."""
    return F.when(F.lower(ch).between("a", "g"), 0).otherwise(1)


def case_paired(ch: Column) -> list[Column]:
    """O2: order A a B b ..."""
    return [F.lower(ch).asc(), ch.asc()]


def average(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A2: ``key, average``; sums and counts are merged before the shuffle."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.avg(value).alias("average"))


def whole_number(text: Column) -> Column:
    """P5: the 32-bit number that a text of digits with an optional sign says. Any other text is an error, null too."""
    wrong = F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(text, F.lit("null")))).cast("int")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.cast("int")).otherwise(wrong)


def token_average(lines: DataFrame, column: str = "value") -> DataFrame:
    """A2 over P1: ``key, average``, how often a token stands in the lines that hold it. That is all its places over all
    its lines, so two counts are added by token, before and after one shuffle, and no pair of line and token is shuffled."""
    words = tokens(F.col(column))
    places = lines.select(F.explode(words).alias("key"), F.lit(1).alias("n"), F.lit(0).alias("held"))
    held = lines.select(F.explode(F.array_distinct(words)).alias("key"), F.lit(0).alias("n"), F.lit(1).alias("held"))
    sums = places.unionByName(held).groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return sums.select("key", (F.col("n").cast("double") / F.col("held")).alias("average"))


def successors(rows: DataFrame, group: Column, value: Column, *order: Column) -> DataFrame:
    """``src, dst``: each row's ``value`` and that of the next row in the order, within ``group``, which leads the order.
    Rows are range-partitioned, so no group is held in one task; of each part the first row goes to the part before it."""
    from quarry.store import materialise

    spark = rows.sparkSession
    placed = rows.select(group.alias("g"), value.alias("src"), *[c.alias(f"o{k}") for k, c in enumerate(order)])
    placed = placed.orderBy("g", *[f"o{k}" for k in range(len(order))]).select("g", "src", F.monotonically_increasing_id().alias("at"))
    placed = materialise(placed, "successors").withColumn("part", F.shiftright("at", 33))
    firsts = placed.groupBy("part").agg(F.min_by(F.struct("g", "src"), "at").alias("first")).orderBy("part").collect()  # one a part
    kinds = ", ".join(f"{n} {placed.schema[c].dataType.simpleString()}" for n, c in (("next_g", "g"), ("next_src", "src")))
    follows = [(a["part"], b["first"]["g"], b["first"]["src"]) for a, b in zip(firsts, firsts[1:], strict=False)]
    border = F.broadcast(spark.createDataFrame(follows, f"part long, {kinds}"))
    inside = Window.partitionBy("part").orderBy("at")
    held = placed.select("part", "g", "src", F.lead(F.struct("g", "src")).over(inside).alias("next")).join(border, "part", "left")
    after = F.coalesce("next", F.struct(F.col("next_g").alias("g"), F.col("next_src").alias("src")))
    return held.select("g", "src", after.alias("after")).filter(F.col("g").eqNullSafe(F.col("after.g")) & F.col("after.src").isNotNull()).select("src", F.col("after.src").alias("dst"))


def by_average(rows: DataFrame) -> DataFrame:
    """O1: average descending, key ascending, as a range-partitioned global sort."""
    return rows.orderBy(F.col("average").desc(), F.col("key").asc())


def key_modulo(key: Column, n: int) -> Column:
    """R2: code of the first character modulo ``n``; an empty key is an error, as it has no first character."""
    checked = F.when(F.length(key) > 0, F.ascii(key)).otherwise(F.raise_error(F.lit("empty key")).cast("int"))
    return checked % n


def range_partition(avg: Column, n: int, low: float = 9.0, width: float = 2.05) -> Column:
    """Equal ranges of the average, the highest first; values outside go to the nearest range, NaN to the last."""
    step = ((avg - low) / (width / n)).cast("double")
    inside = F.least(F.greatest(n - F.when(step < 0, F.ceil(step)).otherwise(F.floor(step)) - 1, F.lit(0)), F.lit(n - 1))
    return F.when(F.isnan(avg), n - 1).otherwise(inside).cast("int")


def rank_bucket(rank: Column, buckets: int = 32, width: float = 0.5) -> Column:
    """Buckets of ``width``, ascending; negative and large ranks go to the last."""
    return F.when((rank < 0) | (rank >= width * (buckets - 1)), buckets - 1).otherwise(F.floor(rank / width)).cast("int")


def positions(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``rows`` with their position (from 0) in the order: a range-partitioned sort, counts of its partitions, and an
    offset for each. No task sees all rows; the driver sees one count for each partition."""
    spark = rows.sparkSession
    from quarry.store import materialise

    placed = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed, "positions").withColumn("_part", F.shiftright("_id", 33))
    counts, before, at = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}, [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_id", "_before")


def blocks(placed: DataFrame, parts: int, pos: str = "pos", total: int | None = None) -> DataFrame:
    """Contiguous blocks of positions, the first ``total % parts`` of which have one row more."""
    n = placed.count() if total is None else total
    small, extra = divmod(n, parts)
    at = F.col(pos)
    early = F.floor(at / (small + 1))
    late = extra + F.floor((at - extra * (small + 1)) / max(small, 1))
    return placed.withColumn("block", F.when(at < extra * (small + 1), early).otherwise(late).cast("int"))


def ranked(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Positions (from 1) of a small result by one window; ``positions`` is for large ones."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def positional_difference(left: DataFrame, right: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """``pos, left_value, right_value`` wherever two sequences differ, including positions only one of them has."""
    a = left.select(F.col(pos), F.col(value).alias("left_value"))
    b = right.select(F.col(pos), F.col(value).alias("right_value"))
    return a.join(b, pos, "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
