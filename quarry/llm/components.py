"""Connected components of a graph held as DataFrames.

Each round every node takes the smallest label among itself and its neighbours, then the label of that label (pointer
jumping), so chains shrink by doubling. Labels are written below ``spark.checkpoint.dir`` after each round; the last two
rounds' tables stay. Hubs are
harmless: minima are taken before the shuffle, and the join on a hub is a plain join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import Rolling, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, comp`` (smallest node reachable) for every node that stands in ``links(a, b)``."""
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = materialise(both, "links")
    rolling = Rolling("labels")
    labels = rolling.step(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("comp")).withColumnRenamed("src", "node"))
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["src"]).select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("further"))
        step = step.join(jump, step["next"] == jump["at"], "left")
        step = step.select("node", "comp", F.least("next", F.coalesce("further", "next")).alias("next"))
        step = rolling.step(step)
        changed = step.filter("comp <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still changed after {rounds} rounds")
