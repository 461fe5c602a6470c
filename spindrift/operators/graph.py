"""Connected components by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, remove


def connected_components(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node and component (the least node reachable) of every linked node.

    Each round a node takes the least label of itself and its neighbours, then the label
    of that label, so the way to the least node halves at least. Rounds are written out;
    the driver sees only whether a label changed. Self-links are ignored.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = label.select(F.col("a").alias("l"), F.col("l").alias("j"))
        new = materialise(low.join(jump, "l", "left").select("a", "old", F.least("l", F.coalesce("j", "l")).alias("l")), "labels")
        changed = new.where("l <> old").limit(1).count()
        remove(label)
        label = new
        if not changed:
            remove(both)
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))
