"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, stored


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node in ``links`` (u, v: long), as a stored table with another
    column.

    Each round takes the least label around and then that label's own label, so long paths take few rounds; every round is
    written to the shared folder. Nothing but the number of changes comes to the driver.
    """
    both = stored(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = labels.select("node", "root").join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        now = stored(low.join(own, "low", "left").select("node", F.least("low", "next").alias("root"), "was"), "labels")
        changed = now.where("root <> was").limit(1).count()
        forget(labels)
        labels = now
        if not changed:
            forget(both)
            return labels
