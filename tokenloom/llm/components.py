"""Connected components of a table of links, by rounds of joins; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed

#: Links that a task of a round holds, about.
LINKS_PER_PARTITION = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of all nodes in ``links`` (``a``, ``b``: long, not null).

    Each round gives a node the smallest label around it and then that label's own label, so chains halve. Self links and repeated
    links do no harm; an empty table gives no rows. A node with very many links is a hot join key
    between plain scans, which adaptive execution splits, and its labels are pre-aggregated.
    """
    # Rounds over a table of few links need few partitions, and leave few files.
    parts = max(1, min(math.ceil(links.count() / LINKS_PER_PARTITION), links.sparkSession.sparkContext.defaultParallelism * 64))
    kept = lambda df: checkpointed(df.coalesce(parts))
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        nearer = kept(labels.join(around, labels["node"] == around["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")))
        above = nearer.select(F.col("node").alias("top"), F.col("component").alias("next"))
        jumped = kept(nearer.join(above, F.col("component") == F.col("top"), "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "before"))
        if jumped.where("component <> before").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
