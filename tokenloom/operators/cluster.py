"""Clustering of features by the points, or the features, that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.featurizers import Empty
from ..functions.metrics import OverlapIdf
from ._store import checkpointed
from .index import FuzzyIndex, cooccurrence, transposed_points
from .search import SearchParams, best, neighbors


def _threshold(cutoff: float, mean: Column) -> Column:
    """The least score that counts, over the logarithm of the mean size; null, so that none counts, where the mean is 1 or missing."""
    return F.lit(cutoff) / F.nullif(F.ln(mean), F.lit(0.0))


def cluster_rows(tf: DataFrame, cutoff: float, epochs: int = 1) -> DataFrame:
    """``feature``, ``mapped``: features joined to the one whose co-occurrences overlap theirs best.

    ``mapped`` co-occurs with the feature and has a row at least as long; a score is the overlap of both rows over the logarithm of
    the longer one's length, and counts from the last epoch's threshold on. Scores do not change between epochs, so one pass decides.
    """
    if not 0 <= cutoff <= 1:
        raise ValueError("cutoff must be in [0, 1]")
    if epochs < 1:
        raise ValueError("epochs must be 1 or more")
    edges = checkpointed(cooccurrence(tf))
    sizes = edges.groupBy("feature_a").agg(F.sum("n").alias("size"))
    x, y = (edges.select(F.col("feature_a").alias(f"f{k}"), F.col("feature_b").alias("shared"), F.col("n").alias(f"n{k}")) for k in "ab")
    # Only features that co-occur are paired, and these meet in what both share: a common feature makes no pairs of its own.
    together = edges.select(F.col("feature_a").alias("fa"), F.col("feature_b").alias("fb"))
    common = together.join(x, "fa").join(y, ["fb", "shared"]).groupBy("fa", "fb").agg(F.sum(F.least("na", "nb")).alias("c"))
    sa, sb = (sizes.select(F.col("feature_a").alias(f"f{k}"), F.col("size").alias(f"s{k}")) for k in "ab")
    scored = common.join(sa, "fa").join(sb, "fb").where("sb >= sa and sb > 1").withColumn("score", F.col("c") / F.least("sa", "sb") / F.ln("sb"))
    mean = sizes.agg((F.sum("size") / F.count(F.lit(1))).alias("mean"))
    last = 1.0 - (1.0 - cutoff) / epochs * (epochs - 1)
    least = mean.select(_threshold(last, F.col("mean")).alias("least"))
    first = scored.join(F.broadcast(least), F.col("score") >= F.col("least")).groupBy("fa").agg(F.max("score").alias("top"))
    return scored.join(first.withColumnRenamed("fa", "f"), (F.col("fa") == F.col("f")) & (F.col("score") == F.col("top"))).groupBy(F.col("fa").alias("feature")).agg(F.min("fb").alias("mapped"))


def overlap_idf(tf: DataFrame) -> DataFrame:
    """``feature``, ``other``, ``sim``: overlap of two features' points over the logarithm of the more frequent one's occurrences, for features and strictly more frequent ones that share a point."""
    stats = tf.groupBy("feature").agg(F.sum("tf").alias("df"))
    x, y = (tf.select("label", F.col("feature").alias(f"f{k}"), F.col("tf").alias(f"t{k}")) for k in "ab")
    common = x.join(y, "label").where("fa <> fb").groupBy("fa", "fb").agg(F.sum(F.least("ta", "tb")).alias("c"))
    sa, sb = (stats.select(F.col("feature").alias(f"f{k}"), F.col("df").alias(f"d{k}")) for k in "ab")
    both = common.join(sa, "fa").join(sb, "fb").where("da < db")
    return both.select(F.col("fa").alias("feature"), F.col("fb").alias("other"), (F.col("c") / F.least("da", "db") / F.ln(F.greatest("da", "db"))).alias("sim"))


def roots(parents: DataFrame) -> DataFrame:
    """``feature``, ``mapped``: the root of each feature in ``parents`` (``feature``, ``parent``; roots are their own), by pointer jumping."""
    current = checkpointed(parents.select("feature", F.col("parent").alias("mapped")))
    while True:
        above = current.select(F.col("feature").alias("at"), F.col("mapped").alias("next"))
        jumped = checkpointed(current.join(above, F.col("mapped") == F.col("at")).select("feature", F.col("next").alias("mapped"), (F.col("next") != F.col("mapped")).alias("moved")))
        current = jumped.select("feature", "mapped")
        if jumped.where("moved").isEmpty():
            return current


def cluster_points(tf: DataFrame, cutoff: float, params: SearchParams | None = None) -> DataFrame:
    """``feature``, ``mapped`` for all features: each joins its nearest more frequent one, by ``overlap_idf``, from a threshold on, and that one's root.

    The nearest is the best of all, or with ``params`` the best that a budgeted search of the features' index finds. Where each feature occurs once, none joins
    another; an empty table gives no rows.
    """
    stats = tf.groupBy("feature").agg(F.sum("tf").alias("df"))
    least = F.broadcast(stats.agg(_threshold(cutoff, F.sum("df") / F.count(F.lit(1))).alias("least")))
    if params is None:
        scored = overlap_idf(tf).join(least, F.col("sim") >= F.col("least"))
        top = scored.groupBy(F.col("feature").alias("f")).agg(F.max("sim").alias("top"))
        chosen = scored.join(top, (F.col("feature") == F.col("f")) & (F.col("sim") == F.col("top"))).groupBy("feature").agg(F.min("other").alias("parent"))
    else:
        index = FuzzyIndex.from_points(checkpointed(transposed_points(tf)), Empty())
        found = best(neighbors(index, index.points, params.with_metric(OverlapIdf())))
        chosen = found.join(least, F.col("sim") >= F.col("least")).where("sim > 0").select(F.col("query_id").alias("feature"), F.col("label").alias("parent"))
    return roots(stats.select("feature").join(chosen, "feature", "left").select("feature", F.coalesce("parent", "feature").alias("parent")))


def remap(tf: DataFrame, mapping: DataFrame, *, keep_unseen: bool) -> DataFrame:
    """``label``, ``feature``, ``tf`` with features replaced by ``mapping`` (``feature``, ``mapped``); others stay with ``keep_unseen`` and go without."""
    joined = tf.join(mapping, "feature", "left" if keep_unseen else "inner")
    return joined.groupBy("label", F.coalesce("mapped", "feature").alias("feature")).agg(F.sum("tf").alias("tf"))
