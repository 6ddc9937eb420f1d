"""Points, the inverted index, and its changes.

Tables: ``points`` (``label``, ``features``, ``n``), ``point_features`` (``label``, ``feature``, ``tf``),
``stats`` (``feature``, ``freq``: occurrences, ``df``: points) and ``postings`` (``feature``, ``label``, ``occ``, ``prank``),
whose rank within the feature follows a hash, so that a first stretch of it is a fixed sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.featurizers import Empty, Featurizer, Sequence, Text
from ._store import checkpointed

#: Features of queries that are broadcast at most; beyond that a shuffled join gives the same index.
MAX_BROADCAST_FEATURES = 1_000_000


def points(sequences: DataFrame, featurizer: Featurizer, *, label: str = "word", sequence: Sequence | None = None, distinct: bool = True) -> DataFrame:
    """``label``, ``features`` (sorted bag), ``n``; rows of equal label and sequence are one point unless ``distinct`` is off. A null sequence has no features."""
    rows = sequences.distinct() if distinct else sequences
    bag = F.coalesce(featurizer.features(sequence or Text(F.col(label))), F.array().cast("array<string>"))
    return rows.select(F.col(label).alias("label"), F.array_sort(bag).alias("features")).withColumn("n", F.size("features"))


def point_features(points_: DataFrame) -> DataFrame:
    """``label``, ``feature``, ``tf``."""
    return points_.select("label", F.explode("features").alias("feature")).groupBy("label", "feature").agg(F.count(F.lit(1)).alias("tf"))


def feature_stats(tf: DataFrame) -> DataFrame:
    return tf.groupBy("feature").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df"))


def transposed_points(tf: DataFrame) -> DataFrame:
    """Features as points: ``label`` (the feature), ``features`` (the labels that have it, by occurrence), ``n``."""
    each = tf.select(F.col("feature").alias("label"), F.explode(F.array_repeat("label", F.col("tf").cast("int"))).alias("f"))
    return each.groupBy("label").agg(F.array_sort(F.collect_list("f")).alias("features"), F.count(F.lit(1)).cast("int").alias("n"))


def mapped_points(points_: DataFrame, mapping: DataFrame, *, keep_unseen: bool = False) -> DataFrame:
    """Points whose features are replaced by ``mapping`` (``feature``, ``mapped``; a feature once); others stay with ``keep_unseen`` and go without.

    For points and queries alike, so that an index is built and searched through the mapping. A point that loses all features stays.
    """
    to = F.coalesce("mapped", "feature") if keep_unseen else F.col("mapped")
    each = points_.select("label", F.explode_outer("features").alias("feature")).join(mapping.select("feature", "mapped"), "feature", "left")
    return each.groupBy("label").agg(F.array_sort(F.collect_list(to)).alias("features")).withColumn("n", F.size("features"))


def posting_order() -> Column:
    """A hash of feature, point and occurrence: the order of postings."""
    return F.md5(F.concat_ws("|", "feature", "label", F.col("occ").cast("string")).cast("binary"))


def postings(tf: DataFrame) -> DataFrame:
    occurrences = tf.select("feature", "label", F.explode(F.sequence(F.lit(1), F.col("tf").cast("int"))).alias("occ"))
    return occurrences.withColumn("prank", F.row_number().over(W.partitionBy("feature").orderBy(posting_order(), "label", "occ")))


@dataclass(frozen=True)
class FuzzyIndex:
    """Points and postings as DataFrames, with the featurizer that made them."""

    points: DataFrame
    tf: DataFrame
    stats: DataFrame
    postings: DataFrame
    featurizer: Featurizer

    @staticmethod
    def build(sequences: DataFrame, featurizer: Featurizer, *, label: str = "word", sequence: Sequence | None = None) -> FuzzyIndex:
        return FuzzyIndex.from_points(points(sequences, featurizer, label=label, sequence=sequence), featurizer)

    @staticmethod
    def from_points(points_: DataFrame, featurizer: Featurizer) -> FuzzyIndex:
        tf = point_features(points_)
        return FuzzyIndex(points_, tf, feature_stats(tf), postings(tf), featurizer)

    @staticmethod
    def for_queries(sequences: DataFrame, featurizer: Featurizer, queries: DataFrame, *, label: str = "word", sequence: Sequence | None = None) -> FuzzyIndex:
        """What ``queries`` (points) find in ``sequences`` (a label once), and nothing else: an index of the features that queries have, of points that have one.

        These features have all their occurrences and each point its ``n``, so look-ups and similarities are those of a whole index. Points carry no ``features``.
        """
        asked = checkpointed(queries.select(F.explode("features").alias("feature")).distinct())
        if asked.count() <= MAX_BROADCAST_FEATURES:
            asked = F.broadcast(asked)
        bags = sequences.select(F.col(label).alias("label"), featurizer.features(sequence or Text(F.col(label))).alias("features"))
        # A plain explode would filter by the bag's size first, with the whole sequence made again for each of its grams.
        each = bags.select("label", F.size("features").alias("n"), F.explode_outer("features").alias("feature")).join(asked, "feature", "left_semi")
        found = checkpointed(each.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n")))
        tf = found.select("label", "feature", "tf")
        return FuzzyIndex(found.select("label", "n").distinct(), tf, feature_stats(tf), postings(tf), featurizer)

    def compress(self, cutoff: int) -> FuzzyIndex:
        """Five compress steps, with cut-offs that fall by the ratio 144/89 to ``cutoff``."""
        kept = self.tf
        for c in cutoffs(cutoff):
            # A step reads what is kept twice; without a cut the plan would double each time.
            kept = checkpointed(compress_step(self.points, self.tf, kept, c))
        return FuzzyIndex(self.points, self.tf, feature_stats(kept), postings(kept), self.featurizer)

    def transpose(self) -> DataFrame:
        """Features as points: ``label`` (the feature), ``features`` (the labels that have it, by occurrence), ``df`` (occurrences)."""
        return transposed_points(self.tf).select("label", "features", F.col("n").cast("long").alias("df"))

    def transposed(self) -> FuzzyIndex:
        """An index of the features as points, whose features are the labels that have them."""
        return FuzzyIndex.from_points(transposed_points(self.tf), Empty())

    def save(self, folder: str) -> None:
        """Postings are written sorted by feature and rank, so that a look-up's filter reaches the scan."""
        self.points.write.parquet(f"{folder}/points")
        self.tf.write.parquet(f"{folder}/tf")
        self.stats.write.parquet(f"{folder}/stats")
        self.postings.repartitionByRange("feature").sortWithinPartitions("feature", "prank").write.parquet(f"{folder}/postings")

    @staticmethod
    def load(spark: SparkSession, folder: str, featurizer: Featurizer) -> FuzzyIndex:
        return FuzzyIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("points", "tf", "stats", "postings")), featurizer)


def cutoffs(cutoff: int) -> list[int]:
    """The five cut-offs, largest first: each is the next one's 144/89, rounded down."""
    out = [cutoff]
    while len(out) < 5:
        out.append(out[-1] * 144 // 89)
    return out[::-1]


def compress_step(points_: DataFrame, tf: DataFrame, kept: DataFrame, cutoff: int) -> DataFrame:
    """The kept (label, feature, tf) after points of more than ``cutoff`` occurrences lose the features whose occurrences rank beyond it by current frequency.

    A feature with an occurrence beyond the cut-off goes as a whole.
    """
    long = tf.join(points_.where(F.col("n") > cutoff).select("label"), "label", "left_semi")
    freq = kept.groupBy("feature").agg(F.sum("tf").alias("freq"))
    ranked = long.join(freq, "feature", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    upto = F.sum("tf").over(W.partitionBy("label").orderBy("freq", "feature").rowsBetween(W.unboundedPreceding, 0))
    beyond = ranked.withColumn("upto", upto).where(F.col("upto") > cutoff).select("label", "feature")
    return kept.join(beyond, ["label", "feature"], "left_anti")


def cooccurrence(tf: DataFrame) -> DataFrame:
    """``feature_a``, ``feature_b``, ``n``: ordered pairs of occurrences of different features in one point."""
    a, b = tf.select("label", F.col("feature").alias("feature_a"), F.col("tf").alias("ta")), tf.select("label", F.col("feature").alias("feature_b"), F.col("tf").alias("tb"))
    return a.join(b, "label").where("feature_a <> feature_b").groupBy("feature_a", "feature_b").agg(F.sum(F.col("ta") * F.col("tb")).alias("n"))
