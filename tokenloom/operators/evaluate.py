"""Evaluation of search: typo correction, exact search, and locality-sensitive hashing to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import induce_typo, normalized
from .index import FuzzyIndex, point_features
from .search import SearchParams, neighbors, scored


def typo_pairs(words: DataFrame) -> DataFrame:
    """``correct``, ``typo``."""
    return words.select(F.col("word").alias("correct"), induce_typo(F.col("word")).alias("typo"))


def accuracy(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: pairs, right ones, accuracy, and wrong ones that are more, or less, like the typo than the right word is; ``found``: ``query_id``, ``label``.

    A guess no farther from the right word, in edits, than the typo is counts as right.
    """
    rows = pairs.join(found.select(F.col("query_id").alias("typo"), F.coalesce("label", F.lit("")).alias("guess")), "typo", "left")
    near = lambda a, b: F.levenshtein(normalized(F.col(a)), normalized(F.col(b)))
    wrong = F.col("guess") != F.col("correct")
    forgiven = wrong & (near("correct", "typo") >= near("correct", "guess"))
    by_similarity = wrong & ~forgiven & (near("typo", "guess") < near("typo", "correct"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = rows.agg(F.count(F.lit(1)).alias("pairs"), count(~wrong | forgiven).alias("right"), count(by_similarity).alias("similarity_errors"), count(wrong & ~forgiven & ~by_similarity).alias("lookup_errors"))
    return one.withColumn("accuracy", F.col("right") / F.col("pairs"))


def comparisons_per_lookup(index: FuzzyIndex, queries: DataFrame, params: SearchParams) -> DataFrame:
    """One row: the average number of candidates that were compared."""
    return neighbors(index, queries, params).agg((F.count(F.lit(1)) / F.countDistinct("query_id")).alias("comparisons"))


def exact_nearest(index: FuzzyIndex, queries: DataFrame, params: SearchParams) -> DataFrame:
    """``query_id``, ``label``, ``sim``: the best of all points that share a feature with the query, least label first; the standard for recall."""
    q = point_features(queries).select(F.col("label").alias("query_id"), "feature", F.col("tf").alias("tq"))
    pairs = q.join(index.tf, "feature").groupBy("query_id", "label").agg(F.sum(F.least("tq", "tf")).alias("common"))
    sizes = pairs.join(queries.select(F.col("label").alias("query_id"), F.col("n").alias("nq")), "query_id").join(index.points.select("label", F.col("n").alias("np")), "label")
    sims = sizes.withColumn("sim", params.metric.sim())
    top = sims.groupBy(F.col("query_id").alias("q")).agg(F.max("sim").alias("top"))
    return sims.join(top, (F.col("query_id") == F.col("q")) & (F.col("sim") == F.col("top"))).groupBy("query_id").agg(F.min("label").alias("label"), F.max("sim").alias("sim"))


def lsh_nearest(index: FuzzyIndex, queries: DataFrame, *, tables: int = 5, least: float = 0.3) -> DataFrame:
    """``query_id``, ``label``, ``sim``: approximate neighbours by Spark's MinHash LSH on feature sets, re-ranked by Jaccard."""
    from pyspark.ml.feature import CountVectorizer, MinHashLSH

    named = lambda df: df.where(F.size("features") > 0).select("label", "features")
    vectors = CountVectorizer(inputCol="features", outputCol="vector", binary=True, vocabSize=max(1, index.stats.count())).fit(named(index.points))
    base = vectors.transform(named(index.points))
    # Queries without a known feature have no neighbours, and no vector that can be hashed.
    known = queries.select(F.col("label").alias("known"), F.explode("features").alias("feature")).join(index.stats, "feature").select("known").distinct()
    asked = vectors.transform(named(queries).join(known, F.col("label") == F.col("known"), "left_semi"))
    model = MinHashLSH(inputCol="vector", outputCol="hashes", numHashTables=tables, seed=1).fit(base)
    pairs = model.approxSimilarityJoin(asked, base, 1 - least, "d").select(F.col("datasetA.label").alias("query_id"), F.col("datasetB.label").alias("label")).withColumn("rk", F.lit(0))
    return scored(index, queries, pairs, SearchParams().metric).groupBy("query_id").agg(F.max(F.struct("sim", "label")).alias("b")).select("query_id", "b.label", "b.sim")
