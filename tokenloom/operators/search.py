"""Budgeted nearest-neighbour search: a DataFrame of queries in, a DataFrame of neighbours out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import Hamming, Jaccard, Metric, simhash
from .index import FuzzyIndex, point_features


@dataclass(frozen=True)
class SearchParams:
    """A query's budget: its ``depth`` rarest features, ``breadth`` postings of each, ``max_comparisons`` candidates, an end ``use_best_after`` comparisons without a better one or at a similarity over ``return_if_gt`` percent."""

    metric: Metric = Jaccard()
    depth: int = 5
    breadth: int = 20
    use_best_after: int = 20
    return_if_gt: int = 70
    max_comparisons: int = 70

    def with_metric(self, metric: Metric) -> SearchParams:
        return replace(self, metric=metric)


def selected_features(index: FuzzyIndex, query_tf: DataFrame, params: SearchParams) -> DataFrame:
    """``query_id``, ``feature``, ``w``: each query's rarest known features and their integer weights."""
    known = query_tf.select(F.col("label").alias("query_id"), "feature").join(index.stats, "feature")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("freq", "feature"))
    weight = F.expr("512 div (cast(floor(log2(freq)) as int) + 1)")
    return known.withColumn("drank", rank).where(F.col("drank") <= params.depth).select("query_id", "feature", weight.alias("w"))


def candidates(index: FuzzyIndex, queries: DataFrame, params: SearchParams) -> DataFrame:
    """``query_id``, ``label``, ``wt``, ``rk``: candidates by falling weight, at most ``max_comparisons``; ``queries`` are points."""
    chosen = selected_features(index, point_features(queries), params)
    lists = index.postings.where(F.col("prank") <= params.breadth).select("feature", "label")
    summed = chosen.join(lists, "feature").groupBy("query_id", "label").agg(F.sum("w").alias("wt"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("wt"), "label"))
    return summed.withColumn("rk", rank).where(F.col("rk") <= params.max_comparisons)


def scored(index: FuzzyIndex, queries: DataFrame, pairs: DataFrame, metric: Metric) -> DataFrame:
    """``pairs`` (``query_id``, ``label``, ...) with ``sim``; bags are compared inside the row, or by the index's occurrences where its points carry no bags."""
    if "features" not in index.points.columns:
        return _scored_by_occurrences(index, queries, pairs, metric)
    q = queries.select(F.col("label").alias("query_id"), F.col("features").alias("fq"), F.col("n").alias("nq"))
    p = index.points.select("label", F.col("features").alias("fp"), F.col("n").alias("np"))
    if isinstance(metric, Hamming):
        q, p = q.select("query_id", simhash(F.col("fq")).alias("hq")), p.select("label", simhash(F.col("fp")).alias("hp"))
        both = pairs.join(q, "query_id").join(p, "label")
    else:
        # Shared occurrences: what is left of a bag once the other's is taken from it is counted by array_except on numbered features.
        numbered = lambda f: F.transform(f, lambda x, i: F.concat(x, F.lit("\x02"), (i - F.array_position(f, x)).cast("string")))
        q, p = q.withColumn("fq", numbered(F.col("fq"))), p.withColumn("fp", numbered(F.col("fp")))
        both = pairs.join(q, "query_id").join(p, "label").withColumn("common", F.size(F.array_intersect("fq", "fp")))
    return both.withColumn("sim", metric.sim()).select(*pairs.columns, "sim")


def _scored_by_occurrences(index: FuzzyIndex, queries: DataFrame, pairs: DataFrame, metric: Metric) -> DataFrame:
    if isinstance(metric, Hamming):
        raise ValueError("signatures need whole bags")
    asked = point_features(queries).select(F.col("label").alias("query_id"), "feature", F.col("tf").alias("tq"))
    met = pairs.select("query_id", "label").join(asked, "query_id").join(index.tf, ["label", "feature"])
    common = met.groupBy("query_id", "label").agg(F.sum(F.least("tq", "tf")).alias("common"))
    sizes = pairs.join(queries.select(F.col("label").alias("query_id"), F.col("n").alias("nq")), "query_id").join(index.points.select("label", F.col("n").alias("np")), "label")
    both = sizes.join(common, ["query_id", "label"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return both.withColumn("sim", metric.sim()).select(*pairs.columns, "sim")


def stopped(ranked: DataFrame, params: SearchParams) -> DataFrame:
    """The candidates that a sequential comparison would reach before a stop rule ends it."""
    before = W.partitionBy("query_id").orderBy("rk").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("query_id").orderBy("rk").rowsBetween(W.unboundedPreceding, 0)
    a = ranked.withColumn("pm", F.max("sim").over(before))
    b = a.withColumn("imp", F.when((F.col("rk") > 1) & (F.col("sim") > F.col("pm")), F.col("rk")))
    over = F.when(F.col("sim") > params.return_if_gt / 100, 1).otherwise(0)
    d = b.withColumn("lr", F.coalesce(F.max("imp").over(before), F.lit(0))).withColumn("done", F.coalesce(F.max(over).over(before), F.lit(0)))
    end = (F.col("rk") - F.col("lr") > params.use_best_after) | (F.col("done") == 1) | (F.col("rk") > params.max_comparisons)
    return d.withColumn("st", F.max(F.when(end, 1).otherwise(0)).over(upto)).where("st = 0").select(*ranked.columns)


def neighbors(index: FuzzyIndex, queries: DataFrame, params: SearchParams, *, exclude_self: bool = False) -> DataFrame:
    """``query_id``, ``rk``, ``label``, ``sim``: every candidate that was compared."""
    found = candidates(index, queries, params)
    if exclude_self:
        found = found.where("query_id <> label")
    return stopped(scored(index, queries, found.select("query_id", "label", "rk"), params.metric), params).select("query_id", "rk", "label", "sim")


def best(found: DataFrame) -> DataFrame:
    """``query_id``, ``label``, ``sim``: the most similar neighbour, the first of equals."""
    return found.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("rk")).alias("r"), "label")).alias("b")).select("query_id", "b.label", "b.sim")


def nearest(index: FuzzyIndex, queries: DataFrame, params: SearchParams) -> DataFrame:
    """A row for each query: ``query_id``, ``label``, ``sim``; null label and similarity 0 without a neighbour."""
    found = best(neighbors(index, queries, params))
    return queries.select(F.col("label").alias("query_id")).join(found, "query_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def statistics(index: FuzzyIndex, queries: DataFrame, params: SearchParams) -> DataFrame:
    """One row: calls, and averages of input features, distinct ones, candidate postings and candidates."""
    chosen = selected_features(index, point_features(queries), params)
    lists = index.postings.where(F.col("prank") <= params.breadth).select("feature", "label")
    per = chosen.join(lists, "feature").groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("label").alias("uniq"))
    rows = queries.select(F.col("label").alias("query_id"), "n", F.size(F.array_distinct("features")).alias("nu")).join(per, "query_id", "left")
    mean = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("called"), mean("n").alias("input_features"), mean("nu").alias("input_features_unique"), mean("total").alias("nbrs_total"), mean("uniq").alias("nbrs_unique"))
