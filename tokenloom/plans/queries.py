"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.featurizers import DEFAULT, BookEnds, Custom, Empty, Featurizer, FourGrams, Mapped, SkipScheme, Text, Tokens, filter_map, ngram, skipgram
from ..functions.metrics import Hamming, Jaccard, Overlap, simhash
from ..functions.text import induce_typo, normalized
from ..operators import cluster, evaluate
from ..operators._store import checkpointed
from ..operators.index import FuzzyIndex, compress_step, cooccurrence, mapped_points, point_features, points
from ..operators.lexicon import Lexicon
from ..operators.search import SearchParams, candidates, nearest, scored, statistics
from ..sources import document_words, shingle_tokens, tokens, with_reversed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Of the lexicon look-ups: the reference's second configuration.
PARAMS = SearchParams()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_words(table(spark, sf_dir, "documents"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()


def shown(features: Column) -> Column:
    return F.array_join(F.array_sort(features), " ")


@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalized(F.col("text")).cast("binary")).alias("digest"))


@query
def lexicon_upper_distinct(spark, sf_dir):
    return words(spark, sf_dir)


@query
def induced_typos(spark, sf_dir):
    return words(spark, sf_dir).select("word", induce_typo(F.col("word")).alias("typo"))


@query
def reverse_union(spark, sf_dir):
    return with_reversed(words(spark, sf_dir))


FEATURIZERS: dict[str, Featurizer] = {
    "ngram2": ngram(2), "ngram3": ngram(3), "skipgram_2_0_3_2": skipgram(2, (0, 3), 2), "skip_scheme_ranges": SkipScheme((0, 2), (0, 2), (1, 2)),
    "book_ends_4_4": BookEnds(4, 4, ngram(2)), "default_features": DEFAULT, "default_ascii": FourGrams(), "empty_featurizer": Empty(),
    "custom_featurizer": Custom(lambda s: F.array(s.cut(F.lit(0), 1))),
}


def _featurized(name: str) -> None:
    def run(spark, sf_dir):
        return words(spark, sf_dir).select("word", shown(FEATURIZERS[name].features(Text(F.col("word")))).alias("features"))

    QUERIES[name] = run


for _name in FEATURIZERS:
    _featurized(_name)


def shingles(spark, sf_dir, name, key):
    docs = table(spark, sf_dir, name).select(F.col(key).alias("label"), shingle_tokens(F.col("text")).alias("tokens"))
    return points(docs, ngram(3), label="label", sequence=Tokens(F.col("tokens")), distinct=False)


@query
def word_shingles3(spark, sf_dir):
    return shingles(spark, sf_dir, "documents", "doc_id").select(F.col("label").alias("doc_id"), "n", F.md5(F.array_join("features", "|").cast("binary")).alias("digest"))


def index(spark, sf_dir, source=words, featurizer: Featurizer = DEFAULT) -> FuzzyIndex:
    """An index whose points and occurrences are kept, as several of its tables come from them."""
    made = points(source(spark, sf_dir), featurizer).persist()
    return FuzzyIndex.from_points(made, featurizer)


def typos(spark, sf_dir, featurizer: Featurizer = DEFAULT) -> DataFrame:
    return points(words(spark, sf_dir).select(induce_typo(F.col("word")).alias("word")), featurizer).persist()


def _bigrams(spark, sf_dir, source=words) -> DataFrame:
    return point_features(points(source(spark, sf_dir), ngram(2)))


def mapping(tf: DataFrame) -> DataFrame:
    """Features that begin with a vowel go to ``V``."""
    return filter_map(tf, vowels)


def vowels(feature: Column) -> Column:
    return F.when(feature.rlike("^[AEIOU]"), F.lit("V"))


MAPPED = Mapped(DEFAULT, vowels, keep_unseen=True)


@query
def mapped_keep(spark, sf_dir):
    tf = _bigrams(spark, sf_dir)
    return cluster.remap(tf, mapping(tf), keep_unseen=True)


@query
def mapped_drop(spark, sf_dir):
    tf = _bigrams(spark, sf_dir)
    return cluster.remap(tf, mapping(tf), keep_unseen=False)


@query
def filtermap(spark, sf_dir):
    return mapping(_bigrams(spark, sf_dir))


@query
def featurize_set(spark, sf_dir):
    return words(spark, sf_dir).select("word", shown(F.array_distinct(ngram(2).features(Text(F.col("word"))))).alias("features"))


@query
def featurize_counts(spark, sf_dir):
    return _bigrams(spark, sf_dir)


@query
def featurize_x2(spark, sf_dir):
    bag = ngram(2).features(Text(F.col("word")))
    return words(spark, sf_dir).select("word", F.size(bag).cast("long").alias("n"), shown(F.array_distinct(bag)).alias("features"))


@query
def document_tokens(spark, sf_dir):
    found = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ").cast("binary")).alias("digest"))


@query
def featurize_x3(spark, sf_dir):
    bag = DEFAULT.features(Text(F.col("word")))
    return words(spark, sf_dir).select("word", F.size(bag).cast("long").alias("n"), shown(F.array_distinct(bag)).alias("features"), F.array_max(bag).alias("last"))


@query
def point_sizes(spark, sf_dir):
    return index(spark, sf_dir).points.select("label", F.col("n").cast("long").alias("n"))


@query
def simhash60(spark, sf_dir):
    return index(spark, sf_dir, featurizer=ngram(2)).points.select("label", simhash(F.col("features")).alias("simhash"))


def _part_pairs(spark, sf_dir, metric) -> DataFrame:
    parts = index(spark, sf_dir, part_names, ngram(2))
    a, b = (parts.tf.select("feature", F.col("label").alias(n)) for n in ("query_id", "label"))
    pairs = a.join(b, "feature").where("query_id <> label").select("query_id", "label").distinct()
    return scored(parts, parts.points, pairs, metric)


@query
def jaccard_pairs(spark, sf_dir):
    return _part_pairs(spark, sf_dir, Jaccard())


@query
def overlap_pairs(spark, sf_dir):
    return _part_pairs(spark, sf_dir, Overlap())


@query
def hamming_pairs(spark, sf_dir):
    return _part_pairs(spark, sf_dir, Hamming())


@query
def overlap_idf_pairs(spark, sf_dir):
    return cluster.overlap_idf(_bigrams(spark, sf_dir, part_names))


@query
def levenshtein_pairs(spark, sf_dir):
    return words(spark, sf_dir).select("word", F.levenshtein("word", induce_typo(F.col("word"))).cast("long").alias("edits"))


@query
def index_feature_stats(spark, sf_dir):
    return index(spark, sf_dir).stats


@query
def index_postings_ranked(spark, sf_dir):
    return index(spark, sf_dir, featurizer=ngram(2)).postings.select("feature", "label", F.col("occ").cast("long").alias("occ"), F.col("prank").cast("long").alias("prank"))


@query
def compressed_step(spark, sf_dir):
    made = index(spark, sf_dir, featurizer=ngram(2))
    return compress_step(made.points, made.tf, made.tf, 6)


@query
def compressed_index(spark, sf_dir):
    return index(spark, sf_dir, featurizer=ngram(2)).compress(3).stats


def lookup(words_: DataFrame, params: SearchParams = PARAMS, featurizer: Featurizer = DEFAULT) -> Lexicon:
    """A search of the words for the typos of all."""
    return Lexicon(words_, words_.select(induce_typo(F.col("word")).alias("word")).distinct(), featurizer, params)


@query
def candidates_weighted(spark, sf_dir):
    return candidates(index(spark, sf_dir), typos(spark, sf_dir), PARAMS).select("query_id", "label", "wt", F.col("rk").cast("long").alias("rk"))


@query
def neighbors_budgeted(spark, sf_dir):
    return lookup(checkpointed(words(spark, sf_dir))).neighbors().select("query_id", F.col("rk").cast("long").alias("rk"), "label", "sim")


@query
def nearest_jaccard(spark, sf_dir):
    return lookup(checkpointed(words(spark, sf_dir))).nearest()


@query
def nearest_overlap(spark, sf_dir):
    return lookup(checkpointed(words(spark, sf_dir)), PARAMS.with_metric(Overlap())).nearest()


@query
def nearest_hamming(spark, sf_dir):
    return lookup(checkpointed(words(spark, sf_dir)), PARAMS.with_metric(Hamming())).nearest()


@query
def search_stats(spark, sf_dir):
    return statistics(index(spark, sf_dir), typos(spark, sf_dir), PARAMS)


@query
def feature_cooccurrence(spark, sf_dir):
    return cooccurrence(_bigrams(spark, sf_dir))


@query
def transpose_df(spark, sf_dir):
    return index(spark, sf_dir, part_names, ngram(2)).transpose().select("label", F.array_join("features", "|").alias("features"), "df")


@query
def cluster_a(spark, sf_dir):
    return cluster.cluster_rows(_bigrams(spark, sf_dir, part_names), 0.5, 2)


@query
def cluster_b(spark, sf_dir):
    return cluster.cluster_points(_bigrams(spark, sf_dir, part_names), 0.2)


@query
def cluster_remap(spark, sf_dir):
    tf = _bigrams(spark, sf_dir, part_names)
    return cluster.remap(tf, cluster.cluster_points(tf, 0.2), keep_unseen=True)


@query
def cluster_b_budgeted(spark, sf_dir):
    return cluster.cluster_points(_bigrams(spark, sf_dir, part_names), 0.2, PARAMS)


@query
def clustered_points(spark, sf_dir):
    """Part names through the clusters of their features."""
    made = points(part_names(spark, sf_dir), ngram(2))
    return mapped_points(made, cluster.cluster_points(point_features(made), 0.2)).select("label", F.array_join("features", "|").alias("features"), F.col("n").cast("long").alias("n"))


@query
def nearest_mapped(spark, sf_dir):
    """Typos' nearest words in an index that is built and searched through a mapped featurizer."""
    return lookup(checkpointed(words(spark, sf_dir)), featurizer=MAPPED).nearest()


@query
def comparisons_average(spark, sf_dir):
    return lookup(checkpointed(words(spark, sf_dir))).comparisons()


def items_and_index(spark, sf_dir) -> tuple[FuzzyIndex, DataFrame]:
    """Benchmark items as points, and an index of what they find in the documents."""
    items = checkpointed(shingles(spark, sf_dir, "benchmark", "item_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), shingle_tokens(F.col("text")).alias("tokens"))
    return FuzzyIndex.for_queries(docs, ngram(3), items, label="label", sequence=Tokens(F.col("tokens"))), items


@query
def benchmark_lookup(spark, sf_dir):
    """Each benchmark item's nearest document by word shingles."""
    return nearest(*items_and_index(spark, sf_dir), PARAMS.with_metric(Overlap()))


@query
def accuracy_report(spark, sf_dir):
    known = checkpointed(words(spark, sf_dir))
    return evaluate.accuracy(evaluate.typo_pairs(known), lookup(known).nearest())


@query
def brute_force_nearest(spark, sf_dir):
    """Each benchmark item's best document of all that share a shingle."""
    return evaluate.exact_nearest(*items_and_index(spark, sf_dir), PARAMS)
