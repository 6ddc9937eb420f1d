import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.featurizers import DEFAULT, BookEnds, FourGrams, Mapped, SkipScheme, ngram
from tokenloom.functions.metrics import Hamming, Jaccard, Overlap
from tokenloom.functions.text import induce_typo
from tokenloom.operators import lexicon
from tokenloom.operators.evaluate import comparisons_per_lookup
from tokenloom.operators.index import FuzzyIndex, points
from tokenloom.operators.lexicon import Lexicon
from tokenloom.operators.search import SearchParams, nearest, neighbors
from tokenloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def vowels(f):
    return F.when(f.rlike("^[AEIOU]"), F.lit("V"))


@pytest.fixture(scope="module")
def known(spark):
    rng = random.Random(5)
    made = {"".join(rng.choices("ABCE", k=rng.randrange(1, 12))) for _ in range(400)} | {"", "Z", "AAAAAAAAAAAA", "ABABABABABAB", "A" * 300}
    return words(spark, sorted(made)).persist()


@pytest.mark.parametrize(
    ("featurizer", "params"),
    [
        (DEFAULT, SearchParams()),
        (DEFAULT, SearchParams(Overlap(), depth=3, breadth=7, use_best_after=4, return_if_gt=60, max_comparisons=9)),
        (DEFAULT, SearchParams(Hamming(), use_best_after=3)),
        (ngram(2), SearchParams(Jaccard(), depth=20, breadth=40, use_best_after=50, return_if_gt=101)),
        (SkipScheme((0, 2), (0, 2), (1, 2)) + BookEnds(3, 3, ngram(2), tagged=False), SearchParams()),
        (Mapped(DEFAULT, vowels, keep_unseen=True), SearchParams(use_best_after=1)),
        (Mapped(DEFAULT, vowels), SearchParams()),
    ],
)
def test_arrays_and_tables_find_alike(spark, known, featurizer, params):
    asked = known.select(induce_typo(F.col("word")).alias("word")).distinct()
    index, queries = FuzzyIndex.build(known, featurizer), points(asked, featurizer)
    made = Lexicon(known, asked, featurizer, params)
    assert made.fits
    found = sorted(made.neighbors().collect())
    assert found == sorted(neighbors(index, queries, params).collect()) and len(found) > 20
    assert sorted(map(str, made.nearest().collect())) == sorted(map(str, nearest(index, queries, params).collect()))
    assert made.comparisons().collect() == comparisons_per_lookup(index, queries, params).collect()


def test_few_postings_below_the_limit_are_made_good(spark, known, monkeypatch):
    params = SearchParams(breadth=40)
    asked = known.select(induce_typo(F.col("word")).alias("word")).distinct()
    monkeypatch.setattr(lexicon, "SPARE", 0.5)
    assert sorted(Lexicon(known, asked, DEFAULT, params).neighbors().collect()) == sorted(neighbors(FuzzyIndex.build(known, DEFAULT), points(asked, DEFAULT), params).collect())


@pytest.mark.parametrize(("values", "featurizer"), [(["fish", "Fish"], DEFAULT), (["FISH", "FISHY", "COD"], FourGrams()), ([], DEFAULT), (["A"], DEFAULT)])
def test_other_words_and_featurizers_and_little(spark, values, featurizer):
    asked = words(spark, ["FISH", "DISH", ""])
    made = Lexicon(words(spark, values), asked, featurizer, SearchParams())
    assert sorted(map(str, made.nearest().collect())) == sorted(map(str, nearest(FuzzyIndex.build(words(spark, values), featurizer), points(asked, featurizer), SearchParams()).collect()))


LOOKUPS = ["nearest_jaccard", "neighbors_budgeted", "accuracy_report", "comparisons_average", "nearest_overlap", "nearest_mapped", "nearest_hamming"]


@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_keep_and_shuffle_no_features(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "features" not in plan and "InMemoryRelation" not in plan
