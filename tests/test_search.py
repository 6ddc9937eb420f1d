import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.featurizers import DEFAULT, BookEnds, Empty, Mapped, SkipScheme, Text, Tokens, ngram, skipgram
from tokenloom.functions.metrics import Jaccard, Metric, Overlap, OverlapIdf
from tokenloom.functions.text import decomposed, induce_typo
from tokenloom.operators.evaluate import exact_nearest, lsh_nearest
from tokenloom.operators.cluster import cluster_points, cluster_rows
from tokenloom.operators.index import FuzzyIndex, cutoffs, mapped_points, point_features, points
from tokenloom.operators.search import SearchParams, nearest, neighbors, stopped
from tokenloom.plans.oracle import ORACLE_SQL
from tokenloom.plans.queries import QUERIES
from tokenloom.sources import lexicon, tokens
from tokenloom.streaming import search_stream

SPECIES = ("tenuis", "torihalimeda", "tortuosa", "turaki", "valenciennesi", "valida", "variolosa")
SF = "/root/testdata/sf0.001"


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


@pytest.fixture(scope="module")
def corals(spark):
    return FuzzyIndex.build(words(spark, [f"acropora {s}" for s in SPECIES]), ngram(2))


def features(spark, featurizer, value):
    return words(spark, [value]).select(featurizer.features(Text(F.col("word")))).first()[0]


def test_known_neighbour(spark, corals):
    asked = points(words(spark, ["acorpora torehalemida"]), ngram(2))
    found = nearest(corals, asked, SearchParams(Jaccard(), 20, 10, 5, 70, 5)).first()
    assert (found.label, found.sim) == ("acropora torihalimeda", 0.3793103448275862)


def test_search_finds_what_all_pairs_find(spark, corals):
    asked = points(words(spark, ["acropora valda", "acropora turak", "tenuis"]), ngram(2))
    wide = SearchParams(Jaccard(), 10_000, 10_000, 10_000, 101, 10_000)
    assert sorted(nearest(corals, asked, wide).collect()) == sorted(exact_nearest(corals, asked, wide).collect())
    assert {r.query_id: r.label for r in lsh_nearest(corals, asked).collect()}["acropora valda"] == "acropora valida"


def test_query_without_neighbour_keeps_its_row(spark, corals):
    found = nearest(corals, points(words(spark, ["zz", "", None]), ngram(2)), SearchParams()).collect()
    assert len(found) == 3 and all(r.label is None and r.sim == 0 for r in found)


@pytest.mark.parametrize(
    ("featurizer", "value", "expected"),
    [
        (ngram(2), "abc", ["ab", "bc"]),
        (ngram(2), "a", []),
        (ngram(2), "", []),
        (ngram(2), None, None),
        (skipgram(2, (1, 3), 2), "abcdefg", ["ab\x01de", "ab\x01ef", "ab\x01fg", "bc\x01ef", "bc\x01fg", "cd\x01fg"]),
        (BookEnds(3, 3, ngram(2), tagged=False), "Hello world!", ["He", "el", "d!", "ld"]),
        (BookEnds(3, 3, ngram(2)), "Hello", ["He", "el", "~ll", "~lo"]),
        (SkipScheme((0, 0), (0, 0), (1, 2)), "ab", ["a", "ab", "b"]),
        (Empty(), "abc", []),
        (skipgram(1, (0, 0), 1), "abab", ["ab", "ab", "ba"]),
    ],
)
def test_featurizers(spark, featurizer, value, expected):
    found = features(spark, featurizer, value)
    assert (found if found is None else sorted(found)) == (expected if expected is None else sorted(expected))


def test_featurizer_on_tokens(spark):
    df = spark.createDataFrame([("one fish two fish",)], "text string").select(tokens(F.col("text")).alias("t"))
    assert df.select(ngram(2).features(Tokens(F.col("t")))).first()[0] == ["one fish", "fish two", "two fish"]


def test_typos_and_normalisation(spark):
    found = words(spark, ["FISH", "CORAL", ""]).select(induce_typo(F.col("word"))).collect()
    assert [r[0] for r in found] == ["AFISH", "ACOREAL", "A"]
    assert words(spark, ["Łé ß"]).select(decomposed("word")).first()[0] == "e ss"


def sequential(sims, params):
    """The stop rules, one candidate after another."""
    out, last, top = [], 0, None
    for k, s in enumerate(sims, 1):
        if k > params.max_comparisons or k - last > params.use_best_after:
            break
        out.append(k)
        if s > params.return_if_gt / 100:
            break
        if top is not None and s > top:
            last = k
        top = s if top is None else max(top, s)
    return out


def test_stop_rules_equal_sequential_comparison(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(10) / 10 for _ in range(rng.randrange(1, 15))] for _ in range(200)] + [[0.5, 0.4, 0.6, 0.1, 0.2, 0.7, 0.95]]
    df = spark.createDataFrame([(q, k, s) for q, sims in enumerate(lists) for k, s in enumerate(sims, 1)], "query_id int, rk int, sim double")
    for params in (SearchParams(use_best_after=2, return_if_gt=90), SearchParams(use_best_after=4, return_if_gt=70, max_comparisons=6), SearchParams(use_best_after=0)):
        got = {}
        for r in stopped(df, params).orderBy("rk").collect():
            got.setdefault(r.query_id, []).append(r.rk)
        assert got == {q: x for q, sims in enumerate(lists) if (x := sequential(sims, params))}


def test_overlap_is_symmetric(spark):
    index = FuzzyIndex.build(words(spark, ["ab", "abcd"]), ngram(1))
    found = {(r.query_id, r.label): r.sim for r in neighbors(index, index.points, SearchParams(Overlap(), return_if_gt=101)).collect()}
    assert found[("ab", "abcd")] == found[("abcd", "ab")] == 1.0


def test_saved_index_answers_alike(spark, corals, tmp_path):
    corals.save(str(tmp_path / "index"))
    again = FuzzyIndex.load(spark, str(tmp_path / "index"), ngram(2))
    asked = points(words(spark, ["acropora valda"]), ngram(2))
    assert nearest(again, asked, SearchParams()).collect() == nearest(corals, asked, SearchParams()).collect()


def test_compress_cutoffs():
    assert cutoffs(10) == [64, 40, 25, 16, 10]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Fish\nfish\ncoral\n")
    assert sorted(r.word for r in lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["CORAL", "FISH"]


def test_mapped_featurizer_and_mapped_points_agree(spark):
    to_v = lambda f: F.when(f.rlike("^[aeiou]"), F.lit("V"))
    assert features(spark, Mapped(ngram(2), to_v), "acorn") == ["V", "V"]
    assert features(spark, Mapped(ngram(2), to_v, keep_unseen=True), "acorn") == ["V", "co", "V", "rn"]
    plain = points(words(spark, ["acorn", "xyz", ""]), ngram(2))
    table = words(spark, ["ac", "or"]).select(F.col("word").alias("feature"), F.lit("V").alias("mapped"))
    for keep in (False, True):
        found = {r.label: r.features for r in mapped_points(plain, table, keep_unseen=keep).collect()}
        assert found == {r.label: r.features for r in points(words(spark, ["acorn", "xyz", ""]), Mapped(ngram(2), to_v, keep)).collect()}


def test_transposed_index_is_searched(spark, corals):
    turned = corals.transposed()
    found = {r.query_id: r for r in nearest(turned, turned.points, SearchParams(OverlapIdf(), 100, 100, 1000, 101, 1000)).collect()}
    assert found["ki"].label is not None and found["ki"].sim > 0


@pytest.mark.parametrize("params", [None, SearchParams()])
@pytest.mark.parametrize("values", [[], ["ab"], ["ab", "cd"], [None, ""]])
def test_clusters_of_little(spark, values, params):
    tf = point_features(points(words(spark, values), ngram(2)))
    assert sorted(cluster_points(tf, 0.2, params).collect()) == [(v, v) for v in values if v]
    assert cluster_rows(tf, 0.5).count() == 0
    with pytest.raises(ValueError, match="epochs"):
        cluster_rows(tf, 0.5, 0)


def test_metric_of_ones_own(spark, corals):
    class Shared(Metric):
        def sim(self):
            return F.col("common") / 100

    asked = points(words(spark, ["acropora valda"]), ngram(2))
    assert nearest(corals, asked, SearchParams(Shared())).first().label == "acropora valida"


def test_stream_of_queries(spark, corals, tmp_path):
    words(spark, ["acropora valda"]).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("word string").parquet(str(tmp_path / "in"))
    search_stream(corals, stream, SearchParams(), lambda df, _: got.extend(df.collect()), checkpoint=str(tmp_path / "state")).awaitTermination(120)
    assert [r.label for r in got] == ["acropora valida"]


def test_empty_and_repeated_input(spark):
    index = FuzzyIndex.build(words(spark, []), DEFAULT)
    assert nearest(index, points(words(spark, ["coral", "coral"]), DEFAULT), SearchParams()).count() == 1


@pytest.mark.parametrize("name", ["default_ascii", "skip_scheme_ranges", "simhash60", "compressed_index", "nearest_jaccard", "search_stats", "cluster_a", "cluster_b", "cluster_b_budgeted", "clustered_points", "nearest_mapped", "nearest_hamming", "document_tokens", "accuracy_report", "brute_force_nearest"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = con.sql(ORACLE_SQL[name])
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(str([near(r[c]) for c in columns]) for r in found.collect())
    assert sorted(result.columns) == columns
    assert got == sorted(str([near(r[result.columns.index(c)]) for c in columns]) for r in result.fetchall())
    spark.catalog.clearCache()


def test_an_index_for_queries_answers_as_a_whole_one(spark):
    rng = random.Random(7)
    made = words(spark, sorted({"".join(rng.choices("abcd", k=rng.randrange(9))) for _ in range(300)}))
    asked = points(words(spark, ["abcab", "dddd", "zz", "", "a"]), ngram(2))
    whole, part = FuzzyIndex.build(made, ngram(2)), FuzzyIndex.for_queries(made, ngram(2), asked)
    for params in (SearchParams(Jaccard()), SearchParams(Overlap(), breadth=3, use_best_after=2)):
        assert sorted(neighbors(part, asked, params).collect()) == sorted(neighbors(whole, asked, params).collect())
        assert sorted(map(str, nearest(part, asked, params).collect())) == sorted(map(str, nearest(whole, asked, params).collect()))
        assert sorted(exact_nearest(part, asked, params).collect()) == sorted(exact_nearest(whole, asked, params).collect())


@pytest.mark.parametrize("name", ["brute_force_nearest", "benchmark_lookup"])
def test_item_lookups_keep_no_whole_documents(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "InMemoryRelation" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_imports_without_the_pipeline(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(repo)!r}); sys.modules['tokenloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
