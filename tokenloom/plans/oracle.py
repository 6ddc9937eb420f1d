"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

from ..functions.text import ACCENTED, BASE

NORMAL = f"replace(translate(text, '{ACCENTED}', '{BASE}'), 'ß', 'ss')"
WORDS = f"words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(upper({NORMAL}), '[^A-Z]+')) AS w FROM documents) WHERE w <> '')"
PARTS = "words AS (SELECT DISTINCT p_name AS word FROM part)"
TYPO = "CASE WHEN length(word) > 4 THEN 'A' || substring(word, 1, 3) || 'E' || substring(word, 4) ELSE 'A' || word END"
TYPOS = f"asked AS (SELECT DISTINCT {TYPO} AS word FROM words)"
NONE = "[]::VARCHAR[]"


def _each(s: str, n: int, gram: str) -> str:
    return f"list_transform(range(1, greatest(length({s}) - {n} + 2, 1)), lambda x: {gram})"


def ngram(s: str, n: int) -> str:
    return _each(s, n, f"substring({s}, x, {n})")


def scheme(s: str, a: tuple[int, int], g: tuple[int, int], b: tuple[int, int]) -> str:
    parts = []
    for i in range(a[0], a[1] + 1):
        for gap in range(max(g[0], 1), g[1] + 1):
            for k in range(b[0], b[1] + 1):
                left, right = f"substring({s}, x, {i})", f"substring({s}, x + {i + gap}, {k})"
                parts.append(_each(s, i + gap + k, f"{left} || chr(1) || {right}" if i and k else left if i else right))
    if g[0] == 0:
        parts += [ngram(s, w) for w in range(max(1, a[0] + b[0]), a[1] + b[1] + 1)]
    return " || ".join(f"({p})" for p in parts)


def book_ends(s: str, k: int, n: int) -> str:
    head, toe = f"substring({s}, 1, {k})", f"substring({s}, length({s}) - {k - 1}, {k})"
    return f"(CASE WHEN length({s}) >= {k} THEN {ngram(head, n)} || list_transform({ngram(toe, n)}, lambda f: '~' || f) ELSE {NONE} END)"


def default(s: str) -> str:
    return f"({scheme(s, (2, 2), (0, 3), (2, 2))}) || {book_ends(s, 4, 2)}"


def four_grams(s: str) -> str:
    ends = f"CASE WHEN length({s}) > 1 THEN ['$' || substring({s}, 1, 2) || '#', '#' || right({s}, 2) || '$'] ELSE {NONE} END"
    inner = f"CASE WHEN length({s}) > 2 THEN ['$' || substring({s}, 2, 2) || '#', '#' || substring({s}, length({s}) - 2, 2) || '$'] ELSE {NONE} END"
    steps = [f"list_transform(range(1, greatest(length({s}) - {k}, 1)), lambda x: CASE WHEN x > 1 THEN substring({s}, x - 1, 2) || substring({s}, x + {k}, 2) ELSE substring({s}, 1, 1) || substring({s}, x + {k}, 2) || '#' END)" for k in (1, 2, 3)]
    return " || ".join(f"({p})" for p in (ends, inner, *steps))


def points(features: str, source: str = "words", name: str = "p") -> str:
    return f"{name} AS (SELECT word AS label, list_sort({features}) AS features, len(features)::BIGINT AS n FROM (SELECT word, {features} AS features FROM {source}))"


TF = "tf AS (SELECT label, feature, count(*) AS tf FROM (SELECT label, unnest(features) AS feature FROM p) GROUP BY ALL)"
STATS = "stats AS (SELECT feature, sum(tf)::BIGINT AS freq, count(*) AS df FROM tf GROUP BY feature)"
POSTINGS = "postings AS (SELECT feature, label, occ, row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws('|', feature, label, occ)), label, occ) AS prank FROM (SELECT feature, label, unnest(range(1, tf + 1)) AS occ FROM tf))"
QUERY_TF = "qf AS (SELECT label AS query_id, feature, count(*) AS tq FROM (SELECT label, unnest(features) AS feature FROM q) GROUP BY ALL)"
CHOSEN = "chosen AS (SELECT * FROM (SELECT query_id, feature, 512 // (floor(log2(freq))::INT + 1) AS w, row_number() OVER (PARTITION BY query_id ORDER BY freq, feature) AS drank FROM qf JOIN stats USING (feature)) WHERE drank <= 5)"
MET = "met AS (SELECT query_id, label, w FROM chosen JOIN postings USING (feature) WHERE prank <= 20)"
RANKED = "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wt DESC, label) AS rk FROM (SELECT query_id, label, sum(w)::BIGINT AS wt FROM met GROUP BY ALL)) WHERE rk <= 70)"
COMMON = "common AS (SELECT r.query_id, r.label, sum(least(tq, tf)) AS c FROM ranked r JOIN qf ON qf.query_id = r.query_id JOIN tf ON tf.label = r.label AND tf.feature = qf.feature GROUP BY ALL)"
STOP = """d0 AS (SELECT *, max(sim) OVER (PARTITION BY query_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM scored),
d1 AS (SELECT *, CASE WHEN rk > 1 AND sim > pm THEN rk END AS imp FROM d0),
d2 AS (SELECT *, coalesce(max(imp) OVER v, 0) AS lr, coalesce(max(CASE WHEN sim > 0.7 THEN 1 ELSE 0 END) OVER v, 0) AS done FROM d1 WINDOW v AS (PARTITION BY query_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nb AS (SELECT query_id, rk, label, sim FROM (SELECT *, max(CASE WHEN rk - lr > 20 OR done = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rk ROWS UNBOUNDED PRECEDING) AS st FROM d2) WHERE st = 0)"""
NEAREST = "SELECT q.label AS query_id, b.label, coalesce(b.sim, 0.0) AS sim FROM q LEFT JOIN (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rk) = 1) b ON b.query_id = q.label"
# Votes of a feature are counts of 10 bits, 12 to a number, so that a point's are added up in five numbers (points have fewer than 1,024 features).
LANES = "(SELECT f, [" + ", ".join(f"sum(CASE WHEN b // 12 = {k} THEN ((x >> b) & 1)::HUGEINT << (10 * (b % 12))::INT ELSE 0 END)" for k in range(5)) + "] AS v FROM (SELECT f, ('0x' || substr(md5(f), 1, 15))::BIGINT AS x FROM (SELECT DISTINCT unnest(features) AS f FROM {0})), (SELECT unnest(range(60)) AS b) GROUP BY f)"
SIGNS = (
    "(SELECT label, list_sum(list_transform(range(60), lambda b: CASE WHEN 2 * ((v[b // 12 + 1] >> (10 * (b % 12))::INT) & 1023) > n THEN 1::BIGINT << b ELSE 0::BIGINT END))::BIGINT AS h FROM (SELECT label, count(*) AS n, ["
    + ", ".join(f"sum(v[{k}])" for k in range(1, 6))
    + "] AS v FROM (SELECT label, unnest(features) AS f FROM {0}) JOIN "
    + LANES
    + " USING (f) GROUP BY label))"
)


def _scored(kind: str) -> str:
    if kind == "hamming":
        return f"hp AS {SIGNS.format('p')}, hq AS {SIGNS.format('q')}, scored AS (SELECT r.query_id, r.label, rk, sqrt(1.0 / (bit_count(xor(coalesce(hq.h, 0), coalesce(hp.h, 0))) + 1)) AS sim FROM ranked r LEFT JOIN hq ON hq.label = r.query_id LEFT JOIN hp ON hp.label = r.label)"
    low = {"jaccard": "(q.n + p.n - c)", "overlap": "least(q.n, p.n)", "idf": "CASE WHEN q.n < p.n THEN q.n * ln(p.n) ELSE 1e308 END"}[kind]
    return f"{COMMON}, scored AS (SELECT r.query_id, r.label, rk, CASE WHEN c IS NULL THEN 0.0 ELSE c::DOUBLE / {low} END AS sim FROM ranked r JOIN q ON q.label = r.query_id JOIN p ON p.label = r.label LEFT JOIN common m ON m.query_id = r.query_id AND m.label = r.label)"


INDEX = f"WITH RECURSIVE {WORDS}, {points(default('word'))}, {TF}, {STATS}, {POSTINGS}"
LOOKUP = f"{INDEX}, {TYPOS}, {points(default('word'), 'asked', 'q')}, {QUERY_TF}, {CHOSEN}, {MET}, {RANKED}"
VOWELS = f"list_transform({default('word')}, lambda f: CASE WHEN regexp_matches(f, '^[AEIOU]') THEN 'V' ELSE f END)"
MAPPED_LOOKUP = f"WITH RECURSIVE {WORDS}, {points(VOWELS)}, {TF}, {STATS}, {POSTINGS}, {TYPOS}, {points(VOWELS, 'asked', 'q')}, {QUERY_TF}, {CHOSEN}, {MET}, {RANKED}"
BIGRAMS = f"WITH RECURSIVE {WORDS}, {points(ngram('word', 2))}, {TF}, {STATS}, {POSTINGS}"
PART_BIGRAMS = f"WITH RECURSIVE {PARTS}, {points(ngram('word', 2))}, {TF}, {STATS}"
MAPPING = "map AS (SELECT DISTINCT feature, 'V' AS mapped FROM tf WHERE regexp_matches(feature, '^[AEIOU]'))"
REMAP = "SELECT label, coalesce(mapped, tf.feature) AS feature, sum(tf)::BIGINT AS tf FROM tf {} JOIN map ON map.feature = tf.feature GROUP BY 1, 2"
PAIRED = "o AS (SELECT a.label AS query_id, b.label AS label, sum(least(a.tf, b.tf)) AS c FROM tf a JOIN tf b ON a.feature = b.feature AND a.label <> b.label GROUP BY ALL)"
PAIR_SIM = "SELECT o.query_id, o.label, c::DOUBLE / {} AS sim FROM o JOIN p x ON x.label = o.query_id JOIN p y ON y.label = o.label"
IDF = "idf AS (SELECT a.feature, b.feature AS other, sum(least(a.tf, b.tf))::DOUBLE / least(any_value(x.freq), any_value(y.freq)) / ln(greatest(any_value(x.freq), any_value(y.freq))) AS sim FROM tf a JOIN tf b ON a.label = b.label AND a.feature <> b.feature JOIN stats x ON x.feature = a.feature JOIN stats y ON y.feature = b.feature WHERE x.freq < y.freq GROUP BY a.feature, b.feature)"
CLUSTERED = f"""{IDF}, t AS (SELECT 0.2 / ln(sum(freq) / count(*)) AS t FROM stats),
up AS (SELECT s.feature, coalesce(b.other, s.feature) AS parent FROM stats s LEFT JOIN (SELECT feature, other FROM idf, t WHERE sim >= t QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sim DESC, other) = 1) b ON b.feature = s.feature),
walk AS (SELECT feature, parent AS mapped FROM up UNION SELECT w.feature, u.parent FROM walk w JOIN up u ON u.feature = w.mapped),
map AS (SELECT w.feature, w.mapped FROM walk w JOIN up u ON u.feature = w.mapped AND u.parent = u.feature)"""
LINKED = """up AS (SELECT s.feature, coalesce(b.other, s.feature) AS parent FROM stats s LEFT JOIN chosen_b b ON b.feature = s.feature),
walk AS (SELECT feature, parent AS mapped FROM up UNION SELECT w.feature, u.parent FROM walk w JOIN up u ON u.feature = w.mapped),
map AS (SELECT w.feature, w.mapped FROM walk w JOIN up u ON u.feature = w.mapped AND u.parent = u.feature)"""
COLUMNS = "p AS (SELECT feature AS label, list_sort(list(label)) AS features, count(*) AS n FROM (SELECT label, unnest(features) AS feature FROM p0) GROUP BY feature), q AS (SELECT * FROM p)"
EDGES = "e AS (SELECT a.feature AS feature_a, b.feature AS feature_b, sum(a.tf * b.tf)::BIGINT AS n FROM tf a JOIN tf b ON a.label = b.label AND a.feature <> b.feature GROUP BY ALL)"


def _shingled(kind: str, key: str, name: str) -> str:
    tokens = f"list_filter(string_split_regex(upper({NORMAL}), '[^A-Z]+'), lambda x: x <> '')"
    return f"{name} AS (SELECT label, features, len(features)::BIGINT AS n FROM (SELECT {key} AS label, list_sort(list_transform(range(1, greatest(len(t) - 1, 1)), lambda x: t[x] || ' ' || t[x + 1] || ' ' || t[x + 2])) AS features FROM (SELECT {key}, {tokens} AS t FROM {kind})))"


DOCS = f"WITH {_shingled('documents', 'doc_id', 'p')}, {TF}, {STATS}, {POSTINGS}, {_shingled('benchmark', 'item_id', 'q')}, {QUERY_TF}"


def _compressed() -> str:
    out, before = [], "tf"
    for step, c in enumerate((14, 9, 6, 4, 3)):
        out.append(f"""f{step} AS (SELECT feature, sum(tf) AS freq FROM {before} GROUP BY feature),
g{step} AS (SELECT label, feature FROM (SELECT tf.label, tf.feature, sum(tf.tf) OVER (PARTITION BY tf.label ORDER BY coalesce(freq, 0), tf.feature ROWS UNBOUNDED PRECEDING) AS upto FROM tf JOIN p ON p.label = tf.label AND p.n > {c} LEFT JOIN f{step} f ON f.feature = tf.feature) WHERE upto > {c}),
k{step} AS (SELECT * FROM {before} b WHERE NOT EXISTS (SELECT 1 FROM g{step} g WHERE g.label = b.label AND g.feature = b.feature))""")
        before = f"k{step}"
    return ", ".join(out)


def _features(sql: str) -> str:
    return f"WITH {WORDS} SELECT word, array_to_string(list_sort({sql}), ' ') AS features FROM words"


ORACLE_SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, md5({NORMAL}) AS digest FROM documents",
    "lexicon_upper_distinct": f"WITH {WORDS} SELECT word FROM words",
    "induced_typos": f"WITH {WORDS} SELECT word, {TYPO} AS typo FROM words",
    "reverse_union": f"WITH {WORDS} SELECT word FROM words UNION SELECT reverse(word) FROM words",
    "ngram2": _features(ngram("word", 2)),
    "ngram3": _features(ngram("word", 3)),
    "skipgram_2_0_3_2": _features(scheme("word", (2, 2), (0, 3), (2, 2))),
    "skip_scheme_ranges": _features(scheme("word", (0, 2), (0, 2), (1, 2))),
    "book_ends_4_4": _features(book_ends("word", 4, 2)),
    "default_features": _features(default("word")),
    "default_ascii": _features(four_grams("word")),
    "empty_featurizer": f"WITH {WORDS} SELECT word, '' AS features FROM words",
    "custom_featurizer": f"WITH {WORDS} SELECT word, substring(word, 1, 1) AS features FROM words",
    "word_shingles3": f"WITH {_shingled('documents', 'doc_id', 'p')} SELECT label AS doc_id, n::INT AS n, md5(array_to_string(features, '|')) AS digest FROM p",
    "mapped_keep": f"{BIGRAMS}, {MAPPING} {REMAP.format('LEFT')}",
    "mapped_drop": f"{BIGRAMS}, {MAPPING} {REMAP.format('')}",
    "filtermap": f"{BIGRAMS}, {MAPPING} SELECT feature, mapped FROM map",
    "featurize_set": _features(f"list_distinct({ngram('word', 2)})"),
    "featurize_counts": f"{BIGRAMS} SELECT label, feature, tf FROM tf",
    "featurize_x3": f"{INDEX} SELECT label AS word, n, array_to_string(list_sort(list_distinct(features)), ' ') AS features, list_max(features) AS last FROM p",
    "point_sizes": f"{INDEX} SELECT label, n FROM p",
    "simhash60": f"{BIGRAMS} SELECT p.label, coalesce(h, 0) AS simhash FROM p LEFT JOIN {SIGNS.format('p')} s ON s.label = p.label",
    "jaccard_pairs": f"{PART_BIGRAMS}, {PAIRED} {PAIR_SIM.format('(x.n + y.n - c)')}",
    "overlap_pairs": f"{PART_BIGRAMS}, {PAIRED} {PAIR_SIM.format('least(x.n, y.n)')}",
    "hamming_pairs": f"{PART_BIGRAMS}, {PAIRED}, s AS {SIGNS.format('p')} SELECT query_id, o.label, sqrt(1.0 / (bit_count(xor(x.h, y.h)) + 1)) AS sim FROM o JOIN s x ON x.label = query_id JOIN s y ON y.label = o.label",
    "overlap_idf_pairs": f"{PART_BIGRAMS}, {IDF} SELECT feature, other, sim FROM idf",
    "levenshtein_pairs": f"WITH {WORDS} SELECT word, levenshtein(word, {TYPO})::BIGINT AS edits FROM words",
    "index_feature_stats": f"{INDEX} SELECT * FROM stats",
    "index_postings_ranked": f"{BIGRAMS} SELECT * FROM postings",
    "compressed_step": f"{BIGRAMS}, g AS (SELECT label, feature FROM (SELECT tf.label, tf.feature, sum(tf.tf) OVER (PARTITION BY tf.label ORDER BY freq, tf.feature ROWS UNBOUNDED PRECEDING) AS upto FROM tf JOIN p ON p.label = tf.label AND p.n > 6 JOIN stats ON stats.feature = tf.feature) WHERE upto > 6) SELECT * FROM tf WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.label = tf.label AND g.feature = tf.feature)",
    "compressed_index": f"{BIGRAMS}, {_compressed()} SELECT feature, sum(tf)::BIGINT AS freq, count(*) AS df FROM k4 GROUP BY feature",
    "candidates_weighted": f"{LOOKUP} SELECT query_id, label, wt, rk FROM ranked",
    "neighbors_budgeted": f"{LOOKUP}, {_scored('jaccard')}, {STOP} SELECT * FROM nb",
    "nearest_jaccard": f"{LOOKUP}, {_scored('jaccard')}, {STOP} {NEAREST}",
    "nearest_overlap": f"{LOOKUP}, {_scored('overlap')}, {STOP} {NEAREST}",
    "nearest_hamming": f"{LOOKUP}, {_scored('hamming')}, {STOP} {NEAREST}",
    "search_stats": f"{LOOKUP}, per AS (SELECT query_id, count(*) AS total, count(DISTINCT label) AS uniq FROM met GROUP BY query_id) SELECT count(*) AS called, sum(n)::DOUBLE / count(*) AS input_features, sum(len(list_distinct(features)))::DOUBLE / count(*) AS input_features_unique, sum(coalesce(total, 0))::DOUBLE / count(*) AS nbrs_total, sum(coalesce(uniq, 0))::DOUBLE / count(*) AS nbrs_unique FROM q LEFT JOIN per ON per.query_id = q.label",
    "feature_cooccurrence": f"{BIGRAMS}, {EDGES} SELECT * FROM e",
    "transpose_df": f"{PART_BIGRAMS} SELECT feature AS label, string_agg(label, '|' ORDER BY label) AS features, count(*) AS df FROM (SELECT label, unnest(features) AS feature FROM p) GROUP BY feature",
    "cluster_a": f"{PART_BIGRAMS}, {EDGES}, z AS (SELECT feature_a AS f, sum(n) AS s FROM e GROUP BY ALL), t AS (SELECT 0.75 / ln(sum(s) / count(*)) AS t FROM z), c AS (SELECT x.feature_a AS fa, y.feature_a AS fb, sum(least(x.n, y.n)) AS c FROM e x JOIN e y ON x.feature_b = y.feature_b JOIN e k ON k.feature_a = x.feature_a AND k.feature_b = y.feature_a GROUP BY ALL), r AS (SELECT fa, fb, c::DOUBLE / least(a.s, b.s) / ln(b.s) AS score FROM c JOIN z a ON a.f = fa JOIN z b ON b.f = fb WHERE b.s >= a.s AND b.s > 1) SELECT fa AS feature, fb AS mapped FROM r, t WHERE score >= t QUALIFY row_number() OVER (PARTITION BY fa ORDER BY score DESC, fb) = 1",
    "cluster_b": f"{PART_BIGRAMS}, {CLUSTERED} SELECT feature, mapped FROM map",
    "cluster_remap": f"{PART_BIGRAMS}, {CLUSTERED} {REMAP.format('LEFT')}",
    "cluster_b_budgeted": f"WITH RECURSIVE {PARTS}, {points(ngram('word', 2), 'words', 'p0')}, {COLUMNS}, {TF}, stats0 AS (SELECT label AS feature, n AS freq FROM p), {STATS}, {POSTINGS}, {QUERY_TF}, {CHOSEN}, {MET}, {RANKED}, {_scored('idf')}, {STOP}, best AS ({NEAREST}), chosen_b AS (SELECT query_id AS feature, label AS other FROM best WHERE sim > 1e-300 AND sim >= (SELECT 0.2 / ln(sum(freq) / count(*)) FROM stats0)), {LINKED.replace('stats s', 'stats0 s')} SELECT feature, mapped FROM map",
    "clustered_points": f"{PART_BIGRAMS}, {CLUSTERED} SELECT label, string_agg(mapped, '|' ORDER BY mapped) AS features, count(*) AS n FROM (SELECT label, unnest(features) AS feature FROM p) JOIN map USING (feature) GROUP BY label",
    "nearest_mapped": f"{MAPPED_LOOKUP}, {_scored('jaccard')}, {STOP} {NEAREST}",
    "comparisons_average": f"{LOOKUP}, {_scored('jaccard')}, {STOP} SELECT count(*)::DOUBLE / count(DISTINCT query_id) AS comparisons FROM nb",
    "featurize_x2": f"WITH {WORDS} SELECT word, len({ngram('word', 2)})::BIGINT AS n, array_to_string(list_sort(list_distinct({ngram('word', 2)})), ' ') AS features FROM words",
    "document_tokens": "SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS t FROM documents)",
    "benchmark_lookup": f"{DOCS}, {CHOSEN}, {MET}, {RANKED}, {_scored('overlap')}, {STOP} {NEAREST}",
    "brute_force_nearest": f"{DOCS}, m AS (SELECT query_id, label, sum(least(tq, tf)) AS c FROM qf JOIN tf USING (feature) GROUP BY ALL), s AS (SELECT query_id, m.label, c::DOUBLE / (q.n + p.n - c) AS sim FROM m JOIN q ON q.label = query_id JOIN p ON p.label = m.label) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) = 1",
    "accuracy_report": f"{LOOKUP}, {_scored('jaccard')}, {STOP}, best AS ({NEAREST}), r AS (SELECT word AS correct, {TYPO} AS typo FROM words), g AS (SELECT r.*, coalesce(label, '') AS guess FROM r JOIN best ON query_id = typo), k AS (SELECT *, guess <> correct AS wrong, guess <> correct AND levenshtein(correct, typo) >= levenshtein(correct, guess) AS forgiven, levenshtein(typo, guess) < levenshtein(typo, correct) AS nearer FROM g) SELECT count(*) AS pairs, count(*) FILTER (NOT wrong OR forgiven) AS \"right\", count(*) FILTER (wrong AND NOT forgiven AND nearer) AS similarity_errors, count(*) FILTER (wrong AND NOT forgiven AND NOT nearer) AS lookup_errors, (count(*) FILTER (NOT wrong OR forgiven))::DOUBLE / count(*) AS accuracy FROM k",
}
