"""Operator 2: quality rules judged by host, in DataFrame operations only.

Each document is measured once, in its row. A host's failures are counted, its failure rate is shrunk
towards the corpus by a beta prior fitted to the hosts' rates (method of moments), and the verdict
goes back to the host's documents. Only the measures, not the texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed

#: A Java regex class of the characters between words.
GAP = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"


def _deleted(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measure(docs: DataFrame, *, host: str = "source") -> DataFrame:
    """``doc_id``, ``host``, and the counts ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words`` of each document.

    Words are runs of characters other than white space (0x20, 0x09-0x0D). ``n_lines``: lines with a
    word; ``n_dup_lines``: those equal to an earlier one; ``n_repeat_words``: words inside a window
    of three words that the text has twice or more. A null text has no words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("t"),
        F.array_remove(F.split(text, GAP), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("l"),
    )
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "host", n.cast("long").alias("n_words"),
        F.length(_deleted(F.col("t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_deleted(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        windows.alias("g"),
    )
    placed = counted.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter(F.transform("s", lambda x, i: F.when((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2))))
    return placed.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size("s") == 0, F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )


def host_rates(measured: DataFrame, failed: Column) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed`` and ``rate``: the failure rate shrunk by a beta prior fitted to all hosts' rates.

    With mean m of the hosts' raw rates, and v, their variance less that of samples of their sizes at one rate m, the prior's
    weight is m (1 - m) / v - 1. Where rates vary no more than samples do, all are m; where they vary more than a beta
    distribution can, the weight is 1. A null host is a host.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(failed, 1).otherwise(0)).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    whole = F.avg(raw) * (1 - F.avg(raw))
    prior = hosts.agg(F.avg(raw).alias("m"), whole.alias("whole"), (F.var_pop(raw) - whole * F.avg(1 / F.col("n_docs"))).alias("v"))
    weight = F.when(F.col("whole") > F.col("v"), F.col("whole") / F.col("v") - 1).otherwise(F.lit(1.0))
    shrunk = F.when(F.col("v") <= 0, F.col("m")).otherwise((F.col("n_failed") + F.col("m") * weight) / (F.col("n_docs") + weight))
    return hosts.join(F.broadcast(prior), F.lit(True), "left").select("host", "n_docs", "n_failed", shrunk.alias("rate"))


def judge(docs: DataFrame, *, host: str = "source", max_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10, max_dup_line_percent: int = 30) -> DataFrame:
    """One row per document (``doc_id``, ``text`` and the host column; others are ignored) with its measures and verdict.

    ``base_failed``: fewer than ``min_words`` words or too many in repeated windows. ``rule_failed``: that,
    too many symbols for its word characters, or too many repeated lines. ``n_docs``, ``n_failed``: the host's documents, and those with
    ``rule_failed``; ``host_rate``: their shrunk rate; ``kept``: not ``base_failed`` and a host rate of at most ``max_rate``. Null texts
    have no words and so fail; null hosts are one host; repeated rows get a row each; an empty table gives no rows.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rule = base | (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"))
    measured = checkpointed(measure(docs, host=host).withColumn("base_failed", base).withColumn("rule_failed", rule))
    # Read from the checkpoint, both sides of the join are plain scans, so a hot host's side can be split.
    hosts = checkpointed(host_rates(measured, F.col("rule_failed")))
    verdict = hosts.select(F.col("host").alias("known_host"), "n_docs", "n_failed", F.col("rate").alias("host_rate"), (F.col("rate") > max_rate).alias("host_failed"))
    return measured.join(verdict, F.col("host").eqNullSafe(F.col("known_host"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "rule_failed", "host_failed", "n_docs", "n_failed", "host_rate"
    )


JUDGE_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS l FROM d),
r AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM r),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM b),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY source),
prior AS (SELECT avg(k / n) AS m, avg(k / n) * (1 - avg(k / n)) AS u, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS v FROM hosts),
s AS (SELECT m, v, CASE WHEN u > v THEN u / v - 1 ELSE 1.0 END AS z FROM prior),
rates AS (SELECT source, n, k, CASE WHEN v <= 0 THEN m ELSE (k + m * z) / (n + z) END AS rate FROM hosts, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, rule_failed,
       rate > 0.5 AS host_failed, rates.n::BIGINT AS n_docs, rates.k::BIGINT AS n_failed, round(rate, 6) AS host_rate
FROM f JOIN rates ON rates.source IS NOT DISTINCT FROM f.source
"""
