"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces. The automaton holds every window
of ``window`` consecutive item words, with a space at either end, so a match is a run of whole
words. Each text is normalised and scanned once; match ends are mapped to word numbers and, for
matched documents, to code-point spans of the original text.

The items are the stated query set. Their windows are dealt by hash to blocks of about ``block_chars``
characters, and usually one block holds them all. A block is one pass over the texts, with one automaton that a task builds
once; what the passes find is carried along with the text. So memory is bounded however many items there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed, discard, written
from ._text import pieces, utf8, word_table

_TABLE = word_table("alnum").tobytes()
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>, spans array<struct<start:long,end:long>>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
#: What one pass over the texts hands to the next.
CARRIED = "doc_id long, text string, hits array<long>, owners array<long>"
CARRIED_KINDS = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return utf8(text).translate(_TABLE).split()


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id``, ``key`` (a window, with a space at either end), ``n`` (its words); a shorter item is one window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                keys = [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1 if n else 0)]
                for k in range(0, len(keys), 10_000):
                    some = keys[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([n] * len(some), pa.int32())], ["item_id", "key", "n"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id long, key binary, n int").distinct()


def _automaton(rows: list[tuple[int | None, bytes, int]]):
    """The automaton of windows; a window's value is its number of words and the items that have it."""
    import ahocorasick

    found: dict[bytes, tuple[int, set]] = {}
    for item, key, n in rows:
        found.setdefault(bytes(key), (n, set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for key, value in found.items():
        machine.add_word(key.decode("latin-1"), value)
    machine.make_automaton()
    return machine


def _spans(text: str, runs: list[int]) -> list[dict[str, int]]:
    """Code-point spans of the runs of hit words (begin, end, begin, end, ...) in the original text."""
    raw = utf8(text)
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(runs[0::2], runs[1::2], strict=True)]


def _found(machine, words: list[bytes], runs: list[int], own: list[int | None]) -> tuple[list[int], list[int | None]]:
    """``runs`` (the begin and end of each run of hit words) and ``own`` (the items) with what this automaton finds in a text."""
    joined = b" " + b" ".join(words) + b" "
    got = list(machine.iter(joined.decode("latin-1"))) if len(machine) and words else []
    if not got:
        return runs, own
    gaps = np.cumsum(np.frombuffer(joined, np.uint8) == 32) - 1
    hit, found = np.zeros(int(gaps[-1]), bool), set(own)
    for begin, end in zip(runs[0::2], runs[1::2], strict=True):
        hit[begin:end] = True
    for end, (size, items) in got:
        hit[gaps[end] - size : gaps[end]] = True
        found |= items
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist(), sorted(found, key=lambda x: (x is None, x))


def _one_pass(rows: DataFrame, windows: list[tuple[int | None, bytes, int]], schema: str, kinds: list[pa.DataType], each: Callable[..., tuple]) -> DataFrame:
    """What ``each`` makes of every row's ``doc_id``, text and words, and of the hits and owners with what occurs of these windows.

    Text goes through one worker of a task, a few rows at a time, whatever ``each`` makes of it.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(windows)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shipped.value)
        for batch in pieces(batches):
            out = []
            for key, text, runs, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits", "owners")), strict=True):
                words = words_of(text)
                out.append(each(key, text, words, *_found(machine, words, runs, own)))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, min_percent: int = 5, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document: how much of it lies in windows of the benchmark.

    ``docs``: ``doc_id``, ``text``; ``benchmark``: ``item_id``, ``text``; other columns are ignored.
    ``contaminated``: some word is hit, and at least ``min_percent`` of them. ``item_ids``: items with
    occurring windows; ``items_sha256``: of those ids sorted as strings and joined by commas;
    ``spans``: hit stretches as code points of the original text. Null and empty texts have no words
    and are never contaminated; null or empty items have no windows; a null item id counts as
    ``null``; repeated items are one item; repeated documents get a row each. Texts are read once for every
    ``block_chars`` characters of windows.
    """
    windows = item_windows(benchmark, window)
    windows = checkpointed(windows)
    n_blocks = -(-windows.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0] // block_chars) or 1
    none = F.array().cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("hits"), none.alias("owners"))

    def carried(key: int | None, text: str | None, words: list[bytes], runs: list[int], own: list[int | None]) -> tuple:
        return key, text, runs, own

    def judged(key: int | None, text: str | None, words: list[bytes], runs: list[int], own: list[int | None]) -> tuple:
        n_hit = sum(runs[1::2]) - sum(runs[0::2])
        names = sorted("null" if x is None else str(x) for x in own)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        return key, len(words), n_hit, len(own), digest, n_hit > 0 and 100 * n_hit >= min_percent * len(words), [x for x in own if x is not None], _spans(text, runs) if n_hit else []

    before = None
    for k in range(n_blocks):
        block = windows.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == k).select("item_id", "key", "n").collect()  # about block_chars characters
        last = k == n_blocks - 1
        rows = _one_pass(rows, [tuple(r) for r in block], *((SCHEMA, KINDS, judged) if last else (CARRIED, CARRIED_KINDS, carried)))
        if not last:
            rows = written(rows)
            if before is not None:
                discard(before)
            before = rows
    return rows


SCAN_SQL = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN wins ON pos.k = wins.k AND pos.n = wins.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
