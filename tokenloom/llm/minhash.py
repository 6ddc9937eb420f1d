"""Operator 7: near-duplicates by MinHash bands with sequential Bayesian verification.

Documents of the same word sequence are one class. A class representative's signature has
``BANDS * ROWS`` minima; representatives that agree in a band share a bucket. Candidates are compared
batch by batch of their signatures; with a uniform prior on the similarity, a pair is dropped once the posterior
probability that it reaches the threshold is below its batch's share of ``MISS``. What survives is verified on the full shingle sets.

Buckets can be large, so their pairs are not made. First each member is compared with its bucket's leader, the
member that meets most others over all buckets. Linked members are joined to components; then only
buckets that still hold several components compare members across these, in blocks, inside the tasks:
Bayesian verification and then the full sets decide there, and a verified link joins its two components for
the rest of the group. So every pair that shares a bucket is compared or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed
from ._text import LOWER, Words, blocks, mix64, pieces, word_table
from .components import components

BANDS, ROWS = 48, 8
#: Chance that all batches together drop a link, as posterior probability; each batch has an equal share.
MISS = 1e-5
#: Minima that are compared at a time.
BATCH = 32
#: Members of a bucket that one task compares with as many.
BLOCK = 2000
#: Ids that are broadcast at most; beyond that a shuffled join gives the same rows.
MAX_BROADCAST_IDS = 2_000_000
_WORDS = word_table("white")
_LOWER = LOWER.tobytes()
_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_PLACES = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``size`` words, of all words if they are fewer, none without words."""
    words = Words(texts, _WORDS)
    h, out = words.hashes, []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        every = np.zeros(n, np.uint64)
        for k in range(size):
            every += h[k : k + n] * _PLACES[k]
        every = mix64(every)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(every[a : b - size + 1]))
            elif b > a:
                out.append(mix64((h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The lower 16 bits of each set's minima, a row per set; rows of empty sets mean nothing."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    begin = 0
    while begin < len(some):
        end, held = begin, 0
        while end < len(some) and (held == 0 or held + len(sets[some[end]]) <= 1 << 16):
            held += len(sets[some[end]])
            end += 1
        own = some[begin:end]
        x = np.concatenate([sets[i] for i in own])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])[:-1]])
        buffer, minima = np.empty_like(x), np.empty((BANDS * ROWS, len(own)), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(x, _FACTORS[k], out=buffer)
            np.add(buffer, _SHIFTS[k], out=buffer)
            np.minimum.reduceat(buffer, first, out=minima[k])
        # A minimum is small; a mix spreads it over the bits that are kept.
        minima = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[own] = (minima ^ (minima >> np.uint32(16))).astype(np.uint16).T
        begin = end
    return out


@cache
def least_matches(threshold_percent: int, miss: float) -> tuple[int, ...]:
    """For each number of batches compared, the matches below which the posterior chance of a link is under ``miss``.

    The posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1), whose mass above t is the
    chance that a binomial (n + 1, t) is at most m.
    """
    t, out = threshold_percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold_percent: int) -> np.ndarray:
    """Row numbers of the pairs of signatures that no batch drops."""
    rows, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(threshold_percent, MISS * BATCH / (BANDS * ROWS))):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[rows, part] == right[rows, part]).sum(axis=1)
        stay = matches >= least
        rows, matches = rows[stay], matches[stay]
        if not len(rows):
            break
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``class`` (a digest of the word sequence, null without words), ``n_shingles``, ``signature``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = batch.column("doc_id")
            for begin, texts in blocks(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, shingle)
                same = [hashlib.blake2b(b" ".join(t.translate(_LOWER).split()), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets, strict=True)]
                signs = [row.tobytes() if len(s) else None for row, s in zip(signatures(sets), sets, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(texts)), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "class", "n_shingles", "signature"])

    return docs.mapInArrow(run, "doc_id long, class binary, n_shingles long, signature binary")


def pruned(pairs: DataFrame, signs: DataFrame, threshold_percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` that Bayesian verification of their signatures keeps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.array(survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), threshold_percent))
                yield batch.select(["a", "b"]).take(rows)

    return _both(pairs, signs, "signature", "sa", "sb").mapInArrow(run, "a long, b long")


def _both(pairs: DataFrame, values: DataFrame, value: str, left: str, right: str) -> DataFrame:
    """``a``, ``b`` and the values of both. ``a`` can be a hot key; it is joined last, between an exchange and a plain scan."""
    second = values.select(F.col("doc_id").alias("b"), F.col(value).alias(right))
    first = values.select(F.col("doc_id").alias("a"), F.col(value).alias(left))
    return pairs.join(second, "b").join(first, "a").select("a", "b", left, right)


def sets_of(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id`` and ``shingles`` (sorted distinct hashes as bytes) of the documents in ``ids`` (``id``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for begin, texts in blocks(batch.column("text").to_pylist()):
                sets = [s.tobytes() for s in shingle_sets(texts, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    ids = checkpointed(ids.distinct())
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return checkpointed(docs.join(ids, docs["doc_id"] == F.col("id"), "left_semi").mapInArrow(run, "doc_id long, shingles binary").dropDuplicates(["doc_id"]))


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, threshold_percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                mine, theirs = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * common >= threshold_percent * (len(mine) + len(theirs) - common):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, shingle)
    return _both(pairs, sets, "shingles", "x", "y").mapInArrow(run, "a long, b long")


def across(members: DataFrame, threshold_percent: int) -> DataFrame:
    """Links between different components of a bucket; ``members``: ``bucket``, ``n``, ``doc_id``, ``component``, ``signature``, ``shingles`` (hashes as bytes).

    A bucket's members are dealt to blocks, and each pair of blocks is a group of its own, so a large
    bucket is spread over many tasks. A pair is compared in the first bucket that it shares. A group gives
    fewer links than it has components, enough to connect what is linked.
    """
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), many).cast("int")
    dealt = members.withColumn("many", many).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component", "own", "signature", "shingles")

    def linked(key: tuple[int, int, int], group: list[tuple]) -> list[tuple[int, int]]:
        ids, comp, own = (np.array([r[k] for r in group], np.int64) for k in (0, 1, 2))
        signs = np.frombuffer(b"".join(r[3] for r in group), np.uint16).reshape(-1, BANDS * ROWS)
        out = []
        for x in range(len(group)):
            others = np.flatnonzero((comp != comp[x]) & (ids > ids[x]) & (own != own[x] if key[1] != key[2] else True))
            if not len(others):
                continue
            others = others[survivors(np.broadcast_to(signs[x], (len(others), BANDS * ROWS)), signs[others], threshold_percent)]
            same = (signs[others] == signs[x]).reshape(-1, BANDS, ROWS).all(axis=2)
            mine = np.frombuffer(group[x][4], np.uint64)
            for y in others[same.argmax(axis=1) == key[0] & 63]:
                if comp[y] == comp[x]:
                    continue
                theirs = np.frombuffer(group[y][4], np.uint64)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * common >= threshold_percent * (len(mine) + len(theirs) - common):
                    out.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key, found = None, []
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "doc_id", "component", "own", "signature", "shingles")]
            for bucket, i, j, *row in zip(*columns, strict=True):
                if (bucket, i, j) != key:
                    found += linked(key, group) if len(group) > 1 else []
                    key, group = (bucket, i, j), []
                group.append(tuple(row))
        found += linked(key, group) if len(group) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row per document (``doc_id``, ``text``; other columns are ignored) with its near-duplicate component.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle``-word shingles (lower-cased A-Z;
    all words where they are fewer) is at least ``threshold_percent`` percent. ``n_shingles``: the set's size;
    ``component_id``: the smallest id reachable over links; ``kept``: whether that is the row's own id.
    Texts without words, and null, have no shingles and are linked with nothing; a null id is linked with
    nothing, has a null component and is kept; rows of one id are one document, a row each; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = checkpointed(signed(source, shingle))
    usable = signs.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    classes = checkpointed(usable.groupBy("class").agg(F.min("doc_id").alias("first")))
    heads = checkpointed(usable.join(classes, "class").where(F.col("doc_id") == F.col("first")).select("doc_id", "signature").dropDuplicates(["doc_id"]))

    def band(i: int) -> Column:
        """A hash of the band whose lower 6 bits are the band's number."""
        return F.xxhash64(F.substring("signature", 1 + 2 * ROWS * i, 2 * ROWS)).bitwiseAND(-64).bitwiseOR(i)

    keyed = heads.select("doc_id", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("bucket"))
    sizes = checkpointed(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = checkpointed(keyed.join(sizes, "bucket"))
    met = checkpointed(members.groupBy("doc_id").agg(F.sum("n").alias("met")))
    leaders = checkpointed(members.join(met, "doc_id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("d"))).alias("top")).select("bucket", (-F.col("top.d")).alias("leader")))
    pairs = members.join(leaders, "bucket").where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = checkpointed(verified(checkpointed(pruned(pairs, heads, threshold_percent)), source, shingle, threshold_percent))

    joined = components(links)
    placed = checkpointed(members.join(joined, members["doc_id"] == joined["node"], "left").select("bucket", "n", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    split = checkpointed(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"))
    still = checkpointed(placed.join(split, "bucket"))
    sets = sets_of(still.select(F.col("doc_id").alias("id")), source, shingle)
    joined = components(links.union(checkpointed(across(still.join(heads, "doc_id").join(sets, "doc_id"), threshold_percent))))

    whole = classes.join(joined, classes["first"] == joined["node"], "left").select("class", F.coalesce("component", "first").alias("component"))
    final = checkpointed(whole)
    return (
        signs.select("doc_id", "class", "n_shingles").join(final, "class", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(node, top) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
k AS (SELECT node, min(top) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id, coalesce(k.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = w.doc_id
"""
