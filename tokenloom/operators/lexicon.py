"""Budgeted search of words in words, by arrays; the rows are those of ``search``.

A word is its own label, so that its features are made where they are needed and never stored. What all tasks read are the
words, the features' occurrences and the first postings of each feature that a query looks up, a few bytes each: they are sent to
all workers. A worker compares what a query's stop rules let it reach. No pair of words is shuffled.

Words consist of the letters A to Z, and a feature of at most five symbols: letters, the separator, the end mark. Beyond ``MAX_WORDS`` words or for
other featurizers and metrics, ``FuzzyIndex`` and ``search`` give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.featurizers import SEPARATOR, TOE, BookEnds, Featurizer, Mapped, Multi, SkipScheme
from ..functions.metrics import BITS, HEX_DIGITS, Hamming, Jaccard, Overlap
from . import search
from ._store import checkpointed
from .evaluate import comparisons_per_lookup
from .index import FuzzyIndex, points, posting_order
from .search import SearchParams

#: Symbols of features in the order of their bytes; a feature is a number of SYMBOLS of them, filled up with the first.
ALPHABET = "\0" + SEPARATOR + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + TOE
SYMBOLS = 5
#: Words that are sent to all workers at most; queries that are searched at once; words whose features are made at once.
MAX_WORDS, QUERIES, BATCH = 16_000_000, 256, 4096
#: Postings of the least hashes that are ranked for each posting wanted, before all are.
SPARE = 3


@dataclass(frozen=True)
class Shape:
    """A gram: ``first`` letters, ``gap``, ``second`` letters; within the ``head`` first or the ``toe`` last letters, if not 0."""

    first: int
    gap: int
    second: int
    head: int = 0
    toe: int = 0
    tagged: bool = False

    def symbols(self) -> list[int | str]:
        """Offsets of letters, and other symbols."""
        a, b = self.first, self.second
        both = [SEPARATOR] if a and b else []
        return [TOE] * self.tagged + [*range(a)] + both + [*range(a + self.gap, a + self.gap + b)]


def shapes(featurizer: Featurizer) -> list[Shape] | None:
    """The grams of a featurizer; null if it can't be told."""
    if isinstance(featurizer, SkipScheme):
        found = [Shape(*s) for s in featurizer.shapes()]
    elif isinstance(featurizer, BookEnds) and isinstance(featurizer.inner, SkipScheme):
        inner = featurizer.inner.shapes()
        found = [Shape(*s, head=featurizer.head) for s in inner] + [Shape(*s, toe=featurizer.toe, tagged=featurizer.tagged) for s in inner]
    elif isinstance(featurizer, Multi):
        parts = [shapes(p) for p in featurizer.parts]
        found = None if None in parts else [s for p in parts for s in p]
    else:
        return None
    return found if found is not None and all(1 <= len(s.symbols()) <= SYMBOLS and (s.first or s.second) for s in found) else None


def supported(featurizer: Featurizer, params: SearchParams) -> bool:
    inner = featurizer.inner if isinstance(featurizer, Mapped) else featurizer
    return bool(shapes(inner)) and type(params.metric) in (Jaccard, Overlap, Hamming) and params.depth * params.breadth < 2000 and params.max_comparisons < 2000 and params.use_best_after > 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def run_places(keys: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal ones."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of strings."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    blob = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return blob, offsets - offsets[0]


def strings(blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(blob[ranges(starts, sizes)])]).cast(pa.string())


def grams(all_shapes: list[Shape], blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and numbers of all features of words."""
    if len(blob) and (blob.min() < 65 or blob.max() > 90):
        raise ValueError("words must consist of the letters A to Z")
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    at = (np.arange(len(blob)) - np.repeat(offsets[:-1], size)).astype(np.int32)
    left = np.repeat(size, size).astype(np.int32) - at
    letters = np.concatenate([blob.astype(np.int32) - 63, np.zeros(64, np.int32)])
    owners, keys = [], []
    for s in all_shapes:
        span = s.first + s.gap + s.second
        fits = left >= span
        if s.head:
            fits &= (at + span <= s.head) & (at + left >= s.head)
        if s.toe:
            fits &= (left <= s.toe) & (at + left >= s.toe)
        here = np.flatnonzero(fits)
        key = np.zeros(len(here), np.int32)
        symbols = s.symbols()
        for symbol in symbols:
            key *= len(ALPHABET)
            key += ALPHABET.index(symbol) if isinstance(symbol, str) else letters[here + symbol]
        owners.append(owner[here])
        keys.append(key * len(ALPHABET) ** (SYMBOLS - len(symbols)))
    return np.concatenate(owners), np.concatenate(keys)


def spelled(keys: np.ndarray) -> list[str]:
    """The features of numbers."""
    columns = [np.array(list(ALPHABET), dtype="U1")[keys // len(ALPHABET) ** (SYMBOLS - 1 - i) % len(ALPHABET)] for i in range(SYMBOLS)]
    return ["".join(c).rstrip("\0") for c in zip(*columns, strict=True)]


@dataclass
class Dictionary:
    """All features of words and queries: numbers before the featurizer's mapping, and by those the ranks of features among all (-1: none); occurrences in words by rank; hashes by rank."""

    shapes: list[Shape]
    raw: np.ndarray
    rank: np.ndarray | None
    freq: np.ndarray
    hashes: np.ndarray | None = None

    def __post_init__(self):
        # A set of numbers as bits, with the members before each word of 64 bits.
        size = len(ALPHABET) ** SYMBOLS // 64 + 1
        self.bits, mark = np.zeros(size, np.uint64), np.uint64(1)
        np.bitwise_or.at(self.bits, self.raw >> 6, mark << (self.raw & 63).astype(np.uint64))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int32)[:-1]]).astype(np.int32)

    def bag(self, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words, ranks and places among equal ones of all features, in that order; features of each word."""
        owner, key = grams(self.shapes, blob, offsets)
        word = key >> 6
        low = (np.uint64(1) << (key & 63).astype(np.uint64)) - np.uint64(1)
        rank = self.before[word] + np.bitwise_count(self.bits[word] & low)
        if self.rank is not None:
            rank = self.rank[rank]
            owner, rank = owner[rank >= 0], rank[rank >= 0]
        both = np.sort(owner.astype(np.int64) << 32 | rank)
        owner = both >> 32
        return owner, both & 0xFFFFFFFF, run_places(both), np.bincount(owner, minlength=len(offsets) - 1)

    @cached_property
    def votes(self) -> np.ndarray:
        """A row of bits for each feature."""
        return np.stack([(self.hashes >> i & 1).astype(np.uint8) for i in range(BITS)], axis=1)

    def signs(self, owner: np.ndarray, rank: np.ndarray, n: np.ndarray) -> np.ndarray:
        """SimHashes of bags."""
        out, ends = np.zeros(len(n), np.int64), np.cumsum(n)
        some = np.flatnonzero(n)
        if len(some):
            sums = np.add.reduceat(self.votes[rank], (ends - n)[some], axis=0, dtype=np.int64)
            out[some] = ((2 * sums > n[some, None]).astype(np.int64) << np.arange(BITS)).sum(axis=1)
        return out


@dataclass
class Lists:
    """Words in order, with their signs, and for each feature the words of its first postings."""

    blob: np.ndarray
    offsets: np.ndarray
    signs: np.ndarray | None
    starts: np.ndarray
    words: np.ndarray

    def taken(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = self.offsets[ids].astype(np.int64), self.offsets[ids + 1].astype(np.int64) - self.offsets[ids]
        return self.blob[ranges(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def named(self, ids: np.ndarray) -> pa.Array:
        starts = self.offsets[ids].astype(np.int64)
        return strings(self.blob, starts, self.offsets[ids + 1] - starts)


def selected(book: Dictionary, owner: np.ndarray, rank: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and their rarest features."""
    one = (place == 0) & (book.freq[rank] > 0)
    order = np.sort(owner[one] << 53 | book.freq[rank[one]] << 21 | rank[one])
    order = order[run_places(order >> 53) < depth]
    return order >> 53, order & 0x1FFFFF


class Searcher:
    """One worker's search of some queries at once."""

    def __init__(self, book: Dictionary, lists: Lists, params: SearchParams):
        self.book, self.lists, self.params = book, lists, params
        self.local = np.zeros(len(book.freq), np.int32)
        self.weights = 512 // (np.floor(np.log2(np.maximum(book.freq, 1))).astype(np.int64) + 1)

    def search(self, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrices of queries by ranks: the words, their similarities, and whether they were compared."""
        params, lists, queries = self.params, self.lists, len(offsets) - 1
        owner, rank, place, n = self.book.bag(blob, offsets)
        asked, feature = selected(self.book, owner, rank, place, params.depth)
        starts, counts = lists.starts[feature], lists.starts[feature + 1] - lists.starts[feature]
        met = lists.words[ranges(starts, counts)].astype(np.int64)
        each = np.sort(np.repeat(asked, counts) << 45 | met << 10 | np.repeat(self.weights[feature], counts))
        pair = each >> 10
        first = np.flatnonzero(run_places(pair) == 0)
        weight = np.add.reduceat(each & 1023, first) if len(first) else first
        pair = pair[first]
        order = np.sort((pair >> 35) << 53 | ((1 << 21) - 1 - weight) << 32 | pair & 0x7FFFFFFF)
        at = run_places(order >> 53)
        order, at = order[at < params.max_comparisons], at[at < params.max_comparisons]
        asked, met = order >> 53, order & 0x7FFFFFFF
        width = int(at.max()) + 1 if len(at) else 1
        words, sims, reached = np.full((queries, width), -1), np.full((queries, width), -1.0), np.zeros((queries, width), bool)
        words[asked, at] = met
        score = self.scorer(owner, rank, n)
        going, low = np.ones(queries, bool), 0
        while low < width and going.any():
            high = min(low + params.use_best_after, width)
            q, k = np.nonzero((words[:, low:high] >= 0) & going[:, None])
            if len(q):
                sims[q, k + low] = score(q, words[q, k + low])
            reached = self.reached(sims, min(high + 1, width)) & (words >= 0)
            low, going = high, reached[:, min(high, width - 1)]
        return words, sims, reached

    def reached(self, sims: np.ndarray, high: int) -> np.ndarray:
        """What the stop rules reach of the first ``high`` ranks."""
        known, k = sims[:, :high], np.arange(1, high + 1)
        none = np.full((len(sims), 1), -2.0)
        top = np.concatenate([none, np.maximum.accumulate(known, axis=1)[:, :-1]], axis=1)
        better = np.maximum.accumulate(np.where((k > 1) & (known > top), k, 0), axis=1)
        better = np.concatenate([np.zeros((len(sims), 1), better.dtype), better[:, :-1]], axis=1)
        ended = (k - better > self.params.use_best_after) | (top > self.params.return_if_gt / 100)
        out = np.zeros(sims.shape, bool)
        out[:, :high] = ~np.logical_or.accumulate(ended, axis=1)
        return out

    def scorer(self, owner: np.ndarray, rank: np.ndarray, n: np.ndarray):
        if isinstance(self.params.metric, Hamming):
            signs = self.book.signs(owner, rank, n)
            return lambda q, words: np.sqrt(1.0 / (np.bitwise_count(signs[q] ^ self.lists.signs[words]) + 1.0))
        mine, column = np.unique(rank, return_inverse=True)
        table = np.zeros((len(n), len(mine) + 1), np.int32)
        np.add.at(table, (owner, column + 1), 1)
        flat, wide = table.ravel(), len(mine) + 1

        def score(q: np.ndarray, words: np.ndarray) -> np.ndarray:
            self.local[mine] = np.arange(1, wide)
            some, which = np.unique(words, return_inverse=True)
            theirs, ranks, place, m = self.book.bag(*self.lists.taken(some))
            columns = self.local[ranks]
            self.local[mine] = 0
            shared = columns > 0
            theirs, columns, place = theirs[shared], columns[shared], place[shared].astype(np.int32)
            counts = np.bincount(theirs, minlength=len(some))
            starts, sizes = (np.cumsum(counts) - counts)[which], counts[which]
            at = ranges(starts, sizes)
            hits = flat[np.repeat(q * wide, sizes) + columns[at]] > place[at]
            sums, ends = np.concatenate([[0], np.cumsum(hits)]), np.cumsum(sizes)
            common, np_ = sums[ends] - sums[ends - sizes], m[which]
            below = n[q] + np_ - common if isinstance(self.params.metric, Jaccard) else np.minimum(n[q], np_)
            return np.where(common == 0, 0.0, common / np.maximum(below, 1))

        return score


def _counted(all_shapes: list[Shape]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(len(ALPHABET) ** SYMBOLS, np.int32), np.zeros(len(ALPHABET) ** SYMBOLS, bool)
        for batch in batches:
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            owner, keys = grams(all_shapes, *texts(batch.column("word")))
            seen[keys] = True
            found, n = np.unique(keys[~asked[owner]], return_counts=True)
            counts[found] += n.astype(np.int32)
        found = np.flatnonzero(seen)
        yield pa.record_batch({"key": found.astype(np.int32), "n": counts[found].astype(np.int64)})

    return run


@dataclass
class Lexicon:
    """Words to search (``word``, each once) for queries (``word``, each once)."""

    words: DataFrame
    queries: DataFrame
    featurizer: Featurizer
    params: SearchParams

    @cached_property
    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Words and queries, in order and numbered."""
        n = int(self.words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        numbered = lambda df: checkpointed(df.select("word").repartitionByRange(n, "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))
        return numbered(self.words), numbered(self.queries)

    def dictionary(self) -> Dictionary:
        words, queries = self.tables
        mapped = self.featurizer if isinstance(self.featurizer, Mapped) else None
        grams_ = shapes(mapped.inner if mapped else self.featurizer)
        both = words.select("word", F.lit(False).alias("asked")).union(queries.select("word", F.lit(True).alias("asked")))
        # Few tasks, as each gives most features.
        rows = both.coalesce(12).mapInArrow(_counted(grams_), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
        raw, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        names, rank, freq = None, None, n
        if mapped:
            names = spelled(raw)
            to = F.coalesce(mapped.function(F.col("f")), F.col("f")) if mapped.keep_unseen else mapped.function(F.col("f"))
            table = words.sparkSession.createDataFrame(pa.table({"i": np.arange(len(raw)), "f": pa.array(names, pa.string())})).select("i", to.alias("f"))
            given = table.toArrow().sort_by("i")["f"].to_pylist()
            names = sorted({g for g in given if g is not None}, key=str.encode)
            ranks = {g: i for i, g in enumerate(names)}
            rank = np.array([-1 if g is None else ranks[g] for g in given], np.int64)
            freq = np.bincount(rank[rank >= 0], weights=n[rank >= 0], minlength=len(names)).astype(np.int64)
        if len(freq) >= 1 << 21 or (len(freq) and freq.max() >= 1 << 31):
            raise ValueError("too many features")
        hashes = None
        names = names if names is not None else spelled(raw)
        if isinstance(self.params.metric, Hamming):
            hashes = np.array([int(hashlib.md5(f.encode()).hexdigest()[:HEX_DIGITS], 16) for f in names], np.int64)
        self.names = names
        return Dictionary(grams_, raw, rank, freq, hashes)

    def lists(self, book: Dictionary, shipped) -> Lists:
        words, queries = self.tables
        depth, breadth = self.params.depth, self.params.breadth

        def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = shipped.value
            used = np.zeros(len(book.freq), bool)
            for batch in batches:
                for low in range(0, batch.num_rows, QUERIES):
                    used[selected(book, *book.bag(*texts(batch.column("word").slice(low, QUERIES)))[:3], depth)[1]] = True
            yield pa.record_batch({"rank": np.flatnonzero(used).astype(np.int32)})

        used = np.zeros(len(book.freq), bool)
        used[queries.select("word").mapInArrow(chosen, "rank int").distinct().toArrow()["rank"].to_numpy()] = True
        # Hashes below this are ranked at first; few features have fewer of them than the postings that are wanted.
        shares = np.maximum(SPARE * breadth, 30) / np.maximum(book.freq, 1)
        below = pa.array(["g" if x >= 1 else f"{int(x * 2**32):08x}" for x in shares], pa.string())
        spark = words.sparkSession
        spelling = spark.sparkContext.broadcast((pa.array(self.names, pa.string()), below))

        def postings(used: np.ndarray, limited: bool) -> DataFrame:
            uses = spark.sparkContext.broadcast(np.packbits(used))

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                book, (features, below) = shipped.value, spelling.value
                wanted = np.unpackbits(uses.value)[: len(book.freq)].astype(bool)
                for batch in batches:
                    for low in range(0, batch.num_rows, BATCH):
                        some = batch.slice(low, BATCH)
                        owner, rank, place, _ = book.bag(*texts(some.column("word")))
                        take = wanted[rank]
                        owner, rank, place = owner[take], rank[take], place[take]
                        yield pa.record_batch(
                            {"rank": rank.astype(np.int32), "feature": features.take(at := pa.array(rank)), "below": below.take(at), "id": some.column("id").take(of := pa.array(owner)), "label": some.column("word").take(of), "occ": (place + 1).astype(np.int32)}
                        )

            rows = words.mapInArrow(run, "rank int, feature string, below string, id long, label string, occ int").withColumn("hash", posting_order())
            kept = rows.where("hash < below") if limited else rows
            # Ids are in the order of labels.
            order = F.row_number().over(W.partitionBy("rank").orderBy("hash", "id", "occ"))
            return kept.select("rank", F.unhex("hash").alias("hash"), "id", "occ").withColumn("prank", order).where(F.col("prank") <= breadth).select("rank", "id")

        found = [postings(used, True).toArrow()]
        ranks = found[0]["rank"].to_numpy()
        short = used & (np.bincount(ranks, minlength=len(used)) < np.minimum(book.freq, breadth))
        if short.any():
            keep = ~short[ranks]
            found = [found[0].filter(pa.array(keep)), postings(short, False).toArrow()]
        rows = pa.concat_tables(found)
        every = words.toArrow().sort_by("id")
        blob, offsets = texts(every["word"].combine_chunks())
        rank, ids = rows["rank"].to_numpy().astype(np.int64), np.searchsorted(every["id"].to_numpy(), rows["id"].to_numpy())
        signs = None
        if isinstance(self.params.metric, Hamming):

            def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                book = shipped.value
                for batch in batches:
                    for low in range(0, batch.num_rows, BATCH):
                        some = batch.slice(low, BATCH)
                        owner, rank, _, n = book.bag(*texts(some.column("word")))
                        yield pa.record_batch({"id": some.column("id"), "sign": book.signs(owner, rank, n)})

            signs = words.mapInArrow(signed, "id long, sign long").toArrow().sort_by("id")["sign"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(used)))]).astype(np.int32)
        return Lists(blob, offsets.astype(np.int32 if len(blob) < 1 << 31 else np.int64), signs, starts, ids[np.argsort(rank, kind="stable")].astype(np.int32))

    def _searched(self, rows, schema: str) -> DataFrame:
        """A table of ``rows(words, words' places, lists, what a search found)`` of some queries at a time."""
        _, queries = self.tables
        book = self.dictionary()
        spark = queries.sparkSession
        lists = spark.sparkContext.broadcast(self.lists(book, shipped := spark.sparkContext.broadcast(book)))
        params = self.params

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shipped.value, lists.value, params)
            for batch in batches:
                for low in range(0, batch.num_rows, QUERIES):
                    some = batch.column("word").slice(low, QUERIES)
                    yield rows(some, searcher.lists, *searcher.search(*texts(some)))

        return queries.select("word").mapInArrow(run, schema)

    @cached_property
    def fits(self) -> bool:
        """Whether arrays hold the words, and all are of letters."""
        odd = [df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("word").rlike("^[A-Z]*$"), F.lit(False))).alias("odd")).first() for df in self.tables]
        return supported(self.featurizer, self.params) and odd[0].n <= MAX_WORDS and not any(r.odd for r in odd)

    def _as_tables(self) -> tuple[FuzzyIndex, DataFrame, SearchParams]:
        return FuzzyIndex.build(self.tables[0].select("word"), self.featurizer), points(self.tables[1].select("word"), self.featurizer), self.params

    def nearest(self) -> DataFrame:
        """``search.nearest``."""
        if not self.fits:
            return search.nearest(*self._as_tables())

        def rows(asked, lists, words, sims, reached):
            best, each = np.where(reached, sims, -1.0).argmax(axis=1), np.arange(len(words))
            some = reached[each, best]
            labels = lists.named(words[each, best][some])
            at = pa.array(np.cumsum(some) - 1, mask=~some)
            return pa.record_batch({"query_id": asked, "label": labels.take(at), "sim": np.where(some, sims[each, best], 0.0)})

        return self._searched(rows, "query_id string, label string, sim double")

    def neighbors(self) -> DataFrame:
        """``search.neighbors``."""
        if not self.fits:
            return search.neighbors(*self._as_tables())

        def rows(asked, lists, words, sims, reached):
            q, k = np.nonzero(reached)
            return pa.record_batch({"query_id": asked.take(pa.array(q)), "rk": (k + 1).astype(np.int32), "label": lists.named(words[q, k]), "sim": sims[q, k]})

        return self._searched(rows, "query_id string, rk int, label string, sim double")

    def comparisons(self) -> DataFrame:
        """``evaluate.comparisons_per_lookup``."""
        if not self.fits:
            return comparisons_per_lookup(*self._as_tables())

        def rows(asked, lists, words, sims, reached):
            n = reached.sum(axis=1)
            return pa.record_batch({"n": np.array([n.sum()], np.int64), "some": np.array([(n > 0).sum()], np.int64)})

        return self._searched(rows, "n long, some long").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.nullif(F.sum("some"), F.lit(0))).alias("comparisons"))
