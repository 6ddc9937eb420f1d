"""Operator 10: language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased UTF-8 bytes and an end symbol. Each byte is eight binary decisions, most
significant bit first; the decisions made so far pick one of 255 binary predictors. Each predictor has
a tree of contexts, the last 0 to ``DEPTH`` bytes, and each context keeps the bits it has seen. A
context's own probability is the Krichevsky-Trofimov estimate Pe; its weighted one is

    Pw = Pe / 2 + product of Pw over the contexts that are one byte longer / 2   (deepest: Pw = Pe),

so that all depths are mixed by how well they have coded the training texts. The tree is frozen after
training; a text's code length is the sum of its bytes' under the mixture.

All this depends on the training texts only through the counts of ``DEPTH + 1`` consecutive bytes
(grams). They are counted in the tasks, added up by one shuffle, and dealt in ranges of their contexts, read from the
last byte back, so that a subtree lies in one partition or in neighbouring ones, and partitions are of
one size however common a context is. Only contexts on the two edges of a range can be in several partitions; these few
nodes' counts and weights are put together on the driver, and then each partition gives its grams their log-probabilities.
Grams that only held-out texts have are counted too, as zero, so the table has every gram needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed
from ._text import LOWER, Words, blocks, word_table

DEPTH = 5
#: Ends a text; UTF-8 has no such byte. Texts begin as if after DEPTH zero bytes.
END = 0xFF
_WORDS = word_table("white")
_LOG2 = np.log(2.0)
#: Rows that a counting task gathers before it passes them on.
HELD_ROWS = 2_000_000
WORD, GRAM, END_TOKEN = 0, 1, 2


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, in order, as numbers (the coded byte is the lowest), and where each text's begin."""
    joined = np.frombuffer(b"".join(bytes(DEPTH) + t + bytes([END]) for t in texts), np.uint8)
    data = LOWER[joined].astype(np.uint64)
    size = len(data) - DEPTH
    out = np.zeros(size, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | data[k : k + size]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    begin = first[:-1] + DEPTH * np.arange(len(texts))
    # Between two texts, the windows that end in padding code nothing.
    return out[np.arange(first[-1]) + np.repeat(begin - first[:-1], lengths)], first


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place.reshape(-1), np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``kind``, ``key``, ``n``: how often the rows marked ``train`` have each word and gram, and end; 0 if only others have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        rows, ends = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, ends
            for kind, parts in held.items():
                if parts:
                    keys, n = _summed(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
                parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array([END_TOKEN], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], ["kind", "key", "n"])
            rows = ends = 0

        for batch in batches:
            train = np.array(batch.column("train").to_pylist(), bool)
            for begin, texts in blocks(batch.column("text").to_pylist(), 2 << 20):
                mine = train[begin : begin + len(texts)]
                ends += int(mine.sum())
                words = Words(texts, _WORDS)
                found, first = grams(texts)
                for kind, keys, sizes in ((WORD, words.hashes, words.counts()), (GRAM, found, np.diff(first))):
                    taught = np.repeat(mine, sizes)
                    unique, n = np.unique(keys[taught], return_counts=True)
                    others = np.setdiff1d(keys[~taught], unique) if kind == GRAM else keys[:0]
                    held[kind].append((np.concatenate([unique, others]), np.concatenate([n, np.zeros(len(others), np.int64)])))
                    rows += len(unique) + len(others)
                if rows > HELD_ROWS:
                    for kind, parts in held.items():
                        held[kind] = [_summed(parts)]
                    rows = sum(len(parts[0][0]) for parts in held.values())
                    if rows > HELD_ROWS // 2:
                        yield from flush()
        yield from flush()

    counted = docs.select("train", "text").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 1/2, by Stirling's series after a shift by 8."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes at ``depth`` above these nodes."""
    return (((keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | (keys & np.uint64(255))


def mixed(own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of Pw, and the share of Pe in it."""
    weighted = np.logaddexp(own, deeper) - _LOG2
    return weighted, np.exp(own - _LOG2 - weighted)


#: Contexts of so many bytes, and those below them, lie in one partition; such a context has at most 65,536 grams.
SPLIT = DEPTH - 1
#: Grams that a partition is to have.
PART_ROWS = 300_000


def newest_first(key: Column) -> Column:
    """The last ``SPLIT`` context bytes of a gram as a number, the last byte highest: the contexts of a subtree are neighbours in this order."""
    byte = [F.shiftrightunsigned(key, 8 * (k + 1)).bitwiseAND(255) for k in range(SPLIT)]
    return reduce(Column.bitwiseOR, (F.shiftleft(b, 8 * (SPLIT - 1 - k)) for k, b in enumerate(byte)))


class Levels:
    """The nodes that some grams' bits visit, by depth; a node's key is its context and its predictor.

    The grams are all those whose contexts lie between two in the order of ``newest_first``. So a node is complete here
    unless its context ends the first or the last of them: ``shared`` marks these, and the root's.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte, context = keys & np.uint64(255), keys >> np.uint64(8)
        bit = np.arange(8, dtype=np.uint64)[:, None]
        predictor = (np.uint64(1) << bit) | (byte[None, :] >> (np.uint64(8) - bit))
        self.ones = ((byte[None, :] >> (np.uint64(7) - bit)) & np.uint64(1)).astype(bool)
        weight = np.broadcast_to(counts.astype(float), predictor.shape)
        unique, place = np.unique(((context[None, :] << np.uint64(8)) | predictor).reshape(-1), return_inverse=True)
        self.place = place.reshape(predictor.shape).astype(np.int32)  # of each bit's deepest node
        flat = self.place.reshape(-1)
        self.keys, self.above = {DEPTH: unique}, {}
        self.ones_n = {DEPTH: np.bincount(flat, (weight * self.ones).reshape(-1), len(unique))}
        self.zeros_n = {DEPTH: np.bincount(flat, (weight * ~self.ones).reshape(-1), len(unique))}
        for d in range(DEPTH - 1, -1, -1):
            self.keys[d], place = np.unique(parents(self.keys[d + 1], d), return_inverse=True)
            self.above[d + 1] = place.reshape(-1)
            self.zeros_n[d], self.ones_n[d] = (np.bincount(self.above[d + 1], n[d + 1], len(self.keys[d])) for n in (self.zeros_n, self.ones_n))
        order = np.zeros(len(keys), np.uint64)
        for k in range(SPLIT):
            order = (order << np.uint64(8)) | ((context >> np.uint64(8 * k)) & np.uint64(255))
        ends = context[[order.argmin(), order.argmax()]]
        self.shared = {d: np.isin(self.keys[d] >> np.uint64(8), ends & np.uint64((1 << 8 * d) - 1)) for d in range(SPLIT)}
        weighted = log_kt(self.zeros_n[DEPTH], self.ones_n[DEPTH])
        self.leaf, self.deeper = {}, {}
        for d in range(DEPTH - 1, -1, -1):
            whole = weighted if d + 1 >= SPLIT else np.where(self.shared[d + 1], 0.0, weighted)
            self.deeper[d] = np.bincount(self.above[d + 1], whole, len(self.keys[d]))
            weighted, self.leaf[d] = mixed(log_kt(self.zeros_n[d], self.ones_n[d]), self.deeper[d])

    def partial(self) -> tuple[np.ndarray, ...]:
        """Of each shared node: depth, key, zeros, ones, and the sum of log Pw over the complete nodes right below it."""
        at = [np.flatnonzero(self.shared[d]) for d in range(SPLIT)]
        depth = np.repeat(np.arange(SPLIT, dtype=np.int32), [len(x) for x in at])
        return depth, *(np.concatenate([x[d][at[d]] for d in range(SPLIT)]) for x in (self.keys, self.zeros_n, self.ones_n, self.deeper))

    def complete(self, nodes: list[tuple[np.ndarray, ...]]) -> None:
        """Takes the shared nodes' counts and shares of Pe from ``nodes``, as ``resolved`` gives them."""
        for d, (names, zeros, ones, leaf) in enumerate(nodes):
            mine = np.flatnonzero(self.shared[d])
            at = np.searchsorted(names, self.keys[d][mine])
            self.zeros_n[d][mine], self.ones_n[d][mine], self.leaf[d][mine] = zeros[at], ones[at], leaf[at]

    def bits(self) -> np.ndarray:
        """For each bit of each gram, its probability under the mixture of all depths."""
        chance = []  # by node, of a zero and of a one; a node's mixture needs only its own way up
        for d in range(DEPTH + 1):
            total = self.zeros_n[d] + self.ones_n[d] + 1
            chance.append([(n[d] + 0.5) / total for n in (self.zeros_n, self.ones_n)])
        place, out = self.place, None
        for d in range(DEPTH, -1, -1):
            own = np.where(self.ones, chance[d][1][place], chance[d][0][place])
            out = own if out is None else (leaf := self.leaf[d][place]) * own + (1 - leaf) * out
            if d:
                place = self.above[d][place]
        return out


def resolved(depth: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each depth above ``SPLIT`` the shared nodes in order, their counts, and the share of Pe; the sums are over all partitions."""
    out: list[tuple[np.ndarray, ...]] = []
    below: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))
    for d in range(SPLIT - 1, -1, -1):
        mine = np.flatnonzero(depth == d)
        mine = mine[np.argsort(node[mine])]
        names, children = node[mine], deeper[mine]
        children = children + np.bincount(np.searchsorted(names, parents(below[0], d)), below[1], len(names))
        weighted, leaf = mixed(log_kt(zeros[mine], ones[mine]), children)
        below = names, weighted
        out.insert(0, (names, zeros[mine], ones[mine], leaf))
    return out


def gram_scores(counts: DataFrame) -> DataFrame:
    """``key`` and ``score`` (log10 probability of its last byte after the others) of the grams in ``counts`` (``key``, ``n``)."""
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-counts.count() // PART_ROWS))
    dealt = checkpointed(counts.select("key", "n").repartitionByRange(parts, newest_first(F.col("key"))))

    def gathered(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        tables = [(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), b.column("n").to_numpy(zero_copy_only=False)) for b in batches]
        return (np.concatenate([k for k, _ in tables]), np.concatenate([n for _, n in tables])) if tables else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = gathered(batches)
        if len(keys):
            depth, node, *sums = Levels(keys, n).partial()
            yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(node.view(np.int64)), *map(pa.array, sums)], ["depth", "node", "zeros", "ones", "deeper"])

    # At most 255 predictors of two contexts of each depth for a partition, whatever the partition holds.
    rows = dealt.mapInArrow(edges, "depth int, node long, zeros double, ones double, deeper double").groupBy("depth", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("deeper")).toArrow()
    depth, node, zeros, ones, deeper = (rows.column(i).to_numpy() for i in range(5))
    shipped = spark.sparkContext.broadcast(resolved(depth, node.astype(np.int64).view(np.uint64), zeros, ones, deeper))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = gathered(batches)
        if len(keys):
            tree = Levels(keys, n)
            tree.complete(shipped.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.log10(tree.bits()).sum(axis=0))], ["key", "score"])

    return dealt.mapInArrow(scored, "key long, score double")


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    """Values of the keys in a table of sorted keys and values."""
    names, values = table
    if not len(names):
        return np.full(len(keys), missing)
    unique, place = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(names, unique), len(names) - 1)
    return np.where(names[at] == unique, values[at], missing)[place.reshape(-1)]


def _table(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("key", value).toArrow()
    keys, values = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def score(docs: DataFrame, training: Column, *, max_table_rows: int = 8_000_000, common_words: int = 100_000) -> DataFrame:
    """One row per document (``doc_id``, ``text``; other columns are ignored), with the model learnt from those for which ``training`` holds.

    ``n_tokens`` (words, and an end), ``n_known`` (tokens with a training count), ``train_tokens``;
    ``base_score``: add-one unigram log10 probability of the tokens; ``score``: the context-tree model's
    log10 probability of the lower-cased text and its end; ``bits_per_byte``: its code length by bytes, the end counted. Null
    and empty texts are an end alone; repeated rows get a row each; an empty table gives no rows. Without
    training rows every bit has probability 1/2.

    Tables that go to all workers are of checked size: of word counts the ``common_words`` most frequent,
    of grams all if they are at most ``max_table_rows``. All other look-ups are shuffled joins by word or gram.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = checkpointed(corpus_counts(marked))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    ends = counts.where(F.col("kind") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds, occurrences = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, vocabulary = occurrences + ends, kinds + (ends > 0)
    floor = float(tokens + vocabulary + 1)
    spark = docs.sparkSession

    model = checkpointed(gram_scores(counts.where(F.col("kind") == GRAM).select("key", "n")))
    frequent = words.orderBy(F.desc("n"), "key").limit(common_words)
    tables = spark.sparkContext.broadcast((_table(frequent, "n"), _table(model, "score") if model.count() <= max_table_rows else None))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of kind 2 for each document with what the tables tell, and rows of kind 0 and 1 for words and grams to look up."""
        common, scores = tables.value
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            keys = batch.column("doc_id").to_pylist()
            for begin, texts in blocks(batch.column("text").to_pylist(), 2 << 20):
                m = len(texts)
                mine = numbers[begin : begin + m]
                found = Words(texts, _WORDS)
                owner = np.repeat(np.arange(m), found.counts())
                n = _looked_up(common, found.hashes, -1).astype(np.int64)
                known = n >= 0
                base = np.bincount(owner[known], np.log10((n[known] + 1) / floor), m) + np.log10((ends + 1) / floor)
                n_known = np.bincount(owner[known], n[known] > 0, m).astype(np.int64) + (ends > 0)
                code, first = grams(texts)
                sizes = np.diff(first)
                total = np.add.reduceat(_looked_up(scores, code, np.nan), first[:-1]) if scores else np.zeros(m)
                yield _rows(2, mine, np.zeros(m, np.int64), np.ones(m, np.int64), keys[begin : begin + m], found.counts() + 1, n_known, base, total, sizes)
                for kind, at, key in ((0, owner[~known], found.hashes[~known]), *(() if scores else ((1, np.repeat(np.arange(m), sizes), code),))):
                    order = np.lexsort((key, at))
                    at, key = at[order], key[order]
                    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])])) if len(at) else np.zeros(0, np.int64)
                    yield _rows(kind, mine[at[new]], key[new].view(np.int64), np.diff(np.append(new, len(at))))

    numbered = marked.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = checkpointed(numbered.mapInArrow(run, "kind int, row long, key long, n long, doc_id long, n_tokens long, n_known long, base double, total double, size long"))
    rare = found.where("kind = 0").join(words.select("key", F.col("n").alias("c")), "key", "left").select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("k"), (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(floor))).alias("b"), F.lit(0.0).alias("s"))
    far = found.where("kind = 1").join(model, "key").select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), (F.col("n") * F.col("score")).alias("s"))
    own = found.where("kind = 2")
    more = rare.unionByName(far).groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    total = F.col("total") + F.coalesce("s", F.lit(0.0))
    return own.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total / F.lit(float(np.log10(2))) / F.col("size")).alias("bits_per_byte"),
    )


_NAMES = ["kind", "row", "key", "n", "doc_id", "n_tokens", "n_known", "base", "total", "size"]


def _rows(kind: int, row: np.ndarray, key: np.ndarray, n: np.ndarray, *rest: Iterable) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    more = [pa.array(x, t) for x, t in zip(rest, types, strict=True)] if rest else [pa.nulls(len(row), t) for t in types]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), pa.array(row), pa.array(key), pa.array(n), *more], _NAMES)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % parts == part, F.lit(True))
