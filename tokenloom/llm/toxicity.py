"""Operator 6: toxicity by non-negative positive-unlabelled learning.

A logistic model over occurrences of words and of word beginnings (once, twice, four times) is trained from confirmed toxic documents (P) and a sample of all
training documents as unlabelled text (U). With class prior p the risk is

    p * E_P[loss(+1)] + max(0, E_U[loss(-1)] - p * E_P[loss(-1)]),

whose second term estimates the risk of clean text without clean labels; where a batch makes it
negative, the step ascends instead, so the model can't fit the negative part away. The labels, language, source
and id of a document are no features.

The samples are bounded (parameters), taken by a hash of the id, and reach the driver as feature hashes.
Features are those that positives have clearly oftener than text at large, as counted over all training documents
in one pass. Scoring is a look-up of the model's features, at most ``max_features`` of them, in another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, blocks, mix64, pieces, span_hashes, word_table

_TABLE = word_table("alnum")


#: Word beginnings that are features: so many bytes of longer words.
PREFIXES = (4, 5, 6)
#: A feature has a weight for each of these numbers of occurrences that a text reaches: a long text can have any beginning once by chance.
LEVELS = (1, 2, 4)


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and hashes of all words, then of the word beginnings of each length."""
    found = Words(texts, _TABLE)
    text = np.repeat(np.arange(len(texts)), found.counts())
    yield text, found.hashes
    for n in PREFIXES:
        longer = found.ends - found.starts > n
        starts = found.starts[longer]
        yield text[longer], mix64(span_hashes(found.data, starts, starts + n) + np.uint64(n))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the words and word beginnings of all texts."""
    parts = list(_parts(texts))
    return np.concatenate([t for t, _ in parts]), np.concatenate([h for _, h in parts])


@dataclass(frozen=True)
class Features:
    """Sorted feature hashes that texts are searched for."""

    words: np.ndarray

    @cached_property
    def _likely(self) -> np.ndarray:
        """For the upper 20 bits of a hash, whether a feature has them."""
        table = np.zeros(1 << 20, bool)
        table[(self.words >> np.uint64(44)).astype(np.int64)] = True
        return table

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts, and columns of their features: for a feature at place p of ``words`` the column ``len(LEVELS) * p + k`` if the text has it ``LEVELS[k]`` times."""
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for text, hashes in _parts(texts) if len(self.words) else ():  # a hash is of one part
            likely = self._likely[(hashes >> np.uint64(44)).astype(np.int64)]
            text, hashes = text[likely], hashes[likely]
            place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[place] == hashes
            pairs, n = np.unique(text[known] * len(self.words) + place[known], return_counts=True)
            for k, least in enumerate(LEVELS):
                enough = pairs[n >= least]
                rows.append(enough // len(self.words))
                columns.append(len(LEVELS) * (enough % len(self.words)) + k)
        return np.concatenate(rows), np.concatenate(columns)


@dataclass(frozen=True)
class Model:
    """``score = sigmoid(bias + sum of weights over the columns of a text)``; ``words`` are sorted hashes, of ``len(LEVELS)`` columns each."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def _features(self) -> Features:
        return Features(self.words)

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, column = self._features.found(texts)
        total = self.bias + np.bincount(text, self.weights[column], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def document_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows of ``docs`` have each of the sorted feature hashes, and how many rows there are.

    Each task sends one count for each feature that it met, so the shuffle is bounded by features, not by texts.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Features(words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(words), np.int64), 0
        for batch in pieces(batches):
            for _, texts in blocks(batch.column("text").to_pylist()):
                counts += np.bincount(shipped.value.found(texts)[1], minlength=len(LEVELS) * len(words))[:: len(LEVELS)]
                n += len(texts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(counts[met], n))], ["place", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = rows.column("place").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(len(words), np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return out, int(n[place < 0].sum())


def _lists(docs: DataFrame, split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each row of ``docs`` the sorted distinct values that ``split`` gives with numbers of texts, as views of received buffers; in an order of their own, as tasks end in any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for _, texts in blocks(batch.column("text").to_pylist()):
                text, values = split(texts)
                order = np.lexsort((values, text))
                text, values = text[order], values[order]
                first = np.searchsorted(text, np.arange(len(texts) + 1))
                out += [np.unique(values[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["values"])

    out: list[np.ndarray] = []
    for part in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "values array<long>").toArrow().column("values").chunks:
        values, first = part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()
        out += [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return sorted(out, key=lambda x: (len(x), x.tobytes()))


def word_sets(docs: DataFrame) -> list[np.ndarray]:
    """The distinct feature hashes of each row."""
    return [x.view(np.uint64) for x in _lists(docs, features)]


def presence(docs: DataFrame, words: np.ndarray) -> list[np.ndarray]:
    """The columns of each row's features among ``words``."""
    shipped = docs.sparkSession.sparkContext.broadcast(Features(words))
    return _lists(docs, lambda texts: shipped.value.found(texts))


def choose(positive: list[np.ndarray], count: Callable[[np.ndarray], tuple[np.ndarray, int]], *, max_features: int = 20_000, min_documents: int = 4, min_lift: float = 3.0, min_z: float = 6.0) -> np.ndarray:
    """The sorted features of at least ``min_documents`` of the positives, ``min_lift`` times as common there as in all training
    text, which ``count`` counts, and by ``min_z`` standard deviations; at most ``max_features``, those that tell most.
    """
    words, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *positive]), return_counts=True)
    words, counts = words[counts >= min_documents], counts[counts >= min_documents]
    if not len(words):
        return words
    general, total = count(words)
    p, q = (counts + 0.5) / (len(positive) + 1), (general + 0.5) / (total + 1)
    gain = counts * np.log(p / q)
    z = (counts - len(positive) * q) / np.sqrt(len(positive) * q * (1 - np.minimum(q, 0.999)))
    chosen = np.flatnonzero((p >= min_lift * q) & (z >= min_z))
    return words[np.sort(chosen[np.argsort(-gain[chosen], kind="stable")[:max_features]])]


def risk(theta: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> tuple[float, np.ndarray]:
    """The second term of the risk, and the gradient to descend: that of the whole risk, or, where the term is negative, of its opposite.

    ``sides``: of P and of U the columns of all rows', the rows that have them, and the number of rows; the bias is last in ``theta``.
    """
    margins = [theta[-1] + np.bincount(owner, theta[flat], n) for flat, owner, n in sides]
    chance = [1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in margins]
    pull = [prior * chance[0] / sides[0][2], chance[1] / sides[1][2]]  # of the losses as clean text
    clean = float(np.logaddexp(0, margins[1]).mean() - prior * np.logaddexp(0, margins[0]).mean())
    parts = [prior * (chance[0] - 1) / sides[0][2] - pull[0], pull[1]] if clean >= 0 else [pull[0], -pull[1]]
    gradient = np.zeros_like(theta)
    for weight, (flat, owner, _) in zip(parts, sides, strict=True):
        gradient[:-1] += np.bincount(flat, weight[owner], len(theta) - 1)
        gradient[-1] += weight.sum()
    return clean, gradient


def fit(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Non-negative PU training by Adam over the whole samples, rows of columns of ``words``. Without features, positives or unlabelled texts the model scores the prior."""
    prior = min(max(prior, 1e-4), 0.9)
    theta = np.append(np.zeros(len(LEVELS) * len(words)), np.log(prior / (1 - prior)))
    if not len(words) or not positive or not unlabelled:
        return Model(words[:0], theta[:0], float(theta[-1]))
    sides = [(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]), len(held)) for held in (positive, unlabelled)]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = risk(theta, sides, prior)[1] + decay * np.append(theta[:-1], 0.0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        falling = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        theta = theta - falling * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, training: Column, *, max_positive: int = 4000, max_unlabelled: int = 8000, **options: float) -> Model:
    """A model from the rows of ``docs`` (``doc_id``, ``text``) for which ``training`` holds.

    P: those that ``labels`` (``doc_id``, ``toxic``) marks 1; U: a sample of all of them. The class prior is the share
    of 1 among training labels. ``max_positive`` and ``max_unlabelled`` bound the samples, which are the rows
    with the smallest hashes of their ids; ``options`` are those of ``choose``. Null labels and null ids teach nothing;
    repeated labels count once, as 1 if any is.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") == 1).alias("positive"))
    taught = docs.where(training & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = taught.select("doc_id")
    shared = ids.join(marks, ids["doc_id"] == marks["label_id"])
    n, k = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0))).first()
    chosen = shared.where("positive").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    others = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled)
    positive = taught.join(F.broadcast(chosen), "doc_id").select("text").distinct()  # copies tell nothing more
    words = choose(word_sets(positive), lambda found: document_counts(taught, found), **options)
    return fit(words, presence(positive, words), presence(taught.join(F.broadcast(others), "doc_id"), words), (k / n) if n else 0.1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but those named ``score`` and ``predicted``, and these: the model's probability of toxic text (null text: as empty) and whether it is at least 0.5."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    schema = kept.select("*").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            values = np.concatenate([shipped.value.score(t) for _, t in blocks(texts)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % parts == part, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``; the model learns from the others' labels alone.

    Empty and null texts get the bias's score; repeated rows get a row each; empty tables give no rows or the prior's scores.
    """
    held = held_out(F.col("doc_id"))
    model = train(docs, labels, ~held, **options)
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", held.alias("held_out"), "score", "predicted")
