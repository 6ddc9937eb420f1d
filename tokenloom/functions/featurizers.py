"""Featurizers: immutable specifications that compile to a column of features, a bag as an array of strings.

A featurizer enumerates grams of a sequence, which is a string (of characters) or an array of tokens.
Two groups of one feature are joined by ``SEPARATOR``; a feature with an empty group is the other group alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x01"
#: Marks features of a sequence's end.
TOE = "~"


@dataclass(frozen=True)
class Text:
    """A string as a sequence of characters."""

    column: Column

    def size(self) -> Column:
        return F.length(self.column)

    def cut(self, start: Column, n: Column | int) -> Column:
        """The stretch of ``n`` from ``start`` (from 0) as a feature."""
        return F.substring(self.column, start + 1, F.lit(n) if isinstance(n, int) else n)

    def part(self, start: Column, n: int) -> Text:
        return Text(self.cut(start, n))


@dataclass(frozen=True)
class Tokens:
    """An array of tokens; a gram's tokens are joined by ``between``."""

    column: Column
    between: str = " "

    def size(self) -> Column:
        return F.size(self.column)

    def cut(self, start: Column, n: Column | int) -> Column:
        return F.array_join(F.slice(self.column, start + 1, F.lit(n) if isinstance(n, int) else n), self.between)

    def part(self, start: Column, n: int) -> Tokens:
        return Tokens(F.slice(self.column, start + 1, n), self.between)


Sequence = Text | Tokens


def no_features() -> Column:
    return F.array().cast("array<string>")


class Featurizer:
    """``features`` gives a sequence's bag, null for a null sequence."""

    def features(self, sequence: Sequence) -> Column:
        return F.when(sequence.column.isNotNull(), self.bag(sequence))

    def bag(self, sequence: Sequence) -> Column:
        raise NotImplementedError

    def __add__(self, other: Featurizer) -> Multi:
        return Multi((self, other))


def _each(sequence: Sequence, n: int, gram: Callable[[Column], Column]) -> Column:
    """``gram(x)`` for each x at which n elements stand."""
    count = sequence.size() - n
    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), gram)).otherwise(no_features())


@dataclass(frozen=True)
class SkipScheme(Featurizer):
    """Two groups with a gap, each of a range of sizes; with a gap of 0, also the contiguous stretches of both groups' sizes together."""

    first: tuple[int, int]
    gap: tuple[int, int]
    second: tuple[int, int]

    def shapes(self) -> list[tuple[int, int, int]]:
        """``(first, gap, second)`` sizes; gap 0 and second 0 for a contiguous stretch."""
        (a0, a1), (g0, g1), (b0, b1) = self.first, self.gap, self.second
        apart = [(a, g, b) for a in range(a0, a1 + 1) for g in range(max(1, g0), g1 + 1) for b in range(b0, b1 + 1)]
        together = [(w, 0, 0) for w in range(max(1, a0 + b0), a1 + b1 + 1)] if g0 == 0 else []
        return apart + together

    def bag(self, sequence: Sequence) -> Column:
        def shape(a: int, g: int, b: int) -> Column:
            if a and b:
                return _each(sequence, a + g + b, lambda x: F.concat(sequence.cut(x, a), F.lit(SEPARATOR), sequence.cut(x + (a + g), b)))
            return _each(sequence, a + g + b, lambda x: sequence.cut(x, a) if a else sequence.cut(x + g, b))

        shapes = [shape(*s) for s in self.shapes()]
        return F.concat(*shapes) if shapes else no_features()


def ngram(n: int) -> SkipScheme:
    """All contiguous stretches of n elements."""
    return SkipScheme((0, 0), (0, 0), (n, n))


def skipgram(first: int, gap: tuple[int, int], second: int) -> SkipScheme:
    """A group, a gap of some sizes, and a group."""
    return SkipScheme((first, first), gap, (second, second))


@dataclass(frozen=True)
class BookEnds(Featurizer):
    """The inner featurizer on the first ``head`` and the last ``toe`` elements; with ``tagged``, features of the end are marked."""

    head: int
    toe: int
    inner: Featurizer
    tagged: bool = True

    def bag(self, sequence: Sequence) -> Column:
        size = sequence.size()
        front = F.when(size >= self.head, self.inner.bag(sequence.part(F.lit(0), self.head))).otherwise(no_features())
        end = self.inner.bag(sequence.part(F.greatest(size - self.toe, F.lit(0)), self.toe))
        end = F.transform(end, lambda f: F.concat(F.lit(TOE), f)) if self.tagged else end
        return F.concat(front, F.when(size >= self.toe, end).otherwise(no_features()))


@dataclass(frozen=True)
class Multi(Featurizer):
    """The bags of several featurizers together."""

    parts: tuple[Featurizer, ...]

    def bag(self, sequence: Sequence) -> Column:
        return reduce(lambda a, b: F.concat(a, b), [p.bag(sequence) for p in self.parts], no_features())


@dataclass(frozen=True)
class Empty(Featurizer):
    """No features."""

    def bag(self, sequence: Sequence) -> Column:
        return no_features()


@dataclass(frozen=True)
class Custom(Featurizer):
    """A featurizer from a function of a sequence to an array column."""

    function: Callable[[Sequence], Column]

    def bag(self, sequence: Sequence) -> Column:
        return self.function(sequence)


@dataclass(frozen=True)
class Mapped(Featurizer):
    """The inner featurizer's features through a function of a column; those that it gives null stay with ``keep_unseen`` and go without."""

    inner: Featurizer
    function: Callable[[Column], Column]
    keep_unseen: bool = False

    def bag(self, sequence: Sequence) -> Column:
        to = F.transform(self.inner.bag(sequence), lambda f: F.coalesce(self.function(f), f) if self.keep_unseen else self.function(f))
        return F.filter(to, lambda f: f.isNotNull())


def filter_map(features: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """``feature``, ``mapped``: the distinct ``feature`` of a table for which the function gives a value."""
    return features.select("feature").distinct().withColumn("mapped", function(F.col("feature"))).where("mapped is not null")


DEFAULT = skipgram(2, (0, 3), 2) + BookEnds(4, 4, ngram(2))


@dataclass(frozen=True)
class FourGrams(Featurizer):
    """Four-character features with markers ``$`` and ``#`` at a string's ends, and skip grams of three steps back."""

    def bag(self, sequence: Sequence) -> Column:
        size = sequence.size()
        at = lambda i: sequence.cut(i, 1)
        dollar, hash_ = F.lit("$"), F.lit("#")
        ends = F.when(size > 1, F.array(F.concat(dollar, at(F.lit(0)), at(F.lit(1)), hash_), F.concat(hash_, at(size - 2), at(size - 1), dollar))).otherwise(no_features())
        inner = F.when(size > 2, F.array(F.concat(dollar, at(F.lit(1)), at(F.lit(2)), hash_), F.concat(hash_, at(size - 3), at(size - 2), dollar))).otherwise(no_features())

        def back(step: int) -> Column:
            """Features of neighbours b, c = b + 1 with a = b - step, which reach a - 1 or the string's start."""
            return F.when(
                size - 1 - step > 0,
                F.transform(F.sequence(F.lit(0), F.greatest(size - 2 - step, F.lit(0))), lambda a: F.when(a > 0, F.concat(at(a - 1), at(a), at(a + step), at(a + (step + 1)))).otherwise(F.concat(at(F.lit(0)), at(a + step), at(a + (step + 1)), hash_))),
            ).otherwise(no_features())

        return F.concat(ends, inner, *[back(k) for k in (1, 2, 3)])
