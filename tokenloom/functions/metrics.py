"""Similarities as columns over shared and total feature counts, and signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a feature's MD5 that vote; 60 bits stay clear of the sign.
HEX_DIGITS = 15
BITS = 4 * HEX_DIGITS


class Metric:
    """``sim`` over ``common`` (shared features, with multiplicity), bag sizes ``nq`` and ``np``, and signatures ``hq`` and ``hp``."""

    def sim(self) -> Column:
        raise NotImplementedError

    def dist(self) -> Column:
        """The reciprocal of the similarity; the largest double where that is 0."""
        return F.when(self.sim() == 0, F.lit(1.7976931348623157e308)).otherwise(1 / self.sim())


@dataclass(frozen=True)
class Jaccard(Metric):
    def sim(self) -> Column:
        return F.when(F.col("common") == 0, F.lit(0.0)).otherwise(F.col("common") / (F.col("nq") + F.col("np") - F.col("common")))


@dataclass(frozen=True)
class Overlap(Metric):
    def sim(self) -> Column:
        return F.when(F.col("common") == 0, F.lit(0.0)).otherwise(F.col("common") / F.least("nq", "np"))


@dataclass(frozen=True)
class OverlapIdf(Metric):
    """Overlap over the logarithm of the larger bag's size, with strictly larger bags only."""

    def sim(self) -> Column:
        return F.when((F.col("common") > 0) & (F.col("nq") < F.col("np")), F.col("common") / F.col("nq") / F.ln("np")).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Hamming(Metric):
    def sim(self) -> Column:
        return F.sqrt(1.0 / (self.dist() + 1))

    def dist(self) -> Column:
        return F.bit_count(F.col("hq").bitwiseXOR(F.col("hp")))


def feature_bits(feature: Column) -> Column:
    """60 bits of a feature's MD5."""
    return F.conv(F.substring(F.md5(feature.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long")


def simhash(features: Column) -> Column:
    """60-bit SimHash of a bag: a bit is set if more than half of the features' hashes have it; no features give 0."""
    hashes = F.transform(features, feature_bits)
    start = F.array_repeat(F.lit(0), BITS)
    votes = F.aggregate(hashes, start, lambda acc, h: F.transform(acc, lambda v, i: v + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)))
    return F.aggregate(F.transform(votes, lambda v, i: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.expr("0L"), lambda a, b: a + b)
