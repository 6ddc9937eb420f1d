"""Inputs: lexicons and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the distinct upper-cased lines of a text file."""
    return spark.read.text(path).select(F.upper(F.col("value")).alias("word")).distinct()


def with_reversed(words: DataFrame) -> DataFrame:
    """``word``: the given words and their reversals, each once."""
    return words.select("word").union(words.select(F.reverse("word"))).distinct()


def tokens(text: Column) -> Column:
    """White-space separated tokens of a text; null text gives null."""
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def document_words(docs: DataFrame) -> DataFrame:
    """``word``: the distinct upper-cased, transliterated runs of letters in ``text``."""
    return docs.select(F.explode(F.split(F.upper(normalized(F.col("text"))), "[^A-Z]+")).alias("word")).where("word <> ''").distinct()


def shingle_tokens(text: Column) -> Column:
    """Upper-cased, transliterated words of a text in order."""
    return F.array_remove(F.split(F.upper(normalized(text)), "[^A-Z]+"), "")
