"""Text normalisation and synthetic typos."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters with diacritics of the supported languages, and their base letters.
ACCENTED = "çäÄóèÊíñÑéÉÇêÈüöÖÍÜÓ"
BASE = "caAoeEinNeECeEuoOIUO"


def normalized(text: Column) -> Column:
    """Accents removed and sharp s written out; null stays null."""
    return F.replace(F.translate(text, ACCENTED, BASE), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """ASCII by compatibility decomposition, for text beyond the table above; characters without one are dropped."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.replace("ß", "ss")).encode("ascii", "ignore").decode())


def induce_typo(word: Column) -> Column:
    """``A`` in front, and ``E`` after the fourth byte where the word has more than four."""
    typo = F.concat(F.lit("A"), normalized(word))
    return F.when(F.octet_length(word) > 4, F.overlay(typo, F.lit("E"), F.lit(5), F.lit(0))).otherwise(typo)
