"""Text functions. Only what the JVM cannot do goes through an Arrow UDF."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

ASCII_ONLY = r"^\p{ASCII}*\z"


@F.pandas_udf(StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _casefold_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(DoubleType())
def _ratio_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right, strict=True)
        ],
        dtype="float64",
    )


def _only_non_ascii(value: Column, fast: Column, udf) -> Column:
    # ASCII values reach Python as nulls, so only the others cost text transfer.
    is_ascii = value.rlike(ASCII_ONLY)
    return F.when(is_ascii, fast).otherwise(udf(F.when(~is_ascii, value)))


def nfkc(value: Column) -> Column:
    """Unicode NFKC normal form."""
    return _only_non_ascii(value, value, _nfkc_udf)


def casefold(value: Column) -> Column:
    """Full Unicode case folding (``lower`` keeps a few letters apart)."""
    return _only_non_ascii(value, F.lower(value), _casefold_udf)


def ratcliff_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, in this argument order."""
    return _ratio_udf(left, right)


def collapse_spaces(value: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
