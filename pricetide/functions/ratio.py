"""Ratcliff-Obershelp similarity, which Spark has no expression for, and a bound of it that Spark has.

Python runs on distinct text pairs only, and callers first drop the pairs that the bound rules out.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matched share of two strings. Not symmetric: keep the argument order."""
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


def levenshtein_ratio(left: Column, right: Column) -> Column:
    """Edit-distance stand-in that stays in the JVM."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(left, right) / longest
    )


def common_characters(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two texts' characters."""
    uses = lambda text, c: F.length(text) - F.length(F.replace(text, c))
    characters = F.array_distinct(F.filter(F.split(left, ""), lambda c: c != ""))
    return F.aggregate(characters, F.lit(0), lambda total, c: total + F.least(uses(left, c), uses(right, c)))


def ratio_bound(left: Column, right: Column) -> Column:
    """Upper bound of both similarities: matched characters are at most the common ones.

    An edit distance is at least the longer length less the common characters, so its ratio is
    bounded by common / longest, which 2 * common / (sum of lengths) is never below.
    """
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * common_characters(left, right) / total)


def distinct_ratios(texts: DataFrame, left: str, right: str, name: str, similarity: str = "sequence") -> DataFrame:
    """Similarity of every distinct pair of texts: each pair is computed once."""
    pairs = texts.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()
    return pairs.withColumn(name, SIMILARITIES[similarity](F.col(left), F.col(right)))


SIMILARITIES = {"sequence": sequence_ratio, "levenshtein": levenshtein_ratio}
JVM_SIMILARITIES = (levenshtein_ratio,)
