"""Shared text expressions: words, shingles, ASCII lower case."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.75


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that every engine agrees."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(words(text)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes not to clash with a column."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def shingle_hashes(tokens: Column, n: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of n-word shingles. Fewer words make one shingle; none make none."""
    size = F.size(tokens)
    last = F.greatest(size - n, F.lit(0))
    each = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.array_join(F.slice(tokens, i + 1, n), " ")),
    )
    return F.when(size > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))
