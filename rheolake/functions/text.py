"""Keys and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indexed_key(key: Column, prefix: str) -> Column:
    """The number in ``prefix_12``; null for other keys."""
    return F.regexp_extract(key, f"^{prefix}_([0-9]+)$", 1).try_cast("int")


def number_or(text: Column, default: float) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def int_list(text: Column) -> Column:
    """Numbers of a list separated by commas or semicolons; other tokens are dropped."""
    tokens = F.split(F.replace(text, F.lit(";"), F.lit(",")), ",")
    return F.filter(F.transform(tokens, lambda t: F.trim(t).try_cast("int")), lambda n: n.isNotNull())
