"""Row keys that order rows at random but always the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "~"


def key_part(name: str) -> Column:
    """One column as text behind its length, or the null mark. No two lists of values give the same text of parts.

    The text of a fraction is the shortest one that reads back as the same number, so no digit is lost.
    """
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK))


def row_key(df: DataFrame, columns: list[str], seed: int | str) -> Column:
    """md5 over the seed and the columns, as 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{len(str(seed))}:{seed}"), *[key_part(name) for name in columns]))
