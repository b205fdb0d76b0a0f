"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are spread over.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows``, of which a key may have any number, with ``few``, which has few of each key.

    Rows get a salt by the hash of column ``by``; the other side is repeated for each salt. So a hot key is ``salts`` groups.
    """
    salt = "__salt"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts)))))
    return left.join(right, [*keys, salt]).drop(salt)
