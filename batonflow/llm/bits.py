"""Bit sets of ids: small, bounded broadcasts that tell which rows are surely not among some ids.

A set has 16 bits an id up to MOST_BITS. Beyond that it fills up, and more rows
than needed are looked at more closely; no result depends on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOST_BITS = 1 << 27


def place(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def row_hash(rows: DataFrame) -> Column:
    """A hash of a whole row, to put rows of one id in an order that no partitioning changes."""
    return F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind))


def bit_set(ids: DataFrame, key: str) -> np.ndarray:
    """64-bit words with one bit for each id. At most MOST_BITS / 64 of them come to the driver."""
    size = 1 << max(16, min(MOST_BITS.bit_length() - 1, (16 * ids.count()).bit_length()))
    at = ids.select(place(F.col(key), size).alias("at"))
    found = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows surely not of `ids`, rows that may be): only the latter need a join, and their texts a shuffle."""
    words = bit_set(ids, key)
    shared, size = rows.sparkSession.sparkContext.broadcast(words), len(words) * 64

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, at.to_numpy()))

    hit = may(place(F.col(key), size))
    return rows.where(~hit), rows.where(hit)
