"""A bit set of hashed keys, of bounded size: rows whose key surely is not among some keys need no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A set has about sixteen bits for each key, at most 2**28 bits (32 MB); with more keys it filters less. It never
#: filters out a key.
MOST_LOG = 28


def slot_of(column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - MOST_LOG)


@dataclass
class BitSet:
    bits: bytes
    log: int

    def among(self, slots: np.ndarray) -> np.ndarray:
        """Which slots are in the set."""
        at = slots >> (MOST_LOG - self.log)
        return (np.frombuffer(self.bits, np.int64)[at >> 6] >> (at & 63)) & 1 == 1


def set_bits(keys: DataFrame) -> BitSet:
    """The set of column ``key``: at most 2**MOST_LOG / 64 words come to the driver."""
    log = min(MOST_LOG, max(16, int(16 * keys.count()).bit_length()))
    slot = keys.select(F.shiftright(slot_of("key"), MOST_LOG - log).alias("s"))
    found = slot.groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return BitSet(out.tobytes(), log)


def filter_rows(df: DataFrame, column: str, *sets: BitSet, inside: bool = True) -> DataFrame:
    """Rows whose key may be in all of the sets (``inside``), or all others. The two halves make up ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(sets)

    @F.pandas_udf("boolean")
    def has(slot):
        import pandas as pd

        slots = slot.to_numpy(np.int64)
        return pd.Series(np.logical_and.reduce([s.among(slots) for s in shared.value]))

    test = has(slot_of(df[column]))
    return df.where(test if inside else ~test)
