"""Count-min sketch of hashed keys: each partition's sketch is added to the others', and what it overestimates as repeated is kept.

A row of the sketch has 2**40 counters, of which those that aren't 0 are stored. Tasks need to know only which counters
reach two; these are held in a bit set whose size follows their number, under two addresses each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch

#: About sixteen bits for each repeated counter, 2 * 2**28 bits (64 MB) at most: this is what the driver collects and tasks
#: get. Where that is too few, the estimates grow and more is compared exactly; nothing is lost.
LOG_COUNTERS, MOST_LOG = 40, 28
SCHEMA = "slot bigint, n bigint"


@dataclass
class Repeated:
    """Which counters reach two."""

    bits: bytes
    log: int

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are estimated at two or more."""
        words = np.frombuffer(self.bits, np.int64)
        slot = (keys >> np.uint64(64 - LOG_COUNTERS)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for b in (slot & ((1 << self.log) - 1), (slot >> (LOG_COUNTERS - self.log)) + (1 << self.log)):
            out &= (words[b >> 6] >> (b & 63)) & 1 == 1
        return out


def partial(keys: np.ndarray) -> pa.RecordBatch:
    """A part's sketch, as the counters that aren't 0."""
    slot, n = np.unique((keys >> np.uint64(64 - LOG_COUNTERS)).astype(np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.minimum(n, 2))], ["slot", "n"])


def merge(partials: DataFrame, scratch: Scratch) -> Repeated:
    """Adds up partial sketches and keeps which counters reach two: a key estimated under two surely occurs once."""
    full = scratch.save(partials.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot"), "counters")
    log = min(MOST_LOG, max(16, int(8 * full.count()).bit_length()))
    bits = full.select(F.explode(F.array(F.col("slot").bitwiseAND((1 << log) - 1), F.shiftright("slot", LOG_COUNTERS - log) + (1 << log))).alias("b"))
    words = bits.groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(2 << (log - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    scratch.drop("counters")
    return Repeated(out.tobytes(), log)
