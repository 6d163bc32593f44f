"""A filter of fixed size that spares rows a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A fixed 16 MB; more keys only make it let more pass.
FILTER_BITS = 1 << 27
CHUNK_BITS = 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


class Bits:
    """A fixed-size filter over 64-bit keys, broadcast; lets every key of the set pass, and few others while it is sparse."""

    def __init__(self, keys: DataFrame, key: str):
        def slots(batches):
            for b in batches:
                slot = place(b.column(0).to_numpy().view(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((slot // CHUNK_BITS).astype(np.int32)), pa.array((slot % CHUNK_BITS).astype(np.int32))], names=["i", "at"])

        def parts(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                chunk, at = b.column("i").to_numpy(), b.column("at").to_numpy()
                for i in np.unique(chunk).tolist():
                    held.setdefault(i, np.zeros(CHUNK_BITS, bool))[at[chunk == i]] = True
            for i, on in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["i", "bits"])

        # Keys are dealt by chunk, so a chunk is made in one task from its keys, whatever the number of tasks before.
        spread = keys.select(key).mapInArrow(slots, "i int, at int").repartition(FILTER_BITS // CHUNK_BITS, "i")
        rows = spread.mapInArrow(parts, "i int, bits binary").collect()  # FILTER_BITS in all
        words = np.zeros((FILTER_BITS // CHUNK_BITS, CHUNK_BITS // 8), np.uint8)
        for r in rows:
            words[r["i"]] = np.frombuffer(r["bits"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(words.reshape(-1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = place(keys)
        return (self.sent.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def place(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * _A) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
