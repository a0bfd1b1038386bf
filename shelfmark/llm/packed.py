"""Hashes in compact exchanges: sorted, many to a row, and filters of a fixed size for what repeats.

Where all hashes of a corpus must meet but few of them do, a row for each costs several times the text. Here a slice's
hashes are sorted and dealt as binary rows to shares, each of which is a range of hashes; so a share has its part of
all hashes, whatever repeats. What is found to meet then passes a filter whose size is fixed, and only that is
exchanged as rows. A full filter lets more pass than it need and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares for each shuffle partition: a share is what one call holds in memory.
SHARES_A_PARTITION = 4
#: Bits of a filter: 16 MB, however large the tables are.
FILTER_BITS = 2**27
_BUCKET = 32_768
#: Where the higher part of a hash begins.
_HIGHER = 21


def shares(spark: SparkSession) -> int:
    return min(2**24, SHARES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted unsigned hashes: the shares that have some, and where each share's begin (with the end of the last)."""
    share = ((hashes >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
    found, begins = np.unique(share, return_index=True)
    return found.astype(np.int32), np.append(begins, len(hashes)).astype(np.int32)


def binary_rows(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``rows`` (a matrix of bytes)."""
    offsets = pa.array((ends.astype(np.int64) * rows.shape[1]).astype(np.int32)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


class BitFilter:
    """Two bits for each hash, at places that its lower and its higher part give."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def _set(self, at: np.ndarray) -> np.ndarray:
        at = at & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.astype(np.uint64)
        out = self._set(hashes)
        out[out] = self._set(hashes[out] >> np.uint64(_HIGHER))
        return out


def bit_filter(rows: DataFrame, column: str):
    """A broadcast filter of the values of a long column; each bucket of bits is put together where its rows are."""
    parts = F.array(F.col(column), F.shiftrightunsigned(column, _HIGHER))
    place = F.explode(F.transform(parts, lambda h: h.bitwiseAND(FILTER_BITS - 1) + 1))
    places = rows.select(place.alias("place"))
    buckets = places.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    found = buckets.toArrow()  # FILTER_BITS / 8 bytes at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, piece in zip(found.column("k").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[(k - 1) * _BUCKET // 8 : k * _BUCKET // 8] = np.frombuffer(piece, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(BitFilter(bits))
