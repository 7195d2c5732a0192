"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.plans.store import discard, shared_dir, stored

__all__ = ["Bits", "bitmap", "count_kind", "discard", "marked", "shared_dir", "span_text", "stored"]

LEAST_BITS, MOST_BITS, CHUNK = 20, 29, 16  # a bitmap takes 128 KB to 64 MB; 2^16 bits travel in a row


class Bits(NamedTuple):
    """A bitmap of hashed keys: unmarked keys are surely absent."""

    words: Broadcast
    size: int

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.size))

    def marks(self, place: np.ndarray) -> np.ndarray:
        return (self.words.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places by chunk -> a row of bits for each chunk."""
    at, bits = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])
    for batch in batches:
        place = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in np.unique(place >> CHUNK).tolist():
            if chunk != at:
                if at is not None:
                    yield row()
                at, bits = chunk, np.zeros(1 << CHUNK, dtype=bool)
            bits[place[place >> CHUNK == chunk] & ((1 << CHUNK) - 1)] = True
    if at is not None:
        yield row()


def bitmap(keys: DataFrame) -> Bits:
    """keys (key) -> a bitmap with 64 bits a key, of 64 MB at most: beyond 8 million keys it marks ever more other keys.

    The driver collects the bitmap alone.
    """
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (64 * keys.count()).bit_length()))
    places = keys.select(F.pmod(F.xxhash64("key"), F.lit(size)).alias("place")).distinct().withColumn("chunk", F.shiftright("place", CHUNK))
    rows = places.repartition("chunk").sortWithinPartitions("chunk").select("place").mapInArrow(_chunks, "chunk long, bits binary").collect()
    words = np.zeros((size >> CHUNK, (1 << CHUNK) // 8), dtype=np.uint8)
    for r in rows:
        words[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Bits(keys.sparkSession.sparkContext.broadcast(words.reshape(-1)), size)


def marked(df: DataFrame, key: Column, bits: Bits, want: bool = True) -> DataFrame:
    """The rows of df whose key the bitmap marks, or those whose key it doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(bits.marks(place) == want))

    return df.withColumn("__place", bits.place(key)).mapInArrow(run, df.schema)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
