"""A bitmap of runs that goes to all executors, so that of a large side only the runs that may be in a small one move on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.runs import mix

#: Bits for each run, of the whole bitmap at most (64 MB, whatever the runs are), and bits that are set for a run.
BITS_PER_RUN, MOST_BITS, PROBES = 64, 1 << 29, 4


def _places(runs: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(runs + np.uint64(k)) & np.uint64(bits - 1) for k in range(1, PROBES + 1)]


def bitmap(index: DataFrame, column: str = "run") -> np.ndarray:
    """Words of a bitmap of the 64-bit hashes in a column; a larger index fills it up, so that more may pass, none too few."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (BITS_PER_RUN * index.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            words, first = np.unique(place >> np.uint64(6), return_index=True)
            if len(words):
                ors = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ors.view(np.int64))], names=["word", "bits"])

    found = index.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which runs may be in the bitmap: all that are, and about one of 50,000 that aren't while its size is not bounded."""
    passes = np.ones(len(runs), bool)
    for place in _places(runs, 64 * len(words)):
        at = np.flatnonzero(passes)
        place = place[at]
        passes[at] = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return passes


def passing(df: DataFrame, probes: str, words: np.ndarray) -> DataFrame:
    """Rows of which an array of 64-bit hashes has any that may be in the bitmap; of the array, those stay."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(probes)
            lists = batch.column(place)
            found = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            passes = may_hold(shared.value, found)
            rows, counts = np.unique(owner[passes], return_counts=True)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(found[passes].view(np.int64)))
            columns = batch.take(pa.array(rows)).columns
            yield pa.RecordBatch.from_arrays([kept if i == place else c for i, c in enumerate(columns)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
