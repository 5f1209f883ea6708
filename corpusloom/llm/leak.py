"""Problem 5: evaluation items that leaked into documents, whole or in part.

Pigeonhole edit matching in runs of five words.  An item is the string of its R distinct runs, of which a document may lack
e = R - ceil(R/2), the error budget; e + 1 of the runs are its pieces, so that every document that holds half of the runs
holds a piece exactly, and as the pieces take every second position, so does one with thirteen words in a row.  Of every
item with a piece hit the runs that the document holds are laid out in its order, and Myers' bit-parallel distance between
them and the item, in runs, decides: up to e edits are a leak.  Runs that were moved are no error by the problem's rule, so
where the order of the document costs more, they are measured once more in the item's order.  Thirteen words in a row are a
leak by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.runs import in_slices, run_hashes, run_starts, word_hashes
from corpusloom.llm.visible import word_form, word_points
from corpusloom.operators.run_filter import bitmap, may_hold
from corpusloom.session import counted, cut

RUN, ROW_OF_WORDS, SHARE = 5, 13, 0.5


def need(runs: int) -> int:
    """Of so many distinct runs, those that a document must hold."""
    return -(-runs // 2)


def pieces(runs: np.ndarray) -> np.ndarray:
    """Which places of an item's runs hold a piece: error budget plus one of the distinct runs, every second place first."""
    _, first, number = np.unique(runs, return_index=True, return_inverse=True)
    budget = len(first) - need(len(first))
    chosen = np.zeros(len(first), bool)
    for start in (0, 1):
        for k in number[start::2].tolist():
            if start and chosen.sum() > budget:
                break
            chosen[k] = True
    return chosen[number]


def myers(symbols: dict[int, int], length: int, text: list[int]) -> int:
    """Least edit distance of a pattern to any part of a text; symbols: symbol -> bits of its places in the pattern."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    positive, negative, score, best = full, 0, length, length
    for symbol in text:
        eq = symbols.get(symbol, 0)
        across = (((eq & positive) + positive) ^ positive) | eq | negative
        up = negative | (full & ~(across | positive))
        down = positive & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        step = eq | negative
        positive = down | (full & ~(step | up))
        negative = up & step
    return best


def run_distance(runs: int, held: list[int]) -> int:
    """Edits, in runs, between an item of so many distinct runs, numbered in order, and the ones that a text holds."""
    symbols = {k: 1 << k for k in range(runs)}
    distance = myers(symbols, runs, held)
    if distance > runs - need(runs):
        distance = myers(symbols, runs, sorted(set(held)))
    return distance


def longest_row(places: np.ndarray, at: np.ndarray) -> int:
    """Words of the longest row of an item's runs, at their places in the item, that a text holds in a row."""
    order = np.lexsort((places, places - at))
    diagonal, step = (places - at)[order], places[order]
    breaks = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(step) != 1))
    return int(np.diff(np.concatenate([[-1], breaks, [len(step) - 1]])).max()) + RUN - 1


def verify(runs: int, held: np.ndarray, places: np.ndarray, at: np.ndarray) -> tuple[bool, int, int]:
    """(leak, words in a row, distance) of one document and one item of so many distinct runs.

    The document holds the item's run number held[k], which stands at places[k] in the item, at its word at[k].
    """
    row = longest_row(places, at)
    first = np.unique(at, return_index=True)[1]
    distance = run_distance(runs, held[first].tolist())
    return distance <= runs - need(runs) or row >= ROW_OF_WORDS, row, distance


def _item_runs(items: DataFrame) -> DataFrame:
    """(benchmark, item_id, item, run, also, place, held, runs, piece): every run of every item, at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 3):
            owner, hashes = word_hashes(batch.column(3).to_pylist(), word_form, word_points())
            at = run_starts(owner, RUN)
            found, also, of = run_hashes(hashes, at, RUN), run_hashes(hashes, at, RUN, True), owner[at]
            _, first = np.unique(of, return_index=True)
            held, runs, piece = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
            for own in map(slice, first, np.append(first[1:], len(at))):
                _, seen, number = np.unique(found[own], return_index=True, return_inverse=True)
                rank = np.empty(len(seen), np.int32)
                rank[np.argsort(seen)] = np.arange(len(seen))
                held[own], runs[own], piece[own] = rank[number], len(seen), pieces(found[own])
            names = batch.schema.names[:3]
            columns = [c.take(pa.array(of)) for c in batch.columns[:3]] + [pa.array(x) for x in (found.view(np.int64), also.view(np.int64), (at - np.searchsorted(owner, of)).astype(np.int32), held, runs, piece)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "run", "also", "place", "held", "runs", "piece"])

    numbered = items.select("benchmark", "item_id", F.xxhash64("text").alias("item"), "text")
    return numbered.mapInArrow(run, "benchmark string, item_id string, item long, run long, also long, place int, held int, runs int, piece boolean")


def _held_runs(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, run, also, at): the runs of every document that the bitmap of the items' runs lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            owner, hashes = word_hashes(batch.column(1).to_pylist(), word_form, word_points())
            at = run_starts(owner, RUN)
            found = run_hashes(hashes, at, RUN)
            some = may_hold(shared.value, found)
            at, found = at[some], found[some]
            place = at - np.searchsorted(owner, owner[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(found.view(np.int64)), pa.array(run_hashes(hashes, at, RUN, True).view(np.int64)), pa.array(place)], names=["doc_id", "run", "also", "at"])

    return docs.mapInArrow(run, "doc_id long, run long, also long, at long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for k in range(batch.num_rows):
            runs, hits = batch.column(3)[k].as_py(), batch.column(4)[k].values.flatten()
            at, held, places = (x.to_numpy() for x in hits)
            leak, row, distance = verify(runs, held, places.astype(np.int64), at)
            if leak:
                rows.append((k, row, len(np.unique(held)) / runs, distance))
        keep, row, share, distance = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:3]] + [pa.array(row, pa.int32()), pa.array(share, pa.float64()), pa.array(distance, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:3], "words_in_row", "share_of_runs", "run_distance"])


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(benchmark, item_id, doc_id, words_in_row, share_of_runs, run_distance): every leak in every document.

    The documents are read once, whatever the number of items: a bitmap of the items' runs, of bounded size, goes to all
    executors, and only the runs that it lets pass are joined with the items' runs (by 128 bits of hash) and grouped by
    document and item.  Null and blank texts on either side match nothing; items of under five words have no run;
    re-delivered items count once, an item with several texts leaks by any of them.
    """
    queries = items.select(F.col("benchmark").cast("string").alias("benchmark"), F.col("item_id").cast("string").alias("item_id"), F.col(item_text).alias("text")).where("benchmark is not null and item_id is not null and text is not null").distinct()
    index = cut(_item_runs(queries))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    hits = _held_runs(rows, bitmap(index)).join(counted(index), ["run", "also"])
    pairs = hits.groupBy("benchmark", "item_id", "item", "doc_id").agg(F.first("runs").alias("runs"), F.sort_array(F.collect_set(F.struct("at", "held", "place"))).alias("hits"), F.max("piece").alias("piece"))
    pairs = pairs.where("piece").select("benchmark", "item_id", "doc_id", "runs", "hits")
    return pairs.mapInArrow(_verified, "benchmark string, item_id string, doc_id long, words_in_row int, share_of_runs double, run_distance int")
