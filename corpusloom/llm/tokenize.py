"""Problem 6: token ids of a public byte-level BPE vocabulary for a whole corpus.

Pre-tokenisation is vectorised: an array of code-point classes becomes an array of symbols of a small automaton, the
automaton's transition functions (elements of a finite monoid) are composed by a blocked associative scan, and every
position then knows the automaton's state, hence whether a piece starts there.  No regular expression runs.  The pieces,
as byte slices, feed pair merging through a bounded cache; byte offsets can be kept for decoding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.unicode_arrays import code_points, slices, utf8

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SLICE_BYTES = 2_000_000
CACHED_PIECES = 200_000
LONG_PIECE = 48
BLOCK = 128

# Symbols of the automaton.
LETTER, NUMBER, OTHER, APOSTROPHE, LAST_BLANK, LAST_SPACE, MID_SPACE, SUFFIX, SUFFIX2 = range(9)
SYMBOLS = 9
# States: what the piece that holds the previous character still accepts.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_APOSTROPHE, IN_SUFFIX, AT_BLANK, IN_SPACES = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts here)."""
    if symbol in (SUFFIX, SUFFIX2):
        if state == AT_APOSTROPHE:
            return (DONE if symbol == SUFFIX else IN_SUFFIX), False
        symbol = LETTER
    if symbol == LETTER:
        return (DONE, False) if state == IN_SUFFIX else (IN_LETTERS, state not in (IN_LETTERS, AT_BLANK))
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AT_BLANK)
    if symbol in (OTHER, APOSTROPHE):
        joined = state in (IN_OTHERS, AT_APOSTROPHE, AT_BLANK)
        return (AT_APOSTROPHE if symbol == APOSTROPHE and not joined else IN_OTHERS), not joined
    if symbol == MID_SPACE:
        return IN_SPACES, state != IN_SPACES
    return (AT_BLANK if symbol == LAST_BLANK else DONE), True


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        if (kind := unicodedata.category(chr(cp))[0]) in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = MID_SPACE
    table[0x27] = APOSTROPHE
    return table


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(functions[m, state], composition[m, m], next[state, symbol], starts[state, symbol]) for the doubled alphabet.

    Symbol k + SYMBOLS is symbol k as the first of a text: it acts as if the state were DONE.
    """
    step = [[_step(s if k < SYMBOLS else DONE, k % SYMBOLS) for k in range(2 * SYMBOLS)] for s in range(STATES)]
    following = np.array([[x[0] for x in row] for row in step], np.uint8)
    starts = np.array([[x[1] for x in row] for row in step], bool)
    elements = [tuple(range(STATES)), *dict.fromkeys(tuple(following[:, k].tolist()) for k in range(2 * SYMBOLS))]
    known = set(elements)
    for f in elements:  # grows while it is read: the closure under composition
        for k in range(2 * SYMBOLS):
            g = tuple(int(following[s, k]) for s in f)
            if g not in known:
                known.add(g)
                elements.append(g)
    number = {f: i for i, f in enumerate(elements)}
    composition = np.array([[number[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    return np.array(elements, np.uint8), composition, following, starts


@functools.cache
def _generators() -> np.ndarray:
    functions, _, following, _ = _automaton()
    number = {tuple(f): i for i, f in enumerate(functions.tolist())}
    return np.array([number[tuple(following[:, k].tolist())] for k in range(2 * SYMBOLS)], np.uint16)


def _states_before(elements: np.ndarray) -> np.ndarray:
    """Exclusive scan: number of the composed function of all elements before each position."""
    _, composition, _, _ = _automaton()
    size, flat = composition.shape[0], composition.ravel()
    if len(elements) <= BLOCK:
        out, now = np.zeros(len(elements), np.uint16), 0
        for i, e in enumerate(elements.tolist()):
            out[i] = now
            now = int(composition[now, e])
        return out
    rows = -(-len(elements) // BLOCK)
    columns = np.zeros(rows * BLOCK, np.uint16)
    columns[: len(elements)] = elements
    columns = np.ascontiguousarray(columns.reshape(rows, BLOCK).T)
    inside = np.zeros((BLOCK, rows), np.uint16)
    now = np.zeros(rows, np.uint16)
    for j in range(BLOCK):
        inside[j] = now
        now = flat[now.astype(np.int32) * size + columns[j]]
    before = _states_before(now).astype(np.int32) * size
    return flat[before[None, :] + inside].T.ravel()[: len(elements)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a piece starts, over texts laid end to end; every text's first byte is one."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, at = code_points(data)
    n = len(points)
    begins = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    if at is not None:
        begins = np.searchsorted(at, begins)
    symbols = _classes()[points]
    space = symbols == MID_SPACE
    ends = np.zeros(n, bool)
    ends[begins[1:] - 1] = True
    ends[-1] = True
    follows = np.zeros(n, bool)  # a character that is no white space follows in the same text
    follows[:-1] = ~space[1:]
    last = np.flatnonzero(space & follows & ~ends)
    symbols[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    mark = np.flatnonzero((symbols == APOSTROPHE) & ~ends)
    if len(mark):
        first = points[mark + 1]
        second = np.where(ends[mark + 1], 0, points[np.minimum(mark + 2, n - 1)])
        symbols[mark[np.isin(first, [ord(c) for c in "stmd"])] + 1] = SUFFIX
        r, v, l, e = map(ord, "rvle")
        symbols[mark[(((first == r) | (first == v)) & (second == e)) | ((first == l) & (second == l))] + 1] = SUFFIX2
    symbols[begins] += SYMBOLS
    functions, _, _, starts = _automaton()
    state = functions[:, DONE][_states_before(_generators()[symbols])]
    where = np.flatnonzero(starts.ravel()[state.astype(np.int32) * (2 * SYMBOLS) + symbols])
    return where if at is None else at[where]


class Vocabulary:
    """Ranks of a byte-level BPE and the merging of one piece, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cache: dict[bytes, list[int]] = {}

    @classmethod
    def parse(cls, file: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        return self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < 1 << 30:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap over a linked list: n log n for a piece of any length."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j = heapq.heappop(heap)
            if not alive[i] or (mid := end[i]) >= n or end[mid] != j:
                continue
            alive[mid] = False
            end[i] = j
            if j < n:
                before[j] = i
                if (r := ranks.get(piece[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:j])) is not None:
                heapq.heappush(heap, (r, k, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        cache = self.cache
        if len(cache) > CACHED_PIECES:
            cache.clear()
        found = list(map(cache.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    if (ids := cache.get(piece)) is None:
                        ids = self.merge(piece)
                        if len(piece) <= LONG_PIECE:
                            cache[piece] = ids
                    found[i] = ids
        return found


_open: dict[int, Vocabulary] = {}


def _vocabulary(file: bytes) -> Vocabulary:
    """Parsed once per Python worker."""
    key = hash(file)
    if key not in _open:
        _open.clear()
        _open[key] = Vocabulary.parse(file)
    return _open[key]


def encode(strings: pa.Array, vocabulary: Vocabulary, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(list offsets, ids) of a string array; with count_only the ids stay empty."""
    data, offsets = utf8(strings)
    raw = data.tobytes()
    bounds, parts, base = [np.zeros(1, np.int64)], [], 0
    for first, last in slices(offsets, SLICE_BYTES):
        low, high = int(offsets[first]), int(offsets[last])
        texts = offsets[first : last + 1] - low
        starts = piece_starts(data[low:high], texts)
        edges = (starts + low).tolist()
        found = vocabulary.ids([raw[a:b] for a, b in zip(edges, [*edges[1:], high], strict=True)] if edges else [])
        counts = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=counts[1:])
        if not count_only:
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, counts[-1]))
        bounds.append(base + counts[np.searchsorted(starts, texts[1:])])
        base += int(counts[-1])
    return np.concatenate(bounds), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): one row per input row.  Null and empty texts give an empty list; text that looks like a special token
    is ordinary text.  The vocabulary file (about 1 MB, bounded) is read once and broadcast; nothing is shuffled."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        for batch in batches:
            bounds, ids = encode(batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Every row without its text, with its number of tokens (0 for null and empty texts)."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        for batch in batches:
            bounds, _ = encode(batch.column(0), known, count_only=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(bounds), pa.int64())], names=[*(f.name for f in rest), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` bigint"])
    return df.select(F.col(text), *(F.col(f.name) for f in rest)).mapInArrow(run, schema)


def token_spans(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids, ends): with every id the byte position where its token ends in the text's UTF-8 form."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        lengths = np.zeros(max(known.ranks.values()) + 1, np.int64)
        lengths[list(known.ranks.values())] = [len(b) for b in known.ranks]
        for batch in batches:
            bounds, ids = encode(batch.column(1), known)
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[ids])])
            ends = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "ids", "ends"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, ends array<int>")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the inverse of token_ids; a null list gives a null text, unknown ids an error."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: b for b, i in _vocabulary(shared.value).ranks.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(back.__getitem__, x)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
