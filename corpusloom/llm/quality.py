"""Problem 8: statistics that tell running prose from lists, tables and junk, and the kind they lead to.

All statistics are sums over code-point arrays of many texts at once.  A hidden Markov model with the states prose, list,
table and junk labels the lines of a text: the emission of a line is a log-linear function of its statistics, a switch of
state between lines costs SWITCH nats.  The shares of the labels, by characters, give the kind of the text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.language import viterbi
from corpusloom.llm.unicode_arrays import code_points, slices, utf8
from corpusloom.llm.visible import plain_form

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
SWITCH = 1.5
SLICE_BYTES = 1_000_000
#: Least number of a word in sentences and marked entries for evidence of its own.
LEAST_WORDS = 5
CHUNK = 40
#: Mean evidence at which a line is as likely a sentence as an entry: nouns, in both, weigh a little towards entries.
NEUTRAL = 0.3

SPACE, NEWLINE, LOWER, UPPER, DIGIT, CASELESS, STOP, COMMA, SEMICOLON, PIPE, TAB, MARKUP, CONTROL, SYMBOL, SLASH, COLON = range(16)
CLASSES = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower-case code point, is a Latin vowel) of every code point."""
    kind = np.full(0x110000, SYMBOL, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    vowel = np.zeros(0x110000, bool)
    for cp in range(0x20000):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Lu":
            kind[cp] = UPPER
        elif category == "Ll":
            kind[cp] = LOWER
        elif category[0] == "L":
            kind[cp] = CASELESS
        elif category[0] == "N":
            kind[cp] = DIGIT
        elif category[0] == "M":
            kind[cp] = CASELESS
        elif category[0] == "Z":
            kind[cp] = SPACE
        elif category == "Cc":
            kind[cp] = CONTROL
        if category[0] == "L":
            if len(small := ch.lower()) == 1:
                lower[cp] = ord(small)
            vowel[cp] = unicodedata.normalize("NFD", ch)[0].lower() in "aeiouyæøœ"
    kind[0x20000:0x110000] = CASELESS
    for chars, value in ((".!?…。", STOP), (",،、", COMMA), (";", SEMICOLON), ("|", PIPE), ("\t", TAB), ("\n", NEWLINE), ("<>{}&=\\^~`@%$", MARKUP), ("/", SLASH), (":", COLON)):
        kind[[ord(c) for c in chars]] = value
    return kind, lower, vowel


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = np.uint64(1)
    return np.cumprod(up), np.cumprod(down)


def _in_lines(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of marked characters of every line."""
    return np.add.reduceat(mask.astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)


class Lines:
    """Statistics of the non-blank lines of many texts laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        kinds, lowers, vowels = _tables()
        cp, at = code_points(data)
        n = len(cp)
        begins = offsets[:-1] if at is None else np.searchsorted(at, offsets[:-1])
        self.docs = len(begins)
        full = begins < np.append(begins[1:], n)  # texts with a character
        cls = kinds[cp]
        first = np.zeros(n, bool)
        first[begins[full]] = True
        first[1:] |= cls[:-1] == NEWLINE
        starts = np.flatnonzero(first)
        line = np.cumsum(first) - 1
        lines = len(starts)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(begins, starts, "right") - 1
        counts = np.bincount(line * CLASSES + cls, minlength=lines * CLASSES).reshape(lines, CLASSES)
        solid = ~np.isin(cls, [SPACE, NEWLINE, TAB])
        chars = _in_lines(solid, starts)
        kept = np.flatnonzero(chars)
        # words: runs of letters and digits; a pair of neighbouring caseless letters counts as a word of its own
        alnum = (cls >= LOWER) & (cls <= CASELESS)
        before = np.zeros(n, bool)
        before[1:] = alnum[:-1]
        before[first] = False
        word_start = np.flatnonzero(alnum & ~before)
        after = np.zeros(n, bool)
        after[:-1] = alnum[1:] & ~first[1:]
        word_end = np.flatnonzero(alnum & ~after) + 1
        lower = lowers[cp]
        up, down = _powers(1 << (max(n, 1)).bit_length())
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        hashes = (prefix[word_end] - prefix[word_start]) * down[word_start]
        caseless = cls == CASELESS
        pair = np.flatnonzero(caseless[:-1] & caseless[1:] & ~first[1:]) if n else np.zeros(0, np.int64)
        pair_hash = (lower[pair].astype(np.uint64) + np.uint64(1)) + (lower[pair + 1].astype(np.uint64) + np.uint64(1)) * _BASE
        # delimiters
        follows = np.full(n, NEWLINE, np.uint8)
        follows[:-1] = np.where(first[1:], NEWLINE, cls[1:])
        blank = (cls == SPACE) | (cls == TAB)
        gap = np.zeros(n, bool)
        if n > 1:
            gap[1:] = (cls[1:] == SPACE) & (cls[:-1] == SPACE) & ~first[1:]
        gap_start = gap & ~np.concatenate([[False], gap[:-1]])
        solid_so_far = np.cumsum(solid)
        base = np.concatenate([[0], solid_so_far])[starts]
        inner_gap = gap_start & (solid_so_far > base[line]) & (follows != NEWLINE)
        dot = (cp == 0xB7) | (cp == 0x2022)
        tight = (cls == COMMA) & (follows != SPACE)
        delimiters = [counts[:, PIPE], counts[:, TAB], counts[:, SEMICOLON], _in_lines(tight, starts), _in_lines(inner_gap, starts)]
        # letters that change class inside a word, other than the capital at its start
        change = np.zeros(n, bool)
        if n > 1:
            letter = (cls == LOWER) | (cls == UPPER) | (cls == DIGIT)
            change[1:] = letter[1:] & letter[:-1] & (cls[1:] != cls[:-1]) & ~first[1:]
            capital = np.zeros(n, bool)
            capital[word_start] = True
            change[1:] &= ~(capital[:-1] & (cls[:-1] == UPPER) & (cls[1:] == LOWER))
        latin = ((cls == LOWER) | (cls == UPPER)) & (cp < 0x250)
        mojibake = np.zeros(n, bool)
        if n > 1:
            lead = ((cp[:-1] >= 0xC2) & (cp[:-1] <= 0xF4)) & (cp[1:] >= 0x80) & (cp[1:] <= 0xBF)
            mojibake[1:] = lead & ~first[1:]
        mojibake |= (cp >= 0x7F) & (cp <= 0x9F) | (cp == 0xFFFD)
        self.take = kept
        self.clauses = _in_lines(tight & (follows == CASELESS), starts)[kept]  # commas of scripts that set no space after them
        self.doc = doc[kept]
        self.counts = counts[kept]
        self.chars = chars[kept]
        self.delimiters = np.stack([d[kept] for d in delimiters], axis=1)
        self.commas = (counts[:, COMMA] - delimiters[3])[kept]
        self.dots = _in_lines(dot, starts)[kept]
        self.change = _in_lines(change, starts)[kept]
        self.latin = _in_lines(latin, starts)[kept]
        self.vowels = _in_lines(vowels[cp] & latin, starts)[kept]
        self.broken = _in_lines(mojibake, starts)[kept]
        self.stops = _in_lines((cls == STOP) & ((follows == SPACE) | (follows == NEWLINE) | (cp == 0x3002)), starts)[kept]
        self.spaces = _in_lines(blank, starts)[kept]
        new_line = np.full(lines, -1)
        new_line[kept] = np.arange(len(kept))
        self.word_line = new_line[line[word_start]] if len(word_start) else np.zeros(0, np.int64)
        self.word_hash, self.word_length = hashes, word_end - word_start
        digits_before = np.concatenate([[0], np.cumsum(cls == DIGIT)])
        self.spelled = digits_before[word_end] == digits_before[word_start]
        self.pair_line, self.pair_hash = new_line[line[pair]] if len(pair) else np.zeros(0, np.int64), pair_hash
        self.words = np.bincount(self.word_line, minlength=len(kept))
        place = np.flatnonzero(solid)
        low = np.searchsorted(place, starts[kept])
        high = np.searchsorted(place, ends[kept]) - 1
        f, e = place[low] if len(kept) else low, place[high] if len(kept) else high
        padded, padded_cls = np.concatenate([cp, np.full(3, 10, cp.dtype)]), np.concatenate([cls, np.full(3, NEWLINE, np.uint8)])
        c0, k0, c1, k1, k2 = padded[f], padded_cls[f], padded[f + 1], padded_cls[f + 1], padded_cls[f + 2]
        c2 = padded[f + 2]
        point = np.array([ord(c) for c in ".)"])
        bullet = np.isin(c0, [ord(c) for c in "-*+•·▪◦‣–—☐☑☒✓"]) & (k1 == SPACE)
        box = (c0 == ord("[")) & ((c1 == ord("]")) | (c2 == ord("]")))
        box |= ((c0 == ord("(")) | (c0 == ord("["))) & ((k1 == DIGIT) & ((k2 == DIGIT) | np.isin(c2, [ord(")"), ord("]")])) | ((k1 == LOWER) & (c2 == ord(")"))))
        number = (k0 == DIGIT) & ((np.isin(c1, point) & (k2 == SPACE)) | ((k1 == DIGIT) & np.isin(c2, point)))
        letter_mark = (k0 == LOWER) & (c1 == ord(")"))
        self.marked = bullet | box | number | letter_mark
        self.opens_lower = k0 == LOWER
        self.line_end = (padded_cls[e] == STOP) | ((e > f) & np.isin(cp[e] if len(e) else e, [ord(c) for c in "\"')»”’]"]) & (padded_cls[np.maximum(e - 1, 0)] == STOP))
        # width of the line, and of the word that the next line opens with
        gaps = np.append(np.flatnonzero(blank | (cls == NEWLINE)), n)
        self.opening = np.minimum(gaps[np.searchsorted(gaps, f)], ends[kept]) - f
        self.width = e + 1 - starts[kept]
        self.adjacent = np.concatenate([(kept[1:] == kept[:-1] + 1) & (self.doc[1:] == self.doc[:-1]), [False]]) if len(kept) else np.zeros(0, bool)
        self.line_hash = (prefix[e + 1] - prefix[f]) * down[f]

    def sums(self, hashes: np.ndarray, values: np.ndarray, pairs: bool = True) -> np.ndarray:
        """Sum over the words of every line of the values of known hashes (sorted)."""
        lines = len(self.doc)
        out = np.zeros(lines)
        if not len(hashes):
            return out
        for line, h in self.terms()[: 1 + pairs]:
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out += np.bincount(line, np.where(hashes[i] == h, values[i], 0.0), lines)
        return out

    def terms(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(line, hash) of the words without digits and of the pairs of caseless letters."""
        return [(self.word_line[self.spelled], self.word_hash[self.spelled]), (self.pair_line, self.pair_hash)]

    def wrapped(self) -> np.ndarray:
        """Of every text the share of its broken lines that the next word would have made too wide; 0 if they are few.

        A line is broken where the next one follows at once and it doesn't end a sentence.
        """
        widest = np.zeros(self.docs, np.int64)
        np.maximum.at(widest, self.doc, self.width)
        broken = self.adjacent & ~self.line_end & (self.counts[:, CASELESS] * 2 < self.chars)
        full = np.zeros(len(self.doc), bool)
        full[:-1] = broken[:-1] & (self.width[:-1] + 1 + self.opening[1:] > widest[self.doc[:-1]])
        capitals = self.counts[:, UPPER] > 3 * self.counts[:, LOWER]
        goes_on = np.zeros(len(self.doc), bool)
        goes_on[:-1] = broken[:-1] & (self.opens_lower[1:] | capitals[1:])
        total, carried = np.bincount(self.doc, broken, self.docs), np.bincount(self.doc, goes_on, self.docs)
        return np.where((total >= 2) & (carried >= 0.4 * total), np.bincount(self.doc, full, self.docs) / np.maximum(total, 1), 0.0)

    def units(self) -> np.ndarray:
        """Words of every line, with caseless letters counted in pairs."""
        return self.words + np.bincount(self.pair_line, minlength=len(self.doc))

    def variety(self) -> np.ndarray:
        """Of every line the share of distinct words within chunks of CHUNK words; 1 for lines of under 15 words."""
        lines = len(self.doc)
        first = np.concatenate([[0], np.cumsum(self.words)])[:-1]
        within = np.arange(len(self.word_line)) - first[self.word_line]
        long = self.words[self.word_line] >= 15
        key = self.word_hash[long] ^ ((self.word_line[long] * 4096 + within[long] // CHUNK + 1).astype(np.uint64) * _BASE)
        _, index = np.unique(key, return_index=True)
        distinct = np.bincount(self.word_line[long][index], minlength=lines)
        return np.where(self.words >= 15, distinct / np.maximum(self.words, 1), 1.0)

    def repeated(self) -> np.ndarray:
        """Of every text the share of its four-word runs that stood in it before, or of its lines if that is more."""
        doc = self.doc[self.word_line] if len(self.word_line) else np.zeros(0, np.int64)
        out = np.zeros(self.docs)
        for h, owner in ((self._runs(4), doc[3:]), (self.line_hash, self.doc)):
            if len(h):
                if h is not self.line_hash:
                    same = doc[:-3] == doc[3:]
                    h, owner = h[same], owner[same]
                _, index = np.unique(h ^ ((owner + 1).astype(np.uint64) * _BASE), return_index=True)
                total = np.bincount(owner, minlength=self.docs)
                share = 1 - np.bincount(owner[index], minlength=self.docs) / np.maximum(total, 1)
                out = np.maximum(out, np.where(total >= 6, share, 0.0))
        return out

    def _runs(self, n: int) -> np.ndarray:
        if len(self.word_hash) < n:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.word_hash) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x100000001B3) + self.word_hash[k : len(self.word_hash) - n + 1 + k]
        return total

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(previous, next) line of the same text, -1 where there is none."""
        n = len(self.doc)
        same = self.doc[1:] == self.doc[:-1]
        before, after = np.full(n, -1), np.full(n, -1)
        before[1:][same] = np.flatnonzero(same)
        after[:-1][same] = np.flatnonzero(same) + 1
        return before, after

    def columns(self) -> np.ndarray:
        """Strength, 0 to 2, of the sign that a line is a record: as many delimiters of a kind as the lines beside it."""
        before, after = self.neighbours()
        out = np.zeros(len(self.doc))
        for k in range(self.delimiters.shape[1]):
            d = self.delimiters[:, k]
            slack = 1 if k == 4 else 0
            alike = [(beside >= 0) & (np.abs(d - d[beside]) <= slack * (np.minimum(d, d[beside]) >= 2)) for beside in (before, after)]
            least = 1 if k in (0, 1) else 2
            out = np.maximum(out, (d >= least) * (alike[0] * 1.0 + alike[1] * 1.0))
        return out


def emissions(lines: Lines, evidence: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-linear emission scores of every line in the four states."""
    n = len(lines.doc)
    c, chars, words = lines.counts, np.maximum(lines.chars, 1), lines.words
    units = lines.units()
    prose_like = np.clip(lines.sums(evidence[0], evidence[1] + NEUTRAL) / np.maximum(units, 1), -1.5, 1.5)
    columns = lines.columns()
    symbols = (chars - c[:, LOWER] - c[:, UPPER] - c[:, DIGIT] - c[:, CASELESS]) / chars
    variety, repeated = lines.variety(), lines.repeated()[lines.doc]
    change = lines.change / chars
    letters = c[:, LOWER] + c[:, UPPER] + c[:, CASELESS]
    digits = c[:, DIGIT] / chars
    separators = np.maximum.reduce([c[:, SEMICOLON], lines.dots, lines.commas, c[:, PIPE], _spaced_slashes(lines)])
    row = (separators >= 5) & (units <= 6 * (separators + 1)) & (lines.stops <= 1) & (prose_like < 0.2) & (columns == 0)
    coded = c[:, MARKUP] > 0.07 * chars
    token = (lines.spaces == 0) & (c[:, SLASH] >= 1) & (change < 0.2) & ~coded
    pair = ~coded & (c[:, COLON] >= 1) & (words <= 9) & ~lines.line_end & (lines.stops == 0)
    short = (units <= 14) & ~lines.line_end & (lines.stops == 0)
    loose = ~lines.marked & (columns == 0) & ~row & ~token & ~pair & (letters >= 0.5 * chars) & (change < 0.1)
    carried = np.zeros(n, bool)  # the line goes on with a word in lower case
    if n:
        carried[:-1] = lines.adjacent[:-1] & lines.opens_lower[1:] & loose[1:]
    carried &= loose & ~lines.line_end
    carries = np.concatenate([[False], carried[:-1]]) if n else carried
    flowing = (lines.wrapped()[lines.doc] >= 0.8) & loose
    share_short = np.bincount(lines.doc, short, lines.docs) / np.maximum(np.bincount(lines.doc, minlength=lines.docs), 1)
    entries = (share_short[lines.doc] >= 0.85) & (np.bincount(lines.doc, minlength=lines.docs)[lines.doc] >= 4) & ~flowing
    carried &= ~entries
    carries &= ~entries
    out = np.zeros((n, 4))
    out[:, PROSE] = 1.5 * lines.line_end + 1.0 * np.minimum(lines.stops, 3) + 3.0 * prose_like + 0.5 * (units >= 15) + 1.0 * (units >= 22) * ~row - 2.5 * lines.marked - 3.0 * (letters < 0.5 * chars) + 1.0 * carried + 1.0 * carries + 2.5 * flowing
    out[:, LIST] = 0.5 + 3.5 * lines.marked + 1.0 * short + 1.5 * (entries & (columns == 0)) - 1.0 * lines.line_end - 3.0 * prose_like + 3.0 * row + 3.0 * token + 2.0 * pair - 0.5 * np.minimum(lines.stops, 3) - 1.5 * columns - 1.0 * flowing
    out[:, TABLE] = -1.0 + 2.5 * columns + 3.0 * digits * (columns > 0) - 1.0 * lines.stops * (columns == 0) - 2.0 * (columns == 0) - 1.5 * np.maximum(prose_like, 0)
    vowels = (lines.latin >= 12) & (lines.vowels < 0.22 * lines.latin) & (letters >= 0.6 * chars)
    markup = (c[:, MARKUP] + c[:, SEMICOLON] * (c[:, MARKUP] > 0)) / chars
    noise = (symbols > 0.45) & (columns == 0) & (chars >= 8) & ((c[:, PIPE] == 0) | (symbols > 0.85))
    codes = (change > 0.18) & ~token & (columns < 2)
    out[:, JUNK] = -1.0 + 6.0 * vowels + 7.0 * (markup > 0.07) * (columns < 2) + 6.0 * noise + 6.0 * codes * (chars >= 12) + 12.0 * (lines.broken > 0.04 * chars) + 5.0 * (variety < 0.5) + 14.0 * (repeated > 0.6) * ((columns < 1) | (repeated > 0.9))
    out[:, JUNK] += 3.0 * ((lines.spaces == 0) & (chars > 60) & (c[:, CASELESS] < 0.5 * chars) & ~token)
    return out


def _spaced_slashes(lines: Lines) -> np.ndarray:
    return np.where(lines.spaces >= 2 * lines.counts[:, SLASH], lines.counts[:, SLASH], 0)


def word_hash(word: str) -> int:
    """The hash of a word of the visible form as it is found in a line."""
    total, power = 0, 1
    _, lowers, _ = _tables()
    for ch in word:
        total += (int(lowers[ord(ch)]) + 1) * power
        power = power * int(_BASE) & 0xFFFFFFFFFFFFFFFF
    return total & 0xFFFFFFFFFFFFFFFF


def count_evidence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, numbers in sentences and in marked entries) of the words of both."""
    forms = pa.array([plain_form(t) if t else "" for t in texts], pa.string())
    data, offsets = utf8(forms)
    hashes, numbers = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
    for first, last in slices(offsets, SLICE_BYTES):
        low = offsets[first]
        lines = Lines(data[low : offsets[last]], offsets[first : last + 1] - low)
        plain = (lines.delimiters[:, :4].sum(axis=1) == lines.clauses) & (lines.change * 20 < lines.chars) & (lines.counts[:, MARKUP] == 0)
        sentence = plain & lines.line_end & ~lines.marked & (lines.units() >= 6)
        item = plain & lines.marked & ~lines.line_end & (lines.units() <= 14)
        for line, h in lines.terms():
            for k, kind in enumerate((sentence, item)):
                found, n = np.unique(h[kind[line]], return_counts=True)
                hashes.append(found)
                numbers.append(np.stack([n * (k == 0), n * (k == 1)], axis=1))
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    both = np.concatenate(numbers)
    return known, np.stack([np.bincount(place, both[:, k], len(known)).astype(np.int64) for k in (0, 1)], axis=1)


def log_odds(known: np.ndarray, both: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log odds) of the words found often enough; totals are the numbers of all words."""
    order = np.argsort(known)
    order = order[both[order].sum(axis=1) >= LEAST_WORDS]
    known, both = known[order], both[order]
    odds = np.log((both[:, 0] + 1) / (totals[0] + 1000)) - np.log((both[:, 1] + 1) / (totals[1] + 1000))
    return known, np.clip(odds, -2, 2)


def fit_evidence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log odds): how much more often a word stands in sentences than in marked entries."""
    known, both = count_evidence(texts)
    return log_odds(known, both, both.sum(axis=0))


def word_evidence(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """fit_evidence of all texts of a table: words are counted where the rows are; those with evidence, and the totals
    (under a null hash), come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, both = count_evidence(batch.column(0).to_pylist())
            hashes = pa.concat_arrays([pa.array(known.view(np.int64)), pa.array([None], pa.int64())])
            both = np.concatenate([both, both.sum(axis=0, keepdims=True)])
            yield pa.RecordBatch.from_arrays([hashes, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["hash", "prose", "entry"])

    counts = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "hash long, prose long, entry long")
    counts = counts.groupBy("hash").agg(F.sum("prose").alias("prose"), F.sum("entry").alias("entry"))
    found = counts.where(F.col("hash").isNull() | (F.col("prose") + F.col("entry") >= LEAST_WORDS)).toArrow().combine_chunks()
    both = np.stack([found[c].to_numpy() for c in ("prose", "entry")], axis=1)
    whole = found["hash"].is_null().to_numpy()
    known = found["hash"].drop_null().to_numpy().view(np.uint64)
    return log_odds(known, both[~whole], both[whole].sum(axis=0))


def statistics(texts: list[str | None], evidence: tuple[np.ndarray, np.ndarray], common: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: the statistics, the shares of the four labels by characters, and the kind (index into KINDS)."""
    forms = pa.array([plain_form(t) if t else "" for t in texts], pa.string())
    data, offsets = utf8(forms)
    parts: list[dict[str, np.ndarray]] = []
    for first, last in slices(offsets, SLICE_BYTES):
        low = offsets[first]
        lines = Lines(data[low : offsets[last]], offsets[first : last + 1] - low)
        docs = lines.docs
        labels = viterbi(emissions(lines, evidence).astype(np.float32), np.bincount(lines.doc, minlength=docs), SWITCH)
        of = lambda values: np.bincount(lines.doc, values, docs)
        chars, words, count = of(lines.chars), of(lines.words), of(np.ones(len(lines.doc)))
        share = np.bincount(lines.doc * 4 + labels, lines.chars, docs * 4).reshape(docs, 4) / np.maximum(chars, 1)[:, None]
        length = of(np.bincount(lines.word_line, lines.word_length, len(lines.doc)))
        symbols = of(lines.chars - lines.counts[:, [LOWER, UPPER, DIGIT, CASELESS]].sum(axis=1))
        per = lambda a, b: np.round(a / np.maximum(b, 1), 6)
        parts.append(
            {
                "n_words": words.astype(np.int64), "n_lines": count.astype(np.int64), "mean_word_length": per(length, words), "symbol_ratio": per(symbols, chars), "share_lines_end_stop": per(of(lines.line_end), count),
                "share_common_words": per(of(lines.sums(common, np.ones(len(common)), pairs=False)), words), "repeated_runs": np.round(lines.repeated(), 6), **{f"share_{k}": np.round(share[:, i], 6) for i, k in enumerate(KINDS)},
                "kind": np.where(chars == 0, -1, np.where(share[:, PROSE] >= 0.5, PROSE, share[:, 1:].argmax(axis=1) + 1)),
            }
        )
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


REAL = ("mean_word_length", "symbol_ratio", "share_lines_end_stop", "share_common_words", "repeated_runs", *(f"share_{k}" for k in KINDS))


def text_quality(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics, shares, kind) of every row; null and blank texts have zero counts and a null kind.

    The word evidence is fitted on all texts, whose numbers of words are shuffled; statistics and labels are made of
    each whole text alone, without a shuffle.
    """
    evidence = word_evidence(docs, text)
    words = common_words.select("word").where("word is not null").distinct().collect()
    common = np.unique(np.array([word_hash(plain_form(r.word)) for r in words], np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((evidence, common))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(1).to_pylist(), *shared.value)
            if not found:
                continue
            kinds = pa.array([None if k < 0 else KINDS[k] for k in found.pop("kind").tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values()), kinds], names=[key, *found, "kind"])

    schema = f"`{key}` {kind}, n_words long, n_lines long, " + ", ".join(f"{c} double" for c in REAL) + ", kind string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
