"""Problem 4: the language of every text and of every line of a mixed one, with a confidence.

Script ranges narrow the candidates of a word (Han: zh; Cyrillic: ru; Latin: the other nine), a per-word score (word
frequency per language, letter n-grams for unknown words) rates them, and a Viterbi pass over the words of a text with a
penalty for every switch labels the spans.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.visible import plain_form
from corpusloom.session import cut

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "zh")
# Other spellings of the languages in labels.
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castilian", "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "sv": "sv swe swedish svenska", "pl": "pl pol polish polski", "ru": "ru rus russian русский", "zh": "zh zho chi cmn chinese 中文",
}
NO_LANGUAGE = "und n/a na unknown xx xxx zxx mul mis none null -"
#: Times that all texts are labelled and their words counted: by the seeds, then by the counts of the time before.
ROUNDS = 2
#: Least number of a word in one language, and of an n-gram in all of them, for a score of its own.
LEAST_WORDS, LEAST_GRAMS = 3, 4
#: Characters whose words are counted at once.
CHUNK_CHARS = 1_000_000
SWITCH_PENALTY = 6.0
UNKNOWN_WEIGHT, UNKNOWN_LIMIT = 0.5, 1.5
#: A text is natural language if at least this share of its words, weighted by length, is known in its language.
LEAST_KNOWN = 0.25
WORD = re.compile(r"[^\W\d_]+")
#: A letter beside a digit, as in codes and digests: each one counts as an unknown word.
JUNCTION = re.compile(r"[a-z]\d|\d[a-z]")
HAN, CYRILLIC = re.compile("[㐀-鿿豈-﫿]"), re.compile("[Ѐ-ԯ]")
_RU, _ZH = LANGUAGES.index("ru"), LANGUAGES.index("zh")


def label_language(label: Column) -> Column:
    """Code of the language that a label names whatever its spelling, null for labels that name none; a label of another
    language keeps its lower-cased primary part, so that it counts as naming another one."""
    known = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)])
    primary = F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0)
    whole = F.lower(F.trim(label))
    named = F.coalesce(F.try_element_at(known, whole), F.try_element_at(known, primary), primary)
    return F.when(label.isNull() | (whole == "") | whole.isin(NO_LANGUAGE.split()), None).otherwise(named)


def script(word: str) -> int:
    """0 Latin and others, 1 Cyrillic, 2 Han."""
    if word.isascii():
        return 0
    return 2 if HAN.search(word) else 1 if CYRILLIC.search(word) else 0


def split_words(text: str) -> list[str]:
    return WORD.findall(plain_form(text).lower())


def _grams(word: str) -> Iterable[str]:
    padded = f"<{word}>"
    for n in (2, 3, 4):
        yield from (padded[i : i + n] for i in range(len(padded) - n + 1))


def _digests(strings: Iterable[str]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in strings]), np.uint64)


class Scores:
    """Scores of strings in each language, held as sorted 64-bit digests of the strings and one row of numbers for each."""

    def __init__(self, strings: list[str], values: np.ndarray) -> None:
        keys = _digests(strings)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, strings: list[str]) -> np.ndarray:
        """Row of every string, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(strings), -1)
        digests = _digests(strings)
        at = np.minimum(np.searchsorted(self.keys, digests), len(self.keys) - 1)
        return np.where(self.keys[at] == digests, at, -1)


class WordModel:
    """Scores of a word in each language: log shares, best language 0; candidates that its script rules out get -inf-like values."""

    RULED_OUT = -30.0

    def __init__(self, vocabulary: Scores, grams: Scores) -> None:
        self.vocabulary, self.grams = vocabulary, grams
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)), np.float32)
        self.known = np.zeros((1024, len(LANGUAGES)), bool)

    @classmethod
    def seeded(cls, seeds: Iterable[tuple[str, str]]) -> WordModel:
        """The model of seeds (language, word) alone."""
        by_word: dict[str, set[int]] = defaultdict(set)
        for lang, word in seeds:
            if lang in LANGUAGES:
                for part in split_words(word):
                    by_word[part].add(LANGUAGES.index(lang))
        values = np.full((len(by_word), len(LANGUAGES)), math.log(0.02), np.float32)
        for row, langs in zip(values, by_word.values(), strict=True):
            row[list(langs)] = 0.0
        return cls(Scores(list(by_word), values), Scores([], np.zeros((0, len(LANGUAGES)))))

    @classmethod
    def fit(cls, texts: list[str], seeds: list[tuple[str, str]]) -> WordModel:
        """Seeds (language, word) label the texts; their words are counted, the texts labelled again by the counts."""
        model, k = cls.seeded(seeds), len(LANGUAGES)
        for _ in range(ROUNDS):
            words, grams = defaultdict(lambda: [0] * k), defaultdict(lambda: [0] * k)
            for word, i, n in model.count(texts):
                words[word][i] += n
            held = [(w, sum(1 << i for i in range(k) if n[i])) for w, n in words.items() if w]
            for gram, mask, n in count_grams(held):
                for i in range(k):
                    grams[gram][i] += n * (mask >> i & 1)
            words = {w: n for w, n in words.items() if not w or max(n) >= LEAST_WORDS}
            grams = {g: n for g, n in grams.items() if not g or sum(n) >= LEAST_GRAMS}
            model = cls.counted(list(words), np.array(list(words.values())), list(grams), np.array(list(grams.values())))
        return model

    @classmethod
    def counted(cls, words: list[str], of_words: np.ndarray, grams: list[str], of_grams: np.ndarray) -> WordModel:
        """The model of numbers per language of words and n-grams; the numbers of "" are those of all of them."""
        k = len(LANGUAGES)
        logs, kept = _log_shares(words, of_words.reshape(-1, k), 0.05, 50)
        vocabulary = Scores(kept, np.maximum(logs - logs.max(axis=1, keepdims=True), -7.0).astype(np.float32))
        logs, kept = _log_shares(grams, of_grams.reshape(-1, k), 0.5, 200)
        return cls(vocabulary, Scores(kept, logs - logs.mean(axis=1, keepdims=True)))

    def count(self, texts: list[str]) -> list[tuple[str, int, int]]:
        """(word, language, number) of the words of all lines whose language is plain, and under "" the number of all words
        per language.  Words in Han letters, which get no scores, count under "" only."""
        k = len(LANGUAGES)
        words: list[str] = []
        lengths: list[int] = []
        for text in texts:
            for line in plain_form(text).lower().split("\n"):
                w = WORD.findall(line)
                if (len(w) >= 4 or (w and script(w[0]) == 2)) and 5 * len(JUNCTION.findall(line)) <= len(w):
                    words += w
                    lengths.append(len(w))
        if not words:
            return []
        rows, sizes = self.index(words), np.array(lengths)
        lines = len(sizes)
        line = np.repeat(np.arange(lines), sizes)
        scores = self.table[rows]
        best = np.stack([np.bincount(line, scores[:, i], lines) for i in range(k)], axis=1).argmax(axis=1)
        long = np.array([len(x) > 1 for x in words])
        sure = np.bincount(line, self.known[rows, best[line]] & long, lines) / sizes
        kept = np.flatnonzero(((sure >= 0.2) | (best == _ZH))[line])
        codes, first, numbers = np.unique(rows[kept] * k + best[line[kept]], return_index=True, return_counts=True)
        langs = codes % k
        found = [(words[at], i, n) for at, i, n in zip(kept[first].tolist(), langs.tolist(), numbers.tolist(), strict=True)]
        totals = np.bincount(langs, numbers, k).astype(np.int64).tolist()
        return [x for x in found if script(x[0]) != 2] + [("", i, n) for i, n in enumerate(totals) if n]

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = len(LANGUAGES)
        kinds = np.array([script(w) for w in words])[:, None]
        each = np.arange(k)
        allowed = np.where(kinds == 2, each == _ZH, (each != _ZH) & ((kinds == 0) | (each == _RU)))
        out = np.zeros((len(words), k))
        at = np.where(kinds[:, 0] == 2, -1, self.vocabulary.find(words))
        held = np.flatnonzero(at >= 0)
        out[held] = self.vocabulary.values[at[held]]
        long = np.array([len(w) > 1 for w in words])[:, None]
        known = allowed & np.where(kinds == 2, True, (at >= 0)[:, None] & long & (out > -3.0))
        unknown = np.flatnonzero((at < 0) & (kinds[:, 0] == 0) & long[:, 0])
        grams = [list(_grams(words[i])) for i in unknown]
        owner = np.repeat(np.arange(len(unknown)), [len(g) for g in grams])
        place = self.grams.find(list(itertools.chain.from_iterable(grams)))
        owner, place = owner[place >= 0], place[place >= 0]
        number = np.bincount(owner, minlength=len(unknown))
        of = self.grams.values[place]
        total = np.stack([np.bincount(owner, of[:, i], len(unknown)) for i in range(k)], axis=1)
        total = UNKNOWN_WEIGHT * total / np.maximum(number, 1)[:, None]
        top = np.where(allowed[unknown], total, -np.inf).max(axis=1, initial=-np.inf, keepdims=True)
        out[unknown] = np.where((number > 0)[:, None], np.maximum(total - top, -UNKNOWN_LIMIT), 0.0)
        return np.where(allowed, out, self.RULED_OUT), known

    def index(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        if len(rows) > 300_000:
            rows.clear()
        found = list(map(rows.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, r in zip(words, found, strict=True) if r is None))
            first = len(rows)
            rows.update(zip(new, range(first, first + len(new)), strict=True))
            if len(rows) > len(self.table):
                more = max(len(self.table), len(rows) - len(self.table))
                self.table, self.known = (np.concatenate([x, np.zeros((more, x.shape[1]), x.dtype)]) for x in (self.table, self.known))
            for low in range(0, len(new), 10_000):
                part = slice(first + low, min(first + low + 10_000, len(rows)))
                self.table[part], self.known[part] = self._scores(new[low : low + 10_000])
            found = list(map(rows.get, words))
        return np.array(found, np.int64)


def count_grams(words: Iterable[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(n-gram, languages, number) over distinct words with the languages they stand in, as bits; under "" all n-grams."""
    counts: Counter[tuple[str, int]] = Counter()
    for word, mask in words:
        grams = list(_grams(word))
        counts.update((g, mask) for g in grams)
        counts["", mask] += len(grams)
    return [(g, mask, n) for (g, mask), n in counts.items()]


def _log_shares(strings: list[str], numbers: np.ndarray, more: float, more_in_all: float) -> tuple[np.ndarray, list[str]]:
    """Log shares per language of all strings but "", whose numbers are the totals, and these strings."""
    order = [i for i, x in enumerate(strings) if x]
    totals = np.maximum(1, sum((numbers[i] for i, x in enumerate(strings) if not x), np.zeros(len(LANGUAGES))))
    return np.log((numbers[order] + more) / (totals + more_in_all)), [strings[i] for i in order]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word of many texts at once; scores are laid end to end, lengths per text."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    sizes = lengths[order]
    stay = np.zeros((len(scores), scores.shape[1]), bool)
    jump = np.zeros(len(scores), np.int8)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    active = int((sizes > 0).sum())
    for t in range(int(sizes[0]) if len(sizes) else 0):
        active = int(np.searchsorted(-sizes[:active], -t, "left"))
        at = starts[:active] + t
        if t:
            best = value[:active].argmax(axis=1)
            top = value[np.arange(active), best] - penalty
            keep = value[:active] >= top[:, None]
            stay[at], jump[at] = keep, best
            value[:active] = np.where(keep, value[:active], top[:, None]) + scores[at]
        else:
            value[:active] = scores[at]
    labels = np.zeros(len(scores), np.int8)
    now = value.argmax(axis=1) if len(value) else np.zeros(0, np.int64)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        active = int(np.searchsorted(-sizes, -t, "left"))
        at = starts[:active] + t
        labels[at] = now[:active]
        if t:
            rows = np.arange(active)
            now[:active] = np.where(stay[at, now[:active]], now[:active], jump[at])
    return labels


def _word_weights(words: list[str]) -> list[float]:
    """A run of Han letters holds about a word for every two of them."""
    return [1.0 if w.isascii() or not HAN.search(w) else max(1.0, len(w) / 2) for w in words]


def label_texts(texts: list[str], model: WordModel) -> list[list[tuple[int, str | None, float]]]:
    """Of each text (segment, language, confidence): segment 0 is the whole text, 1, 2, … its non-blank lines.  The
    language is null where the text, or the line, has no natural language."""
    words: list[str] = []
    line_of: list[int] = []
    lines_of_text: list[list[int]] = []
    lengths = np.zeros(len(texts), np.int64)
    codes = np.zeros(len(texts), np.int64)
    lines = 0
    for n, text in enumerate(texts):
        own = []
        for line in plain_form(text).lower().split("\n"):
            if line and not line.isspace():
                w = WORD.findall(line)
                words += w
                line_of += [lines] * len(w)
                lengths[n] += len(w)
                codes[n] += len(JUNCTION.findall(line))
                own.append(lines)
                lines += 1
        lines_of_text.append(own)
    k = len(LANGUAGES)
    if not words:
        return [[(0, None, 0.0), *((i + 1, None, 0.0) for i in range(len(own)))] for own in lines_of_text]
    rows = model.index(words)
    scores = model.table[rows]
    labels = viterbi(scores, lengths).astype(np.int64)
    weights = np.array(_word_weights(words), np.float64)
    line = np.array(line_of, np.int64)
    votes = np.bincount(line * k + labels, weights, lines * k).reshape(lines, k)
    knowing = np.bincount(line * k + labels, weights * model.known[rows, labels], lines * k).reshape(lines, k)
    sums = np.stack([np.bincount(line, scores[:, i], lines) for i in range(k)], axis=1)
    sure = _confidence(votes, sums)
    best_of_line = votes.argmax(axis=1)
    has_words = votes.sum(axis=1) > 0
    out = []
    for n, own in enumerate(lines_of_text):
        whole = votes[own].sum(axis=0) if own else np.zeros(k)
        total, best = whole.sum(), int(whole.argmax())
        if not total or knowing[own].sum() < LEAST_KNOWN * (total + codes[n]):
            out.append([(0, None, 0.0), *((i + 1, None, 0.0) for i in range(len(own)))])
            continue
        weight = votes[own].sum(axis=1)
        mine = best_of_line[own] == best
        found = [(0, LANGUAGES[best], round(float((weight * sure[own])[mine].sum() / total), 6))]
        found += [(i + 1, LANGUAGES[best_of_line[at]], round(float(sure[at]), 6)) if has_words[at] else (i + 1, None, 0.0) for i, at in enumerate(own)]
        out.append(found)
    return out


def _confidence(votes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of each line: share of its words that carry its label, times the odds of the label's score against the best other."""
    rows, best = np.arange(len(votes)), votes.argmax(axis=1)
    others = sums.copy()
    others[rows, best] = -np.inf
    margin = np.clip(sums[rows, best] - others.max(axis=1), -20, 20)
    return votes[rows, best] / np.maximum(votes.sum(axis=1), 1) / (1 + np.exp(-margin))


_open: dict[str, WordModel] = {}


class _Shared:
    """A model for the Python workers, each of which opens it once."""

    def __init__(self, df: DataFrame, model: WordModel) -> None:
        self.token = uuid.uuid4().hex
        self.tables = df.sparkSession.sparkContext.broadcast((model.vocabulary, model.grams))

    def open(self) -> WordModel:
        if self.token not in _open:
            _open.clear()
            _open[self.token] = WordModel(*self.tables.value)
        return _open[self.token]


def _chunks(texts: Iterable[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _per_language(counts: DataFrame, key: str) -> DataFrame:
    """(key, numbers per language) of rows (key, languages as bits, number)."""
    numbers = [F.sum(F.when(F.col("langs").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(LANGUAGES))]
    return counts.groupBy(key).agg(*numbers)


def _collected(counts: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
    found = counts.toArrow()
    return found[key].to_pylist(), np.stack([found[f"n{i}"].to_numpy() for i in range(len(LANGUAGES))], axis=1)


def _counted_model(df: DataFrame, text: str, model: WordModel) -> WordModel:
    """The model of the words of all texts, labelled by another model.  Words and n-grams are counted where the rows are;
    those with scores of their own, and the totals, come to the driver."""
    shared, schema = _Shared(df, model), pa.schema([("word", pa.string()), ("langs", pa.int32()), ("n", pa.int64())])

    def rows(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [[], [], []], schema, strict=True)], schema=schema)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _chunks(batch.column(0).to_pylist()):
                yield rows([(w, 1 << i, n) for w, i, n in shared.open().count(texts)])

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(count_grams(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))

    columns = [F.col(f"n{i}") for i in range(len(LANGUAGES))]
    texts = df.select(F.col(text).alias("text")).where("text is not null")
    words = cut(_per_language(texts.mapInArrow(words_of, "word string, langs int, n long"), "word"))
    held = sum((F.when(c > 0, 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    grams = words.where("word <> ''").select("word", held.alias("langs")).mapInArrow(grams_of, "word string, langs int, n long")
    words = words.where((F.col("word") == "") | (F.greatest(*columns) >= LEAST_WORDS))
    grams = _per_language(grams, "word").where((F.col("word") == "") | (sum(columns, F.lit(0)) >= LEAST_GRAMS))
    return WordModel.counted(*_collected(words, "word"), *_collected(grams, "word"))


def fit_word_model(df: DataFrame, text: str, seeds: DataFrame) -> WordModel:
    """Fit on all texts and all seeds, as WordModel.fit does."""
    model = WordModel.seeded(tuple(r) for r in seeds.select("lang", "word").where("lang is not null and word is not null").distinct().collect())
    for _ in range(ROUNDS):
        model = _counted_model(df, text, model)
    return model


def text_languages(df: DataFrame, key: str, text: str, model: WordModel) -> DataFrame:
    """(key, lines array<struct<seg_no, lang, confidence>>): seg_no 0 is the whole text.

    Null keys give no row; null, blank and wordless texts give a null language; rows are labelled alone, without a shuffle.
    """
    shared = _Shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first in range(0, len(texts), 500):
                found = label_texts(texts[first : first + 500], shared.open())
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                flat = list(zip(*(x for rows in found for x in rows), strict=True)) or [[], [], []]
                structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, 500), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)], names=["key", "segments"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key string, segments array<struct<seg_no:int,lang:string,confidence:double>>")


def is_mixed(segments: Column) -> Column:
    """Whether the lines are not all in one language."""
    languages = F.array_distinct(F.filter(F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(1))), lambda s: s["lang"]), lambda x: x.isNotNull()))
    return F.size(languages) > 1
