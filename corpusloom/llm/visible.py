"""The visible form of a text: one spelling for everything a reader cannot tell apart.

Confusables skeleton: decompose, replace every character by the prototype of its look-alike class, decompose again.  Two
texts look equal exactly when their skeletons are equal.  Letter case, accents, raised, lowered or circled digits and
punctuation stay visible.  The classes of look-alike letters and digits of all scripts are the public confusables data of
Unicode, read where it lies in the ICU library that comes with Spark; a text of one script keeps its letters apart (0 and O,
1 and l, m and rn).
"""

from __future__ import annotations

import functools
import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections import defaultdict

import numpy as np

# Look-alike letters of other scripts and their Latin prototypes (public confusables data).  They are the
# whole table where words of known languages are wanted (plain_form), and come first where classes leave a choice.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԜԝѵ", "ABESIJKMHOPCTYXaeijopcyxshdqWwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
ARMENIAN = dict(zip("ՍՕսօհո", "UOuohn", strict=True))
LATIN = dict(zip("ɑɡıꓲ", "agiI", strict=True))
DASHES = {"‐": "-", "‑": "-", "­": "", "−": "-", "﹣": "-"}
# Decompositions of these kinds differ only in width, joining or line breaking; <super>, <sub>, <circle>, <square>,
# <fraction> and <vertical> change what is seen.
ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF)]
#: Name of the confusables data within an ICU library.
CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"
#: Combining class of strokes through a letter.
OVERLAY = 1


def _icu_library() -> str:
    import pyspark

    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    found = [p for home in homes if home for p in sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))]
    if not found:
        raise FileNotFoundError("Spark's jars hold no ICU library; name one by confusables(path)")
    return found[0]


@functools.cache
def confusables(path: str | None = None) -> dict[str, str]:
    """Character -> prototype of its class, from the data of an ICU library (by default the one among Spark's jars).

    After ICU's header come sections of keys (code point, length - 1 in the high byte), of values (the prototype, or its
    place in the strings) and of strings, whose places and sizes are in the words 3 to 8 of the data.
    """
    with zipfile.ZipFile(path or _icu_library()) as library:
        data = library.read(CONFUSABLES)
    data = data[struct.unpack_from(">H", data)[0] :]
    (keys, count), (values, _), (strings, units) = (struct.unpack_from(">2i", data, at) for at in (12, 20, 28))
    text = data[strings : strings + 2 * units].decode("utf-16-be", "surrogatepass")
    out = {}
    for key, value in zip(struct.unpack_from(f">{count}i", data, keys), struct.unpack_from(f">{count}H", data, values), strict=True):
        size = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else text[value : value + size]
    return out


def _own_kind(ch: str) -> bool:
    """Letters and digits whose look is their own: no ideographs, and nothing raised, lowered or enclosed."""
    cp, kind = ord(ch), unicodedata.decomposition(ch).partition(" ")[0]
    return unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl") and not 0x3040 <= cp < 0xA000 and not 0xAC00 <= cp < 0xE000 and cp < 0x20000 and kind[:1] != "<" and kind == ""


@functools.cache
def look_alikes(path: str | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(letter or digit -> the one that stands for its class, letters with an overlaid mark -> the letter they look like).

    An ASCII member of the class and of the same category (upper, lower, digit) stands for it, else an ASCII member of
    another, else the least member of the same category.  ASCII characters stand for themselves.
    """
    table = confusables(path)
    classes: dict[str, set[str]] = defaultdict(set)
    for ch in {*table, *map(chr, range(0x30, 0x7B))}:
        if _own_kind(ch):
            classes[table.get(ch, ch)].add(ch)
    for proto, members in classes.items():
        if len(proto) == 1 and _own_kind(proto):
            members.add(proto)
    letters, overlaid = {}, {}
    order = {"Ll": 0, "Lu": 1, "Nd": 2}
    for proto, members in classes.items():
        whole = all(unicodedata.category(c)[0] in "LNM" for c in proto)
        plain = sorted((m for m in members if m.isascii()), key=lambda m: order.get(unicodedata.category(m), 3))
        for ch in members:
            same = [m for m in members if unicodedata.category(m) == unicodedata.category(ch)]
            to = next((m for m in plain if m in same), None) or next((m for m in plain if m != ch.swapcase()), None) or min(same)
            if whole and not ch.isascii() and to != ch:
                letters[ch] = to
        if len(proto) == 2 and unicodedata.combining(proto[1]) == OVERLAY and proto[0].isascii():
            overlaid[proto] = min(members)
    return letters, overlaid


def _by_rule() -> dict[int, str]:
    table: dict[int, str] = {}
    for cp in range(0x20000):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        category = unicodedata.category(ch)
        if category == "Cf":
            table[cp] = ""
        elif category == "Zs":
            table[cp] = " "
        elif kind in ALIKE and ch not in "ſẛ":
            to = unicodedata.normalize("NFKD", ch)
            if not to.startswith(" ") and not any(unicodedata.decomposition(chr(int(x, 16))).startswith(("<super>", "<sub>")) for x in rest.split()):
                table[cp] = to
    for first, last in IGNORABLE:
        table.update(dict.fromkeys(range(first, last + 1), ""))
    return table


#: Which look-alikes a form replaces: those of all scripts; those that stand for an ASCII character of their category, so
#: that words stay whole; or the short lists above, so that the letters of every language stay what they are.
ALL, LATIN_ONLY, SHORT = "all", "latin", "short"


@functools.cache
def prototypes(scope: str = ALL) -> dict[int, str]:
    """Code point -> prototype, built by rule from the character database, the classes of look-alikes and the lists above."""
    table = _by_rule()
    if scope != SHORT:
        same = lambda a, b: scope == ALL or (b.isascii() and unicodedata.category(a) == unicodedata.category(b))
        table.update({ord(a): b for a, b in look_alikes()[0].items() if ord(a) not in table and same(a, b)})
    for known in (CYRILLIC, GREEK, ARMENIAN, LATIN, DASHES):
        table.update({ord(a): b for a, b in known.items()})
    table.pop(0x20)
    for _ in range(4):  # a decomposition, or a class, can end in another look-alike
        single = {cp: to for cp, to in table.items() if len(to) == 1}
        table = {cp: unicodedata.normalize("NFD", to).translate(single) for cp, to in table.items()}
    return table


@functools.cache
def replacements(scope: str = ALL) -> dict[str, str]:
    """Composed character -> its visible form, for every character that differs from it."""
    normalize, table = unicodedata.normalize, prototypes(scope)
    found = {}
    for cp in range(0x80, 0x20000):
        if not 0xD800 <= cp < 0xE000 and not 0x3400 <= cp < 0xA000:
            to = normalize("NFC", normalize("NFD", chr(cp)).translate(table))
            if to != normalize("NFC", chr(cp)):
                found[chr(cp)] = to
    return found | {chr(cp): to for cp, to in table.items() if cp >= 0x20000}


@functools.cache
def _special(scope: str) -> tuple[frozenset[str], dict[int, str]]:
    found = replacements(scope)
    return frozenset(found), {ord(a): b for a, b in found.items()}


def _form(text: str, scope: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    known, table = _special(scope)
    held = set(text)
    special = known.intersection(held)
    if special:
        for ch in special:
            text = text.replace(ch, table[ord(ch)])
        text = unicodedata.normalize("NFC", text)
    return _whole_letters(text) if scope == ALL and any(unicodedata.combining(c) == OVERLAY for c in held) else text


def _whole_letters(text: str) -> str:
    """Letters with an overlaid stroke as the letters that they look like."""
    text = unicodedata.normalize("NFD", text)
    for marked, letter in look_alikes()[1].items():
        text = text.replace(marked, letter.translate(prototypes()))
    return unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """The visible form, canonically composed, which keeps equality as it is."""
    return _form(text, ALL)


def plain_form(text: str) -> str:
    """The visible form by the short lists only, in which the letters of every language stay what they are."""
    return _form(text, SHORT)


WORD = re.compile(r"[^\W_]+")


def word_form(text: str) -> str:
    """The visible form with case ignored and words whole."""
    return _form(text, LATIN_ONLY).lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the visible form, case ignored."""
    return WORD.findall(word_form(text))


@functools.cache
def word_points() -> np.ndarray:
    """Which code points are letters or digits, hence in words."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])
