import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.runs import word_hashes
from corpusloom.llm.alike import alike_classes, alike_members, alike_pairs, visible_texts
from corpusloom.llm.visible import WORD, LATIN_ONLY, look_alikes, prototypes, replacements, skeleton, word_form, word_points, words


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｆｕｌｌ　width！", "Full width!"), ("café", "café"), ("a​b­c﻿", "abc"), ("no break thin", "no break thin"), ("pаypаl", "paypal"), ("ΑΒΟ", "ABO"), ("ﬁeld", "field"),
        ("a‑b", "a-b"), ("line\r\nend", "line\nend"), ("ｶﾞ", "ガ"), ("ę́", "ę́"), ("ё", "ë"), ("𝐀", "A"),
        ("α", "a"), ("ρ", "p"), ("υ", "u"), ("З", "3"), ("Ӏ", "I"), ("ү", "y"), ("Ꭺ", "A"), ("Ꮯ", "C"), ("Ⲟ", "O"), ("ᴄ", "c"), ("ꓮ", "A"), ("Г", "Γ"), ("о̸", "ø"), ("ó̸", "ǿ"), ("ß", "β"),
    ],
)
def test_alike(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("x2", "x²"), ("①", "1"), ("a,", "a"), ("a b", "a  b"), ("a b", "ab"), ("–", "-"), ("½", "1/2"), ("₂", "2"), ("ж", "z"), ("0", "O"), ("1", "l"), ("I", "l"), ("m", "rn"), ("ø", "o"), ("œ", "oe"), ("к", "k"), ("’", "'"), ("К", "k")])
def test_different(a, b):
    assert skeleton(a) != skeleton(b)


@settings(deadline=None)
@given(st.text(max_size=60))
def test_stable_under_forms(text):
    once = skeleton(text)
    assert skeleton(once) == once
    assert skeleton(unicodedata.normalize("NFD", text)) == skeleton(unicodedata.normalize("NFC", text)) == once


@settings(deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x1FFF, exclude_categories=("Cs",)), max_size=40))
def test_equals_the_definition(text):
    """Decompose, replace every character by its prototype, decompose again; composed at the end."""
    plain = unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(prototypes())
    for stroked, letter in look_alikes()[1].items():
        plain = unicodedata.normalize("NFD", plain).replace(stroked, letter.translate(prototypes()))
    assert skeleton(text) == unicodedata.normalize("NFC", plain)


@settings(deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_arrays(texts):
    owner, hashes = word_hashes(texts, word_form, word_points())
    wanted = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert owner.tolist() == [i for i, _ in wanted]
    seen = {}
    for (_, w), h in zip(wanted, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_stay_whole():
    """No letter of a word turns into something that parts the word."""
    assert len(look_alikes()[0]) > 700
    assert not [a for a, b in replacements(LATIN_ONLY).items() if a.isalnum() and len(b) == 1 and not b.isalnum() and a not in "ﾞﾟ"]  # voice marks join the letter before
    assert words("который красный йод") == words("который красный йод") and len(words("который красный йод")) == 3


def test_words():
    assert words("Ｈｅｌｌｏ, wor​ld_2 É") == ["hello", "world", "2", "é"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, form string, key_a int")


def test_pairs(spark):
    rows = [("a", "pаypal", "x", 1), ("b", "paypal", "x", 1), ("c", "paypal", "x", 1), ("b", "paypal", "x", 1), ("d", "other", "x", 1), (None, "paypal", "x", 1), ("e", None, "x", 1), ("f", "", "x", 1), ("g", " ​", "x", 1), ("h", " ", "x", 1)]
    assert {tuple(r) for r in alike_pairs(frame(spark, rows), "k", "t").collect()} == {("a", "b"), ("a", "c")}
    assert {r.key for r in alike_members(frame(spark, rows), "k", "t").collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in alike_classes(frame(spark, rows), "k", "t").collect()} == {("a", "a", 2), ("b", "a", 1), ("c", "a", 1)}
    assert alike_pairs(frame(spark, []), "k", "t").count() == 0 == alike_classes(frame(spark, []), "k", "t").count()
    long = "x" * 300_000
    assert {tuple(r) for r in alike_pairs(frame(spark, [("p", long, "", 0), ("q", long + "​", "", 0)]), "k", "t").collect()} == {("p", "q")}
    assert {r.key: r.visible for r in visible_texts(frame(spark, [("p", "ａ", "", 0), ("q", None, "", 0), ("r", "", "", 0)]), "k", "t").collect()} == {"p": "a", "q": None, "r": ""}
