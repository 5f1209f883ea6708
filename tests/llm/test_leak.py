import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.runs import runs_of, word_hashes
from corpusloom.llm import leak
from corpusloom.llm.visible import word_form, word_points, words


def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=90), st.lists(st.sampled_from("abcd"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_myers(pattern, text):
    symbols = {}
    for i, p in enumerate(pattern):
        symbols[p] = symbols.get(p, 0) | 1 << i
    assert leak.myers(symbols, len(pattern), text) == min(distance(pattern, text), len(pattern))


def run_array(w):
    return runs_of(*word_hashes([" ".join(w)], word_form, word_points()), 5)[1]


@given(st.lists(st.sampled_from("abcdefgh"), min_size=5, max_size=60))
@settings(deadline=None)
def test_budget_plus_one_pieces(w):
    runs = run_array(w)
    distinct, chosen = set(runs.tolist()), set(runs[leak.pieces(runs)].tolist())
    assert len(chosen) >= len(distinct) - leak.need(len(distinct)) + 1 and chosen <= distinct
    assert set(runs[::2].tolist()) <= chosen


def compared(item, body):
    """verify() of one item and one text, and whether a piece of the item stands in the text."""
    runs, text = run_array(item), run_array(body).tolist()
    number = {r: k for k, r in enumerate(dict.fromkeys(runs.tolist()))}
    hits = sorted((at, number[r], place) for at, r in enumerate(text) for place, x in enumerate(runs.tolist()) if x == r)
    piece = bool(set(runs[leak.pieces(runs)].tolist()) & set(text))
    at, held, places = (np.array(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, int),) * 3
    return (leak.verify(len(number), held, places, at) if hits else (False, 0, len(number))), piece


ITEM = [f"a{i}" for i in range(30)]
FILL = [f"x{i}" for i in range(40)]


@pytest.mark.parametrize(
    ("body", "leaks", "edits"),
    [
        (FILL + ITEM + FILL, True, 0),
        (ITEM[:10] + ["new"] + ITEM[10:], True, 4),  # a word too many breaks four runs
        (ITEM[:10] + ["new"] + ITEM[11:], True, 5),  # another word five
        (ITEM[:8] + FILL[:4] + ITEM[12:20] + FILL[5:9] + ITEM[24:], False, 16),  # a near miss: 10 of 26 runs, no row of 13
        (ITEM[15:27] + FILL + ITEM[:12], True, 10),  # two rows of twelve words, moved: 16 of 26 runs
        (ITEM[:12] + FILL + ITEM[20:24], False, 18),
        (FILL + ITEM[3:8] + FILL, False, 25),  # a piece, or a run beside one, and nothing else
        (ITEM[:13], True, 17),  # a row of thirteen is a leak whatever the distance
        (ITEM[:8] * 6, False, 22),  # repeats of the same runs are no more of the item
    ],
)
def test_distance_decides(body, leaks, edits):
    (found, row, distance), piece = compared(ITEM, body)
    assert (found, distance) == (leaks, edits)
    assert piece or not leaks


@given(st.integers(0, 1 << 30))
@settings(max_examples=100, deadline=None)
def test_rejects_and_keeps_what_the_rule_does(seed):
    random.seed(seed)
    alphabet = [f"w{i}" for i in range(random.choice([3, 12, 60]))]
    item = random.choices(alphabet, k=random.randrange(5, 40))
    body = random.choices(alphabet, k=5)
    for _ in range(random.randrange(6)):
        a = random.randrange(len(item))
        body += item[a : a + random.choice([5, 7, 12, 13, 20])] + random.choices(alphabet, k=random.randrange(3))
    (found, _, distance), piece = compared(item, body)
    assert found == bool(brute([(1, " ".join(body))], [("b", "q", " ".join(item))]))
    assert piece or not found
    five = {" ".join(item[i : i + 5]) for i in range(len(item) - 4)}
    here = {" ".join(body[i : i + 5]) for i in range(len(body) - 4)}
    assert distance >= len(five - here) and (distance <= len(five) // 2) == (2 * len(five & here) >= len(five))


def test_most_piece_hits_are_rejected():
    """Of 300 texts that hold one piece or a few of an item, the distance rejects what the budget does not allow."""
    random.seed(3)
    rejected = 0
    for _ in range(300):
        parts = [ITEM[2 * k : 2 * k + random.randrange(5, 12)] for k in random.sample(range(13), random.randrange(1, 4))]
        body = sum((p + random.choices(FILL, k=9) for p in parts), [])
        (found, _, _), piece = compared(ITEM, body)
        rejected += piece and not found
        assert found == bool(brute([(1, " ".join(body))], [("b", "q", " ".join(ITEM))]))
    assert rejected > 150


def brute(docs, items):
    out = set()
    for benchmark, item_id, text in items:
        w = words(text or "")
        five, thirteen = ({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} for n in (5, 13))
        for doc, body in docs:
            d = words(body or "")
            a, b = ({" ".join(d[i : i + n]) for i in range(len(d) - n + 1)} for n in (5, 13))
            if five and (thirteen & b or 2 * len(five & a) >= len(five)):
                out.add((benchmark, item_id, doc))
    return out


@pytest.fixture(scope="module")
def made():
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [("b", f"q{i}", " ".join(random.choices(vocabulary, k=random.randrange(3, 45)))) for i in range(40)] + [("b", "none", None), ("b", "blank", " "), ("c", "q1", "Ｗ1 w2 W3 w4 w5")]
    docs = []
    for i in range(150):
        w = random.choices(vocabulary, k=random.randrange(0, 50))
        for _ in range(random.randrange(3)):
            part = (random.choice(items)[2] or "").split()
            a = random.randrange(len(part) + 1)
            w[len(w) // 2 : len(w) // 2] = part[a : a + random.choice([5, 9, 12, 13, 14, 40])]
        docs.append((i, " ".join(w)))
    return [*docs, (900, None), (901, ""), (902, "W1, w2; w3 w​4 w5!"), (903, "x " * 200_000 + items[1][2] + " y" * 200_000)], items


def test_against_brute_force(spark, made):
    docs, items = made
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs + [(None, "w1 w2 w3 w4 w5")]], "doc_id long, text string, benchmark string, item_id string")
    i = spark.createDataFrame([(*x, 1) for x in items + items[:3]] + [(None, "q", "w1 w2 w3 w4 w5", 1)], "benchmark string, item_id string, text string, doc_id int")
    rows = [tuple(r)[:3] for r in leak.leaked_items(d, i).collect()]
    assert set(rows) == brute(docs, items) and len(rows) == len(set(rows)) and ("b", "q1", 903) in rows
    assert leak.leaked_items(d.where("false"), i).count() == 0 and leak.leaked_items(d, i.where("false")).count() == 0
