import os
import random

import pyarrow as pa
import pytest

from corpusloom.llm import tokenize as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_VOCABULARY), reason="no vocabulary file")
tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    own = tk.Vocabulary.parse(tk.read_vocabulary(tk.DEFAULT_VOCABULARY))
    return own, tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def encode(vocabulary, texts):
    bounds, ids = tk.encode(pa.array(texts, pa.string()), vocabulary)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_equal_to_another_implementation(both):
    own, other = both
    random.seed(1)
    alphabet = " \n\t 'strevlmdST1²é中!.́​\r "
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(40))) for _ in range(5000)]
    texts += ["", " ", "'", "''s", "it's we'll they've I'd 'sx 're'", "<|endoftext|>", "a" * 20_000, "'" * 999, "ab" * 5000, " " * 700 + "x", "x" + "\n" * 300, "日本語" * 400, "🏽👩‍👧" * 50, "\x00\x1c\x85 x"]
    assert encode(own, texts) == [other.encode_ordinary(t) for t in texts]


def test_scan_equals_stepping():
    random.seed(2)
    import numpy as np

    functions, _, following, _ = tk._automaton()
    for n in (1, 5, tk.BLOCK, tk.BLOCK + 1, 3000, tk.BLOCK * tk.BLOCK + 7):
        symbols = np.array([random.randrange(2 * tk.SYMBOLS) for _ in range(n)])
        states, state = [], tk.DONE
        for s in symbols:
            states.append(state)
            state = following[state, s]
        assert functions[:, tk.DONE][tk._states_before(tk._generators()[symbols])].tolist() == [int(s) for s in states]


def test_columns(spark, both):
    texts = ["it's", None, "", "naïve café", "x" * 100_000, "it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as ids", "1 as ends", "2 as n_tokens")
    ids = {r.doc_id: r.ids for r in tk.token_ids(df, "doc_id", "text").collect()}
    assert ids == {i: both[1].encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tk.decode_ids(tk.token_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    for r in tk.token_spans(df, "doc_id", "text").collect():
        raw = (texts[r.doc_id] or "").encode()
        pieces = [raw[a:b] for a, b in zip([0, *r.ends], r.ends, strict=False)]
        assert b"".join(pieces) == raw and [both[0].ranks[p] for p in pieces] == r.ids
    counts = tk.token_counts(df.drop("n_tokens"), "text")
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {i: len(x) for i, x in ids.items()} and "ids" in counts.columns
    assert tk.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_bounded_cache(both, monkeypatch):
    monkeypatch.setattr(tk, "CACHED_PIECES", 10)
    monkeypatch.setattr(tk, "SLICE_BYTES", 50)
    own = tk.Vocabulary(both[0].ranks)
    texts = [f"word{i} number {i * 7}" for i in range(300)]
    assert encode(own, texts) == [both[1].encode_ordinary(t) for t in texts]
    assert len(own.cache) < 60
