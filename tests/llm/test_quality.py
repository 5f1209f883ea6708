import numpy as np
import pytest

from corpusloom.llm import quality as q
from corpusloom.llm.sampling import bounded_sample

PROSE = "The old mill keeps the register of the town. Later, the council reads a letter from the village, and the school copies the map of the valley. In the same week, the harbour office closes its doors."
NONE = (np.zeros(0, np.uint64), np.zeros(0))
TEXTS = {
    "prose": [PROSE, PROSE.upper(), PROSE.replace(". ", ".\n"), PROSE.replace(", ", ",\n"), "# Title\n\n" + PROSE, PROSE.replace(" ", " "), "普查期间，第二版的天文台比较了报告。同一个星期里，第二版的许可证检查了日报。"],
    "list": ["- the mill\n- the map of the valley\n- the school\n- the old town", "1. mill\n2. map\n3. school", "User-agent: *\nDisallow: /private/\nAllow: /public/\nUser-agent: Bot\nDisallow: /", "[x] the mill\n[ ] the map\n[x] the school", "a/b/c.txt\nd/e/f.json\ng/h/i.bin", "Mill; Map; School; Town; Valley; Harbour; Office; Village"],
    "table": ["name,size,date\nmill,12,2020-01-01\nmap,7,2021-02-02\nschool,9,2022-03-03", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "name    size   place\nmill    12     north\nmap     7      south", "a\tb\tc\n1\t2\t3\n4\t5\t6"],
    "junk": ["Cj/Dj6D4ANKHNAGfutOXf3Z9p29GRxc6daKYxcxVy3CKXFeUGbhVG2T8tl8CpWqsFCAX", "<div class=\"a\" id=\"c50\"><span></span></div>\n&nbsp;&#355;&lt;/b&gt;", "ERR 0xdd80\n" * 40, "free best online free download best free online download free best online free best download free online best free download", "xkqj wrtzp bncvd ghjklm pqrstv xkqjw rtzpb ncvdg", "(|?%=~</_>#[{'-/>;<]+_%&~].<>;_:,$\" \\~(!%{=("],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in TEXTS.items() for t in texts])
def test_kinds(kind, text):
    assert q.KINDS[q.statistics([text], NONE, np.zeros(0, np.uint64))["kind"][0]] == kind


def test_statistics_against_plain_counts():
    common = np.unique(np.array([q.word_hash(w) for w in ("the", "of", "и")], np.uint64))
    texts = ["The cat, of course.\nNo stop\n\n", "Они и я.", "", None, " \n ", "one"]
    s = q.statistics(texts, NONE, common)
    assert s["n_words"].tolist() == [6, 3, 0, 0, 0, 1] and s["n_lines"].tolist() == [2, 1, 0, 0, 0, 1]
    assert s["share_common_words"].tolist() == [0.333333, 0.333333, 0, 0, 0, 0] and s["share_lines_end_stop"].tolist() == [0.5, 1, 0, 0, 0, 0]
    assert s["mean_word_length"].tolist()[0] == round(sum(map(len, "The cat of course No stop".split())) / 6, 6)
    assert s["symbol_ratio"].tolist()[0] == round(2 / 22, 6) and s["kind"].tolist()[2:5] == [-1, -1, -1]


def test_slices_change_nothing(monkeypatch):
    texts = [t for texts in TEXTS.values() for t in texts] * 3
    whole = q.statistics(texts, NONE, np.zeros(0, np.uint64))
    monkeypatch.setattr(q, "SLICE_BYTES", 100)
    for k, v in q.statistics(texts, NONE, np.zeros(0, np.uint64)).items():
        assert np.array_equal(v, whole[k]), k


def test_evidence_tells_sentences_from_entries():
    nouns = ["mill", "map", "school", "council", "register", "letter"]
    texts = [f"The {a} keeps the {b} of the {c} again." for a in nouns for b in nouns for c in nouns] + [f"- the {a}\n- the {b}\n- the {c}" for a in nouns for b in nouns for c in nouns]
    hashes, odds = q.fit_evidence(texts)
    known = dict(zip(hashes.tolist(), odds.tolist(), strict=True))
    assert known[q.word_hash("keeps")] > 1 > 0 > known[q.word_hash("mill")]


def test_columns(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "  ", PROSE, PROSE * 2000, PROSE])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as kind", "1 as n_words")
    words = spark.createDataFrame([("en", "the"), ("en", None), (None, "of")], "lang string, word string")
    found = {r.doc_id: r for r in q.text_quality(df, words).collect()}
    assert [found[i].kind for i in range(6)] == [None, None, None, "prose", "junk", "prose"]  # a text repeated 2000 times is endless repetition
    assert found[0].n_words == 0 and found[3].share_common_words > 0.2 and found[3][1:] == found[5][1:]
    assert q.text_quality(df.where("false"), words.where("false")).count() == 0
    assert len(bounded_sample(df, "text", 3)) <= 3


def _words(n):
    return ["x" + "".join("bdfghklmnp"[int(d)] for d in f"{i:05}") for i in range(n)]


def test_evidence_of_all_words():
    words = _words(60_000)
    hashes, _ = q.fit_evidence([" ".join(words[i : i + 20]) + "." for i in range(0, len(words), 20)] * 5)
    assert set(hashes.tolist()) == {q.word_hash(w) for w in words}


def test_columns_cover_all_texts_and_common_words(spark):
    words, rare = _words(60_000), "velm dorn quist harb tolm wend"
    entries = spark.range(60_000).selectExpr("id as doc_id", "concat('- mill ', translate(cast(id as string), '0123456789', 'bdfghklmnp')) as text")
    texts = [f"The {w}: {rare}." for w in words[:5]] + [rare, " ".join(words), None]  # words of evidence stand in five of all texts
    df = entries.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    common = spark.createDataFrame([("en", w) for w in words], "lang string, word string")
    found = {r.doc_id: r for r in q.text_quality(df, common).where("doc_id < 0").collect()}
    assert found[-6].kind == "prose" and found[-7].share_common_words == 1 and found[-8].kind is None
    known, odds = q.fit_evidence([r.text for r in df.where("text is not null").collect()])
    assert odds[known == q.word_hash("velm")].tolist() == [2]


def test_evidence_of_sentences_with_commas_without_spaces():
    texts = ["同一个星期里，旧城区的申请书比较了报告，而且图书馆保存了手稿。"] * 5 + ["- 报告\n- 旧城区\n- 手稿"] * 5 + ["name,报告,12,35,67,890."] * 5
    hashes, odds = q.fit_evidence(texts)
    known = dict(zip(hashes.tolist(), odds.tolist(), strict=True))
    assert known[q.word_hash("比较")] > 1 and known[q.word_hash("保存")] > 1 and q.word_hash("name") not in known
