import numpy as np
import pytest

from corpusloom.llm import language as lg

TEXTS = {
    "en": "the committee of the town keeps the register and the council reads a letter from the village", "de": "die gemeinde bewahrt das register und der rat liest einen brief aus dem dorf in der alten stadt",
    "fr": "le conseil de la ville garde le registre et lit une lettre du village pendant les travaux", "es": "el consejo de la ciudad guarda el registro y lee una carta del pueblo durante las obras",
    "ru": "совет города хранит реестр и читает письмо из деревни во время работ на реке", "zh": "旧城区的档案馆保存了报告而且图书馆记录了笔记本",
}


@pytest.fixture(scope="module")
def model():
    texts = [" ".join(np.random.default_rng(i).permutation(t.split())) for t in TEXTS.values() for i in range(40)]
    seeds = [(lang, w) for lang, t in TEXTS.items() for w in t.split() if len(w) < 5 or lang in ("ru", "zh")]
    return lg.WordModel.fit(texts, seeds)


def test_held_out_orders(model):
    for lang, text in TEXTS.items():
        shuffled = " ".join(np.random.default_rng(99).permutation(text.split()))
        assert lg.label_texts([shuffled], model)[0][0][1] == lang


def test_lines_of_mixed_text(model):
    text = f"{TEXTS['en']}\n\n{TEXTS['ru']}\n{TEXTS['en']} «совет»\n{TEXTS['zh']}"
    found = lg.label_texts([text], model)[0]
    assert [x[1] for x in found] == ["en", "en", "ru", "en", "zh"] and [x[0] for x in found] == [0, 1, 2, 3, 4]
    assert all(0 < x[2] <= 1 for x in found)


def test_looks_do_not_matter(model):
    spoiled = TEXTS["en"].replace("o", "о").replace("e ", "e ").replace("tt", "t​t")
    assert lg.label_texts([spoiled], model)[0][0][1] == "en"


@pytest.mark.parametrize("text", ["", " \n ", "12 345 6\n7 8", "4b5eca 30d9cd 732470 3b36d5 a0e1c2 e5a4d1", "!!! ???"])
def test_no_language(model, text):
    assert {x[1] for x in lg.label_texts([text], model)[0]} == {None}


def test_viterbi_equals_one_by_one():
    rng = np.random.default_rng(7)
    lengths = np.array([0, 5, 1, 12, 0, 7])
    scores = rng.normal(0, 3, (lengths.sum(), 4)).astype(np.float32)
    found, at = lg.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        s = scores[at : at + n]
        if n:
            value, back = s[0].astype(float), []
            for row in s[1:]:
                best = value.argmax()
                move = value[best] - 2.0 > value
                back.append(np.where(move, best, np.arange(4)))
                value = np.where(move, value[best] - 2.0, value) + row
            path = [int(value.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert found[at : at + n].tolist() == path[::-1]
        at += n
    assert len(lg.viterbi(np.zeros((0, 4), np.float32), np.zeros(3, np.int64))) == 0


def test_labels(spark):
    given = {"en": "en", "EN": "en", "en_US": "en", "English": "en", "eng": "en", " de ": "de", "pt-BR": "pt", "zho": "zh", "und": None, "": None, "xx": None, "n/a": None, None: None, "ja": "ja", "Français": "fr"}
    df = spark.createDataFrame([(k,) for k in given], "l string")
    assert {r.l: r.y for r in df.select("l", lg.label_language(df.l).alias("y")).collect()} == given


def test_columns(spark, model):
    rows = [("a", TEXTS["en"]), ("b", None), (None, TEXTS["en"]), ("c", ""), ("d", f"{TEXTS['de']}\n{TEXTS['fr']}"), ("e", (TEXTS["es"] + " ") * 3000), ("a", TEXTS["en"])]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "'clash' as key", "1 as segments")
    out = lg.text_languages(df, "id", "text", model)
    found = {r.key: [s.lang for s in r.segments] for r in out.collect()}
    assert found == {"a": ["en", "en"], "b": [None], "c": [None], "d": [found["d"][0], "de", "fr"], "e": ["es", "es"]} and out.count() == 6
    assert {r.key for r in out.where(lg.is_mixed(out.segments)).collect()} == {"d"}
    assert lg.text_languages(df.where("false"), "id", "text", model).count() == 0


def test_fit_covers_all_texts_and_seeds(spark):
    rare = [f"{TEXTS['de']} {''.join('bdfghklmnp'[int(d)] for d in f'{i % 2000:04}')}" for i in range(6000)]  # 2,000 words, each in three texts
    seeds = [(lang, w) for lang in ("de", "ru") for w in TEXTS[lang].split()]
    more = spark.range(20_001).selectExpr("'en' as lang", "concat('x', translate(cast(id as string), '0123456789', 'bdfghklmnp')) as word")
    df = spark.createDataFrame([(t,) for t in [*rare, *[TEXTS["ru"]] * 3, None]], "text string").repartition(5)
    found = lg.fit_word_model(df, "text", spark.createDataFrame(seeds, "lang string, word string").unionByName(more))
    words = sorted({t.split()[-1] for t in rare})
    assert len(words) == 2000
    ru = found.index(lg.split_words("совет деревни"))
    assert found.known[ru, lg.LANGUAGES.index("ru")].all()
    whole = lg.WordModel.fit([*rare, *[TEXTS["ru"]] * 3], [*seeds, *[tuple(r) for r in more.collect()]])
    words += [*TEXTS["de"].split(), *TEXTS["ru"].split(), "bdfgz", "gemeinden", "zzz"]
    rows, same = found.index(words), whole.index(words)
    assert np.allclose(found.table[rows], whole.table[same], atol=1e-6)


def test_fit_on_nothing(spark):
    none = spark.createDataFrame([(None, None)], "lang string, word string")
    model = lg.fit_word_model(none.selectExpr("word as text"), "text", none)
    assert lg.label_texts([TEXTS["en"], TEXTS["zh"]], model)[1][0][1] == "zh"
