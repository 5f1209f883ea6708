import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import signals as s


def verdict(spark, make, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(make(*(F.col(k) for k in columns)).alias("y")).first().y


@pytest.mark.parametrize(
    ("file", "agent", "path", "wanted"),
    [
        ("User-agent: *\nDisallow: /private\nAllow: /private/ok", "x", "/private/ok/1", "allowed"), ("User-agent: *\nDisallow: /private", "x", "/private", "disallowed"), ("User-agent: a\nDisallow: /", "b", "/", "unknown"),
        ("User-agent: *\nDisallow: /\nUser-agent: Bot\nDisallow:", "BOT", "/x", "allowed"), ("Disallow: /x # no\n", "any", "/x/y", "disallowed"), ("User-agent: a\nUser-agent: b\n\nDisallow: /", "b", "/", "disallowed"),
        ("User-agent: a\nCrawl-delay: 1\nUser-agent: b\nDisallow: /", "a", "/", "allowed"), ("User-agent: *\nDisallow: /a\nAllow: /a", "x", "/a", "allowed"), ("", "x", "/", "unknown"), (None, "x", "/", "unknown"),
        ("User-agent: *\nDisallow: /*.pdf", "x", "/a.pdf", "allowed"),
    ],
)
def test_robots(spark, file, agent, path, wanted):
    assert verdict(spark, lambda f, a, p: s.robots_verdict(s.robots_rules(f), a, p), f=file, a=agent, p=path) == wanted


@pytest.mark.parametrize(
    ("file", "path", "mime", "wanted"),
    [
        ("User-Agent: *\nDisallow-AI-Training: image/*\n", "/p.jpg", "image/jpeg", "disallowed"), ("User-Agent: *\nDisallow-AI-Training: image/*\n", "/p.jpg", None, "allowed"),
        ("User-Agent: *\nDisallow-AI-Training: *\nAllow-AI-Training: text/plain\n", "/p", "TEXT/PLAIN", "allowed"), ("User-Agent: *\nDisallow-AI-Training: *\nAllow-AI-Training: text/plain\n", "/p", "text/html", "disallowed"),
        ("User-Agent: *\nAllow-AI-Training: image/png\nDisallow-AI-Training: /p\n", "/p.png", "image/png", "disallowed"),
    ],
)
def test_ai_txt(spark, file, path, mime, wanted):
    assert verdict(spark, lambda f, p, m: s.ai_txt_verdict(s.ai_txt_rules(f), F.lit("GPTBot"), p, m), f=file, p=path, m=mime) == wanted


def test_not_utf8_is_an_error():
    with pytest.raises(UnicodeDecodeError):
        s.parse_rules(b"\xff\xfe\x00", "allow", "disallow")


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ('<html><head><meta name="tdm-reservation" content="1"></head></html>', 1), ("<META NAME='tdm-reservation' CONTENT='0' />", 0), ('<meta content="1" name="tdm-reservation">', 1),
        ('<meta charset="utf-8">', None), ('<meta name="tdm-reservation" content="2"><meta name="tdm-reservation" content="1">', None), ("<meta name=tdm-reservation content=1>", None), (None, None),
    ],
)
def test_tdm_meta(spark, html, wanted):
    assert verdict(spark, s.tdm_meta, h=html) == wanted


def test_tdm(spark):
    rules = '[{"location": "/a", "tdm-reservation": 1}, {"location": "/ab", "tdm-reservation": 0}]'
    get = lambda header, path, file=rules: verdict(spark, lambda h, f, p: s.tdm_verdict(s.tdm_header(h), F.lit(None).cast("int"), s.tdm_rules(f), p), h=header, f=file, p=path)
    assert [get(None, "/a/x"), get(None, "/abc"), get(None, "/z"), get("1", "/abc"), get("2", "/z"), get(None, "/a", "")] == ["disallowed", "allowed", "unknown", "disallowed", "unknown", "unknown"]
    for bad in ('{"location": "/"}', '[{"location": "/", "tdm-reservation": 7}]', "nonsense"):
        with pytest.raises(Exception, match="malformed"):
            get(None, "/", bad)


def reference_decision(verdicts, ruleset):
    if "disallowed" in verdicts:
        return "exclude" if ruleset == "strict" else "flag"
    if "allowed" in verdicts:
        return "include"
    return {"strict": "exclude", "audit": "flag", "permissive": "include"}[ruleset]


def test_decisions(spark):
    import itertools

    rows = [(list(zip("abc", v, strict=True)), r) for v in itertools.product(("allowed", "disallowed", "unknown"), repeat=3) for r in ("strict", "audit", "permissive")]
    df = spark.createDataFrame(rows, "reports array<struct<source:string,verdict:string>>, ruleset string")
    for r in df.select("*", s.decide(F.col("reports"), F.col("ruleset")).alias("d")).collect():
        verdicts = [x.verdict for x in r.reports]
        assert r.d.decision == reference_decision(verdicts, r.ruleset)
        if "disallowed" in verdicts:
            assert r.d.reason == f"{'abc'[verdicts.index('disallowed')]} signal: Disallowed"


@given(st.text(alphabet="useragntdilow-:*/# \n", max_size=80))
def test_parser_never_fails(text):
    assert all(a is not None for a, _, _ in s.parse_rules(text, "allow", "disallow"))
