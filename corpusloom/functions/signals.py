"""Consent signals: robots.txt, ai.txt and TDM reservation, and the rulesets that decide on them.

Files are parsed once into arrays of (agent, allow, pattern) by an Arrow-batched UDF; verdicts are Column expressions over
the arrays, so one parsed file answers for any number of paths and agents by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOWED, DISALLOWED, UNKNOWN = "allowed", "disallowed", "unknown"
RULES = T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("pattern", T.StringType())]))

# User agents that collect training data.
AI_USER_AGENTS = """
GPTBot ChatGPT-User OAI-SearchBot Google-Extended ClaudeBot anthropic-ai Claude-Web CCBot PerplexityBot Perplexity-User Applebot-Extended
Bytespider FacebookBot Meta-ExternalAgent Amazonbot cohere-ai cohere-training-data-crawler Diffbot ImagesiftBot Omgilibot YouBot
""".split()


def parse_rules(file: bytes | str, allow: str, disallow: str) -> list[tuple[str, bool | None, str | None]]:
    """(agent, allow, pattern) of every rule under every agent of its group; an agent alone has a null rule.

    Neighbouring User-agent lines share a group; rules before any agent belong to *; blank and comment lines change
    nothing, an unknown directive ends a run of agents; bytes that are not UTF-8 are an error.
    """
    text = file.decode("utf-8") if isinstance(file, (bytes, bytearray)) else file
    out: list[tuple[str, bool | None, str | None]] = []
    agents: list[str] | None = None
    naming = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*(agents or []), value.lower()] if naming else [value.lower()]
            out.append((value.lower(), None, None))
        elif key in (allow, disallow):
            if agents is None:
                agents = ["*"]
                out.append(("*", None, None))
            out += [(a, key == allow, value) for a in agents]
        naming = key == "user-agent"
    return out


def _rules_udf(allow: str, disallow: str):
    @F.pandas_udf(RULES)
    def udf(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in files:
            yield series.map(lambda f: None if f is None else [{"agent": a, "allow": w, "pattern": p} for a, w, p in parse_rules(f, allow, disallow)])

    return udf


def robots_rules(file: Column) -> Column:
    return _rules_udf("allow", "disallow")(file)


def ai_txt_rules(file: Column) -> Column:
    return _rules_udf("allow-ai-training", "disallow-ai-training")(file)


def knows_agent(rules: Column, agent: Column) -> Column:
    return F.exists(rules, lambda r: (r["agent"] == F.lower(agent)) | (r["agent"] == "*"))


def _of_agent(rules: Column, agent: Column) -> Column:
    """Rules of the agent's own groups if there are any, else of the groups for all."""
    own = F.filter(rules, lambda r: r["agent"] == F.lower(agent))
    return F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))


def _best(rules: Column, agent: Column, score) -> Column:
    """Verdict of the rule with the greatest score; of equal ones an allowing rule; no matching rule allows."""
    mine = _of_agent(rules, agent)
    scored = F.filter(F.transform(mine, lambda r: F.struct(score(r["pattern"]).alias("score"), r["allow"].alias("allow"))), lambda x: x["score"].isNotNull())
    winner = F.array_max(scored)
    return F.when(rules.isNull() | (F.size(mine) == 0), UNKNOWN).when(F.coalesce(winner["allow"], F.lit(True)), ALLOWED).otherwise(DISALLOWED)


def robots_verdict(rules: Column, agent: Column, path: Column) -> Column:
    """The longest prefix of the path wins; an empty pattern matches nothing; no globbing."""
    return _best(rules, agent, lambda p: F.when((p != "") & path.startswith(p), F.octet_length(p)))


def ai_txt_verdict(rules: Column, agent: Column, path: Column, mime: Column | None = None) -> Column:
    """Paths count 1000 more than their length; media patterns need a media type: type/* its length, a whole type its length
    and 10, * counts 1."""
    mime = F.lit(None).cast("string") if mime is None else mime

    def score(p: Column) -> Column:
        media = (p == "*") | (p.contains("/") & ~p.startswith("/"))
        prefix = F.regexp_replace(p, "/\\*$", "")
        of_media = F.when(p == "*", 1).when(p.endswith("/*"), F.when(F.lower(mime).startswith(F.lower(prefix)), F.octet_length(prefix) + 2)).when(F.lower(p) == F.lower(mime), F.octet_length(p) + 10)
        return F.when(media, F.when(mime.isNotNull(), of_media)).when((p != "") & path.startswith(p), F.octet_length(p) + 1000)

    return _best(rules, agent, score)


TDM_RULES = "array<struct<location:string,`tdm-reservation`:int,`tdm-policy`:string>>"


def tdm_rules(file: Column) -> Column:
    """Rules of a well-known file, a JSON array; none for an empty file; another shape or reservation is an error."""
    parsed = F.from_json(file, TDM_RULES, {"mode": "PERMISSIVE"})
    wrong = parsed.isNull() | F.exists(parsed, lambda r: r["location"].isNull() | ~F.coalesce(r["tdm-reservation"].isin(0, 1), F.lit(False)))
    return F.when(file.isNull(), None).when(F.trim(file) == "", F.array().cast(TDM_RULES)).when(wrong, F.raise_error(F.lit("malformed TDM reservation file"))).otherwise(parsed)


def tdm_header(value: Column) -> Column:
    bare = F.trim(value)
    return F.when(bare.isin("0", "1"), bare.cast("int"))


def tdm_meta(html: Column) -> Column:
    """Reservation of the first meta tag that is named for it and has a content, in any order of its quoted attributes."""
    tags = F.regexp_extract_all(F.lower(html), F.lit(r"(<meta[^>]*)>"), 1)
    quoted = lambda name: name + r"""=\s*(?:"([^"]*)"|'([^']*)')"""
    value = lambda tag, name: F.when(tag.rlike(quoted(name)), F.concat(F.regexp_extract(tag, quoted(name), 1), F.regexp_extract(tag, quoted(name), 2)))
    named = F.filter(tags, lambda t: (value(t, "name") == "tdm-reservation") & value(t, "content").isNotNull())
    return tdm_header(value(F.get(named, F.lit(0)), "content"))


def tdm_verdict(header: Column, meta: Column, rules: Column, path: Column) -> Column:
    """Header before meta tag before the longest matching location, of equal ones the first; none is unknown."""
    matching = F.filter(F.transform(rules, lambda r, i: F.struct(F.octet_length(r["location"]).alias("n"), (-i).alias("i"), r["location"].alias("l"), r["tdm-reservation"].alias("r"))), lambda x: (x["l"] != "") & path.startswith(x["l"]))
    value = F.coalesce(header, meta, F.array_max(matching)["r"])
    return F.when(value.isNull(), UNKNOWN).when(value == 1, DISALLOWED).otherwise(ALLOWED)


def decide(reports: Column, ruleset: Column) -> Column:
    """struct(decision, reason) of an array of struct(source, verdict) in report order under strict, audit or permissive."""
    no = F.filter(reports, lambda r: r["verdict"] == DISALLOWED)
    yes = F.exists(reports, lambda r: r["verdict"] == ALLOWED)
    reason = F.when(F.size(no) > 0, F.concat(F.get(no, F.lit(0))["source"], F.lit(" signal: Disallowed"))).when(~yes & (ruleset != "permissive"), F.lit("no signal expressed a preference (all Unknown)"))
    decision = (
        F.when((F.size(no) > 0) & (ruleset == "strict"), "exclude").when(F.size(no) > 0, "flag").when(yes, "include")
        .when(ruleset == "strict", "exclude").when(ruleset == "audit", "flag").otherwise("include")
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def is_included(decision: Column) -> Column:
    return decision != "exclude"
