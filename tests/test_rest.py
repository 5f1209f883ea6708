import base64
import json

import numpy as np
import pytest

from corpusloom.functions import evidence as e
from corpusloom.functions import media
from corpusloom.operators.passages import passages
from corpusloom.streaming.incremental import arriving_words, each_batch


def test_json_and_statements():
    assert e.deterministic_json({"b": [2, 1], "a": {"d": 1.0, "c": "é"}}) == '{"a":{"c":"é","d":1.0},"b":[2,1]}'
    with pytest.raises(ValueError):
        e.deterministic_json(float("nan"))
    assert e.canonicalize({"a": {"t": 1}, "l": [{"x": 2}]}, {"a.t": "<T>", "l[].x": "<X>"}) == {"a": {"t": "<T>"}, "l": [{"x": "<X>"}]}
    made = e.statement("m", {"sha256": "0" * 64}, "type", {})
    assert e.statement_of_bundle({"dsseEnvelope": {"payload": base64.b64encode(json.dumps(made).encode()).decode()}}) == made
    with pytest.raises(ValueError):
        e.statement("m", {"sha256": "XYZ"}, "type", {})
    near = lambda i, d: {"leafIndex": i, "document_id": d}
    assert e.non_inclusion_predicate({}, "bb", "interior", near(1, "aa"), near(2, "cc"))["boundaryCase"] == "interior"
    for wrong in [("bb", "interior", None, near(0, "cc")), ("bb", "interior", near(1, "aa"), near(3, "cc")), ("dd", "interior", near(1, "aa"), near(2, "cc")), ("bb", "nowhere", None, None)]:
        with pytest.raises(ValueError):
            e.non_inclusion_predicate({}, *wrong)
    with pytest.raises(ValueError):
        e.inclusion_predicate({}, 3, 3, [], "blake3", 1.0)
    with pytest.raises(ValueError):
        e.binding_predicate({"sha256": "0" * 64}, [])
    assert e.pre_authentication_encoding("t", b"xy") == b"DSSEv1 1 t 2 xy" and e.rfc3339(0) == "1970-01-01T00:00:00Z"
    totals = {"documents": 1, "total_bytes": 2}
    assert "n<1K" in e.dataset_card("d", totals, "r", "n<1K", []) and e.cyclonedx("d", totals, "r", 0)["components"][0]["name"] == "d"
    assert e.croissant("d", totals, "r", [{"license_spdx": "MIT"}], "u")["license"] == ["MIT"]
    assert e.corpus_predicate(totals, "r", [{"signal": "ai_txt", "coverage_ppm": 5}], [])["signalCoverage"] == {"ai_txt": 5}


def test_image_hashes():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (60, 90, 3)).astype(np.uint8)
    big = np.repeat(np.repeat(image, 2, 0), 2, 1)
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    for f in (media.phash, media.blockhash):
        assert f(image) == f(big)
        assert (f(image) ^ f(noisy)).bit_count() <= 6
        assert (f(image) ^ f(rng.integers(0, 255, (60, 90, 3)).astype(np.uint8))).bit_count() > 12
    assert np.allclose(media.shrink(np.ones((5, 7)), 3, 2), 1)


def test_passages(spark):
    text = "before any title there are words here\n = Some Title = \n\n The game is a role @-@ playing game .\n = = Part = = \n too short\n another line that is long enough\n = Some Title = \n words of the second article here\n"
    found = passages(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert sorted((r.source_uri, r.passage) for r in found) == [
        ("wikipedia://Some_Title#p1", "The game is a role-playing game."), ("wikipedia://Some_Title#p2", "another line that is long enough"),
        ("wikipedia://Some_Title-2#p1", "words of the second article here"), ("wikipedia://_unknown#p1", "before any title there are words here"),
    ]


def test_streams(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01' as at, 'one two' as text union all select timestamp'2025-01-01', null union all select timestamp'2025-02-01', 'x'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in"))
    each_batch(stream, lambda df: df.where("text is not null"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = arriving_words(stream, "at", "text").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.documents, r.words) for r in spark.table("w").collect()) == [(1, 1), (2, 2)]
