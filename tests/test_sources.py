import json

import pytest
from pyspark.sql import functions as F

from corpusloom.schemas import MANIFEST
from corpusloom.sources import readers as r


def test_jsonl(spark, tmp_path):
    lines = ['{"id": "a", "text": "one"}', "", '{"id": 7, "text": "two"}', '{"text": "three"}', '{"id": null, "text": ""}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert {tuple(x) for x in r.read_documents(spark, str(tmp_path / "c.jsonl")).collect()} == {("a", "one"), ("7", "two"), ("c/3", "three"), ("c/4", "")}
    for bad in ('{"id": 1}', '{"text": 3}', "nonsense", '{"text": null}'):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="no text in line 0"):
            r.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError, match="unknown kind"):
        r.read_documents(spark, "x.csv")


def test_parquet(spark, tmp_path):
    spark.createDataFrame([("x", 1), (None, 2)], "text string, n int").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    found = r.read_documents(spark, str(tmp_path / "d.parquet")).collect()
    assert sorted(x.text for x in found) == ["", "x"] and sorted(x.id.rsplit("/", 1)[1] for x in found) == ["0", "1"]
    with pytest.raises(TypeError):
        r.read_parquet_texts(spark, str(tmp_path / "d.parquet"), "n")


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.range(50).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("document_id"), F.lit(0).alias("occurrence_index"), F.lit(7).alias("size_bytes"))
    full = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST))
    r.write_manifest(full, str(tmp_path / "m"))
    found = r.read_manifest(spark, str(tmp_path / "m"))
    assert found.schema.simpleString() == MANIFEST.simpleString() and r.manifest_row_count(spark, str(tmp_path / "m")) == 50
    assert {bytes(x.document_id) for x in found.collect()} == {bytes(x.document_id) for x in rows.collect()}
    assert "org.apache.spark.version" in r.manifest_metadata(str(tmp_path / "m"))
    rows.write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="lacks"):
        r.read_manifest(spark, str(tmp_path / "short"))


def test_corpus_description_and_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "c.toml").write_text('[corpus]\nname = "c"\nsource_date_epoch = 9\n[[entry]]\nsource_url = "a.txt"\nmodality = "text"\n')
    entries = r.read_corpus_toml(spark, str(tmp_path / "c.toml"))
    row = r.with_file_content(spark, entries, str(tmp_path)).first()
    assert (bytes(row.content), row.included, row.fetched_at, row.input_ordinal) == (b"one", True, 9, 0)
    stored = spark.createDataFrame([(b"\1" * 32, b"x"), (b"\1" * 32, b"x"), (b"\2" * 32, b"y")], "document_id binary, content binary")
    for _ in range(2):
        r.store_content(stored, str(tmp_path / "cas"))
    assert spark.read.parquet(str(tmp_path / "cas")).count() == 2
    (tmp_path / "c.toml").write_text('[[entry]]\nsource_url = "https://x.example/"\nmodality = "text"\n')
    with pytest.raises(ValueError, match="remote"):
        r.read_corpus_toml(spark, str(tmp_path / "c.toml"))


def test_remote_names():
    assert r.manifest_source("hf://a/b@v1") == {"kind": "hf", "location": "a/b", "revision": "v1"}
    assert r.manifest_source("hf://a/b")["revision"] == "main" and r.manifest_source("file:///x")["location"] == "/x"
    assert r.cache_key("hf://a/b") == r.cache_key("hf://a/b@main") != r.cache_key("hf://a/b@v1")
    json.dumps(r.manifest_source("https://x.example/m"))


def test_trees_rows_and_reports(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / "t" / split).mkdir(parents=True)
        (tmp_path / "t" / split / "1.txt").write_text(split)
    assert {(x.split, x.name, bytes(x.content)) for x in r.read_text_tree(spark, str(tmp_path / "t")).collect()} == {("train", "1.txt", b"train"), ("test", "1.txt", b"test")}
    rows = r.entries_of_rows(spark.createDataFrame([("u", None)], "u string, t string"), F.col("t"), F.col("u"), "d").first()
    assert (rows.source_url, bytes(rows.content), rows.size_bytes, rows.language) == ("u", b"", 0, None)
    r.write_report({"b": 1, "a": 2}, "# r\n", str(tmp_path / "out"))
    assert (tmp_path / "out" / "report.json").read_text() == '{"a":2,"b":1}'
