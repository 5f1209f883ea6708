import os

import pytest

from corpusloom.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = {"p1_found": ["src", "key_a", "key_b"], "p2_found": ["row_a", "row_b"], "p4_found": ["src", "rec_key", "seg_no", "lang"], "p5_found": ["benchmark", "item_id", "doc_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind"]}
    assert df.columns == columns.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
    if name == "p6_ids":
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
