"""The registered queries on the small driver tables, and the pipeline."""

import os

import brute
import duckdb
import pytest

from loomtick.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    made = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in made.description)
    want = sorted(str([dict(zip([c[0] for c in made.description], r, strict=True))[c] for c in columns]) for r in made.fetchall())
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        assert set(r[0] for r in docs.select("doc_id").collect()) <= set(r[0] for r in before.select("doc_id").collect())
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c[1] for c in brute.classes(rows, 0.8)})
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
