"""The SQL of the training-data queries, and the pipeline against its parts."""

import os

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import frames, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "stamps"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got, expected = queries.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert a.equals(b)


def test_stages_keep_columns_and_take_effect(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        docs = frames.stored(out)
        kept = docs.count()
        assert 0 < kept <= n, name
        n = kept
    assert len(corpus_pipeline.STAGES) == 5
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() > 100
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 4096


def test_held_out_accuracy(spark):
    larger = SF_DIR.replace("sf0.001", "sf0.01")  # the smallest table has some seventy labels
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    scored = queries.op7_quality_classifier(spark, larger).join(labels, "doc_id").filter("held_out")
    right, total = scored.filter("predicted = quality").count(), scored.count()
    assert right >= 0.9 * total
