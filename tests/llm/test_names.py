"""Operators and pipeline stages keep columns whose names clash with those that they make themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat_format, decontaminate, fingerprints, frames, license_scan, line_dedup, minhash_dedup, packing, quality, secrets, url_filter

INTERNAL = (
    "_doc", "_hash", "_dropped", "_keep", "_gone", "_many", "_leaks", "_host", "_path", "_best", "_key", "_before", "_salt", "_rank", "_n", "_score", "_lines", "n_lines", "n_dropped", "score",
    "sequence_id", "offset", "length", "piece", "kept", "component_id", "cluster", "spans", "n_shingles", "text_hash", "label", "quality", "item_id", "run", "rule", "host", "path", "verdict", "KEY",
)
LINE = "a line that recurs in many documents and is quite long"


@pytest.fixture(scope="module")
def table(spark):
    texts = [f"{LINE}\n" + " ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)] + [None, "", f"{LINE}\nw1 w2"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(None, "no id"), (3, texts[3])], "doc_id long, text string")
    return rows.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in INTERNAL])


def own_values_stay(out, names=INTERNAL):
    rows = out.collect()
    assert rows
    for r in rows:
        who = "none" if r["doc_id"] is None else r["doc_id"]
        assert all(r[n] == f"{n} of {who}" for n in names)


def without(*names):
    return [n for n in INTERNAL if n not in names]


def test_rows_with_more_columns(spark, table):
    bench = spark.createDataFrame([(1, "w1x0 w1x1 w1x2 w1x3 w1x4 w1x5 w1x6", "x")], "item_id long, text string, _leaks string")
    own_values_stay(line_dedup.dedup_lines(table), without("n_lines", "n_dropped"))
    own_values_stay(minhash_dedup.one_of_each(table))
    left = decontaminate.without_leaks(table, bench)
    own_values_stay(left)
    assert 1 not in {r.doc_id for r in left.collect()} and left.count() == table.count() - 1
    model = quality.train_quality(table, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    own_values_stay(quality.score_quality(table, model), without("score"))
    own_values_stay(quality.score_quality(table, model, "_score"), without("_score"))


def test_pages_with_more_columns(spark, table):
    pages = table.withColumn("url", F.lit("http://a.com/x"))
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    out = url_filter.judge_urls(pages, rules)
    own_values_stay(out, without("host", "path", "rule", "verdict"))
    assert {r.verdict for r in out.collect()} == {"block"} and len(out.columns) == len(set(out.columns))


def test_pieces_with_more_columns(spark, table):
    pieces = table.drop("piece", "length").selectExpr("*", "cast(0 as int) as piece", "cast(7 as long) as length")
    out = packing.pack(pieces, max_tokens=16)
    own_values_stay(out, without("piece", "length", "sequence_id", "offset"))
    assert len(out.columns) == len(set(out.columns)) and {r.offset for r in out.collect()} == {0, 7}


@pytest.mark.parametrize("operator", [minhash_dedup.near_duplicates, license_scan.scan_licenses, secrets.scan_secrets, fingerprints.edit_fingerprints], ids=lambda f: f.__name__)
def test_operators_that_return_their_own_columns(table, operator):
    assert operator(table).count() >= 12


def test_conversations_with_more_columns(table):
    turns = table.selectExpr("*", "doc_id as conv_id", "0 as turn", "'assistant' as role")
    assert chat_format.read_back(chat_format.format_conversations(turns)).count() == 12


def test_stages(spark, table, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, "w1x0 w1x1 w1x2 w1x3 w1x4 w1x5 w1x6")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frames.stored(table)
    empty = frames.stored(table.limit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        own_values_stay(out)
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 12
    assert last(spark, empty, str(tmp_path)).collect() == []
