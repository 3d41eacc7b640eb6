"""Dense numbers, the block index and the query language, against exhaustive versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators import grammar, inverted, lexical, numbering


def values(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


# --- numbers ------------------------------------------------------------------------------------------------------


def test_dense_ids_follow_the_order(spark):
    r = random.Random(1)
    rows = [(f"p{r.randrange(40)}", i, f"c{i}") for i in range(3000)] + [(None, 1, "x"), ("p1", None, "y")]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "paper_id string, idx int, chunk_id string").repartition(9)
    got = sorted(values(numbering.dense_ids(frame, ["paper_id", "idx"]), "rowid", "paper_id", "idx"))
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0))
    assert got == [(n, a, b) for n, (a, b, _) in enumerate(order, 1)]
    assert numbering.dense_ids(frame.limit(0), ["paper_id"]).count() == 0


def test_one_paper_is_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(20_000).select(F.lit("hot").alias("paper_id"), F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("chunk_id"))
        got = numbering.chunk_rowids(frame)
        assert got.select(F.min("chunk_rowid"), F.max("chunk_rowid"), F.count_distinct("chunk_rowid")).first()[:] == (1, 20_000, 20_000)
        assert got.filter("cast(chunk_id AS int) + 1 != chunk_rowid").count() == 0
        assert got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- the block index ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(200_000)]
    rows = [(k, " ".join(["the"] + [r.choice(words) for _ in range(r.randrange(60))]), f"w{k % 50} the") for k in range(1500)] + [(5000, None, ""), (5001, "the " * 40, None)]
    docs = spark.createDataFrame(rows, "id long, text string, title string").cache()
    return rows, docs, inverted.build(docs, "id", ["text", "title"])


def field_terms(spark, queries):
    frame = spark.createDataFrame(queries, "query_id long, q string")
    terms = lexical.query_terms(frame, "query_id", "q")
    return terms, terms.select("query_id", F.explode(F.array(F.lit("text"), F.lit("title"))).alias("field"), "term", "times")


@pytest.mark.parametrize("k", [1, 10, 60, 100])
def test_pruned_search_equals_all_scores(spark, corpus, k, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 64)
    _, docs, index = corpus
    queries = [(0, "the w3 w17"), (1, "the"), (2, "w1 w1 w250"), (3, "none at all"), (4, "the w2 w399 w7 w9"), (5, ""), (6, "w5")]
    plain, terms = field_terms(spark, queries)
    expected = lexical.top_k(lexical.bm25(lexical.build_index(docs, "id", ["text", "title"]), plain, {"title": 2.0}), k)
    got = inverted.search(index, terms, k, {"title": 2.0})
    key = ("query_id", "rank", "id")
    assert sorted(values(got, *key)) == sorted(values(expected, *key))
    scores = dict(((a, b), s) for a, b, s in values(expected, "query_id", "id", "score"))
    assert all(abs(scores[a, b] - s) < 1e-9 for a, b, s in values(got, "query_id", "id", "score"))


def test_less_is_read_than_held(spark, corpus):
    _, _, index = corpus
    _, terms = field_terms(spark, [(0, "the w3 w300"), (1, "the")])
    counts = {q: (a, b) for q, a, b in values(inverted.read_of(index, terms, 10, {"title": 2.0}), "query_id", "read", "held")}
    assert counts[0][0] < 0.75 * counts[0][1] and counts[1][0] < 0.75 * counts[1][1]


def test_written_index_gives_the_same(spark, corpus, tmp_path):
    _, _, index = corpus
    index.write(f"{tmp_path}/index")
    stored = inverted.BlockIndex.read(spark, f"{tmp_path}/index")
    _, terms = field_terms(spark, [(0, "the w3 w17"), (1, "w5")])
    assert sorted(values(inverted.search(stored, terms, 10), "query_id", "rank", "id")) == sorted(values(inverted.search(index, terms, 10), "query_id", "rank", "id"))


def positions(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def phrase_brute(rows, words, slop):
    out = {}
    for i, text, _ in rows:
        w = positions(text)
        lists = [{p - k for p, x in enumerate(w) if x == word} for k, word in enumerate(words)]
        if slop == 0:
            n = len(set.intersection(*lists))
        else:
            n = sum(all(any(a <= x <= a + slop for x in own) for own in lists) for a in set.union(*lists)) if all(lists) else 0
        if n:
            out[i] = n
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_phrases_from_positions(spark, corpus, slop):
    rows, _, index = corpus
    asked = [["the", "w3"], ["w1", "w1"], ["w3", "none"], positions(rows[7][1]), ["the", "the", "the"], ["w2", "the"]]
    frame = spark.createDataFrame([(n, "text", w, slop) for n, w in enumerate(asked)], "phrase_id long, field string, words array<string>, slop int")
    got = {}
    for p, i, n in values(inverted.phrases(index, frame), "phrase_id", "id", "tf"):
        got.setdefault(p, {})[i] = n
    assert got == {n: e for n, w in enumerate(asked) if (e := phrase_brute(rows, w, slop))}


# --- the query language -------------------------------------------------------------------------------------------


def test_trees():
    t = grammar.parse
    assert t("a") == {"all": [], "any": [{"leaf": 0}], "none": [], "boost": 1.0}
    assert t("a AND (b OR c)") == {"all": [{"leaf": 0}, {"all": [], "any": [{"leaf": 1}, {"leaf": 2}], "none": [], "boost": 1.0}], "any": [], "none": [], "boost": 1.0}
    assert t("a OR b AND NOT c") == {"all": [], "any": [{"leaf": 0}, {"all": [{"leaf": 1}], "any": [], "none": [{"leaf": 2}], "boost": 1.0}], "none": [], "boost": 1.0}
    assert t("+a -b c") == {"all": [{"leaf": 0}], "any": [{"leaf": 2}], "none": [{"leaf": 1}], "boost": 1.0}
    assert t("(a b)^3")["any"][0]["boost"] == 3.0
    assert t("") is None and t("()") is None and t("AND") is None and t('" "') is None
    own = grammar.leaves('title:x "two words"~2^1.5 year:[2020 TO 2022} text:(c d) front-running (open')
    assert [(x["kind"], x["field"], x["words"], x["slop"], x["boost"]) for x in own] == [
        ("words", "title", ["x"], 0, 1.0), ("words", None, ["two", "words"], 2, 1.5), ("range", "year", [], 0, 1.0), ("words", "text", ["c"], 0, 1.0), ("words", "text", ["d"], 0, 1.0),
        ("words", None, ["front", "running"], 0, 1.0), ("words", None, ["open"], 0, 1.0),
    ]
    assert (own[2]["low"], own[2]["high"], own[2]["ends"]) == ("2020", "2022", "[}")


def test_selected_documents(spark):
    rows = [(1, "a b c", "2020"), (2, "a c", "2021"), (3, "b a", "2022"), (4, "d", "2022"), (5, "c b x a", None)]
    docs = spark.createDataFrame(rows, "id long, text string, year string")
    index = inverted.build(docs, "id", ["text"])
    expected = {
        "a": {1, 2, 3, 5}, "a AND (b OR c)": {1, 2, 3, 5}, "a AND NOT c": {3}, "+a -c": {3}, "NOT a": set(), '"a b"': {1}, '"b a"~1': {3, 5}, "d OR a AND c": {1, 2, 4, 5},
        "+year:[2020 TO 2021] a": {1, 2}, "year:{2020 TO *]": {2, 3, 4}, "nofield:a": set(), "(a b) AND c": {1, 2, 5}, "+(b x) -(c AND x)": {1, 3}, "b-a": {3}, "": set(), "a AND none": set(), "-a d": {4},
    }
    queries = spark.createDataFrame(list(enumerate(expected)), "query_id long, query string")
    got = {}
    for q, i in values(grammar.search(index, docs, "id", ["text"], queries), "query_id", "id"):
        got.setdefault(q, set()).add(i)
    assert {text: got.get(n, set()) for n, text in enumerate(expected)} == expected


def test_plain_words_score_as_bm25_and_boosts_multiply(spark, corpus):
    _, docs, index = corpus
    queries = spark.createDataFrame([(0, "w3 w17"), (1, "(w3 w17)^2"), (2, "text:w3^3")], "query_id long, query string")
    got = {(q, i): s for q, i, s in values(grammar.search(index, docs, "id", ["text", "title"], queries, {"title": 2.0}), "query_id", "id", "score")}
    plain = spark.createDataFrame([(0, "w3 w17")], "query_id long, q string")
    expected = dict(values(lexical.bm25(lexical.build_index(docs, "id", ["text", "title"]), lexical.query_terms(plain, "query_id", "q"), {"title": 2.0}), "id", "score"))
    assert {i for q, i in got if q == 0} == set(expected)
    assert all(abs(got[0, i] - s) < 1e-9 and abs(got[1, i] - 2 * s) < 1e-9 for i, s in expected.items())
    one = dict(values(lexical.bm25(lexical.build_index(docs, "id", ["text"]), lexical.query_terms(spark.createDataFrame([(0, "w3")], "query_id long, q string"), "query_id", "q")), "id", "score"))
    assert all(abs(got[2, i] - 3 * s) < 1e-9 for i, s in one.items()) and {i for q, i in got if q == 2} == set(one)


def test_positions_come_back(spark):
    docs = spark.createDataFrame([(1, "a b a a c")], "id long, text string")
    index = inverted.build(docs, "id", ["text"])
    assert {r.term: r.p for r in index.postings.select("term", inverted.undelta(F.col("deltas")).alias("p")).collect()} == {"a": [0, 2, 3], "b": [1], "c": [4]}
    assert docs.select(tokens("text").alias("t")).first().t == ["a", "b", "a", "a", "c"]
