"""An index of segments, against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import grammar, inverted
from quillspark.operators.segments import SegmentedIndex

SCHEMA = "id long, text string, title string"
QUERIES = [(0, "the w3 w17"), (1, "the"), (2, "w1 w1 w50"), (3, "none"), (4, "w2 w9 new")]


def documents(r, ids, longest=60):
    words = [f"w{int(r.paretovariate(0.7)) % 100}" for _ in range(20_000)]
    return {k: (" ".join(["the"] + [r.choice(words) for _ in range(r.randrange(longest))]), f"w{k % 50} the") for k in ids}


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], SCHEMA)


def hits(spark, index, k):
    rows = [(q, f, w, 1) for q, text in QUERIES for f in ("text", "title") for w in dict.fromkeys(text.split())]
    terms = spark.createDataFrame(rows, "query_id long, field string, term string, times int")
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in inverted.search(index, terms, k, {"title": 2.0}).collect()}


def same(spark, own, docs, k=10):
    a, b = hits(spark, own.open(), k), hits(spark, inverted.build(frame(spark, docs), "id", ["text", "title"]), k)
    assert a.keys() == b.keys() and a
    assert all(a[x][0] == b[x][0] and abs(a[x][1] - b[x][1]) < 1e-9 for x in a)


@pytest.fixture
def own(spark, tmp_path):
    return SegmentedIndex(spark, f"{tmp_path}/index", "id", ["text", "title"])


@pytest.mark.parametrize("longest", [6, 400])
def test_changes_equal_an_index_built_anew(spark, own, longest):
    """With new documents much shorter, or much longer, than the old ones, so that impacts in old segments grow or fall."""
    r = random.Random(5)
    state = documents(r, range(400))
    assert own.apply(frame(spark, state)) == 1
    new = documents(r, range(350, 700), longest) | {900: ("new new new", None), 901: (None, None)}
    gone = [*range(0, 60), 5555]
    state = {k: v for k, v in (state | new).items() if k not in gone}
    own.apply(frame(spark, new), spark.createDataFrame([(k,) for k in gone], "id long"))
    assert sorted(x[1:] for x in own.segments()) == [(352, 0), (400, 110)]
    same(spark, own, state)
    assert own.merge() == 3 and sorted(x[1:] for x in own.segments()) == [(290, 0), (352, 0)]
    same(spark, own, state, 100)
    assert own.merge() is None


def test_segments_of_a_size_are_merged(spark, own):
    r, state = random.Random(6), {}
    for k in range(3):
        new = documents(r, range(k * 20, k * 20 + 25))
        state |= new
        own.apply(frame(spark, new))
    assert len(own.segments()) == 3
    own.merge(fanout=3)
    assert [x[1:] for x in own.segments()] == [(65, 0)]
    same(spark, own, state)
    before = hits(spark, own.open(), 10)
    assert len(own.vacuum()) == 3 + 3 + 2 and own.version() == 4
    assert hits(spark, own.open(), 10) == before


def test_what_was_not_committed_does_not_count(spark, own, monkeypatch):
    state = documents(random.Random(7), range(50))
    own.apply(frame(spark, state))

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(own, "_commit", killed)
        own.apply(frame(spark, {7: ("new", "new")}))
    assert own.version() == 1
    own.apply(frame(spark, {7: ("new", "new")}))
    assert sorted(x[1:] for x in own.segments()) == [(1, 0), (50, 1)]
    assert [x[1:] for x in own.segments(1)] == [(50, 0)]  # an older version can still be read
    assert len([s for s in own.vacuum() if s.startswith("segments/")]) == 1


def test_phrases_and_the_query_language(spark, own):
    own.apply(spark.createDataFrame([(1, "a b c", ""), (2, "a c", ""), (3, "a b", "")], SCHEMA))
    changed = spark.createDataFrame([(1, "b a", ""), (4, "c a b", "")], SCHEMA)
    own.apply(changed, spark.createDataFrame([(2,)], "id long"))
    docs = spark.createDataFrame([(1, "b a", ""), (3, "a b", ""), (4, "c a b", "")], SCHEMA)
    asked = spark.createDataFrame([(0, '"a b"'), (1, "c"), (2, "a AND NOT c"), (3, "b-a")], "query_id long, query string")
    for index in (own.open(), inverted.build(docs, "id", ["text"])):
        got = grammar.search(index, docs, "id", ["text"], asked).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        assert {r["query_id"]: r["ids"] for r in got.collect()} == {0: [3, 4], 1: [4], 2: [1, 3], 3: [1]}


def test_deleting_everything_and_nothing(spark, own):
    with pytest.raises(ValueError, match="nothing"):
        own.open()
    own.apply(deleted=spark.createDataFrame([(1,)], "id long"))
    own.apply(spark.createDataFrame([(1, "a", "a")], SCHEMA))
    own.apply(spark.createDataFrame([], SCHEMA))
    own.apply(deleted=spark.createDataFrame([(1,)], "id long"))
    assert not hits(spark, own.open(), 10)
