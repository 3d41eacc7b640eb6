import pytest

from quillspark.functions.stem import stem, stemmed_tokens
from quillspark.operators import lexical

PAIRS = {
    "caresses": "caress", "flies": "fli", "ties": "tie", "mules": "mule", "denied": "deni", "agreed": "agre", "owned": "own", "humbled": "humbl", "sized": "size", "meeting": "meet", "stating": "state",
    "itemization": "item", "sensational": "sensat", "traditional": "tradit", "reference": "refer", "colonizer": "colon", "plotted": "plot", "generously": "generous", "consistency": "consist", "consistently": "consist",
    "hopping": "hop", "hoping": "hope", "knightly": "knight", "dying": "die", "gas": "gas", "this": "this", "kiwis": "kiwi", "cry": "cri", "by": "by", "say": "say", "apologies": "apolog", "relational": "relat",
    "happy": "happi", "controlling": "control", "rate": "rate", "probate": "probat", "succeed": "succeed", "news": "news", "communities": "communiti", "électricité": "électricité", "blockchains": "blockchain",
}


@pytest.mark.parametrize(("word", "expected"), PAIRS.items())
def test_stems(word, expected):
    assert stem(word) == expected


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "traded relations"), (2, "nothing")], "id long, text string")
    index = lexical.build_index(docs, "id", ["text"], stemmed_tokens)
    terms = lexical.query_terms(spark.createDataFrame([(0, "trading relational")], "query_id long, q string"), "query_id", "q", stemmed_tokens)
    assert [r.id for r in lexical.bm25(index, terms).collect()] == [1]
