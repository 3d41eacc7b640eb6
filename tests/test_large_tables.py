"""Queries over what only larger tables have: long keys, frequent words, many copies."""

import random

import duckdb

from quillspark.operators import chunking, inverted, layout, lexical, matching
from quillspark.plans.engine import Corpus
from quillspark.plans.queries import ORACLE_SQL, QUERIES


def same_as_sql(spark, name, folder, **tables):
    """Whether a query over these tables returns what DuckDB returns, row by row; the rows."""
    duck = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, expected = QUERIES[name](spark, str(folder)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert len(b) and a.equals(b)
    return got


def documents(spark, texts):
    """documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", f"src{i % 9}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def test_order_keys_of_more_than_six_digits(spark, tmp_path):
    keys = [123456, 1234560, 1234567, 1234569, 9123457, 912345, 7, 70, 5000001]
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    got = same_as_sql(spark, "match_cascade", tmp_path, orders=orders, documents=documents(spark, [(i, "a title\nand text") for i in (123456, 912345, 7, 500000)]))
    assert len(got) == 8


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_fields_are_counted_and_scored_without_postings(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(5000)]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(25))) + "\nthe end") for i in range(900)] + [(1000, None), (1001, ""), (1002, "w1")]
    benches = benchmark(spark, ["the w1 w2", "end", "", "none", " ".join(words[:60])])
    got = same_as_sql(spark, "bm25_multifield_boost", tmp_path, documents=documents(spark, texts), benchmark=benches)
    assert got.groupby("query_id").size().max() == 60
    # No row of a document and a word meets in an exchange: what is left of the plan reads a checkpoint of counts.
    plan = QUERIES["bm25_multifield_boost"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan


def test_only_what_may_be_among_the_best_is_kept(spark):
    """Ties at the k-th place go by id, also where they come after the best were cut for the first time."""
    docs = spark.createDataFrame([(3000 - i, "w " * (1 + i % 3) + "x " * (3 - i % 3)) for i in range(3000)], "id long, text string").coalesce(1)
    terms = lexical.query_terms(spark.createDataFrame([(q, "w") for q in range(120)], "query_id long, q string"), "query_id", "q")
    expected = lexical.top_k(lexical.bm25(lexical.build_index(docs, "id", ["text"]), terms), 5)
    rows = lambda frame: sorted((r["query_id"], r["rank"], r["id"]) for r in frame.collect())
    assert rows(lexical.search(docs, "id", ["text"], terms, 5)) == rows(expected)


def test_chunks_are_joined_once(spark):
    """What a search reads of the chunks is a checkpoint, not the joins that number them."""
    chunks = spark.createDataFrame([("p", f"p::{i}", i, "s", "some words", None) for i in range(5)], "paper_id string, chunk_id string, idx int, section string, text string, embedding array<float>")
    papers = spark.createDataFrame([("p", "t", "a", ["x"], "2020", "u", 1, "b", "m")], "paper_id string, title string, authors string, topics array<string>, release_date string, pdf_url string, n_pages int, abstract string, md string")
    corpus = Corpus(papers, chunks, spark.createDataFrame([], "src string, dst string, kind string, times long"))
    assert "Join" not in corpus._numbered()._jdf.queryExecution().executedPlan().toString()
    assert len(corpus.search("words", mode="lex")["hits"]) == 2


def test_an_index_is_made_without_a_shuffle_of_postings(spark):
    """Each task makes the blocks of its own documents, packed by column; a search over several slices is whole."""
    docs = spark.createDataFrame([(i, f"the w{i % 7} w{i % 5}") for i in range(900)], "id long, text string").repartition(3)
    index = inverted.build(docs, "id", ["text"])
    assert all(".parquet" in f for x in (index.postings, index.blocks) for f in x.inputFiles()) and index.blocks.inputFiles()
    terms = lexical.query_terms(spark.createDataFrame([(1, "w3 the"), (2, "w4")], "query_id long, q string"), "query_id", "q")
    expected = lexical.top_k(lexical.bm25(lexical.build_index(docs, "id", ["text"]), terms), 10)
    got = inverted.search(index, terms.withColumn("field", lexical.F.lit("text")), 10)
    rows = lambda frame: sorted((r["query_id"], r["rank"], r["id"]) for r in frame.collect())
    assert rows(got) == rows(expected)


def test_sections_are_sorted_once_and_patterns_skip_long_blocks(spark):
    """Blocks are sorted once for both windows; a block too long for a heading meets no pattern."""
    blocks = spark.createDataFrame([("p", i, t, 10.0, 1) for i, t in enumerate(["1 One", "soft­-\nly  cut", "a-\n b\n\n\n\nc\td ", "2 Two " + "x" * 90])], "paper_id string, ord int, text string, font_size double, page int")
    found = layout.sections(blocks)
    assert [tuple(x)[1:] for x in found.orderBy("section_no").collect()] == [(1, "1 One", "soft-\nly cut ab\n\nc d 2 Two " + "x" * 90)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    heading = layout.with_headings(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < heading.index("(length(trim(") < heading.index("RLIKE")


def test_titles_are_made_once_and_good_matches_ask_for_no_others(spark):
    """A file whose own title is a candidate meets no others by words; titles of more words than are told apart are compared too."""
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(60)] + ["слово", "иное"]
    title = lambda: " ".join(r.sample(vocabulary, r.choice([1, 2, 5, 9, 22, 30, 45])))
    titles = [title() for _ in range(120)] + ["слово", "слово иное", "word1 word2 word3 word4 word5 word6 word7"]
    rows = [(f"f{k:03}", t) for k, t in enumerate(titles)] + [(f"g{k:03}", " ".join(w for w in t.split() if r.random() < 0.8)) for k, t in enumerate(titles)] + [(f"h{k:03}", title()) for k in range(150)]
    files, candidates = spark.createDataFrame(rows, "file string, title string"), spark.createDataFrame([(f"c{k:03}", t) for k, t in enumerate(titles)], "candidate string, title string")
    found = matching.fuzzy_match(files, candidates)
    a, b = (matching._titles(t, k).groupBy("words", "slug").agg(lexical.F.min(k).alias(k)) for t, k in ((files, "file"), (candidates, "candidate")))
    pairs = a.crossJoin(b.select("candidate", lexical.F.col("words").alias("w2"), lexical.F.col("slug").alias("s2"))).withColumnsRenamed({"words": "w1", "slug": "s1"})
    best = matching._best(matching._scored(pairs)).join(a, "file").drop("file")
    expected = matching._titles(files, "file").join(best, ["words", "slug"]).select("file", "candidate", "score")
    assert sorted(tuple(x) for x in found.collect()) == sorted(tuple(x) for x in expected.collect()) and found.count() > 250
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = a.filter("file LIKE 'f%'")
    begun = matching._best(matching._scored_by_beginning(own, b))
    asked = matching._by_rare_words(own, b, begun)
    exact = {x.file for x in begun.filter("score = 1.2").collect()}
    assert len(exact) > 100 and not exact & {x.file for x in asked.collect()}


def test_long_sections_go_to_python_in_small_batches(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    docs = spark.createDataFrame([(f"p{k}", "## A\n\n" + "Some longer words stand here. " * 2000) for k in range(40)], "paper_id string, md string")
    chunks = chunking.chunk_sections(docs, budget=128, overlap=16)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    got = chunks.groupBy("paper_id").agg({"tokens": "sum", "idx": "count"}).collect()
    assert len(got) == 40 and len({tuple(x)[1:] for x in got}) == 1 and got[0]["sum(tokens)"] >= 10000
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
