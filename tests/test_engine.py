"""Goldens, properties and round trips of the engine."""

import dataclasses
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, citations, fusion, grammar, inverted, layout, lexical, matching, records, taxonomy, vectors
from quillspark.plans.engine import Corpus, serve
from quillspark.sources import readers, sinks
from quillspark.streaming import ingest


def values(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


# --- functions ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (" http://arxiv.org/abs/2405.01329 ", "https://arxiv.org/pdf/2405.01329.pdf"),
        ("http://arxiv.org/pdf/2405.01329v2", "https://arxiv.org/pdf/2405.01329v2.pdf"),
        ("https://arxiv.org/list/q-fin", "https://arxiv.org/list/q-fin"),
        ("https://eprint.iacr.org/2024/442/", "https://eprint.iacr.org/2024/442.pdf"),
        ("https://a.b/c", "https://a.b/c"),
    ],
)
def test_normalized_urls(spark, url, expected):
    assert one(spark, tx.normalize_url, url) == expected


def test_url_classes(spark):
    urls = ["https://arxiv.org/x", "https://papers.ssrn.com/y", "https://dl.acm.org/z", "https://www.nature.com/", "http://h.org", "nothing", None]
    got = values(spark.createDataFrame([(u,) for u in urls], "u string").select(tx.url_class("u").alias("c"), tx.gated_reason("u").alias("r")), "c", "r")
    assert [c for c, _ in got] == ["arxiv", "ssrn", "gated", "gated", "direct", "unknown", "unknown"]
    assert got[2][1] == "auth_required: dl.acm.org requires institutional access" and got[1][1] is None
    assert one(spark, tx.github_raw, "https://github.com/u/r/blob/main/a/b.pdf") == "https://raw.githubusercontent.com/u/r/main/a/b.pdf"
    assert one(spark, tx.referer, "https://h.org/a?b") == "https://h.org/"


def test_identifiers(spark):
    text = "see arXiv:2405.01329v2, 12345.6789 and (math.AG/0601001v1); doi 10.1000/XyZ_1.). 2405.013299"
    assert one(spark, tx.arxiv_ids, text) == ["2405.01329", "math.ag/0601001"]
    assert one(spark, tx.dois, text) == ["10.1000/xyz_1"]


def test_slugs_and_keys(spark):
    assert one(spark, lambda c: tx.slug(c, 60), "Ünïcode & Straße: It's 100%") == "unicode-strasse-its-100"
    assert one(spark, lambda c: tx.slug(c, 8, word_boundary=True), "alpha beta gamma") == "alpha"
    assert one(spark, lambda c: tx.paper_id(c, F.lit("u")), "!!!").startswith("untitled-")


def test_bibliography(spark):
    rows = [("p1", "T", "Ada B. Lovelace, X", "2021-05-06"), ("p2", "T", "", ""), ("p3", "T", "Émile Zö-la", "1999")]
    got = spark.createDataFrame(rows, "id string, title string, authors string, date string").select(tx.bib_key("authors", "date").alias("k"), tx.bibtex("id", "title", "authors", "date").alias("b")).collect()
    assert [r.k for r in got] == ["lovelace2021", "anon", "zla1999"]
    assert got[0].b == "@misc{lovelace2021,\n  title  = {T},\n  author = {Ada B. Lovelace, X},\n  year   = {2021},\n  note   = {paper_id: p1}\n}"


def test_paragraphs(spark):
    assert one(spark, tx.clean_paragraph, " exam-\nple  of\tit\n\n\n\nend­ing ") == "example of it\n\nending"


# --- lexical ------------------------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "d")], "id long, text string")
    queries = spark.createDataFrame([(0, "a b")], "query_id long, q string")
    got = dict(values(lexical.bm25(lexical.build_index(docs, "id", ["text"]), lexical.query_terms(queries, "query_id", "q")), "id", "score"))
    part = lambda tf, df, dl: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got == pytest.approx({1: part(2, 1, 3) + part(1, 2, 3), 2: part(1, 2, 2)})


def test_query_grammar(spark):
    docs = spark.createDataFrame([(1, "a b", "2021"), (2, "a c", "2021"), (3, "b a", "1999")], "id long, text string, year string")
    index = inverted.build(docs, "id", ["text"])

    def found(query):
        asked = spark.createDataFrame([(0, query)], "query_id long, query string")
        return sorted(r.id for r in grammar.search(index, docs, "id", ["text"], asked).collect())

    assert found("+a -c") == [1, 3]
    assert found('"a b"') == [1]
    assert found("+year:[2020 TO 2022] a") == [1, 2]


def test_expansion(spark):
    assert one(spark, lexical.expand_query, "an index") == "an index decentralized exchange"
    assert one(spark, lambda c: lexical.expand_query(c, word_boundary=True), "an index") == "an index"
    assert one(spark, lexical.expand_query, "MEV") == "MEV maximal extractable value miner extractable value"
    assert one(spark, lexical.expand_query, "plain") == "plain"


def test_fragments():
    text = "start " + "pad " * 200 + "alpha beta gamma " + "pad " * 200
    assert lexical.best_fragment(text, {"alpha", "beta"}).startswith("alpha beta gamma") and len(lexical.best_fragment(text, {"alpha"})) <= 600
    assert lexical.best_fragment("short", {"none"}) == "short" and lexical.best_fragment("x" * 700, set()) == "x" * 600 + "…"


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "d")], "id long, text string")
    index = lexical.build_index(docs, "id", ["text"])
    sinks.index(index, str(tmp_path / "i"), 8)
    terms = spark.createDataFrame([(0, "a", 1), (0, "b", 1)], "query_id long, term string, times long")
    loaded = sinks.load_index(spark, str(tmp_path / "i"), ["a", "b"], 8)
    assert dict(values(lexical.bm25(loaded, terms), "id", "score")) == pytest.approx(dict(values(lexical.bm25(index, terms), "id", "score")))


# --- vectors and fusion -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_numpy(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0])]
    own = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    got = vectors.knn(own.filter("id < 3").withColumnRenamed("id", "query_id"), own, 7, metric, drop_self=True).collect()
    for q in range(3):
        a, b = v[q].astype(float), v.astype(float)
        d = np.linalg.norm(b - a, axis=1) if metric == "l2" else 1 - b @ a / np.linalg.norm(b, axis=1) / np.linalg.norm(a)
        expected = [i for i in np.argsort(d) if i != q][:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == expected


def test_centroids_have_length_one(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0]), (None, [1.0, 1.0])]
    got = {r.g: r.embedding for r in vectors.centroids(spark.createDataFrame(rows, "g string, embedding array<float>"), "g").collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["z"] == [0.0, 0.0] and len(got) == 2


def test_fusion_is_symmetric_and_capped(spark):
    r = random.Random(1)
    lists = [spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(r.sample(range(30), 12))], "query_id long, id long, rank int") for _ in range(2)]
    a, b = (dict(values(fusion.rrf(x), "id", "score")) for x in (lists, lists[::-1]))
    assert a == pytest.approx(b)
    hits = fusion.ranked(fusion.rrf(lists)).withColumn("g", F.col("id") % 4)
    capped = fusion.cap_per_group(hits, "g", 2, 6).collect()
    assert len(capped) == 6 and max(sum(1 for x in capped if x.g == g) for g in range(4)) <= 2
    assert [x["rank"] for x in sorted(fusion.cap_per_group(hits, "g", 0, 5).collect(), key=lambda x: x.position)] == [1, 2, 3, 4, 5]


def test_rerank_keeps_the_tail(spark):
    hits = spark.createDataFrame([(0, i, i, 1.0 / i, float(i)) for i in range(1, 8)], "query_id long, id long, rank int, score double, new double")
    got = sorted(fusion.rerank(hits, 3, F.col("new")).collect(), key=lambda r: r.new_rank)
    assert [r.id for r in got] == [3, 2, 1, 4, 5, 6, 7]


# --- layout and chunks --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "size", "expected"),
    [
        ("1. Introduction", 10.0, True), ("2.3 Methods of the", 10.0, False), ("Results", 14.0, True), ("Results", 10.0, False), ("arXiv:2405.1 [cs]", 20.0, False), ("see https://a.b", 20.0, False),
        ("12 34 = 5", 20.0, False), ("A = B and C", 20.0, False), ("Ends with a comma,", 20.0, False), ("It ends.", 20.0, False), ("ab", 20.0, False), ("word " * 13, 20.0, False), ("3. x", 20.0, False), ("", 20.0, False),
    ],
)
def test_headings(spark, text, size, expected):
    row = spark.createDataFrame([(text, size)], "t string, s double")
    assert row.select(layout.is_heading(F.col("t"), F.col("s"), F.lit(10.0))).first()[0] is expected


def test_sections_and_abstract(spark):
    rows = [("p", k, t, s, 1) for k, (t, s) in enumerate([("A preface line", 10.0), ("Abstract", 14.0), ("We study", 10.0), ("a thing.", 10.0), ("1 Introduction", 10.0), ("Hello", 10.0)])]
    found = layout.sections(spark.createDataFrame(rows, "paper_id string, ord int, text string, font_size double, page int"))
    assert sorted(values(found, "section_no", "heading", "body")) == [(0, "", "A preface line"), (1, "Abstract", "We study a thing."), (2, "1 Introduction", "Hello")]
    assert values(layout.abstracts(found), "abstract") == [("We study a thing.",)]
    md = layout.markdown(found).first().md
    assert md == "A preface line\n\n## Abstract\n\nWe study a thing.\n\n## 1 Introduction\n\nHello\n"
    assert one(spark, lambda c: layout.pick_sections(c, ["INTRO"]), md) == "## 1 Introduction\n\nHello"
    assert one(spark, lambda c: F.size(layout.split_sections(c)), "## Empty\n\n## Full\nx") == 1


def test_recurring_lines(spark):
    rows = [("d", p, t) for p in range(6) for t in ("Page header", f"line {p}", "Ends here.")] + [("e", 1, "Page header")]
    lines = spark.createDataFrame(rows, "doc string, page int, text string")
    assert values(layout.recurring_lines(lines), "doc", "text", "n_pages") == [("d", "Page header", 6)]
    assert layout.strip_recurring(lines).count() == len(rows) - 6


def test_chunks_fit_and_overlap():
    words = " ".join(f"w{k}" for k in range(50))
    assert chunking.pack_units(words, 20, 5) == [" ".join(f"w{k}" for k in range(a, min(a + 20, 50))) for a in (0, 15, 30, 45)]
    small = "\n\n".join(f"p{k} x y z" for k in range(12))
    out = chunking.pack_units(small, 12, 4)
    assert all(len(c.split()) <= 12 for c in out) and all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(out, out[1:], strict=False))
    assert {p for c in out for p in c.split("\n\n")} == set(small.split("\n\n"))
    sentences = " ".join(f"This is sentence number {k}." for k in range(12))
    assert all(len(c.split()) <= 20 for c in chunking.pack_units(sentences, 20, 0)) and chunking.pack_units("") == []


# --- taxonomy, citations, matching, records -----------------------------------------------------------------------


def test_taxonomy(spark):
    rules = spark.createDataFrame([(0, r"\bna[iï]ve\b", "n"), (1, "bayes", "b"), (2, "bayesian", "b"), (3, "graph", "g")], "ord int, pattern string, label string")
    docs = spark.createDataFrame([(1, "A NAÏVE Bayes", "", ""), (2, "t", "", "graph once"), (3, "t", "", "graph and graph"), (4, "t", None, None)], "id long, title string, abstract string, body string")
    assert dict(values(taxonomy.topics(docs, rules), "id", "topics")) == {1: ["n", "b"], 2: ["uncategorized"], 3: ["g"], 4: ["uncategorized"]}
    assert dict(values(taxonomy.platforms(docs, rules), "id", "platforms"))[2] == ["g"]
    mapping = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c3", "d0")], "category string, domain string")
    cats = spark.createDataFrame([(1, ["c3", "c1", "c2", "?"]), (2, [])], "id long, categories array<string>")
    assert dict(values(taxonomy.domains(cats, mapping), "id", "domains")) == {1: ["d0", "d1"], 2: []}


def test_citation_graph(spark):
    papers = spark.createDataFrame([("a", "A", "https://arxiv.org/pdf/2001.00001v1.pdf"), ("b", "B", "https://doi.org/10.1000/b"), ("c", "C", "https://arxiv.org/pdf/2001.00001.pdf")], "paper_id string, title string, pdf_url string")
    texts = spark.createDataFrame([("a", "2001.00001 and 10.1000/B. twice 10.1000/b,"), ("b", "10.1000/b and 2001.00001v3")], "paper_id string, md string")
    found, own = citations.mentions(texts), citations.own_ids(papers)
    graph = citations.edges(found, own)
    assert sorted(values(graph, "src", "dst", "kind", "times")) == [("a", "b", "doi", 2), ("a", "c", "arxiv", 1), ("b", "c", "arxiv", 1)]
    assert ("b", "doi", "10.1000/b") in values(citations.paper_refs(found, own), "paper_id", "kind", "ref")
    assert values(citations.most_cited(graph), "dst", "n") == [("c", 2), ("b", 1)]


def test_matching(spark):
    files = spark.createDataFrame([("id-1", ""), ("ssrn-1234567", ""), ("x", "Deep learning for option pricing"), ("y", "unrelated words entirely")], "file string, title string")
    candidates = spark.createDataFrame([("id-1", None, "One"), ("id-2", "1234567", "Two"), ("id-3", None, "Deep Learning for Options Pricing"), ("id-4", None, "Deep learning")], "candidate string, number string, title string")
    got = {r.file: (r.candidate, round(r.score, 3)) for r in matching.match_cascade(files, candidates).collect()}
    assert got == {"id-1": ("id-1", 1.0), "ssrn-1234567": ("id-2", 0.99), "x": ("id-3", 0.667)}


def test_catalogue_fold(spark):
    base = "https://arxiv.org/pdf/2001.00001"
    rows = [(1, "T", f"{base}v1.pdf", "2020-01-01"), (2, "T", f"{base}v3.pdf", "2019-01-01"), (3, "T", f"{base}v2.pdf", "2021-01-01"), (4, "T", f"{base}v2.pdf", ""), (5, " ", "u", "x"), (6, "U", "https://a.b/c", "")]
    raw = spark.createDataFrame([(a, b, c, "", "x, ,y", d, "") for a, b, c, d in rows], "line long, title string, url string, authors string, topics string, release_date string, referrer string")
    entries = records.catalogue(raw)
    assert entries.filter("line = 1").first().topics == ["x", "y"]
    assert sorted(r.line for r in records.latest_versions(entries).collect()) == [3, 6]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("a", "failed", "n"), ("b", "ok", None)], "k string, status string, note string")
    new = spark.createDataFrame([("a", "ok", 5), ("c", "failed", 6)], "k string, status string, bytes int")
    assert sorted(values(records.upsert(old, new, ["k"]), "k", "status", "note", "bytes")) == [("a", "ok", "n", 5), ("b", "ok", None, None), ("c", "failed", None, 6)]
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "k string, t string")
    done = records.changed(rows, spark.createDataFrame([], "k string, content_hash string"), ["k"], "t")
    assert records.changed(rows, done, ["k"], "t").count() == 0
    assert sorted(values(records.batches(rows, "k", 1), "k", "batch")) == [("a", 0), ("b", 1)]
    html = values(records.failed_report(spark.createDataFrame([("B<", "u2"), ("A", "u1")], "title string, url string")), "no", "item")
    assert html == [(1, '<li>1. <a href="u1">A</a></li>'), (2, '<li>2. <a href="u2">B&lt;</a></li>')]


def test_indicators(spark):
    pages = spark.createDataFrame([("Please SIGN in",), (None,)], "html string")
    assert values(pages.withColumns(records.indicators("html", {"login": ("sign in", "log in"), "robot": ("captcha",)})), "login", "robot") == [(True, False), (False, False)]


def test_excerpts(spark):
    sections = ["Intro", "Intro", "Summary and conclusion", "Discussion", "Results", "Results"]
    rows = [("p", f"p::{k}", k, s, "x" * 1500) for k, s in enumerate(sections)]
    got = sorted(values(records.excerpts(spark.createDataFrame(rows, "paper_id string, chunk_id string, idx int, section string, text string")), "pick", "chunk_id", "text"))
    assert [(p, c) for p, c, _ in got] == [(1, "p::0"), (2, "p::1"), (3, "p::2"), (4, "p::3")] and len(got[3][2]) == 1500


# --- sources, sinks, streams --------------------------------------------------------------------------------------


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Title,Authors,PDF link,Topics,Release date\n"A ""quoted"", title",X,https://a.b/c,"t1, t2",2020-01-01\n,Y,u,,\n')
    got = records.catalogue(readers.catalogue_csv(spark, str(tmp_path / "c.csv"))).collect()
    assert [(r.title, r.topics, r.referrer) for r in got] == [('A "quoted", title', ["t1", "t2"], "")]


def test_texts_and_binaries(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/p1.md").write_text("# x\ny")
    assert values(readers.texts(spark, str(tmp_path / "t/*.md")), "paper_id", "md") == [("p1", "# x\ny")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/good.pdf").write_bytes(b"%PDF-" + b"x" * 10_000)
    (tmp_path / "b/short.pdf").write_bytes(b"%PDF-")
    files = readers.pdfs(spark, str(tmp_path / "b"))
    assert [r.paper_id for r in files.collect()] == ["good"]
    blocks = readers.decode_blocks(files, lambda data: [{"text": "hello", "font_size": 10.0, "bold": False, "page": 1, "y_top": 0.0}, {"text": " ", "font_size": 1.0, "bold": False, "page": 1, "y_top": 0.0}])
    assert values(blocks, "paper_id", "ord", "text") == [("good", 0, "hello")]


def test_json_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("b", "ok"), ("a", "failed")], "paper_id string, status string")
    assert readers.manifest(spark, str(tmp_path / "none"), "paper_id string, status string").count() == 0
    sinks.manifest(rows, str(tmp_path / "m"))
    assert sorted(values(readers.manifest(spark, str(tmp_path / "m"), "paper_id string, status string"), "paper_id", "status")) == [("a", "failed"), ("b", "ok")]
    sinks.per_paper_json(rows, str(tmp_path / "j"))
    assert (tmp_path / "j/paper_id=a").is_dir()
    sinks.table(rows, str(tmp_path / "t"), "paper_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert json.loads(sinks.responses(rows.filter("paper_id = 'a'")).first().value) == {"paper_id": "a", "status": "failed"}


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2001.00001v2</id><published>2020-01-02T00:00:00Z</published><summary> two\n words </summary><author><name>Ada</name></author><author><name>Bo</name></author><arxiv:primary_category term="q-fin"/></entry></feed>'
    got = readers.atom_entries(spark.createDataFrame([(xml,), ("<broken",)], "xml string")).collect()
    assert [(r.arxiv_id, r.abstract, r.published, r.category, r.authors) for r in got] == [("2001.00001", "two words", "2020-01-02", "q-fin", ["Ada", "Bo"])]


def test_whole_papers_only(spark):
    chunks = spark.createDataFrame([("p", "p1"), ("p", "p2"), ("q", "q1")], "paper_id string, chunk_id string")
    have = spark.createDataFrame([("p1", [1.0]), ("q1", [2.0]), ("z", [3.0])], "chunk_id string, embedding array<float>")
    assert values(readers.vectors(chunks, have), "chunk_id") == [("q1",)]


def test_incremental_stream(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    run = lambda: ingest.ingest_new(spark, str(source), "k long", lambda d: d.withColumn("twice", F.col("k") * 2), sink, state)
    (source / "a.json").write_text('{"k": 1}\n')
    run()
    run()
    (source / "b.json").write_text('{"k": 2}\n')
    run()
    assert sorted(values(spark.read.parquet(sink), "k", "twice")) == [(1, 2), (2, 4)]


def test_windows(spark):
    rows = spark.createDataFrame([("2020-01-01 00:01:00", "a"), ("2020-01-01 00:04:00", "a"), ("2020-01-01 00:06:00", "a")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.windowed_counts(rows, "ts", "10 minutes", "5 minutes", None, "kind").collect()
    assert sorted(r.n for r in got) == [1, 2]


# --- the tools ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    md = "Preface\n\n## Introduction\n\nalpha beta gamma\n\n## Results\n\ndelta"
    papers = spark.createDataFrame([(p, f"Paper {p}", "Ada Lovelace", ["Topic", p], f"202{k}-01-01", "u", 3, "abs", md) for k, p in enumerate("pqr")], "paper_id string, title string, authors string, topics array<string>, release_date string, pdf_url string, n_pages int, abstract string, md string")
    embed = vectors.hashing_embedder(16)
    texts = ["alpha beta gamma", "delta epsilon", "alpha zeta", "eta theta"]
    rows = [(p, f"{p}::{k:04d}", k, s, f"{t} {p}", embed([t])[0].tolist()) for p in "pqr" for k, (s, t) in enumerate(zip(["Introduction", "Methods", "Results", "Conclusion"], texts, strict=True))]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_id string, idx int, section string, text string, embedding array<float>")
    edges = spark.createDataFrame([("p", "q", "arxiv", 2), ("p", "q", "doi", 1), ("r", "p", "doi", 1)], "src string, dst string, kind string, times long")
    return Corpus(papers, chunks, edges, embed)


@pytest.mark.parametrize("mode", ["hybrid", "lex", "sem"])
def test_search(corpus, mode):
    found = corpus.search("alpha beta", k=4, mode=mode, per_paper_cap=1)
    assert len(found["hits"]) == 3 and {h["paper_id"] for h in found["hits"]} == set("pqr")
    assert all(h["chunk_id"].endswith("0000") for h in found["hits"])
    assert (found["hits"][0]["bm25"] is None) == (mode == "sem") and (found["hits"][0]["cosine"] is None) == (mode == "lex")
    assert corpus.search("alpha beta", k=2, rerank=True)["hits"][0]["score"] == 1.0


def test_search_by_a_stored_index_and_with_grammar(corpus, spark, tmp_path):
    corpus.build_index().write(f"{tmp_path}/index")
    stored = dataclasses.replace(corpus, index=inverted.BlockIndex.read(spark, f"{tmp_path}/index"))
    for mode in ("lex", "hybrid"):
        a, b = (c.search("alpha beta", k=4, mode=mode)["hits"] for c in (corpus, stored))
        assert [h["chunk_id"] for h in a] == [h["chunk_id"] for h in b] and [round(h["bm25"] or 0, 9) for h in a] == [round(h["bm25"] or 0, 9) for h in b]

    def papers(query):
        return {h["chunk_id"] for h in stored.search(query, k=50, mode="lex", per_paper_cap=50, expand=False)["hits"]}

    everything = papers("alpha OR beta OR delta")
    assert papers("(alpha OR beta) AND NOT delta") == papers("+(alpha beta) -delta") and papers("(alpha OR beta) AND NOT delta") <= everything
    assert papers("alpha AND nothing") == set() and papers('"alpha beta"') <= papers("alpha AND beta")
    both = spark.createDataFrame([(1, "alpha"), (2, "alpha AND beta")], "query_id int, query string")
    assert {r.query_id for r in corpus.search_all(both, mode="lex").collect()} <= {1, 2}


def test_a_reranker_that_fails_keeps_the_order(corpus):
    def failing(asked, text):
        return F.raise_error(F.lit("no model")).cast("double")

    broken = dataclasses.replace(corpus, reranker=failing)
    plain = corpus.search("alpha beta", k=4)["hits"]
    assert [h["chunk_id"] for h in broken.search("alpha beta", k=4, rerank=True)["hits"]] == [h["chunk_id"] for h in plain]


def test_other_tools(corpus):
    assert corpus.get_paper("p", ["result"])["markdown"] == "## Results\n\ndelta" and corpus.get_paper("x") == {"error": "paper_id not found"}
    assert corpus.list_papers("TOPIC", "2021-01-01")["count"] == 2 and corpus.list_papers(limit=1)["papers"][0]["id"] == "r"
    assert corpus.list_topics()["topics"][0] == {"topic": "Topic", "count": 3}
    summary = corpus.summarize_paper("p")
    assert summary["n_chunks"] == 4 and [e["section"] for e in summary["key_excerpts"]] == ["Introduction", "Methods", "Conclusion", "Results"]
    assert len(corpus.find_related("p")["related"]) == 2 and corpus.find_related("x") == {"error": "paper_id not found"}
    assert corpus.citations("p") == {"paper_id": "p", "cites": [{"paper_id": "q", "title": "Paper q", "n": 3}], "cited_by": [{"paper_id": "r", "title": "Paper r", "n": 1}]}
    assert corpus.citations("p", "sideways") == {"paper_id": "p", "cites": [], "cited_by": []}
    assert corpus.cite("p")["key"] == "lovelace2020"


def test_requests(corpus):
    lines = ["", "{bad", '{"jsonrpc":"1.0","id":1,"method":"ping"}', '{"jsonrpc":"2.0","method":"notifications/initialized"}', '{"jsonrpc":"2.0","id":2,"method":"ping"}', '{"jsonrpc":"2.0","id":3,"method":"nope"}', '{"jsonrpc":"2.0","id":4,"method":"tools/call","params":{"name":"cite","arguments":{"paper_id":"p"}}}', '{"jsonrpc":"2.0","id":5,"method":"tools/call","params":{"name":"none"}}', '{"jsonrpc":"2.0","id":6,"method":"tools/list"}']
    out = [json.loads(x) for x in serve(corpus, lines)]
    assert [x["id"] for x in out] == [None, 2, 3, 4, 5, 6]
    assert out[0]["error"]["code"] == -32700 and out[2]["error"]["code"] == -32601
    assert json.loads(out[3]["result"]["content"][0]["text"])["key"] == "lovelace2020" and out[4]["result"]["isError"] and len(out[5]["result"]["tools"]) == 8


def test_schema_is_checked(corpus):
    with pytest.raises(ValueError, match="papers lacks"):
        Corpus(corpus.papers.drop("md"), corpus.chunks, corpus.edges)


def test_words_joined_over_lines(spark):
    assert one(spark, tx.clean_paragraph, "caf\u00e9- \n \u00e9t\u00e9 exam-\n\n ple") == "caf\u00e9\u00e9t\u00e9 example"


def test_recurring_lines_without_their_blanks(spark):
    rows = [("d", p, "Header" + " " * (p % 2)) for p in range(6)] + [("d", p, f"body {p}.") for p in range(6)]
    lines = spark.createDataFrame(rows, "doc string, page int, text string")
    assert values(layout.recurring_lines(lines), "doc", "text", "n_pages") == [("d", "Header", 6)]
    assert {r.text for r in layout.strip_recurring(lines).collect()} == {f"body {p}." for p in range(6)}


def test_gaps_have_samples(spark):
    papers = spark.createDataFrame([(k, f"On MEV {k}", ["x"]) for k in range(20)] + [(30, "mev", ["MEV"])], "id long, title string, topics array<string>")
    got = taxonomy.coverage_gaps(papers, spark.createDataFrame([("mev", "MEV"), ("none", "y")], "word string, label string")).collect()
    assert [(r.word, r.missing, r.examples) for r in got] == [("mev", 20, [f"On MEV {k}" for k in range(8)])]


def test_owners_by_order_and_dois_anywhere(spark):
    papers = spark.createDataFrame([("b", "http://x.org/pdf/10.1000/AB.1.", 1), ("a", "https://doi.org/10.1000/ab.1", 2), ("c", "http://arxiv.org/abs/2001.00001v2", 3)], "paper_id string, pdf_url string, line int")
    assert sorted(values(citations.own_ids(papers, order="line"), "kind", "ref", "owner")) == [("arxiv", "2001.00001", "c"), ("doi", "10.1000/ab.1", "a")]
    assert ("doi", "10.1000/ab.1", "b") in values(citations.own_ids(papers), "kind", "ref", "owner")


def test_upsert_takes_nulls(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, s string, n int")
    new = spark.createDataFrame([("a", None)], "k string, s string")
    assert sorted(values(records.upsert(old, new, ["k"]), "k", "s", "n")) == [("a", None, 1), ("b", "y", 2)]


def test_chunks_by_another_counter(spark):
    from quillspark.operators import chunking

    body = " ".join(f"wording{k}" for k in range(300))
    docs = spark.createDataFrame([("p", f"## A\n\n{body}")], "paper_id string, md string")
    by_letters = chunking.chunk_sections(docs, budget=500, overlap=0, tokenize=lambda t: [t[a : a + 2] for a in range(0, len(t), 2)]).collect()
    assert len(by_letters) > 1 and all(r.tokens > 40 for r in by_letters)
    assert chunking.chunk_sections(docs, budget=500).count() == 1


def test_search_equals_scores_of_an_index(spark):
    import random

    r = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(40))), f"w{k % 7}") for k in range(120)] + [(500, None, "")], "id long, text string, title string")
    queries = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} none") for q in range(9)], "query_id long, text string")
    terms = lexical.query_terms(queries, "query_id", "text")
    expected = lexical.top_k(lexical.bm25(lexical.build_index(docs, "id", ["text", "title"]), terms, {"title": 2.0}), 5)
    key = ("query_id", "rank", "id")
    before = lexical.QUERY_BLOCK
    lexical.QUERY_BLOCK = 4
    try:
        got = lexical.search(docs, "id", ["text", "title"], terms, 5, {"title": 2.0})
    finally:
        lexical.QUERY_BLOCK = before
    assert sorted(values(got, *key)) == sorted(values(expected, *key))
    assert max(abs(a - b) for (_, _, a), (_, _, b) in zip(sorted(values(got, "query_id", "rank", "score")), sorted(values(expected, "query_id", "rank", "score")), strict=True)) < 1e-9
    assert lexical.search(docs, "id", ["text"], terms.limit(0), 5).collect() == []
    narrow = terms.withColumn("query_id", F.col("query_id").cast("int"))
    assert sorted(values(lexical.search(docs, "id", ["text", "title"], narrow, 5, {"title": 2.0}), *key)) == sorted(values(expected, *key))


def test_schemas_of_tools():
    from quillspark.plans.engine import tool_schema

    own = tool_schema("search")
    assert own["required"] == ["query"] and own["properties"]["k"] == {"type": "integer", "default": 8, "minimum": 1, "maximum": 50}
    assert own["properties"]["rerank"] == {"type": "boolean", "default": False}
    assert tool_schema("get_paper")["properties"]["sections"]["type"] == "array"


# --- tiled neighbours ---------------------------------------------------------------------------------------------


def brute_knn(queries, rows, k, drop_self):
    """(query_id, id, rank): by distance to nine digits, then id."""
    out = set()
    for q, a in queries:
        near = sorted((round(float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), 9), i) for i, b in rows if not drop_self or i != q)
        out |= {(q, i, n) for n, (_, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("tile", [7, 40, 10_000])
def test_knn_of_every_row_in_tiles(spark, tile):
    r = np.random.default_rng(tile)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(150)]  # small whole numbers: many ties
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = vectors.knn(frame.withColumnRenamed("id", "query_id"), frame, 5, drop_self=True, tile=tile)
    assert {(x["query_id"], x["id"], x["rank"]) for x in got.collect()} == brute_knn(rows, rows, 5, True)
    plan = got._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_knn_takes_names_lengths_and_large_numbers(spark):
    rows = [("b", [1e200, 0.0]), ("a", [0.0, 1e200]), ("c", [3e200, 0.0]), ("short", [1.0]), ("null", None), ("hole", [1.0, None])]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [0.0, 0.0]), ("short", [4.0]), (None, [0.0, 0.0])], "query_id string, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["id"], x["distance"]) for x in vectors.knn(asked, frame, 2).collect()}
    assert got == {("q", 1): ("a", 1e200), ("q", 2): ("b", 1e200), ("short", 1): ("short", 3.0)}
    assert vectors.knn(asked, frame.filter("id = 'x'"), 2).count() == 0
    assert vectors.knn(asked.filter("query_id = 'x'"), frame, 2).count() == 0


def test_related_by_name(spark):
    groups = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.9, 0.1]), ("z", [0.0, 1.0])], "paper_id string, embedding array<double>")
    got = {(r["source"], r["rank"]): r["paper_id"] for r in vectors.related(groups, "paper_id", 2).collect()}
    assert got == {("x", 1): "y", ("x", 2): "z", ("y", 1): "x", ("y", 2): "z", ("z", 1): "y", ("z", 2): "x"}


# --- folds and set joins ------------------------------------------------------------------------------------------


def test_fold_of_versions_equals_a_loop(spark):
    r = random.Random(4)
    rows = [(n, "T", f"https://arxiv.org/pdf/2001.0000{r.randrange(3)}v{r.randrange(4)}.pdf", r.choice(["", "2020-01-01", "2021-05-05", "2019-12-31"])) for n in range(600)]
    kept = {}
    for n, _, url, date in rows:
        key, version = url[:-6], int(url[-5])
        old = kept.get(key)
        if old is None or version > old[1] or (date and date > old[2]):
            kept[key] = (n, version, date)
    entries = spark.createDataFrame(rows, "line long, title string, url string, release_date string").repartition(5)
    assert sorted(r.line for r in records.latest_versions(entries).collect()) == sorted(n for n, _, _ in kept.values())
    assert records.latest_versions(entries.limit(0)).count() == 0
    assert "collect_list" not in records.latest_versions(entries)._jdf.queryExecution().toString()


def test_fuzzy_match_equals_all_pairs(spark):
    r = random.Random(9)
    vocabulary = ["common"] + [f"word{k}" for k in range(40)]
    title = lambda: " ".join(["common"] * (r.random() < 0.9) + r.sample(vocabulary[1:], r.randrange(1, 7)))
    candidates = [(f"c{k:03}", title()) for k in range(150)] + [("x1", "common"), ("x2", "common"), ("x3", ""), ("x4", None), ("x5", "слово другое"), ("x6", "of a")]
    files = [(f"f{k:03}", r.choice([title(), r.choice(candidates)[1] or "", (r.choice(candidates)[1] or "") + " extra words at the end"])) for k in range(150)]
    files += [("g1", "слово иное ещё"), ("g2", None), ("g3", "common")]

    def parts(t):
        words = {w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split() if len(w) > 2}
        plain = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "-" for c in (t or "").lower())
        return words, "-".join(x for x in plain.split("-") if x)[:80].strip("-")

    expected = {}
    for f, t in files:
        w1, s1 = parts(t)
        scores = []
        for c, u in candidates:
            w2, s2 = parts(u)
            if w1 & w2:
                scores.append((-round(len(w1 & w2) / len(w1 | w2) + (0.2 if s1.startswith(s2[:30]) or s2.startswith(s1[:30]) else 0), 9), c))
        if scores and min(scores)[0] <= -0.35:
            expected[f] = min(scores)[1]
    a, b = spark.createDataFrame(files, "file string, title string"), spark.createDataFrame(candidates, "candidate string, title string")
    got = {x.file: x.candidate for x in matching.fuzzy_match(a, b).collect()}
    assert got == expected and len(expected) > 80
