"""The eight tools over a corpus, and their JSON-RPC front."""

import inspect
import json
import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stem import stemmed_tokens
from quillspark.functions.storage import checkpointed
from quillspark.functions.text import bib_key, bibtex, tokens
from quillspark.operators import citations as graph
from quillspark.operators import fusion, grammar, inverted, lexical, vectors
from quillspark.operators.layout import pick_sections
from quillspark.operators.numbering import chunk_rowids
from quillspark.operators.records import excerpts
from quillspark.operators.taxonomy import facet_counts

POOL, RERANK_POOL = 60, 25
#: What a word without a field is looked for in, and what a hit there counts.
FIELDS, BOOSTS = ["text", "title", "section"], {"title": 2.0}
NOT_FOUND = {"error": "paper_id not found"}


def _required(name: str, frame: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return frame


@dataclass
class Corpus:
    """papers(paper_id, title, authors, topics array, release_date, pdf_url, n_pages, abstract, md),
    chunks(paper_id, chunk_id, idx, section, text, embedding) and citation edges(src, dst, kind, times).

    embedder turns query texts into a matrix; without one, or if it fails, semantic search is off and hybrid falls back
    to words. reranker gives a score column from the columns of the query's text and the chunk's; without one the share
    of the query's words counts, and if it fails the fused order stays. Both are tried once on the driver with one short
    text; what fails later, on an executor, fails the search. With stem, texts and their queries are stemmed (English);
    titles, sections and topics never are.

    Chunks have dense numbers from 1 in the order of their papers and places, by which lists are fused and ties go.
    index is a stored index of build_index(); without one, plain words are scored where chunks are read, and only queries
    with phrases, groups and the like build one.
    """

    papers: DataFrame
    chunks: DataFrame
    edges: DataFrame
    embedder: Callable[[list[str]], np.ndarray] | None = None
    reranker: Callable[[Column, Column], Column] | None = None
    stem: bool = True
    index: inverted.BlockIndex | None = None

    def __post_init__(self) -> None:
        _required("papers", self.papers, ["paper_id", "title", "authors", "topics", "release_date", "pdf_url", "n_pages", "abstract", "md"])
        _required("chunks", self.chunks, ["paper_id", "chunk_id", "idx", "section", "text", "embedding"])
        _required("edges", self.edges, ["src", "dst", "kind", "times"])
        self._centroids: DataFrame | None = None
        self._tried: bool | None = None
        self._reranks: bool | None = None
        self._docs: DataFrame | None = None

    @property
    def spark(self):
        return self.papers.sparkSession

    def _numbered(self) -> DataFrame:
        """(id, chunk_id, paper_id, section, text, embedding, title, topics): chunks by their number, with what is indexed of their papers.

        They are made once, as a checkpoint: each search reads them several times.
        """
        if self._docs is None:
            own = self.chunks.join(chunk_rowids(self.chunks).drop("paper_id"), "chunk_id")
            papers = self.papers.select("paper_id", "title", F.array_join("topics", " ").alias("topics"))
            self._docs = checkpointed(own.join(papers, "paper_id").select(F.col("chunk_rowid").alias("id"), "chunk_id", "paper_id", "section", "text", "embedding", "title", "topics"))
        return self._docs

    def _analysers(self) -> dict[str, Callable]:
        return {"text": stemmed_tokens} if self.stem else {}

    def build_index(self) -> inverted.BlockIndex:
        """The index that search() takes, of chunks by their number; topics can be searched as a field of their own."""
        return inverted.build(self._numbered(), "id", [*FIELDS, "topics"], self._analysers())

    def _by_words(self, asked: DataFrame) -> list[DataFrame]:
        """(query_id, id, score, rank) of queries(query_id, query) of plain words, and of those in the query language."""
        docs, analysers, out = self._numbered(), self._analysers(), []
        special = F.col("query").rlike(grammar.SYNTAX)
        if not (plain := asked.filter(~special)).isEmpty():
            own = [lexical.query_terms(plain, "query_id", "query", analysers.get(f, tokens)).select("query_id", F.lit(f).alias("field"), "term", "times") for f in FIELDS]
            terms = own[0].unionByName(own[1]).unionByName(own[2])
            out.append(inverted.search(self.index, terms, POOL, BOOSTS) if self.index else lexical.search(docs, "id", FIELDS, terms, POOL, BOOSTS, analysers))
        if not (rest := asked.filter(special)).isEmpty():
            if self.index is None:
                self.index = self.build_index()
            out.append(lexical.top_k(grammar.search(self.index, docs, "id", FIELDS, rest, BOOSTS, analysers), POOL))
        return out

    def search_all(self, queries: DataFrame, k: int = 8, mode: str = "hybrid", per_paper_cap: int = 2, rerank: bool = False, expand: bool = True) -> DataFrame:
        """Hits of queries(query_id, query), all at once: (query_id, position, chunk_id, paper_id, title, section, score, snippet, bm25, cosine)."""
        k = max(1, min(50, k))
        asked = queries.select("query_id", F.col("query").alias("original"), (lexical.expand_query(F.col("query")) if expand else F.col("query")).alias("query"))
        docs = self._numbered()
        lists, scores = [], []
        if mode != "sem":
            lex = self._by_words(asked)
            lists.append(lex[0] if len(lex) == 1 else lex[0].unionByName(lex[1]) if lex else self.spark.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, id long, score double, rank int"))
            lists[0] = checkpointed(lists[0])  # some rows for each query, which are read more than once
            scores.append(lists[0].select("query_id", "id", F.col("score").alias("bm25")))
        if mode != "lex" and self._embeds():
            own = vectors.embed(asked.select("query_id", F.concat(F.lit("query: "), "query").alias("t")), "t", self.embedder)
            near = checkpointed(vectors.knn(own, docs.select("id", "embedding"), POOL).select("query_id", "id", "rank", F.col("similarity").alias("score")))
            lists.append(near)
            scores.append(near.select("query_id", "id", F.col("score").alias("cosine")))
        if not lists:
            raise ValueError("semantic search needs an embedder")
        fused = fusion.ranked(fusion.rrf(lists) if len(lists) > 1 else lists[0].select("query_id", "id", "score"))
        fused = lexical.small(fused).join(docs.drop("embedding", "topics"), "id")  # before the cap, so that what is missing takes no place
        if rerank and self._reranker_works():
            words = lexical.small(asked.select("query_id", F.col("original").alias("_asked")))
            score = self.reranker(F.col("_asked"), F.col("text")) if self.reranker else fusion.overlap_score(tokens("_asked"), tokens("text"))
            fused = fusion.rerank(fused.join(words, "query_id"), RERANK_POOL, score).drop("rank", "_asked").withColumnRenamed("new_rank", "rank")
        hits = fusion.cap_per_group(fused, "paper_id", per_paper_cap, k)
        for extra in scores:
            hits = hits.join(extra, ["query_id", "id"], "left")
        for name in ("bm25", "cosine"):
            if name not in hits.columns:
                hits = hits.withColumn(name, F.lit(None).cast("double"))
        hits = hits.join(lexical.small(asked.select("query_id", tokens("query").alias("_terms"))), "query_id")
        return hits.select("query_id", "position", "chunk_id", "paper_id", "title", "section", "score", lexical.snippet(F.col("text"), F.col("_terms")).alias("snippet"), "bm25", "cosine")

    def _embeds(self) -> bool:
        """Whether there is an embedder that works: it is tried once on the driver."""
        if self.embedder is None:
            return False
        if self._tried is None:
            try:
                self._tried = len(self.embedder(["query: "])) == 1
            except Exception as e:  # noqa: BLE001  whatever a model raises, words are left
                logging.getLogger(__name__).warning("no semantic search: %s", e)
                self._tried = False
        return self._tried

    def _reranker_works(self) -> bool:
        """Whether the reranker, if there is one, scores a pair of short texts."""
        if self.reranker is None:
            return True
        if self._reranks is None:
            try:
                one = self.spark.createDataFrame([("a", "b")], "asked string, text string")
                self._reranks = one.select(self.reranker(F.col("asked"), F.col("text"))).first() is not None
            except Exception as e:  # noqa: BLE001  whatever a model raises, the fused order is left
                logging.getLogger(__name__).warning("no reranking: %s", e)
                self._reranks = False
        return self._reranks

    def search(self, query: str, k: int = 8, mode: str = "hybrid", per_paper_cap: int = 2, rerank: bool = False, expand: bool = True) -> dict:
        one = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        rows = self.search_all(one, k, mode, per_paper_cap, rerank, expand).orderBy("position").drop("query_id", "position").collect()
        return {"hits": [r.asDict() for r in rows], "k": max(1, min(50, k)), "mode": mode, "per_paper_cap": per_paper_cap}

    def _paper(self, paper_id: str, *columns) -> dict | None:
        row = self.papers.filter(F.col("paper_id") == paper_id).select(*columns).first()
        return row and row.asDict()

    def get_paper(self, paper_id: str, sections: list[str] | None = None) -> dict:
        found = self._paper(paper_id, F.col("paper_id").alias("id"), "title", "authors", "topics", "release_date", "pdf_url", "n_pages", "abstract", pick_sections(F.coalesce("md", F.lit("")), sections or []).alias("markdown"))
        return found or NOT_FOUND

    def list_papers(self, topic: str | None = None, since: str | None = None, limit: int = 50) -> dict:
        rows = self.papers
        if topic:
            rows = rows.filter(F.exists("topics", lambda t: F.lower(t) == topic.lower()))
        if since:
            rows = rows.filter(F.col("release_date") >= since)
        found = rows.select(F.col("paper_id").alias("id"), "title", "authors", "topics", "release_date").orderBy(F.desc("release_date"), "id").limit(limit).collect()
        return {"papers": [r.asDict() for r in found], "count": len(found)}

    def list_topics(self) -> dict:
        rows = facet_counts(self.papers, "topics").orderBy(F.desc("count"), "facet").collect()
        return {"topics": [{"topic": r["facet"], "count": r["count"]} for r in rows]}

    def summarize_paper(self, paper_id: str) -> dict:
        found = self._paper(paper_id, F.col("paper_id").alias("id"), "title", "authors", "topics", "release_date", "pdf_url", "n_pages", "abstract")
        if not found:
            return NOT_FOUND
        own = self.chunks.filter(F.col("paper_id") == paper_id)
        picks = excerpts(own).join(own.select("chunk_id", "section"), "chunk_id").orderBy("pick").select("chunk_id", "section", "text").collect()
        return {**found, "key_excerpts": [r.asDict() for r in picks], "n_chunks": own.count()}

    def find_related(self, paper_id: str, k: int = 10) -> dict:
        if not self._paper(paper_id, "paper_id"):
            return NOT_FOUND
        if self._centroids is None:
            self._centroids = vectors.centroids(self.chunks, "paper_id").cache()
        source = self._centroids.filter(F.col("paper_id") == paper_id).first()
        if source is None:
            raise ValueError("the paper has no vectors")
        own = self.spark.createDataFrame([(0, source["embedding"])], "query_id long, embedding array<double>")
        others = self._centroids.filter(F.col("paper_id") != paper_id).select(F.col("paper_id").alias("id"), "embedding")
        near = vectors.knn(own, others, max(1, min(30, k))).withColumnRenamed("id", "paper_id").join(self.papers.select("paper_id", "title", "release_date"), "paper_id")
        return {"source": paper_id, "related": [r.asDict() for r in near.orderBy("rank").select("paper_id", "title", "release_date", "similarity").collect()]}

    def citations(self, paper_id: str, direction: str = "both") -> dict:
        def rows(frame: DataFrame) -> list[dict]:
            return [r.asDict() for r in frame.filter(F.col("paper") == paper_id).orderBy(F.desc("n"), "other").select(F.col("other").alias("paper_id"), "title", "n").collect()]

        return {
            "paper_id": paper_id,
            "cites": rows(graph.cites(self.edges, self.papers)) if direction in ("cites", "both") else [],
            "cited_by": rows(graph.cited_by(self.edges, self.papers)) if direction in ("cited_by", "both") else [],
        }

    def cite(self, paper_id: str) -> dict:
        return self._paper(paper_id, bibtex("paper_id", "title", "authors", "release_date").alias("bibtex"), bib_key("authors", "release_date").alias("key")) or NOT_FOUND


_JSON_TYPES = {str: "string", int: "integer", bool: "boolean", "str": "string", "int": "integer", "bool": "boolean"}
# What arguments of tools are bound to.
_BOUNDS = {
    ("search", "k"): {"minimum": 1, "maximum": 50}, ("search", "mode"): {"enum": ["hybrid", "lex", "sem"]}, ("search", "per_paper_cap"): {"minimum": 0},
    ("find_related", "k"): {"minimum": 1, "maximum": 30}, ("citations", "direction"): {"enum": ["cites", "cited_by", "both"]},
}


def tool_schema(tool: str) -> dict[str, Any]:
    """The JSON schema of a tool's arguments, from its signature: types, defaults and bounds; arguments without a default are required."""
    properties, required = {}, []
    for name, p in list(inspect.signature(getattr(Corpus, tool)).parameters.items())[1:]:
        kind = _JSON_TYPES.get(p.annotation) or _JSON_TYPES.get(str(p.annotation).split(" | ")[0])
        own = {"type": kind} if kind else {"type": "array", "items": {"type": "string"}}
        if p.default is inspect.Parameter.empty:
            required.append(name)
        elif p.default is not None:
            own["default"] = p.default
        properties[name] = own | _BOUNDS.get((tool, name), {})
    return {"type": "object", "properties": properties, "required": required}


TOOLS = ("search", "get_paper", "list_papers", "list_topics", "summarize_paper", "find_related", "citations", "cite")


def serve(corpus: Corpus, lines: Iterable[str]) -> Iterator[str]:
    """JSON-RPC 2.0 responses to requests, one a line: initialize, ping, tools/list, tools/call."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}})
            continue
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
            continue
        answer = _answer(corpus, request.get("method", ""), request.get("params") or {})
        if request.get("id") is not None:
            yield json.dumps({"jsonrpc": "2.0", "id": request["id"], **answer})


def _answer(corpus: Corpus, method: str, params: dict) -> dict[str, Any]:
    if method == "initialize":
        return {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quillspark", "version": "1"}}}
    if method == "ping" or method.startswith("notifications/"):
        return {"result": {}}
    if method == "tools/list":
        return {"result": {"tools": [{"name": t, "description": (getattr(Corpus, t).__doc__ or t), "inputSchema": tool_schema(t)} for t in TOOLS]}}
    if method != "tools/call":
        return {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    try:
        if params.get("name") not in TOOLS:
            raise ValueError(f"unknown tool: {params.get('name')}")
        result = getattr(corpus, params["name"])(**(params.get("arguments") or {}))
        return {"result": {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": False}}
    except Exception as e:  # noqa: BLE001  a tool's failure is an answer
        return {"result": {"content": [{"type": "text", "text": f"error: {e}"}], "isError": True}}
