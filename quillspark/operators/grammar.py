"""The lexical query language: a syntax tree for each query, evaluated as set operations for all queries at once.

    clause  = [+ | - | NOT] ( word | "words"[~slop] | [low TO high] | {low TO high} | ( query ) ) [^boost], after an optional field:
    query   = clauses, side by side or joined by AND and OR; AND binds more closely

Reading is lenient: what cannot be read is left out, an open group or phrase ends with the query.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.workers import ship_package
from quillspark.operators import inverted
from quillspark.operators.lexical import small

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<sign>[+-](?=\S))|(?P<open>\()|(?P<close>\))(?:\^(?P<group_boost>\d+(?:\.\d+)?))?|(?P<op>AND|OR|NOT)(?=[\s(]|$)|(?P<field>[^\W\d]\w*):(?=\S)
    |"(?P<phrase>[^"]*)(?:"|$)(?:~(?P<slop>\d+))?(?:\^(?P<phrase_boost>\d+(?:\.\d+)?))?
    |(?P<low_end>[\[{])\s*(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<high_end>[\]}])(?:\^(?P<range_boost>\d+(?:\.\d+)?))?
    |(?P<word>[^\s"()\[\]{}^]+)(?:\^(?P<boost>\d+(?:\.\d+)?))?|(?P<other>.)""",
    re.X | re.S,
)
_WORD = re.compile(r"[^\W_]+")
#: Queries that say more than words.
SYNTAX = r'["()\[\]{}^]|(^|\s)[+-]\S|\b(AND|OR|NOT)\b|\w:\S'
#: Different ranges that a batch of queries may ask for; each is a condition of one plan.
MOST_RANGES = 1000


def parse(query: str) -> dict | None:
    """The tree of a query: {"leaf": n}, or {"all": [...], "any": [...], "none": [...], "boost": b}; None if it asks for nothing.

    leaves(query) has what the numbers stand for.
    """
    return _read(query)[0]


def leaves(query: str) -> list[dict]:
    """The leaves of a query, by number: {"kind": "words" | "range", "field", "words", "slop", "boost", "low", "high", "ends"}."""
    return _read(query)[1]


def _read(query: str) -> tuple[dict | None, list[dict]]:
    found: list[dict] = []
    stack: list[list] = [[]]  # of groups: lists of (occur, node) and "AND" / "OR"
    pending: list[tuple] = [(None, None)]  # of groups: the sign and field that the next clause has
    opened: list[tuple] = []

    def add(node: dict | None) -> None:
        sign, _ = pending[-1]
        pending[-1] = (None, None)
        if node is not None:
            stack[-1].append((sign, node))

    def leaf(**own) -> dict:
        found.append({"field": pending[-1][1] or (next((f for _, f in reversed(opened) if f), None)), "words": [], "slop": 0, "boost": 1.0, "low": None, "high": None, "ends": "[]"} | own)
        return {"leaf": len(found) - 1}

    def close(boost: str | None) -> None:
        tree = _group(stack.pop(), float(boost or 1))
        pending.pop()
        pending[-1] = opened.pop()
        add(tree)

    for m in _TOKEN.finditer(query):
        g = m.groupdict()
        if g["sign"]:
            pending[-1] = (g["sign"], pending[-1][1])
        elif g["field"]:
            pending[-1] = (pending[-1][0], g["field"])
        elif g["op"] == "NOT":
            pending[-1] = ("-", pending[-1][1])
        elif g["op"]:
            stack[-1].append(g["op"])
        elif g["open"]:
            opened.append(pending[-1])
            stack.append([])
            pending.append((None, None))
        elif g["close"]:
            if opened:
                close(g["group_boost"])
        elif g["low"] is not None:
            add(leaf(kind="range", low=g["low"], high=g["high"], ends=g["low_end"] + g["high_end"], boost=float(g["range_boost"] or 1)))
        elif g["phrase"] is not None or g["word"]:
            words = _WORD.findall((g["phrase"] if g["phrase"] is not None else g["word"]).lower())
            words = [w for w in words if len(w.encode()) < 40]
            add(leaf(kind="words", words=words, slop=int(g["slop"] or 0), boost=float(g["phrase_boost"] or g["boost"] or 1)) if words else None)
    while opened:
        close(None)
    return _group(stack[0], 1.0), found


def _group(items: list, boost: float) -> dict | None:
    """A node of clauses and operators: runs joined by AND are nodes of their own, unless one is all there is."""
    runs: list[list] = []
    joined = False
    for item in items:
        if isinstance(item, str):
            joined = item == "AND" and bool(runs)
            continue
        if joined:
            runs[-1].append(item)
        else:
            runs.append([item])
        joined = False
    if not runs:
        return None
    out: dict = {"all": [], "any": [], "none": [], "boost": boost}
    for run in runs:
        if len(run) > 1:
            both: dict = {"all": [], "any": [], "none": [], "boost": 1.0}
            for sign, node in run:
                both["none" if sign == "-" else "all"].append(node)
            if len(runs) == 1:
                return both | {"boost": boost}
            out["any"].append(both)
        else:
            sign, node = run[0]
            out[{"+": "all", "-": "none"}.get(sign, "any")].append(node)
    return out


def score(tree: dict, held: dict[int, float]) -> float | None:
    """A document's score by the scores of the leaves it holds; None if the tree doesn't select it. Clauses that only exclude select nothing."""
    if "leaf" in tree:
        return held.get(tree["leaf"])
    must = [score(t, held) for t in tree["all"]]
    if any(s is None for s in must) or any(score(t, held) is not None for t in tree["none"]):
        return None
    may = [s for s in (score(t, held) for t in tree["any"]) if s is not None]
    if not must and not may:
        return None
    return tree["boost"] * sum([*must, *may])


_LEAVES = "array<struct<kind:string,field:string,words:array<string>,slop:int,boost:double,low:string,high:string,ends:string>>"


def search(index: inverted.BlockIndex, docs: DataFrame, key: str, fields: list[str], queries: DataFrame, boosts: dict[str, float] | None = None, analysers: dict[str, Callable] | None = None) -> DataFrame:
    """(query_id, id, score) of the documents that queries(query_id, query) select; docs(key, ...) is read for ranges only.

    A word's or phrase's score is BM25 over its field, or all fields; a range adds nothing. A word that splits into several,
    like one with a hyphen, is a phrase. Words in a field that is not indexed match nothing, as do ranges of unknown
    columns. Fields with analysers of their own (those of the index) get their words by these. Each document's leaves meet
    in one row, as many as its query has.
    """
    spark = queries.sparkSession
    ship_package(spark)

    @F.pandas_udf("string")
    def tree_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda q: json.dumps(parse(q or "")))

    @F.pandas_udf(_LEAVES)
    def leaves_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda q: leaves(q or ""))

    read = queries.select("query_id", F.posexplode(leaves_of("query")).alias("leaf", "x")).select("query_id", "leaf", "x.*")
    in_fields = F.explode(F.when(F.col("field").isNull(), F.array(*[F.lit(f) for f in fields])).otherwise(F.array("field")))
    words = read.filter("kind = 'words'").select("query_id", "leaf", "boost", "slop", "words", in_fields.alias("field"))
    for f, analyse in (analysers or {}).items():
        words = words.withColumn("words", F.when(F.col("field") == f, analyse(F.array_join("words", " "))).otherwise(F.col("words")))
    single = words.filter(F.size("words") == 1).select("query_id", "leaf", "field", F.get("words", F.lit(0)).alias("term"), F.col("boost").alias("times"))
    hits = inverted.matches(index, single, boosts)
    several = words.filter(F.size("words") > 1).select(F.struct("query_id", "leaf", "boost").alias("phrase_id"), "field", "words", "slop")
    found = inverted.phrases(index, several, boosts)
    hits = hits.unionByName(found.select("phrase_id.query_id", "phrase_id.leaf", "id", (F.col("score") * F.col("phrase_id.boost")).alias("score")))
    ranges = read.filter("kind = 'range'")
    asked = ranges.select("field", "low", "high", "ends").distinct().limit(MOST_RANGES + 1).collect()
    if len(asked) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} different ranges")
    known = [r for r in asked if r["field"] in docs.columns]
    if known:
        inside = docs.select(F.col(key).alias("id"), F.explode(F.filter(F.array(*[F.when(_within(r), F.lit(i)) for i, r in enumerate(known)]), lambda x: x.isNotNull())).alias("r"))
        names = spark.createDataFrame([(i, r["field"], r["low"], r["high"], r["ends"]) for i, r in enumerate(known)], "r int, field string, low string, high string, ends string")
        of_query = ranges.join(F.broadcast(names), ["field", "low", "high", "ends"]).select("query_id", "leaf", "r")
        hits = hits.unionByName(inside.join(small(of_query), "r").select("query_id", "leaf", "id", F.lit(0.0).alias("score")))
    rows = hits.groupBy("query_id", "leaf", "id").agg(F.sum("score").alias("score")).groupBy("query_id", "id").agg(F.collect_list(F.struct("leaf", "score")).alias("held"))

    @F.pandas_udf("double")
    def evaluated(trees: pd.Series, helds: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        out = []
        for text, held in zip(trees, helds, strict=True):
            tree = known.get(text) or known.setdefault(text, json.loads(text))
            out.append(None if tree is None else score(tree, {x["leaf"]: x["score"] for x in held}))
        return pd.Series(out, dtype="float64")

    trees = queries.select("query_id", tree_of("query").alias("tree"))
    scored = rows.join(small(trees), "query_id").withColumn("score", evaluated("tree", "held"))
    return scored.filter("score IS NOT NULL AND NOT isnan(score)").select("query_id", "id", "score")


def _within(r) -> Column:
    value = F.col(r["field"]).cast("string")
    low = F.lit(True) if r["low"] == "*" else value >= r["low"] if r["ends"][0] == "[" else value > r["low"]
    high = F.lit(True) if r["high"] == "*" else value <= r["high"] if r["ends"][1] == "]" else value < r["high"]
    return low & high
