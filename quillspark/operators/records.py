"""Relational work on catalogue records: versions, merges, upserts, audits and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import arxiv_version, content_key, normalize_url, paper_id, url_class
from quillspark.functions.workers import ship_package


def catalogue(raw: DataFrame) -> DataFrame:
    """Entries of a raw catalogue(line, title, url, authors, topics, release_date, referrer): trimmed, with ids and URL classes; without title or URL none."""
    t = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "url", "authors", "topics", "release_date", "referrer")}
    rows = raw.select("line", *[v.alias(c) for c, v in t.items()]).filter("title != '' AND url != ''").withColumn("url", normalize_url("url"))
    topics = F.filter(F.transform(F.split("topics", ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({"topics": topics, "id": paper_id("title", "url"), "url_class": url_class("url")})


def latest_versions(entries: DataFrame, order: str = "line") -> DataFrame:
    """One entry for each content key, by a fold in order: a later entry replaces one with a lower arXiv version, or an older date.

    The fold depends on the order, so a key's lines are one task's; they stream through it sorted, as their place, version
    and date, and the state is one such line, however many there are. The entries themselves are joined back.
    """
    ship_package(entries.sparkSession)
    lines = entries.select(content_key("title", "url").alias("key"), F.col(order).alias("at"), arxiv_version("url").alias("version"), F.col("release_date").alias("date"))
    chosen = lines.repartition("key").sortWithinPartitions("key", "at", "version", "date").mapInArrow(_fold_versions, f"at {dict(entries.dtypes)[order]}")
    return entries.join(chosen.withColumnRenamed("at", order), order, "left_semi")


def _fold_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: tuple | None = None
    for batch in batches:
        done = []
        for key, at, version, date in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "version", "date")), strict=True):
            if kept is None or kept[0] != key:
                if kept is not None:
                    done.append(kept[1])
                kept = (key, at, version, date)
            elif (version is not None and kept[2] is not None and version > kept[2]) or (date and kept[3] is not None and date > kept[3]):
                kept = (key, at, version, date)
        kind = batch.schema.field("at").type
        yield pa.RecordBatch.from_arrays([pa.array(done, kind)], ["at"])
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array([kept[1]], kind)], ["at"])


def or_else(a: Column | str, b: Column | str) -> Column:
    """a unless it is null or empty, else b."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.nullif(a, F.lit("")), b)


def longer(a: Column | str, b: Column | str) -> Column:
    """The longer of two texts; a if they are as long."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old merged with new by key: where new has the row, its columns replace those of old, nulls too; rows of either stay."""
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys])
    b = new.select(*keys, F.lit(True).alias("_is_new"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys])

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_old_{c}")
        fresh = F.when(F.col("_is_new"), F.col(f"_new_{c}"))
        return fresh.otherwise(F.col(f"_old_{c}")) if c in old.columns else fresh

    merged = [value(c).alias(c) for c in values]
    return a.join(b, keys, "full_outer").select(*keys, *merged)


def changed(rows: DataFrame, done: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows that are not in done(keys, content_hash) with the same content."""
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return hashed.join(done.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def batches(rows: DataFrame, key: str, size: int = 25) -> DataFrame:
    """rows with a batch number for requests of `size` ids, in the order of key: the plan of a client that may send a
    request every few seconds, so the ids of one run are few and are numbered in one task."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size))


def failed_report(rows: DataFrame, title: str = "title", url: str = "url") -> DataFrame:
    """(no, item): an HTML list item for each row, numbered by title; the report is for people and short."""
    no = F.row_number().over(Window.orderBy(title, url))
    return rows.select(no.alias("no"), F.format_string('<li>%d. <a href="%s">%s</a></li>', no, F.col(url), F.replace(F.col(title), F.lit("<"), F.lit("&lt;"))).alias("item"))


def indicators(text: Column | str, words: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Flags of a page by name: whether its text holds any of the flag's words, without case. Give them to withColumns()."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return {name: F.exists(F.array(*[F.lit(w.lower()) for w in own]), lambda w: F.contains(low, w)) for name, own in words.items()}


# What key sections are called, in the order in which they are picked.
KEY_TERMS = ("introduction", "conclusion", "discussion", "summary", "results", "contribution")


def excerpts(chunks: DataFrame, terms: tuple[str, ...] = KEY_TERMS, heads: int = 2, budget: int = 6000) -> DataFrame:
    """(paper_id, chunk_id, pick, text): the first chunks of each paper(paper_id, idx, section, text), then for each term the
    first chunk of a section that holds it and has not been picked from; cut to a budget of characters in all.
    """
    low = chunks.withColumn("_section", F.lower(F.coalesce("section", F.lit(""))))
    numbered = low.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy("idx")))
    picked = numbered.filter(F.col("_n") <= heads).select("paper_id", "idx", "_section", F.col("_n").alias("pick"))
    # Only the first chunk of a section can be picked for a term, so one row for each section is enough.
    firsts = numbered.groupBy("paper_id", "_section").agg(F.min("idx").alias("idx"))
    sections = firsts.join(picked.select("paper_id", "_section").distinct(), ["paper_id", "_section"], "left_anti")
    listed = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("idx", "_section"))).alias("s"))
    none = F.array().cast("array<struct<idx:int,_section:string>>")
    fit = lambda taken, term: F.slice(F.filter("s", lambda x: F.contains(x["_section"], term) & ~F.exists(taken, lambda y: y["idx"] == x["idx"])), 1, 1)
    state = F.aggregate(F.array(*[F.lit(t) for t in terms]), none, lambda taken, term: F.concat(taken, fit(taken, term)))
    chosen = listed.select("paper_id", F.posexplode(state).alias("p", "x")).select("paper_id", F.col("x.idx").alias("idx"), (F.col("p") + heads + 1).alias("pick"))
    all_picks = picked.select("paper_id", "idx", "pick").unionByName(chosen)
    texts = chunks.join(all_picks, ["paper_id", "idx"])
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("paper_id").orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    cut = F.when(F.length("text") > left, F.concat(F.substring(F.col("text"), F.lit(1), left), F.lit("…"))).otherwise(F.col("text"))
    return texts.withColumn("_left", left).withColumn("text", cut).filter("_left > 0").select("paper_id", "chunk_id", "pick", "text")

