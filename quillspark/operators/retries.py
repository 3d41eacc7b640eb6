"""Retries of failed downloads: what to try, rounds over a table of attempts, and what came of them.

Nothing here knows a network: the fetcher is a function one passes in. The driver only counts rounds. A round is one job
of a fixed number of tasks, which is the bound on requests at a time, and its attempts are a table in a folder of its own,
so a run that was ended goes on with the first round that is not whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.storage import path_exists
from quillspark.functions.text import col, gated_reason, github_raw, referer
from quillspark.functions.workers import ship_package

# Addresses and patterns of a source that wants its abstract page seen first.
SSRN_HOME = "https://papers.ssrn.com/"
SSRN_ABSTRACT = "https://papers.ssrn.com/sol3/papers.cfm?abstract_id="
SSRN_DELIVERY = r"abstractid=(\d+)"

ATTEMPTS = "paper_id string, url string, code int, error string, waited double, ok boolean, content binary"

#: fetch(url, referer, prelude) gives the code of the answer and its bytes; it may raise.
Fetch = Callable[[str, str | None, str | None], tuple[int, bytes]]


@dataclass(frozen=True)
class Policy:
    """How often and how fast to try. Before round n > 1 a row waits backoff * (n - 1) seconds; the starts of two rows of
    one task lie spacing * tasks seconds apart, so that all tasks together keep `spacing`. An answer with a code in `stop` is final.
    """

    rounds: int = 4
    backoff: float = 2.0
    spacing: float = 0.0
    tasks: int = 4
    stop: tuple[int, ...] = (401, 403, 404, 410, 451)
    least_bytes: int = 10_000


def tries(url: Column | str) -> Column:
    """What to ask for a failed URL, in order: structs of url, referer and prelude (a page to open first, else null).

    Pages of source files become raw ones. A delivery address of SSRN is asked with its abstract page as the referer,
    which is opened first. An address that doesn't end in .pdf is asked once more with this ending, or as it is if it
    has a query.
    """
    u = github_raw(col(url))
    number = F.nullif(F.regexp_extract(u, SSRN_DELIVERY, 1), F.lit(""))
    abstract = F.when(F.contains(u, F.lit("ssrn.com")), F.concat(F.lit(SSRN_ABSTRACT), number))
    sent_from = F.when(F.contains(u, F.lit("ssrn.com")), F.coalesce(abstract, F.lit(SSRN_HOME))).otherwise(referer(u))
    first = F.struct(u.alias("url"), sent_from.alias("referer"), abstract.alias("prelude"))
    ended = F.when(F.contains(u, F.lit("?")), u).otherwise(F.concat(u, F.lit(".pdf")))
    second = F.struct(ended.alias("url"), referer(u).alias("referer"), F.lit(None).cast("string").alias("prelude"))
    return F.when(F.endswith(u, F.lit(".pdf")), F.array(first)).otherwise(F.array(first, second))


def plan(failed: DataFrame, key: str = "paper_id", url: str = "url") -> DataFrame:
    """(key, n, url, referer, prelude): the tries of each row, numbered from 1. A row without URL has none."""
    rows = failed.filter(F.col(url).isNotNull()).select(F.col(key), F.posexplode(tries(url)).alias("n", "t"))
    return rows.select(key, (F.col("n") + 1).alias("n"), "t.url", "t.referer", "t.prelude")


def joined_queues(*queues: DataFrame) -> DataFrame:
    """The rows of several queues with the number of their queue, from 0: those of an earlier queue come first."""
    numbered = [q.withColumn("queue", F.lit(k)) for k, q in enumerate(queues)]
    out = numbered[0]
    for q in numbered[1:]:
        out = out.unionByName(q, allowMissingColumns=True)
    return out


def _fetching(fetch: Fetch, policy: Policy, n: int, pause: Callable[[float], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started: float | None = None
        for batch in batches:
            for paper_id, asked in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "tries")), strict=True):
                waited = policy.backoff * (n - 1)
                if started is not None:
                    waited = max(waited, started + policy.spacing * policy.tasks - time.monotonic())
                if waited > 0:
                    pause(waited)
                started = time.monotonic()
                code, error, content, ok, last = None, None, None, False, None
                for t in asked:
                    last = t["url"]
                    try:
                        code, content = fetch(t["url"], t["referer"], t["prelude"])
                        error = None
                    except Exception as e:  # noqa: BLE001  a failed request is an outcome
                        code, content, error = None, None, f"{type(e).__name__}: {e}"
                    ok = code is not None and code < 400 and len(content) >= policy.least_bytes and content[:5] == b"%PDF-"
                    if ok or code in policy.stop:
                        break
                # One row a batch: contents may be large.
                row = [paper_id, last, code, error, waited, ok, content if ok else None]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in ATTEMPTS.split(", ")])

    return run


def run_rounds(failed: DataFrame, fetch: Fetch, folder: str, policy: Policy | None = None, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """The attempts (round, paper_id, url, code, error, waited, ok, content) on failed(paper_id, url), as a table in `folder`.

    Round n asks for what no earlier round got or was told to leave (a stop code). Within a round the tries of a row
    follow each other until one gives a whole PDF or a stop code; the last is the attempt. Rounds whose table is whole are
    not run again, so the folder belongs to one set of rows. If a task is lost its rows are asked for once more, and
    count once. Rows without id or URL are left out; of rows that repeat an id, the one with the least URL counts.
    """
    policy, spark = policy or Policy(), failed.sparkSession
    ship_package(spark)
    todo = failed.filter("paper_id IS NOT NULL AND url IS NOT NULL").groupBy("paper_id").agg(F.min("url").alias("url"))
    for n in range(1, policy.rounds + 1):
        path = f"{folder}/round={n}"
        if path_exists(spark, f"{path}/_SUCCESS"):
            continue
        left = todo
        for before in range(1, n):
            final = spark.read.schema(ATTEMPTS).parquet(f"{folder}/round={before}").filter(F.col("ok") | F.col("code").isin(*policy.stop))
            left = left.join(final.select("paper_id"), "paper_id", "left_anti")
        asked = left.select("paper_id", tries("url").alias("tries")).repartition(policy.tasks, "paper_id")
        asked.mapInArrow(_fetching(fetch, policy, n, pause), ATTEMPTS).write.mode("overwrite").parquet(path)
    return spark.read.schema(f"{ATTEMPTS}, round int").option("basePath", folder).parquet(*[f"{folder}/round={n}" for n in range(1, policy.rounds + 1)])


def outcomes(failed: DataFrame, attempts: DataFrame) -> DataFrame:
    """(paper_id, status, error, retry_url, bytes, sha256, source) of failed rows, for an upsert into the manifest.

    status is ok or failed; error tells why a host that wants an account gave nothing, else "retry failed". retry_url is
    given where another address than the row's was asked first.
    """
    got = attempts.filter("ok").groupBy("paper_id").agg(F.min_by(F.struct(F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")), "round").alias("g"))
    rewritten = github_raw("url")
    rows = failed.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("url").alias("url")).join(got, "paper_id", "left")
    is_ok = F.col("g").isNotNull()
    return rows.select(
        "paper_id", F.when(is_ok, "ok").otherwise("failed").alias("status"), F.when(~is_ok, F.coalesce(gated_reason(rewritten), F.lit("retry failed"))).alias("error"),
        F.when(rewritten != F.col("url"), rewritten).alias("retry_url"), F.col("g.bytes").alias("bytes"), F.col("g.sha256").alias("sha256"), F.when(is_ok, "retry").alias("source"),
    )
