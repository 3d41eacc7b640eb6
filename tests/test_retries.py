"""Retry rounds against a plain loop; files committed one for each row."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import GATED_HOSTS
from quillspark.operators import records, retries
from quillspark.sources import commits

PDF = b"%PDF-" + b"x" * 10_000
POLICY = retries.Policy(rounds=3, backoff=0.25, tasks=3, stop=(404,))


def _site(log):
    """A made-up site: what it says depends on the address, the referer and how often it was asked."""

    def answer(url, sent_from, prelude):
        h = int(hashlib.sha256(url.encode()).hexdigest(), 16)
        at = f"{log}/{h}"
        with open(at, "a") as f:
            f.write("x")
        asked = len(open(at).read())
        if h % 7 == 0:
            raise TimeoutError("slow")
        if h % 7 == 1:
            return 404, b"gone"
        if h % 7 == 2:
            return (200, PDF + url.encode()) if asked >= 2 else (503, b"")
        if h % 7 == 3:
            return 200, b"<html>" + PDF
        if h % 7 == 4:
            return (200, PDF + url.encode()) if prelude or sent_from.endswith("/") else (403, b"")
        return (200, PDF + url.encode()) if asked >= 4 else (200, b"%PDF-short")

    return answer


def _tries(url):
    if m := re.match(r"https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", url):
        url = "https://raw.githubusercontent.com/" + "/".join(m.groups())
    root = "/".join(url.split("/")[:3]) + "/"
    abstract = re.search(r"abstractid=(\d+)", url) if "ssrn.com" in url else None
    page = "https://papers.ssrn.com/sol3/papers.cfm?abstract_id=" + abstract[1] if abstract else None
    asked = [(url, page or ("https://papers.ssrn.com/" if "ssrn.com" in url else root), page)]
    return asked if url.endswith(".pdf") else [*asked, (url if "?" in url else url + ".pdf", root, None)]


def _urls():
    kinds = ["https://a.example/{}.pdf", "http://b.example/x{}", "https://b.example/get?id={}", "https://github.com/u/r/blob/main/{}.pdf", "https://papers.ssrn.com/sol3/Delivery.cfm?abstractid={}", "https://ssrn.com/{}", f"https://{GATED_HOSTS[0]}/doi/{{}}"]
    return {f"p{i}": kinds[i % len(kinds)].format(i) for i in range(84)}


def test_rounds_equal_a_plain_loop(spark, tmp_path):
    urls = _urls()
    failed = spark.createDataFrame([*urls.items(), ("none", None), (None, "https://a.example/n.pdf")], "paper_id string, url string")
    (tmp_path / "spark").mkdir()
    (tmp_path / "plain").mkdir()
    plain = _site(str(tmp_path / "plain"))
    attempts = retries.run_rounds(failed, _site(str(tmp_path / "spark")), str(tmp_path / "table"), POLICY, pause=lambda s: None)
    want, left = [], dict(urls)
    for n in range(1, POLICY.rounds + 1):
        for paper, url in list(left.items()):
            for asked in _tries(url):
                try:
                    code, content = plain(*asked)
                    ok = code < 400 and len(content) >= 10_000 and content.startswith(b"%PDF-")
                except TimeoutError:
                    code, content, ok = None, None, False
                if ok or code == 404:
                    break
            want.append((n, paper, asked[0], code, ok, content if ok else None))
            if ok or code == 404:
                del left[paper]
    got = [(x["round"], x["paper_id"], x["url"], x["code"], x["ok"], x["content"] and bytes(x["content"])) for x in attempts.collect()]
    assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
    assert {x["waited"] for x in attempts.filter("round = 3").collect()} == {0.5}
    assert {x[0] for x in want} == {1, 2, 3} and any(x[4] for x in want if x[0] > 1)

    out = {x["paper_id"]: x for x in retries.outcomes(failed, attempts).collect()}
    assert out.keys() == urls.keys() | {"none"} and out["none"]["status"] == "failed"
    kept = {x[1]: x[5] for x in want if x[4]}
    for paper, url in urls.items():
        row = out[paper]
        assert row["status"] == ("ok" if paper in kept else "failed")
        assert row["sha256"] == (hashlib.sha256(kept[paper]).hexdigest() if paper in kept else None)
        if paper not in kept:
            assert row["error"] == (f"auth_required: {GATED_HOSTS[0]} requires institutional access" if GATED_HOSTS[0] in url else "retry failed")
        assert row["retry_url"] == (_tries(url)[0][0] if "github" in url else None)
    manifest = spark.createDataFrame([("p0", "failed", "old"), ("kept", "ok", None)], "paper_id string, status string, error string")
    merged = {x["paper_id"]: x["status"] for x in records.upsert(manifest, retries.outcomes(failed, attempts), ["paper_id"]).collect()}
    assert merged["kept"] == "ok" and merged["p0"] == out["p0"]["status"]


def test_rounds_go_on_where_they_ended(spark, tmp_path):
    failed = spark.createDataFrame([("a", "https://x.example/a.pdf"), ("b", "https://x.example/b.pdf")], "paper_id string, url string")
    table = str(tmp_path / "table")
    two = retries.Policy(rounds=1, tasks=2)
    retries.run_rounds(failed, lambda u, r, p: (200, PDF) if "a.pdf" in u else (500, b""), table, two, pause=lambda s: None)
    (tmp_path / "table/round=2").mkdir()  # a round that was not finished
    (tmp_path / "table/round=2/part-0.parquet").write_bytes(b"half")
    asked = tmp_path / "asked"

    def later(u, r, p):
        with open(asked, "a") as f:
            f.write(u + "\n")
        return 200, PDF

    rows = retries.run_rounds(failed, later, table, retries.Policy(rounds=3, tasks=2), pause=lambda s: None).collect()
    assert sorted((x["round"], x["paper_id"], x["ok"]) for x in rows) == [(1, "a", True), (1, "b", False), (2, "b", True)]
    assert asked.read_text() == "https://x.example/b.pdf\n"
    empty = retries.run_rounds(failed.limit(0), later, str(tmp_path / "other"), two)
    assert empty.count() == 0 and retries.outcomes(failed.limit(0), empty).count() == 0


def test_queues_join_in_order(spark):
    a, b = spark.createDataFrame([("x", 1)], "id string, n int"), spark.createDataFrame([("y",)], "id string")
    assert [tuple(x) for x in retries.joined_queues(a, b).orderBy("queue").collect()] == [("x", 1, 0), ("y", None, 1)]


def _files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file() and p.name[0] not in "._"}


def test_a_failed_and_repeated_write_leaves_each_file_once(spark, tmp_path):
    folder, flag = tmp_path / "out", tmp_path / "flag"
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.repeat(F.col("id").cast("string"), 3), "UTF-8").alias("content"))
    want = {f"f{i}": (str(i) * 3).encode() for i in range(40)}
    mark = str(flag)

    def fails(x: int) -> str:
        import os

        if x == 35 and not os.path.exists(mark):
            raise RuntimeError("lost")
        return str(x) * 3

    late = F.udf(fails, "string")
    broken = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(late("id"), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="lost"):
        commits.write_files(broken, str(folder))
    assert commits.listed(spark, str(folder)).count() == 0 and not list((folder / "_lists").iterdir())
    flag.touch()
    commits.write_files(broken, str(folder))
    assert _files(folder) == want and not list(folder.glob("*.tmp"))
    listed = {x["name"]: (x["bytes"], x["sha256"]) for x in commits.listed(spark, str(folder)).collect()}
    assert listed == {k: (len(c), hashlib.sha256(c).hexdigest()) for k, c in want.items()}
    commits.write_files(rows.filter("name = 'f1'"), str(folder))
    assert _files(folder) == want and [x["name"] for x in commits.listed(spark, str(folder)).collect()] == ["f1"]
    commits.write_files(rows.limit(0), str(folder))
    assert commits.listed(spark, str(folder)).count() == 0
    with pytest.raises(ValueError, match="f1"):
        commits.write_files(rows.union(rows.filter("name = 'f1'")), str(folder))
    for name in ("", "../x", "_x", None):
        with pytest.raises(Exception, match="no file can be written"):
            commits.write_files(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(tmp_path / "bad"))


def test_one_object_a_paper(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "é"), ("b", 2, None)], "paper_id string, n int, t string")
    commits.json_each(rows, str(tmp_path / "o"))
    assert {k: json.loads(v) for k, v in _files(tmp_path / "o").items()} == {"a.json": {"paper_id": "a", "n": 1, "t": "é"}, "b.json": {"paper_id": "b", "n": 2}}


def test_import_deletes_sources_after_the_commit(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "pdf"
    inbox.mkdir()
    for name, content in {"one.pdf": PDF + b"1", "two.pdf": PDF + b"2", "two-b.pdf": PDF + b"3", "page.pdf": b"<html>" + PDF, "free.pdf": PDF}.items():
        (inbox / name).write_bytes(content)
    matches = spark.createDataFrame([("one", "p1"), ("two", "p2"), ("two-b", "p2"), ("page", "p3"), ("free", None), ("lost", "p4")], "file string, candidate string")

    def files():
        return spark.read.format("binaryFile").load(str(inbox))

    saved = []

    def lost(rows):
        raise RuntimeError("manifest")

    with pytest.raises(RuntimeError, match="manifest"):
        commits.import_files(files(), matches, str(out), lost)
    assert len(list(inbox.iterdir())) == 5  # nothing goes before the manifest is saved
    done = commits.import_files(files(), matches, str(out), lambda rows: saved.extend(rows.collect()))
    assert done.count() == 2
    assert {x["paper_id"]: (x["status"], x["bytes"], x["source"]) for x in saved} == {"p1": ("ok", len(PDF) + 1, "manual"), "p2": ("ok", len(PDF) + 1, "manual")}
    two = max(f"file:{inbox}/two.pdf", f"file:{inbox}/two-b.pdf")
    assert _files(out) == {"p1.pdf": PDF + b"1", "p2.pdf": PDF + (b"2" if two.endswith("two.pdf") else b"3")}
    assert {p.name for p in inbox.iterdir()} == {"page.pdf", "free.pdf"}
    assert commits.import_files(files(), matches, str(out), lambda rows: None).count() == 0 and len(_files(out)) == 2
