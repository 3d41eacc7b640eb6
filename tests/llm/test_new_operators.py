"""Nearest neighbours, filter audit and timestamps against brute force, with the cases their docstrings define."""

import itertools
import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import duckdb
import numpy as np
import pytest

from quillspark.llm import chat_format, filter_audit, fingerprints, multi_index, queries, timestamps

VECTORS = "vec_id long, embedding array<double>, id int, vector string, first string, distance int"


def vector_rows(spark, rows):
    """Embeddings with columns whose names clash with those that the operator makes."""
    return spark.createDataFrame([(i, v, 1, "x", None, 0) for i, v in rows], VECTORS)


def brute_neighbours(rows, every, k):
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    lengths = [len(v) for _, v in kept]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    kept = [(i, v) for i, v in kept if len(v) == length]
    out = {}
    for q, a in kept:
        if q % every == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in kept if i != q)[:k]
            out |= {(q, n): (i, d) for n, (d, i) in enumerate(near, 1)}
    return out


def found(frame):
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in frame.collect()}


def test_all_cells_give_exact_neighbours_with_ties_and_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-1, 2, 5)]) for i in range(-50, 150)]
    rows += [(None, [1.0] * 5), (1000, None), (1010, [0.0] * 5), (1020, [1.0, None, 0.0, 0.0, 0.0]), (1030, [float("nan")] * 5), (1040, [float("inf")] + [0.0] * 4), (1050, []), (1060, [1.0, 2.0]), (7, [1.0] * 5), (7, [1.0] * 5)]
    got = found(multi_index.neighbours(vector_rows(spark, rows), every=10, k=10, share=1.0, centroids=4))
    expected = brute_neighbours(rows, 10, 10)
    assert got.keys() == expected.keys()
    assert all(got[x][0] == expected[x][0] and abs(got[x][1] - expected[x][1]) < 1e-12 for x in expected)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, None)], [(0, [1.0]), (1, [4.0])], [(0, [2.0, 0.0]), (5, [2.0, 0.0])]])
def test_few_vectors(spark, rows):
    assert found(multi_index.neighbours(vector_rows(spark, rows), every=100, k=10)) == brute_neighbours(rows, 100, 10)


def test_small_blocks_and_tiles_change_nothing(spark):
    r = np.random.default_rng(1)
    rows = multi_index.usable(vector_rows(spark, [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)] + [(i, [1.0] * 6) for i in range(400, 600)]))
    books = multi_index.fit_codebooks(rows, centroids=6)
    index = multi_index.build_index(rows, books)
    own = index.filter("id % 20 = 0").selectExpr("id AS query_id", "vector")
    whole = found(multi_index.search_index(index, books, own, 5, share=0.3, least=10))
    assert whole == found(multi_index.search_index(index, books, own, 5, share=0.3, least=10, block=16, tile=3))
    assert len(whole) == 30 * 5


def test_walk_goes_by_summed_distance():
    r = np.random.default_rng(3)
    first, second, counts = r.normal(size=9), r.normal(size=7), r.integers(0, 4, (9, 7))
    by_sum = sorted(((first[i] + second[j], i, j) for i in range(9) for j in range(7)))
    expected = [(i, j) for _, i, j in by_sum if counts[i, j]]
    assert multi_index.walk(first, second, counts, 10**9) == expected
    passed = multi_index.walk(first, second, counts, 20)
    assert passed == expected[: len(passed)] and sum(counts[c] for c in passed) >= 20 > sum(counts[c] for c in passed[:-1])


def test_recall_of_part_of_the_cells(spark):
    sf_dir = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = found(multi_index.neighbours(vectors, every=100, k=10, least=100))
    kept = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    expected = brute_neighbours(kept, 100, 10)
    queries_of = {q for q, _ in expected}
    hits = sum(len({got[q, n][0] for n in range(1, 11)} & {expected[q, n][0] for n in range(1, 11)}) for q in queries_of)
    assert hits >= 0.9 * 10 * len(queries_of)


# --- filter audit -------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, mask string, part int, n string, good string"


def audit_brute(docs, labels):
    """Filters applied one after the other to each part's documents, in each order."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    fails, parts = [], {}
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]})
        parts.setdefault(s or "", []).append(len(fails) - 1)
    out = []
    for part, own in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, x in enumerate(order, 1):
                gone = {i for i in left if fails[i][x]}
                all_failing = {i for i in own if fails[i][x]}
                left -= gone
                removed_by[x] += len(gone)
                only = sum(sum(fails[i].values()) == 1 for i in all_failing)
                rows.append((part, "".join(order), step, len(left), len(gone), len(all_failing - gone), only, sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)))
        out += [(*row, removed_by[row[1][row[2] - 1]]) for row in rows]
    return sorted(out)


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(d, t, s, "x", 1, "y", "z") for d, t, s in docs], DOCS)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.mask_counts(frame, said)).collect())


def test_audit_equals_filters_applied_in_order(spark):
    r = random.Random(4)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [long, long + " # A", "a b a b a b", "", None, " \t\x0b", "ABC def", long.upper(), "same " * 300, "é€\U0001f600 $", "x" * 5000]
    docs = [(i, r.choice(texts), r.choice(["s", "t", None, ""])) for i in range(120)]
    docs += [(None, long, "s"), (None, long, "s"), (3, "twice", "s"), (3, "twice", "t"), (2, "twice", "t"), docs[5], docs[5]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 100)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    assert audited(spark, docs, labels) == audit_brute(docs, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "A", "s"), (2, "A", "s")]
    assert audited(spark, docs, []) == audit_brute(docs, [])


def test_shapley_is_the_mean_over_orders():
    r = random.Random(2)
    counts = [r.randrange(50) for _ in range(32)]
    f = filter_audit.Removal(counts, 5)
    for i in range(5):
        total = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += f.corner(before | 1 << i) - f.corner(before)
        assert 120 * f.shapley(i) == total
    assert f.corner(31) == sum(counts) - counts[0] and f.corner(0) == 0


# --- timestamps ---------------------------------------------------------------------------------------------------

STAMPS = "stamp_id long, source string, zone string, raw string, wall string, offset int, salt int, rule int"
EPOCH = datetime(1970, 1, 1)
FORM = re.compile(
    r"(?:(?P<y1>20[0-9]{2})-(?P<m1>[0-9]{2})-(?P<d1>[0-9]{2})|(?P<y2>20[0-9]{2})(?P<m2>[0-9]{2})(?P<d2>[0-9]{2})|(?P<d3>[0-9]{2})[.](?P<m3>[0-9]{2})[.](?P<y3>20[0-9]{2})"
    r"|(?P<d4>[0-9]{2}) (?P<b>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (?P<y4>20[0-9]{2})|(?P<a>[0-9]{2})/(?P<c>[0-9]{2})/(?P<y5>20[0-9]{2}))"
    r"(?:[T ](?P<h>[0-9]{2}):(?P<m>[0-9]{2})(?::(?P<s>[0-9]{2}))?(?: ?(?P<p>[AP]M))?(?: ?(?P<o>Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
)


def read_stamp(raw):
    """(epoch us, wall times by order, offset minutes or None), or None."""
    raw = None if raw is None else raw.strip(" \t\n\x0b\x0c\r")
    if raw is None:
        return None
    if re.fullmatch("[0-9]{10}|[0-9]{13}", raw):
        return int(raw) * (1_000_000 if len(raw) == 10 else 1000), {}, None
    g = FORM.fullmatch(raw)
    if not g:
        return None
    g = g.groupdict()
    h, m, s = int(g["h"] or 0), int(g["m"] or 0), int(g["s"] or 0)
    if g["p"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["p"] == "PM" else 0)
    offset = None
    if g["o"]:
        digits = re.sub("[^0-9]", "", g["o"])
        offset = 0 if g["o"] == "Z" else (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if g["o"][0] == "-" else 1)
        if digits and (int(digits[:2]) > 14 or int(digits[2:]) > 59):
            return None
    if h > 23 or m > 59 or s > 59:
        return None
    if g["a"]:
        dates = {"day": (g["y5"], g["c"], g["a"]), "month": (g["y5"], g["a"], g["c"])}
    elif g["b"]:
        dates = {"one": (g["y4"], timestamps.MONTHS.index(g["b"]) + 1, g["d4"])}
    else:
        n = next(i for i in "123" if g[f"y{i}"])
        dates = {"one": (g[f"y{n}"], g[f"m{n}"], g[f"d{n}"])}
    walls = {}
    for order, date in dates.items():
        try:
            walls[order] = datetime(*map(int, date), h, m, s)
        except ValueError:
            pass
    return (None, walls, offset) if walls else None


def in_zone(wall, zone):
    """(us, whether the zone skips or repeats the wall time), by the two folds of the standard library."""
    z = ZoneInfo(zone)
    a, b = (wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
    return (wall - b - EPOCH) // timedelta(microseconds=1), a != b


def stamps_brute(rows):
    known = {"UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia"}
    read, counts = [], {}
    for _, source, zone, raw in rows:
        x = read_stamp(raw)
        if x and x[0] is None and x[2] is None and zone not in known:
            x = None
        read.append(x)
        if x and len(x[1]) == 1 and "one" not in x[1]:
            counts.setdefault(source, {"day": 0, "month": 0})[next(iter(x[1]))] += 1
    out = []
    for (i, source, zone, _), x in zip(rows, read, strict=True):
        if x is None:
            out.append((i, None, "bad", False))
            continue
        epoch, walls, offset = x
        if epoch is not None:
            out.append((i, epoch, "epoch", False))
            continue
        rule, order = "plain", next(iter(walls))
        if len(set(walls.values())) == 2:
            n = counts.get(source, {"day": 0, "month": 0})
            order = "day" if n["day"] > 10 * n["month"] else "month" if n["month"] > 10 * n["day"] else None
            rule, order = ("votes", order) if order else ("default", "day")
        # The standard library's second fold of a gap takes the offset after the change, as here.
        us, odd = ((walls[order] - EPOCH) // timedelta(microseconds=1) - offset * 60_000_000, False) if offset is not None else in_zone(walls[order], zone)
        out.append((i, us, rule, rule != "plain" or odd))
    return out


def normalised(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], STAMPS)
    return [tuple(r) for r in timestamps.normalise(frame).collect()]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def test_stamps_equal_plain_parsing(spark):
    r = random.Random(8)
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", None, "Nowhere/Else"]
    dates = ["2024-03-10", "20240310", "10.03.2024", "10 Mar 2024", "03/10/2024", "10/03/2024", "31/03/2024", "03/31/2024", "27.10.2024", "2024-11-03", "2023-02-29", "2024-02-29", "30/02/2024", "2024-00-10", "11/11/2024", "2099-06-01", "2000-01-01", "10 mar 2024", "1999-01-01"]
    times = ["", "T02:30", " 02:30:15", " 01:59 AM", " 12:00AM", "T12:30 PM", " 13:00 PM", "T24:00", " 23:60", "T02:30Z", " 02:30 +05:30", "T02:30:00-0800", " 02:30 PM Z", "T02:30+15:00", "T02:30+14:59", " 00:30 AM", " 02:30 ", "\x0b", " 1:30", "T02:30:61", "  02:30", " "]
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice(zones), r.choice(["", " ", "\t"]) + r.choice(dates) + r.choice(times)) for i in range(1500)]
    odd = [None, "", " ", "1710037195", "1710037195420", "0000000000", "171003719", "17100371954201", "n/a", "2024-04", "03/25/2", "٢٠٢٤-01-01", "2024-01-01\n", "x" * 100_000, "12:00", "2024-01-01T10:00 GMT"]
    rows += [(2000 + i, "d", r.choice(zones), raw) for i, raw in enumerate(odd)] + [(None, "d", "UTC", "2024-01-01"), (None, "d", "UTC", "2024-01-01"), rows[0], rows[0]]
    assert same(normalised(spark, rows), stamps_brute(rows))
    assert normalised(spark, []) == []


@pytest.mark.parametrize(("votes", "rule"), [((11, 1), "votes"), ((10, 1), "default"), ((0, 0), "default"), ((0, 1), "votes"), ((1, 11), "votes"), ((1, 0), "votes")])
def test_votes(spark, votes, rule):
    rows = [(i, "s", "UTC", "25/12/2024") for i in range(votes[0])] + [(100 + i, "s", "UTC", "12/25/2024") for i in range(votes[1])]
    rows += [(200, "s", "UTC", "01/02/2024"), (201, "s", "UTC", "02/02/2024"), (202, "other", "UTC", "01/02/2024")]
    rows += [(300, "s", "UTC", "12/25/2024 24:00"), (301, "s", "Nowhere", "12/25/2024")]  # bad ones don't vote
    got = normalised(spark, rows)
    assert same(got, stamps_brute(rows))
    assert next(x for x in got if x[0] == 200)[2] == rule


def test_every_hour_of_changes_and_a_skipped_day(spark):
    starts = {"America/New_York": ["2024-03-10", "2024-11-03"], "Europe/Berlin": ["2024-03-31", "2024-10-27"], "Australia/Lord_Howe": ["2024-04-07", "2024-10-06"], "Pacific/Apia": ["2011-12-29", "2011-12-30", "2011-12-31"]}
    rows = []
    for zone, days in starts.items():
        for day in days:
            rows += [(len(rows) + m, "s", zone, f"{day} {m // 4:02}:{m % 4 * 15:02}") for m in range(96)]
    assert same(normalised(spark, rows), stamps_brute(rows))


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_timestamps"])
def test_sql_of_the_larger_table(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "stamps"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    got = {tuple(r) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    columns = ", ".join(queries.QUERIES[name](spark, "/root/testdata/sf0.01").columns)
    assert got == set(duck.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_instants_are_aware():
    assert in_zone(datetime(2024, 3, 10, 2, 30), "America/New_York") == (int(datetime(2024, 3, 10, 6, 30, tzinfo=timezone.utc).timestamp()) * 1_000_000, True)


# --- stored and hot rows of earlier operators ---------------------------------------------------------------------


def test_stored_segments_give_the_same_examples(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant"]), f"c{c} t{t} </turn> \\ ### x") for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(None, t, "assistant", f"alone {t}") for t in range(20)]
    r.shuffle(rows)
    segments = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments.orderBy("segment").repartition(5).write.parquet(f"{tmp_path}/segments")
    stored = spark.read.parquet(f"{tmp_path}/segments")
    assert stored.rdd.getNumPartitions() > 1

    def all_of(frame):
        return sorted((tuple(x) for x in frame.collect()), key=str)

    for f in (chat_format.read_back, chat_format.expand):
        assert all_of(f(stored)) == all_of(f(segments))
    for conv in range(40):
        own = sorted((t, role, text) for c, t, role, text in rows if c == conv)
        for e in (x for x in chat_format.expand(stored).collect() if x.conv_id == conv):
            turns = [chat_format.parse_segment(s + "</turn>\n") for s in e.text.split("</turn>\n")[:-1]]
            assert turns == [(role, text) for _, role, text in own[: len(turns)]]
    alone = [x for x in chat_format.read_back(stored).collect() if x.conv_id is None]
    assert sorted((x.n_turns, x.loss_chars) for x in alone) == sorted((1, len(f"alone {t}")) for t in range(20))


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_DOCS", 50)
    texts = [f"the same beginning of text {k}" for k in range(3000)]
    rows = [(None, t) for t in texts[:1000]] + [(7, t) for t in texts[1000:2000]] + [(8 + k, t) for k, t in enumerate(texts[2000:])] + [(None, "equal")] * 40
    out = fingerprints.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    sizes = out.groupBy(fingerprints.F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < len(rows) / 2
    # The edited texts are those of the whole order: ids, then first bytes, then the hash.
    order = [tuple(x) for x in spark.createDataFrame(rows, "doc_id long, text string").orderBy(fingerprints.F.col("doc_id").asc_nulls_first(), fingerprints._text_order(fingerprints.F.col("text")), "text").collect()]
    expected = [(i, fingerprints.edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order)]
    assert sorted((str(r.doc_id), r.edited_text) for r in out.collect()) == sorted((str(i), t) for i, t in expected)


def test_blocks_are_in_order():
    cuts, inner = np.array([3, 7, 9]), {3: np.array([10, 20]), 9: np.array([5])}
    blocks = fingerprints.Blocks(cuts, inner)
    r = random.Random(3)
    rows = sorted((r.randrange(12), r.randrange(30)) for _ in range(400))
    numbers = blocks.of(np.array([a for a, _ in rows]), np.array([v for _, v in rows])).tolist()
    assert numbers == sorted(numbers) and max(numbers) == blocks.number - 1 and len(set(numbers)) == blocks.number
    assert len({n for (a, _), n in zip(rows, numbers) if a == 3}) == 3 and len({n for (a, _), n in zip(rows, numbers) if a == 7}) == 1


def test_examples_are_written_out_by_parts_and_read_back(spark, monkeypatch):
    """Each assistant turn's example holds all turns before it, also where a conversation's examples are several tasks'."""
    monkeypatch.setattr(chat_format, "PART_CHARS", 400)
    rows = [(c, t, "assistant" if t % 2 else "user", f"c{c} t{t} </turn> \\ ###") for c, n in ((1, 31), (2, 30), (3, 1)) for t in range(n)] + [(None, 0, "user", "alone")]
    segments = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert segments.agg({"last_part": "max"}).first()[0] > 9
    written = chat_format.expand(segments, rest=True)
    got = {(x.conv_id, x.example): x for x in written.collect()}
    assert len(got) == written.count() and got.keys() == {(1, e) for e in range(16)} | {(2, e) for e in range(15)} | {(3, 0), (None, 0)}
    for (conv, e), x in got.items():
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [chat_format.parse_segment(s + "</turn>\n") for s in x.text.split("</turn>\n")[:-1]] == own[: 2 * e + 2]
        assert x.loss_start is None if 2 * e + 1 >= len(own) else chat_format.unescape(x.text[x.loss_start : x.loss_end]) == own[2 * e + 1][1]
    assert sorted((str(x.conv_id), x.n_turns, x.formatted_chars) for x in chat_format.read_examples(written).collect()) == [("1", 31, len(got[1, 15].text)), ("2", 30, len(got[2, 14].text)), ("3", 1, len(got[3, 0].text)), ("None", 1, len(got[None, 0].text))]
    for spoilt in (written.filter("conv_id IS NULL OR conv_id <> 1 OR example <> 4"), written.selectExpr("conv_id", "example", "if(conv_id = 2 AND example = 9, substr(text, instr(text, '</turn>') + 8), text) AS text", "loss_start", "loss_end")):
        with pytest.raises(Exception, match="ValueError"):
            chat_format.read_examples(spoilt).collect()
