"""Operators that SQL cannot express, and the pipeline, against plain versions of what they promise."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_components, brute_lines, docs, rows_of, words

import corpus_pipeline
from quillspark.llm import bytewords as bw
from quillspark.llm import decontaminate, fingerprints, license_scan, packing, quality, queries

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se") for b in ("ten", "dor", "vil")]


def template(text):
    return ["0" if x.isdigit() else x for x in text.split()]


def windows(text, size=5):
    t = template(text)
    return {tuple(t[k : k + size]) for k in range(len(t) - size + 1)}


def test_leaks_equal_window_counts(spark):
    """Lower-case words and numbers; without the slot check an item leaks by its share of windows alone."""
    r = random.Random(21)

    def text(n):
        return " ".join(r.choice(WORDS) if r.random() < 0.9 else str(r.randrange(100)) for _ in range(n))

    items = [(k, text(r.randrange(6, 30))) for k in range(25)]
    rows = []
    for k in range(150):
        own = r.choice(items)[1].split()
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = r.choice([*WORDS, "77"])
        rows.append((k, f"{text(r.randrange(40))} {' '.join(own)} {text(r.randrange(40))}"))
    expected = {}
    for i, t in rows:
        for j, u in items:
            wanted = windows(u)
            found = len(wanted & windows(t))
            if found >= 0.8 * len(wanted):
                expected[i, j] = (len(wanted), found)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_windows, x.n_found) for x in decontaminate.leaks(docs(spark, rows), bench, agreement=0.0).collect()}
    assert got == expected and 30 < len(expected) < 150 * 25


def test_anchors_lose_no_leak(spark, monkeypatch):
    """Names, units, numbers, opened sentences, odd letters: the same leaks as if every document were a candidate."""
    r = random.Random(22)
    parts = [*WORDS[:8], "Anna", "Ben", "The", "the", "12", "3,5", "km", "hours", "km.", "ΟΔΟΣ", "İl", "élan", "Élan", "(see", "2)", "x-y", "--", "it."]
    items = [(k, " ".join(r.choice(parts) for _ in range(r.randrange(1, 16)))) for k in range(60)] + [(70, "Anna Ben Carla Dora Emil Fred"), (71, "4 8 15 16 23 42")]
    names = {"Anna": "Carla", "Ben": "Otto", "12": "97", "3,5": "8", "km": "hours", "the": "The"}
    rows = []
    for k in range(120):
        own = [names.get(x, x) if r.random() < 0.5 else x for x in r.choice(items)[1].split()]
        around = [" ".join(r.choice(parts) for _ in range(r.randrange(10))) for _ in range(2)]
        rows.append((k, f"{around[0]} {' '.join(own)}{r.choice(['', '.', ')', chr(10)])} {around[1]}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.leaks(docs(spark, rows), bench).collect())
    monkeypatch.setattr(decontaminate, "_candidates", lambda texts, wanted, share: (texts.select("doc_id").distinct(), wanted.select("item_id").limit(0)))
    assert got == sorted(tuple(x) for x in decontaminate.leaks(docs(spark, rows), bench).collect()) and len(got) > 40


def test_base_columns_of_licenses(spark):
    r = random.Random(23)
    parts = ["MIT", "mit", "License", "license", "LICENSE,", "apache", "Apache-", "general", "public", "\n", " ", "-", "é", "mité", "licenses", "the"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randrange(25))) for _ in range(400)]
    got = rows_of(license_scan.scan_licenses(docs(spark, list(enumerate(texts)))))
    for i, text in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert got[i][1:6] == (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), text


def test_samples_equal_plain_loops():
    sampler = fingerprints.Sampler()
    for k in range(6):
        text = " ".join(words(80, 40 + k, 25))
        data, offsets = bw.column_bytes(pa.array([text]))
        hashes, counts = np.unique(bw.Words(data, offsets, 0, 1, bw.SPACE).hash, return_counts=True)
        expected = []
        for s in range(fingerprints.SAMPLES):
            best = None
            for h, n in zip(hashes.tolist(), counts.tolist(), strict=True):
                i, j = h & 4095, h >> 20 & 4095
                r = np.float32(sampler.exponential[0][i, s] + sampler.exponential[1][j, s] + np.float32(1e-6))
                c = np.log(np.float32(sampler.exponential[2][i, s] + sampler.exponential[3][j, s] + np.float32(1e-12)))
                beta = np.float32(sampler.uniform[0][i, s] + sampler.uniform[1][j, s])
                beta -= np.floor(beta)
                level = np.floor(np.log(np.float32(n)) / r + beta)
                score = c - r * (level - beta + np.float32(1))
                if best is None or score < best[0]:
                    best = (score, h, int(level))
            with np.errstate(over="ignore"):
                name = bw._mix(np.array([best[1]], np.uint64) + np.array([best[2]], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            expected.append(int(name[0]) >> 48)
        got = np.frombuffer(bytes.fromhex(fingerprints.fingerprint([text])[0]), ">u2").tolist()
        assert sum(a != b for a, b in zip(got, expected, strict=True)) <= 1, k  # scalar and vector logarithms may differ in the last place


def test_packing_under_every_capacity(spark):
    r = random.Random(24)
    rows = [(k, 0, r.randrange(1, 60)) for k in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    packed = packing.pack(pieces, max_tokens=100, max_documents=4, max_attention=4000, weights=(1.0, 0.1, 0.1)).collect()
    bins = {}
    for p in packed:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted((p.doc_id, p.piece, p.length) for p in packed) == rows
    for b in bins.values():
        assert len(b) <= 4 and sum(n * n for _, n in b) <= 4000 and sorted(b)[0][0] == 0
        assert all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:], strict=False)) and sum(n for _, n in b) <= 100
    assert {len(b) for b in bins.values()} & {4} and max(sum(n * n for _, n in b) for b in bins.values()) > 3500


def brute_pipeline(rows, items, labels, spark):
    """Documents that the first four stages leave, by plain code: (doc_id, text)."""
    labelled = spark.createDataFrame([x for x in labels], "doc_id long, quality int")
    model = quality.train_quality(docs(spark, rows), labelled.filter(~queries.held_out()))
    features = list(quality.Indicators().of_column(pa.array([t for _, t in rows], pa.string())))
    rows = [x for x, f in zip(rows, features, strict=True) if model.score(f) >= queries.QUALITY_THRESHOLD]
    rows = [(i, t) for i, _, _, t in brute_lines(rows)]
    groups = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    leaks = {i for i, t in rows for u in items if t and len(windows(t) & windows(u)) >= 0.8 * len(windows(u))}
    return sorted((i, t) for i, t in rows if i not in leaks)


def test_pipeline_equals_plain_stages(spark, tmp_path, tokenizer):
    r = random.Random(25)

    def good(n):
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n)) + "."

    line = "this line recurs in many of the documents and is long enough"
    texts = [good(r.randrange(30, 120)) for _ in range(90)]
    texts += [f"{good(40)}\n{line}\n{good(30)}" for _ in range(8)]
    texts += ["$$ !!! WIN ### " * r.randrange(5, 30) for _ in range(40)]
    texts += [texts[3], texts[4], texts[3]]
    for k in (5, 6, 7):
        own = texts[k].split()
        own[len(own) // 2] = "edit"
        texts.append(" ".join(own))
    items = [good(20).rstrip(".") for _ in range(5)]
    texts += [f"{good(30)} {items[0]} {good(20)}", f"{items[1]}", f"{good(9)} {' '.join(items[2].split()[:9])} {good(30)}"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    labels = [(k, int("!!!" not in t)) for k, t in rows if k % 3]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = brute_pipeline(rows, items, labels, spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {i for i, _ in expected} and len(expected) < len(rows) - 40
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    length = {}
    for p in got:
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
    assert length == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected}


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_notices_have_their_own_labels(spark):
    """The whole notice of each license, among other words, gets its label and no other license's."""
    rows = [(k, f"{' '.join(words(30, k))}\n{text}\n{' '.join(words(30, 99 + k))}") for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = rows_of(license_scan.scan_licenses(docs(spark, rows)))
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        assert got[k][6] == label, license_scan.TEMPLATES[k]
