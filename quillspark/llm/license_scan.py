"""License scans by an exact set-similarity join of text blocks with notice templates.

Tokens of the templates are ordered by their frequency in the whole corpus, rarest first. A block that holds the
wanted share of a template must hold one of the template's first tokens (prefix filter), enough tokens (length
filter), and enough of them after the match in this order (positional filter); what is left is verified. The blocks
of a template of n words are runs of 2 n words at every n-th word, so that each run of n words is inside one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytewords as bw
from quillspark.llm.frames import python_workers

# Phrases that name a license by themselves, and the wordings of notices as the licenses give them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache", "Licensed under the Apache License Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
)


def _words_of(text: str) -> np.ndarray:
    data, offsets = bw.column_bytes(pa.array([text]))
    return bw.Words(data, offsets, 0, 1, bw.NOT_ALNUM).hash


class _Templates:
    """Templates as token numbers, ordered by corpus frequency once that is known."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        words = [_words_of(text) for _, text in templates]
        if any(not len(w) for w in words):
            raise ValueError("a template without words")
        self.labels = [label for label, _ in templates]
        self.lengths = [len(w) for w in words]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.tokens = [np.searchsorted(self.vocabulary, np.unique(w)) for w in words]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of template tokens among words, and their numbers."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        places = np.flatnonzero(self.vocabulary[at] == hashes)
        return places, at[places]


def _frequencies(templates: _Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            for a, b in bw.blocks(offsets):
                total += np.bincount(templates.find(bw.Words(data, offsets, a, b, bw.NOT_ALNUM).hash)[1], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"token": pa.array(np.arange(len(total))), "n": pa.array(total)})

    return run


def _blocks_of(t: _Templates, rank: np.ndarray, need: list[int], places: np.ndarray, tokens: np.ndarray, n_words: int) -> dict[str, float]:
    """The best containment for each label whose template some block contains well enough. rank: by frequency."""
    found: dict[str, float] = {}
    ranks = rank[tokens]
    for label, length, own, least in zip(t.labels, t.lengths, t.tokens, need, strict=True):
        order = np.sort(rank[own])
        prefix = order[: len(order) - least + 1]
        starts = places[np.isin(ranks, prefix)]
        for k in np.unique(np.concatenate([starts // length, starts // length - 1])):
            if k < 0:
                continue
            first, last = k * length, min((k + 2) * length, n_words)
            if last - first < least:  # length filter
                continue
            block = np.unique(ranks[np.searchsorted(places, first) : np.searchsorted(places, last)])
            if len(block) < least:
                continue
            match = np.intersect1d(block, prefix, assume_unique=True)
            if not len(match):
                continue
            i, j = np.searchsorted(order, match[0]), np.searchsorted(block, match[0])
            if 1 + min(len(order) - i - 1, len(block) - j - 1) < least:  # positional filter
                continue
            shared = len(np.intersect1d(order, block, assume_unique=True))
            if shared >= least:
                found[label] = max(found.get(label, 0.0), shared / len(order))
    return found


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text, ...).

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lowered. n_base counts
    the places where a phrase stands word by word, first_word and last_word are the least and greatest of their
    starts, base_labels the phrases' labels. labels adds those of templates of whose distinct words a block holds at
    least `share`; score is the best such containment, and 1 where a phrase stands; 0 without labels. Null and empty
    texts have no words. Null doc_ids and repeated rows are kept; other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    python_workers(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = _Templates(templates)
    counted = source.select("text").mapInArrow(_frequencies(t), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row a token
    total = np.zeros(len(t.vocabulary), np.int64)
    for row in counted:
        total[row["token"]] = row["n"]
    rank = np.empty(len(total), np.int64)
    rank[np.lexsort((np.arange(len(total)), total))] = np.arange(len(total))
    need = [max(1, int(np.ceil(round(share * len(own), 9)))) for own in t.tokens]
    named = [(_words_of(p), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            data, offsets = bw.column_bytes(batch.column("text"))
            for a, b in bw.blocks(offsets):
                w = bw.Words(data, offsets, a, b, bw.NOT_ALNUM)
                places, tokens = t.find(w.hash)
                bounds = np.searchsorted(places, w.first)
                last_words = [(np.flatnonzero(w.hash == p[-1]), p, label) for p, label in named]
                for k in range(b - a):
                    first, end = int(w.first[k]), int(w.first[k + 1])
                    at: list[int] = []
                    base: set[str] = set()
                    for ends, p, label in last_words:
                        for e in ends[np.searchsorted(ends, first) : np.searchsorted(ends, end)]:
                            s = int(e) - len(p) + 1
                            if s >= first and (w.hash[s : s + len(p)] == p).all():
                                at.append(s - first)
                                base.add(label)
                    here = slice(bounds[k], bounds[k + 1])
                    found = _blocks_of(t, rank, need, places[here] - first, tokens[here], end - first) if bounds[k + 1] > bounds[k] else {}
                    score = 1.0 if base else max(found.values(), default=0.0)
                    rows.append((end - first, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
