"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

A piece's demand (tokens, one document, attention cost length ** 2) depends on its length alone, so the corpus is
packed as a histogram: the driver sees one count for each length up to the sequence length, however many rows there
are, and packs whole classes of equal bins at once. The plan it returns is a table of intervals: the pieces of one
length, numbered, fall into runs that go to consecutive bins. Texts and ids are never shuffled; numbering the pieces
shuffles one narrow row a piece, salted so that one very common length is spread over many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.frames import python_workers, unused

#: Entries of a Python worker's memory of encoded words.
REMEMBERED = 50_000
#: Characters that are looked up together.
BLOCK_CHARS = 1 << 20
#: Places of the hash table of merges, a power of two far above their number.
_PLACES = 1 << 19
#: Characters for which the library's normaliser and pre-tokeniser are a plain lower-casing and splitting.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~¡-¬®-įı-ſ‐-‧]*")
_LETTER, _NUMBER = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+|\n")


class BatchMerges:
    """Byte-pair merges of many words at once: in every round, each word merges its leftmost pair of the least rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.inner = np.array([vocabulary[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[names[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[x] << 20 | vocabulary[y] for x, y in pairs], np.int64)
        # An open hash table of pairs: a pair lies at its hash or a few places after it.
        self.table, self.ranks = np.full(_PLACES + 64, -1, np.int64), np.full(_PLACES + 64, len(pairs), np.int64)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = self.table[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.table[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], at[rest] + 1
        self.made = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        self.never = len(pairs)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PLACES.bit_length() + 1)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = self._place(key)
        held = self.table[at]
        out = np.where(held == key, self.ranks[at], self.never)
        going = np.flatnonzero((held != key) & (held != -1))
        while len(going):
            at[going] += 1
            held = self.table[at[going]]
            same = held == key[going]
            out[going[same]] = self.ranks[at[going[same]]]
            going = going[~same & (held != -1)]
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word; no word is empty."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        rank = np.full(len(symbol), self.never)  # of a symbol with the next
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(symbol))
            ready = np.repeat(least == self.never, sizes)
            if ready.any():
                done.append((word[ready], symbol[ready]))
                symbol, word, rank = symbol[~ready], word[~ready], rank[~ready]
                going = least < self.never
                least, sizes = least[going], sizes[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbol[at] = self.made[rank[at]]
            rest = np.ones(len(symbol), bool)
            rest[at + 1] = False
            at = at - np.arange(len(at))  # places once the merged symbols are gone
            symbol, word, rank = symbol[rest], word[rest], rank[rest]
            before = at[(at > 0) & (word[at - 1] == word[at])] - 1
            after = at[at + 1 < len(word)]
            after = after[word[after] == word[after + 1]]
            rank[at] = self.never
            for k in (before, after):
                rank[k] = self._rank(symbol[k], symbol[k + 1])
        owner = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([x for _, x in done])[order].astype("<u4").tobytes() if done else b""
        cuts = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [ids[x:y] for x, y in zip([0, *cuts], cuts)]


class WordTokenizer:
    """Ids of whole texts by a BPE tokeniser that drops white space, with a memory of encoded words.

    White-space-separated chunks are encoded once and remembered, new words of a batch all at once. Texts with
    characters outside common Latin, and any text that may hold a special token, are left to the library as a whole;
    so are all texts if the file's normaliser, pre-tokeniser or model is not of the known kind.
    """

    def __init__(self, source: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        own = json.loads(source)
        parts = (own.get("pre_tokenizer") or {}).get("pretokenizers", [])
        steps = [x["type"] for x in (own.get("normalizer") or {}).get("normalizers", [])]
        model = own["model"]
        self.known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["dropout"] and not model.get("ignore_merges")
        self.special = tuple(x["content"] for x in own.get("added_tokens", []))
        if self.known:
            self.merges = BatchMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, listed: list[str]) -> None:
        if not listed:
            return
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts = _SPLIT.findall("\n".join(listed))
        fresh = list(set(parts) - self.words.keys() - {"\n"})
        for a in range(0, len(fresh), 50_000):
            self.words.update(zip(fresh[a : a + 50_000], self.merges(fresh[a : a + 50_000]), strict=True))
        # The ids of all chunks in one string, cut at the line feeds between them.
        self.words["\n"] = b"\xff\xff\xff\xff"
        joined = np.frombuffer(b"".join(map(self.words.__getitem__, parts)), "<u4")
        cuts = (4 * np.append(np.flatnonzero(joined == 0xFFFFFFFF), len(joined))).tolist()
        whole = joined.tobytes()
        start = 0
        for chunk, cut in zip(listed, cuts, strict=True):
            self.chunks[chunk] = whole[start:cut]
            start = cut + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.known and _PLAIN.fullmatch(x) is not None and not any(t in x for t in self.special) for x in texts]
        own = self._in_blocks([x for x, p in zip(texts, plain, strict=True) if p])
        # The library's results are many times as large as the ids, so only one is held.
        out = [next(own) if p else np.array(self.whole.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4").tobytes() for x, p in zip(texts, plain, strict=True)]
        next(own, None)
        return out

    def _in_blocks(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts, by blocks of BLOCK_CHARS or of one text, so that what is held beside the ids stays small."""
        first, size = 0, 0
        for k, x in enumerate(texts):
            if k > first and size + len(x) > BLOCK_CHARS:
                yield from self._encode_plain(texts[first:k])
                first, size = k, 0
            size += len(x)
        yield from self._encode_plain(texts[first:])

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Each different chunk of the batch is looked up once; a text's ids are gathered from those of its chunks."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        encoded = pc.list_flatten(lists).dictionary_encode()
        # Chunks hold no line feeds: one string of all of them is split much faster than each is made.
        listed = pc.binary_join(pa.ListArray.from_arrays([0, len(encoded.dictionary)], encoded.dictionary.cast(pa.string())), "\n")[0].as_py().split("\n") if len(encoded.dictionary) else []
        code = encoded.indices.to_numpy(zero_copy_only=False)
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        self.chunks[""] = b""  # before white space that begins a text, and after white space that ends it
        known = list(map(self.chunks.get, listed))
        self._learn([x for x, ids in zip(listed, known, strict=True) if ids is None])
        known = [self.chunks[x] if ids is None else ids for x, ids in zip(listed, known, strict=True)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        many = sizes[code]
        ends = np.append(0, np.cumsum(many))
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], many)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(known), "<u4")[place].tobytes()
        cuts = (4 * ends[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]).tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs(doc_id, text, ...): ids are little-endian unsigned 32-bit, as binary.

    A document is its ids followed by end_id, cut after every max_tokens. A null or empty text is end_id alone. Null
    doc_ids and repeated rows are kept as they are; other columns are ignored; no rows give no pieces. tokenizer is
    the path of a tokenizer file that the driver can read; its content is broadcast (a few MB).
    """
    spark = docs.sparkSession
    python_workers(spark)
    with open(tokenizer, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(source.value)
        if key not in _tokenizers:
            _tokenizers[key] = WordTokenizer(source.value)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc, piece, ids = [], [], []
            for d, x in zip(batch.column("doc_id").to_pylist(), _tokenizers[key].encode(texts), strict=True):
                x += end
                for k in range(0, len(x), step):
                    doc.append(d)
                    piece.append(k // step)
                    ids.append(x[k : k + step])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array([p * max_tokens for p in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    source_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source_rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], select: str) -> tuple[np.ndarray, int]:
    """Intervals (length, first number, copies in a bin, first bin, offset) sorted by length and number, and the bins used.

    Best-fit decreasing over (tokens, documents, attention cost): of the open bins in which a piece fits in every
    dimension, it goes to the one with the least weighted norm of what is left afterwards (select="norm") or the
    greatest weighted dot product of demand and residue (select="dot"). Bins with the same content are one class.
    """
    if select not in ("norm", "dot"):
        raise ValueError(f"select: {select}")
    cap, w = np.array(capacity, np.float64), np.array(weights, np.float64)
    left, many, inside = np.zeros((64, 3)), np.zeros(64, np.int64), []

    def add(residue: np.ndarray, bins: int, content: list[tuple[int, int]]) -> None:
        nonlocal left, many
        if len(inside) == len(many):
            left, many = np.vstack([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
        left[len(inside)], many[len(inside)] = residue, bins
        inside.append(content)

    for length in sorted(counts, reverse=True):
        todo, need = counts[length], np.array([length, 1, length * length], np.float64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens does not fit into an empty sequence")
        while todo:
            n = len(inside)
            fits = np.flatnonzero((many[:n] > 0) & (left[:n] >= need).all(axis=1))
            if len(fits):
                rest = left[fits]
                score = (((rest - need) / cap) ** 2 * w).sum(axis=1) if select == "norm" else -((rest / cap) * (need / cap) * w).sum(axis=1)
                best = int(fits[np.argmin(score)])
                residue, bins, content = left[best].copy(), int(many[best]), inside[best]
            else:
                best, residue, bins, content = -1, cap, todo, []
            copies = min(int((residue // need).min()), todo)
            used = min(bins, todo // copies)
            if best >= 0:
                many[best] -= used
            add(residue - copies * need, used, [*content, (length, copies)])
            todo -= used * copies
    rows, base, seen = [], 0, dict.fromkeys(counts, 0)
    for content, bins in zip(inside, many[: len(inside)].tolist(), strict=True):
        if not bins:
            continue
        offset = 0
        for length, copies in content:
            rows.append((length, seen[length], copies, base, offset))
            seen[length] += copies * bins
            offset += length * copies
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5), base


def pack(pieces: DataFrame, max_tokens: int = 4096, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), select: str = "norm") -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset added; columns of these names are replaced.

    Lengths are 1 to max_tokens. max_documents bounds the pieces of a sequence, max_attention the sum of their squared
    lengths. Without them these two capacities are max_tokens and its square, which no sequence can exceed: then only
    the tokens are bounded.
    A sequence is gapless from offset 0. All pieces of all rows are packed, repeated rows too; null doc_ids count as
    values like any other. An empty table gives an empty result. pieces is read twice: cut its lineage before.
    """
    spark = pieces.sparkSession
    python_workers(spark)
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    intervals, _ = plan_bins(counts, capacity, weights, select)
    plan = spark.sparkContext.broadcast(intervals)  # a few rows for each length

    salts = max(16, -(-max(counts.values(), default=0) // 50_000))
    pieces = pieces.drop("sequence_id", "offset")
    salt, rank, earlier = unused(pieces, "_salt", "_rank", "_before")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", salt).agg(F.count("*").alias("n")).select("length", salt, F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias(earlier))
    numbered = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece")))
    numbered = numbered.join(before, ["length", salt]).withColumn(rank, F.col(rank) - 1 + F.col(earlier)).drop(salt, earlier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        starts = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            row = table[np.searchsorted(starts, length * (1 << 48) + place, "right") - 1]
            t = place - row[:, 1]
            kept = [x for x in batch.schema.names if x != rank]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(row[:, 3] + t // row[:, 2]), pa.array(row[:, 4] + t % row[:, 2] * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != rank)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")
