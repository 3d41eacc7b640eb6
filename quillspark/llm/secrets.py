"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns are tried only there, checksums validate.

A pattern of a kind can only begin at one of its keywords, so trying it at the keywords from left to right, and not
inside the match before, gives the leftmost non-overlapping matches of the pattern over the whole text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import python_workers

# Kinds with their keywords, patterns and least lengths.
_ANY_CASE = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _ANY_CASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[opusr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(payload: str) -> str:
    """The CRC-32 of an ASCII string in six base-62 digits, as access tokens carry it at their end."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if k % 2 == 0 else (2 * d - 9 * (d > 4))
    return total % 10 == 0


def _is_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


#: Kind, keywords (lower case), pattern, distance from the keyword at which it may begin, validation.
_Kind = tuple[str, tuple[str, ...], re.Pattern, int, Callable[[re.Match], bool]]
KINDS: tuple[_Kind, ...] = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, 0, lambda m: len(m[2]) >= 8),
    ("access", ("akia",), ACCESS, 0, lambda m: len(m[0]) >= 16),
    ("hex", (), HEX, 0, lambda m: len(m[0]) >= 32),
    ("checked", ("gho_", "ghp_", "ghu_", "ghs_", "ghr_", "npm_"), CHECKED, 0, lambda m: crc_base62(m[1]) == m[2]),
    ("jwt", ("eyj",), JWT, 0, lambda m: _is_header(m[1])),
    ("card", ("card", "visa", "mastercard", "amex"), CARD, 24, lambda m: luhn(m[0])),
)
#: What a pattern cannot begin in once it has failed at the beginning of it; so no run is read again at each keyword in it.
_RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?|[A-Za-z0-9_-]*")}
_HEX_RUN = b"h" * 32
_HEX_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        keywords: dict[str, list[int]] = {}
        for k, (_, own, _, _, _) in enumerate(KINDS):
            for word in own:
                keywords.setdefault(word, []).append(k)
        for word, kinds in keywords.items():
            self.automaton.add_word(word, (len(word), tuple(kinds)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of every secret, in code points, sorted."""
        raw = text.encode("utf-8", "surrogatepass")
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (length, kinds) in self.automaton.iter(raw.lower().decode("utf-8", "surrogatepass")):
            for k in kinds:
                hits.setdefault(k, []).append((end - length + 1, end + 1))
        found: list[tuple[int, int, int]] = []
        for k, places in hits.items():
            kind, _, pattern, near, valid = KINDS[k]
            run = _RUNS.get(kind)
            past = 0
            for start, end in sorted(set(places)):
                if near:
                    m = pattern.search(text, max(end, past), end + near + 24)
                    m = m if m and m.start() <= end + near and not text[m.start() - 1].isdigit() else None
                else:
                    m = pattern.match(text, start) if start >= past else None
                    if m is None and run and start >= past:
                        past = run.match(text, start).end()
                if m:
                    past = m.end()
                    if valid(m):
                        found.append((m.start(), k, m.end()))
        mapped = raw.translate(_HEX_CLASS)
        at, before, place = mapped.find(_HEX_RUN), 0, 0  # place: the code points up to byte `before`
        while at >= 0:
            place += len(raw[before:at].decode("utf-8", "surrogatepass"))
            m = HEX.match(text, place)
            found.append((m.start(), 2, m.end()))
            before, place = at + m.end() - m.start(), m.end()
            at = mapped.find(_HEX_RUN, before)
        return sorted(found)


_scanner: list[Scanner] = []


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text, ...); spans is an array of (kind, start, end) by start and kind.

    Places are code points, end exclusive. Kinds: assign, access and hex (see the patterns above), checked (tokens
    that end with their own CRC-32), jwt (whose header decodes) and card (digits near a keyword that pass Luhn's
    check). Null and empty texts have no spans. Null doc_ids and repeated rows are kept; other columns are ignored.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k][0], "start": s, "end": e} for s, k, e in _scanner[0].spans(x)] if x else [] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
