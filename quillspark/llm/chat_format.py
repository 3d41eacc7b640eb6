"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
Turns are formatted once, as segments of one stream a conversation (format_conversations()); expand() then writes each
example out, context and reply, with the span of its loss mask. read_examples() reads turns and losses from examples
only, and refuses one whose context is not all that was before it. examples() lists the spans without texts.

Written out, examples grow with the square of a conversation's length. So those of a long conversation are dealt into
parts of some PART_CHARS characters, each one's task; a task holds one stream and hands texts on in bounded batches.

A turn is "### role: text</turn>" and a line feed. Inside roles and texts, backslashes, marks of three #, turn ends
and (in roles) colons are escaped reversibly, so that control strings in a text stay text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.frames import partitions_for, python_workers

_MARK, _END = "### ", "</turn>"
_TO_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_PLAIN = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"### ([^:]*): (.*)</turn>\n", re.S)
#: Rows of a batch that is handed on, and characters of texts after which it is handed on with fewer.
_ROWS, _CHARS = 256, 1 << 21
#: Characters of written out examples after which those of a conversation go on in another task.
PART_CHARS = 32_000_000


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _CODES[m[0]], text)


def _escape_role(role: str) -> str:
    return escape(role).replace(":", _CODES[":"]).replace("\n", _CODES["\n"])


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


_SEGMENT_COLUMNS = ["conv_id", "example", "position", "segment", "start", "context_end", "loss_start", "loss_end", "part", "last_part"]
SEGMENT_SCHEMA = "conv_id long, example long, position long, segment string, start long, context_end long, loss_start long, loss_end long, part long, last_part long"
_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]
#: Before the first conversation; null is the name of one.
_NONE = object()


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == _ROWS or chars >= _CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, chars = [], 0
    columns = list(zip(*held, strict=True)) if held else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        last, example, position, start = _NONE, 0, 0, 0
        for conv, role, text, part, last_part in _rows(batches, ["conv_id", "role", "text", "part", "last_part"]):
            if conv is None or conv != last:
                last, example, position, start = conv, 0, 0, 0
            head, body = f"{_MARK}{_escape_role(role or '')}: ", escape(text or "")
            segment = f"{head}{body}{_END}\n"
            target = role == "assistant"
            spans = (start, start + len(head), start + len(head) + len(body)) if target else (None, None, None)
            yield conv, example, position, segment, start, *spans, part, last_part
            example += target
            position, start = position + 1, start + len(segment)

    return _batches(rows(), _SEGMENT_COLUMNS, _SEGMENT_TYPES)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Segments (conv_id, example, position, segment, start, context_end, loss_start, loss_end, part, last_part) of conversations(conv_id, turn, role, text, ...).

    One row a turn, each conversation's in order within one partition. start is the segment's place in its
    conversation's stream, in code points. A segment with context_end is the target of its example: the example is the
    stream from 0 to context_end, then the segment, and its trainable part is loss_start to loss_end of the stream.
    Turns after the last assistant turn belong to a last example without a target, so that no turn is lost. part is the
    part of the conversation's examples in which expand() writes the segment's own, last_part the last of its parts.

    Turns sort by turn (nulls first), then role and text, so ties and repeated rows have a fixed order and all stay.
    Null roles and texts are empty. Rows without conv_id belong to no other: each is a conversation of one turn, whose
    id is null. Other columns are ignored; no rows give none. A conversation is streamed through one task, one batch at
    a time; turns without conv_id are spread.
    """
    spark = conversations.sparkSession
    python_workers(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["turn", "role", "text"]
    dealt = rows.withColumn("_alone", _alone(order)).repartition(partitions_for(spark, conversations.count()), "conv_id", "_alone")
    own = Window.partitionBy("conv_id", "_alone").orderBy(*order)
    sized = dealt.withColumn("_stream", F.sum(F.char_length(F.coalesce("text", F.lit(""))) + F.char_length(F.coalesce("role", F.lit(""))) + 14).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    written = F.sum(F.when(F.col("role") == "assistant", F.col("_stream")))
    parts = {"part": written.over(own.rowsBetween(Window.unboundedPreceding, -1)), "last_part": written.over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    known = sized.withColumns({n: F.when(F.col("conv_id").isNull(), 0).otherwise(F.floor(F.coalesce(c, F.lit(0)) / PART_CHARS)).cast("long") for n, c in parts.items()})
    return known.sortWithinPartitions("conv_id", "_alone", *order).select("conv_id", "role", "text", "part", "last_part").mapInArrow(_format, SEGMENT_SCHEMA)


def _alone(order: list[str]) -> Column:
    """By what rows without conv_id are dealt; 0 for others."""
    return F.when(F.col("conv_id").isNull(), F.xxhash64(*order)).otherwise(F.lit(0).cast("long"))


def _in_order(rows: DataFrame, order: list[str], *parts: str) -> DataFrame:
    """rows with each conversation (or each of its parts) whole and in order in one partition; rows without conv_id are dealt by a hash.

    The session's number of partitions is taken: counting segments would format all turns once more.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "conv_id", *parts, _alone(order)).sortWithinPartitions("conv_id", *parts, *order)


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def read_back(segments: DataFrame) -> DataFrame:
    """read_examples() of the examples that segments, in any order, are expanded to."""
    return read_examples(expand(segments, rest=True))


_READ_COLUMNS = ["conv_id", "example", "n_turns", "turns_sha256", "before_sha256", "loss", "formatted_chars"]
_READ_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each example says, by itself: its turns' digest, that of the turns up to its last reply but the target, and the trainable text."""

    def rows() -> Iterator[tuple]:
        for conv, example, whole, a, b in _rows(batches, ["conv_id", "example", "text", "loss_start", "loss_end"]):
            if whole and not whole.endswith(f"{_END}\n"):
                raise ValueError(f"an example of conversation {conv} that is cut off")
            turns, before, n, at = hashlib.sha256(), None, 0, 0
            loss = None if a is None else unescape(whole[a:b])
            while at < len(whole):
                end = whole.index(f"{_END}\n", at) + len(_END) + 1
                role, text = parse_segment(whole[at:end])
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                at, n = end, n + 1
                if role == "assistant" and (loss is None or at < len(whole)):
                    before = turns.copy()
            if loss is not None and (role, text, b) != ("assistant", loss, len(whole) - len(_END) - 1):
                raise ValueError(f"an example of conversation {conv} whose loss mask is not its last reply")
            yield conv, example, n, turns.hexdigest(), before and before.hexdigest(), loss, len(whole)

    return _batches(rows(), _READ_COLUMNS, _READ_TYPES)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from what their examples say, in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows() -> Iterator[tuple]:
        conv = _NONE
        for own, example, n, turns, before, text, total in _rows(batches, _READ_COLUMNS):
            if own is None or own != conv:
                if conv is not _NONE:
                    yield conv, *last[:2], chars, loss.hexdigest(), last[2]
                conv, chars, loss, expected, last = own, 0, hashlib.sha256(), 0, (0, None, 0)
            if example != expected or before != last[1]:
                raise ValueError(f"an example of conversation {conv} whose context is not all that is before it")
            if text is not None:
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            expected, last = expected + 1, (n, turns, total)
        if conv is not _NONE:
            yield conv, *last[:2], chars, loss.hexdigest(), last[2]

    return _batches(rows(), names, types)


def read_examples(written: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its examples, in any order.

    Each example is read where it is; then only its reply and digests are sent on. Turns, their digest and
    formatted_chars are those of the last example, which holds all; losses are each example's own. An example of no
    conv_id is a conversation.
    """
    python_workers(written.sparkSession)
    read = written.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(_read, "conv_id long, example long, n_turns long, turns_sha256 string, before_sha256 string, loss string, formatted_chars long")
    ordered = _in_order(read, ["example", "turns_sha256"]).select(*_READ_COLUMNS)
    return ordered.mapInArrow(_join_up, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def examples(segments: DataFrame) -> DataFrame:
    """(conv_id, example, context_start, context_end, target_end, loss_start, loss_end): one row for each assistant turn, places in its conversation's stream."""
    return segments.filter("context_end IS NOT NULL").select("conv_id", "example", F.lit(0).cast("long").alias("context_start"), "context_end", (F.col("start") + F.char_length("segment")).alias("target_end"), "loss_start", "loss_end")


def expand(segments: DataFrame, rest: bool = False) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): every example written out, from segments in any order.

    text is the context, all that is before the target, and the target; of that only loss_start to loss_end is trainable.
    With rest, turns after the last assistant turn give an example too, of the whole stream, whose loss span is null.
    The segments go to each part whose examples hold them; a task holds one conversation's stream at a time.
    """
    python_workers(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            group, held, left = _NONE, [], None
            for conv, example, segment, context_end, a, b, part, last_part, here in _rows(batches, columns):
                if conv is None or (conv, here) != group:
                    if left:
                        yield *left, "".join(held), None, None
                    group, held = (conv, here), []
                held.append(segment)
                left = (conv, example) if rest and context_end is None and here == last_part else None
                if context_end is not None and part == here:
                    held = ["".join(held)]
                    yield conv, example, held[0], a, b
            if left:
                yield *left, "".join(held), None, None

        return _batches(rows(), ["conv_id", "example", "text", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    columns = ["conv_id", "example", "segment", "context_end", "loss_start", "loss_end", "part", "last_part", "here"]
    dealt = segments.withColumn("here", F.explode(F.sequence("part", "last_part")))
    return _in_order(dealt, ["position", "segment"], "here").select(*columns).mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")
