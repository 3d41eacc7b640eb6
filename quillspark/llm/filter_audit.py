"""What filters remove, in every order they can be applied in, and each one's Shapley share of it.

Each document has a mask of the filters it fails; all figures follow from the number of documents with each mask. For a
part of the corpus with c(m) documents of mask m, the removal polynomial is the multilinear extension of "documents that
a set of filters removes":

    f(x) = sum over m of c(m) * (1 - product over i in m of (1 - x_i))

At the corner of a set of filters, f counts what they remove together. The partial derivative in x_i, integrated along
the diagonal from 0 to 1, is the Shapley value of filter i; times the number of orders it is a whole number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import frames

#: White space that parts words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"
#: The filters of op12, by letter.
LETTERS = "ABCDE"
#: Values by which rows without doc_id are spread in a join.
NULL_SALTS = 1024

COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (fewer distinct words than half), C (over 2 % capitals), D (holds marks)."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n_words < 200, 100 * n_distinct.cast("long") < 50 * n_words, 100 * capitals.cast("long") > 2 * F.char_length(text), text.rlike("[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source and mask of failures, and how many are labelled so.

    Bit 0 of a mask is filter A, bit 4 filter E: the text is identical to a smaller doc_id's anywhere in the table. A null
    text is an empty one, a null source the part "". Repeated rows count each; those of one doc_id are no copies of
    each other. Rows without doc_id have no labels, are never copies and make none. Of labels that repeat a doc_id, one
    with the value 1 is enough. Other columns are not looked at.

    Texts leave the scan as digests. Rows are counted before each shuffle: a text with very many copies is one row of
    each task and source where copies are looked for, after documents have been joined with their labels by doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(text))), F.lit(0))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0))
    own = own.groupBy("doc_id", "salt", "digest", "mask", "part").agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic")).withColumn("salt", F.lit(0).cast("long"))
    known = own.join(said, ["doc_id", "salt"], "left")
    # The rows of a group that have its least doc_id: only these may be the first of their text.
    key = ["digest", "mask", "part", "good", "toxic"]
    known = known.select("doc_id", "digest", "mask", "part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    groups = known.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = groups.withColumn("first", first).select("mask", "part", "good", "toxic", "n", firsts.alias("firsts"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    rows = groups.select("part", "good", "toxic", both.alias("x")).select("part", "x.mask", "x.n", *[F.when(F.col(c), F.col("x.n")).otherwise(0).alias(c) for c in ("good", "toxic")])
    return rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


class Removal:
    """The removal polynomial of counts by mask, as coefficients of its monomials (a monomial is a set of filters, as bits)."""

    def __init__(self, counts: Sequence[int], filters: int) -> None:
        self.filters = filters
        above = list(counts)  # documents whose mask holds all of a set
        for i in range(filters):
            for s in range(1 << filters):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        self.terms = {s: above[s] * (-1) ** (s.bit_count() + 1) for s in range(1, 1 << filters)}
        self._corners = {s: sum(a for t, a in self.terms.items() if t & s == t) for s in range(1 << filters)}

    def corner(self, filters: int) -> int:
        """f where x is 1 for these filters and 0 for the others: what they remove."""
        return self._corners[filters]

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the partial derivative in x_i at (t, ..., t)."""
        powers: dict[int, int] = {}
        for term, a in self.terms.items():
            if term >> i & 1:
                powers[term.bit_count() - 1] = powers.get(term.bit_count() - 1, 0) + a
        return sum((Fraction(a, power + 1) for power, a in powers.items()), Fraction(0))


def audit_rows(part: str, counts: Sequence[int], good: Sequence[int], toxic: Sequence[int], letters: str = LETTERS) -> Iterator[tuple]:
    """The rows of one part in the order of COLUMNS, for counts by mask."""
    k = len(letters)
    f, lost_good, lost_toxic = (Removal(c, k) for c in (counts, good, toxic))
    total, every, orders = sum(counts), (1 << k) - 1, math.factorial(k)
    shares = [int(orders * f.shapley(i)) for i in range(k)]
    for order in itertools.permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = f.corner(after) - f.corner(before)
            yield (
                part, "".join(letters[x] for x in order), step, total - f.corner(after), removed, f.corner(1 << i) - removed, f.corner(every) - f.corner(every & ~(1 << i)),
                lost_good.corner(after) - lost_good.corner(before), lost_toxic.corner(after) - lost_toxic.corner(before), shares[i],
            )
            before = after


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """COLUMNS for each part of counts(part, mask, n, good, toxic), order of the filters and step; no parts give no rows.

    A part is one narrow row of at most 2 ** len(letters) counts, and parts are dealt over the tasks.
    """
    frames.python_workers(counts.sparkSession)
    names, masks = [c.split()[0] for c in COLUMNS.split(", ")], 1 << len(letters)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, cells in zip(batch["part"], batch["cells"], strict=True):
                columns = [[0] * masks for _ in range(3)]
                for cell in cells:
                    for column, name in zip(columns, ("n", "good", "toxic"), strict=True):
                        column[cell["mask"]] = int(cell[name])
                yield pd.DataFrame(list(audit_rows(part, *columns, letters)), columns=names)

    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).mapInPandas(expand, COLUMNS)
