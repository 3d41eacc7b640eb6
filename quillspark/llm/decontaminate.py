"""Benchmark decontamination by template windows. DataFrame operations only.

Numbers, units and names become typed placeholders, so that a question with other parameters gives the same windows.
Windows of the benchmark are hash-joined with those of the documents. A document leaks an item if it holds enough of
the item's distinct windows and its parameters replace the item's consistently: each value of the item stands for one
value of the document.

Which words are placeholders is decided for few documents only. Each window of an item has an anchor, a run of up to
three words in it that any document with this window must hold as they stand (numbers are all alike). All documents are
cut into words and their runs are hash-joined with the anchors; one that lacks the anchors of too many windows of an
item cannot leak it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import bounded_broadcast, cut, unused

#: Words that count as units after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "usd", "eur", "dollars", "euros", "cents", "miles", "mile", "feet", "inch", "inches", "yards", "pounds", "lb", "oz", "meters", "metres", "liters", "litres", "grams", "kilograms", "kmh", "mph", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "a")
_NUMBER, _UNIT, _NAME = "\x01n", "\x01u", "\x01p"
_SLOT = "\x01"
_BREAK = "\x02"
#: What stands between two words without their punctuation: at the beginning, from white space on, from punctuation on.
_BETWEEN = r"\A[^\p{L}\p{N}]++|\s[^\p{L}\p{N}]*+|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]++(?:\s[^\p{L}\p{N}]*+|\z)"
#: All numbers are one word of the anchors.
_ANY_NUMBER = "0"
#: Most words of an anchor.
ANCHOR_WORDS = 3


def _cores(lowered: Column) -> Column:
    """The words of a lowered text without the punctuation at their ends."""
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def _run_hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _runs_of(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, one, run): the hashes of the runs of so many words, for each place; `one` tells texts of one word."""

    def known(x: Column) -> Column:
        may_be = (x >= "0") & ((x < ":") | (x >= "\x80"))  # spares most words the pattern
        return F.when(may_be & x.rlike(r"^\p{N}\P{L}*$"), _ANY_NUMBER).otherwise(x)

    words = texts.filter("text IS NOT NULL").select("doc_id", _cores(F.lower("text")).alias("words"))
    # The words beside themselves, so that a run is a row and not the work of a function on arrays.
    shifted = [F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(f"x{k}") for k in range(max(lengths))]
    rows = words.select("doc_id", (F.size("words") == 1).alias("one"), F.inline(F.arrays_zip(*shifted)))
    rows = rows.select("doc_id", "one", *[known(F.col(f"x{k}")).alias(f"x{k}") for k in range(max(lengths))])
    run = [F.when(F.col(f"x{n - 1}").isNotNull(), _run_hash([F.col(f"x{k}") for k in range(n)])) for n in lengths]
    return rows.select("doc_id", "one", run[0].alias("run") if len(run) == 1 else F.explode(F.array(*run)).alias("run"))


def _windows(rows: DataFrame, key: str, sizes: list[int], whole: bool = False) -> DataFrame:
    """(key, row, at, size, h, slots, w, literal): the windows of `sizes` template words of each text.

    A capitalised word that opens the text or a sentence may be a name or not: its windows are given both ways, with
    the same `w`. `row` tells texts of the same key apart. With `whole`, a text of fewer words than the largest size is
    one shorter window, and w and literal are given. Else windows of one word are taken from texts of one word only.
    """
    # Letters and digits of any script make words.
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), r"[\s]+", -1)
    rows = rows.select(F.col(key), F.xxhash64("text").alias("row"), F.filter(raw, lambda x: x.rlike(r"[\p{L}\p{N}]")).alias("raw"), _cores(F.lower(F.coalesce("text", F.lit("")))).alias("core"))

    def template(x: Column, i: Column) -> Column:
        previous, core = F.get("raw", i - 1), F.get("core", i)
        unit = core.isin(*UNITS) & previous.rlike(r"^\P{L}*\p{N}\P{L}*$")
        inside = F.coalesce(previous.rlike(r"[\p{L}\p{N},;]$"), F.lit(False))
        name = F.when(inside, F.struct(F.lit(_NAME).alias("t"), F.lit(0).alias("maybe"))).otherwise(F.struct(core.alias("t"), F.lit(1).alias("maybe")))
        sure = F.when(x.rlike(r"^\P{L}*\p{N}\P{L}*$"), _NUMBER).when(unit, _UNIT)
        return F.when(x.rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}") & ~F.coalesce(unit, F.lit(False)), name).otherwise(F.struct(F.coalesce(sure, core).alias("t"), F.lit(0).alias("maybe")))

    rows = rows.withColumn("word", F.transform("raw", template))

    def windows(size: int) -> Column:
        def word(i: Column, k: int) -> Column:
            return F.get("word", i + k)["t"]

        def maybe(i: Column, k: int) -> Column:
            return F.coalesce(F.get("word", i + k)["maybe"], F.lit(0))

        def window(i: Column, words: list[Column]) -> Column:
            is_slot = [F.startswith(w, F.lit(_SLOT)) for w in words]
            slots = F.concat_ws(_BREAK, *[F.when(s, F.get("core", i + k)) for k, s in enumerate(is_slot)])
            fields = [i.alias("at"), F.lit(size).alias("size"), F.xxhash64(*words).alias("h"), slots.alias("slots")]
            if whole:
                literal = F.concat_ws(_BREAK, *[F.when(~s, w) for s, w in zip(is_slot, words, strict=True)])
                fields += [F.xxhash64(*[word(i, k) for k in range(size)]).alias("w"), literal.alias("literal"), anchor(i).alias("anchor")]
            return F.struct(*fields)

        def anchor(i: Column) -> Column:
            """The longest run of words that are no slot for any choice of names; of equal ones the one with most letters."""
            sure = [(maybe(i, k) == 0) & ((word(i, k) == _NUMBER) | ~F.startswith(word(i, k), F.lit(_SLOT))) for k in range(size)]
            text = [F.when(word(i, k) == _NUMBER, _ANY_NUMBER).otherwise(word(i, k)) for k in range(size)]
            made = []
            for n in range(1, min(size, ANCHOR_WORDS) + 1):
                for a in range(size - n + 1):
                    whole = sure[a]
                    for k in range(a + 1, a + n):
                        whole = whole & sure[k]
                    made.append(F.when(whole, F.struct(F.lit(n).alias("n"), F.length(F.concat(*text[a : a + n])).alias("letters"), _run_hash(text[a : a + n]).alias("run"))))
            return F.array_max(F.array(*made))

        def either(i: Column) -> Column:
            """The windows at i for each choice of names; bits of a number are the choices."""
            before = [F.lit(0)]
            for k in range(size):
                before.append(before[-1] + maybe(i, k))

            def chosen(bits: Column) -> Column:
                is_name = [(maybe(i, k) == 1) & (F.call_function("shiftright", bits, before[k]).bitwiseAND(1) == 1) for k in range(size)]
                return window(i, [F.when(n, _NAME).otherwise(word(i, k)) for k, n in enumerate(is_name)])

            last = F.call_function("shiftleft", F.lit(1), before[size]) - 1
            return F.when(before[size] == 0, F.array(window(i, [word(i, k) for k in range(size)]))).otherwise(F.transform(F.sequence(F.lit(0), last), chosen))

        count = F.size("word") - (size - 1)
        count = F.greatest(count, F.least(F.size("word"), F.lit(1))) if whole else F.when(F.size("word") == 1, 1).otherwise(0) if size == 1 else F.greatest(count, F.lit(0))
        return F.flatten(F.transform(F.slice("word", 1, count), lambda x, i: either(i)))

    w = F.explode(F.concat(*[windows(k) for k in sizes])).alias("w")
    return rows.select(key, "row", F.size("word").alias("n"), w).select(key, "row", "n", "w.*").withColumn("size", F.least("size", "n")).drop("n")


def _runs(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, w, own, slots, literal): one place for each found window of the item, for each run of hits.

    A run gathers around one distance between the places in the document and in the item; of several hits of a window
    the nearest to that distance counts, with words taken literally if they are the same. Texts with added or missing words drift by up to half the item. The null run
    is the document as a whole, for items whose parts stand apart.
    """
    pair = ["doc_id", "item_id"]
    texts = [*pair, "doc_row", "item_row"]
    hits = hits.withColumns({"shift": F.col("at") - F.col("place"), "bucket": F.floor((F.col("at") - F.col("place")) / (F.col("slack") + 1))})
    around = F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket")
    anchors = hits.select(*texts, "bucket", F.col("shift").alias("anchor")).distinct().select(*texts, "anchor", around)
    off = F.abs(F.col("shift") - F.col("anchor"))
    near = hits.join(anchors, [*texts, "bucket"]).filter(off <= F.col("slack"))
    n_slots = F.when(F.col("slots") == "", 0).otherwise(F.size(F.split("slots", _BREAK))).alias("n_slots")
    near = near.groupBy(*texts, "anchor", "place").agg(F.min(F.struct(off.alias("off"), "at", n_slots, "w", "own", "slots", "literal")).alias("best"))
    near = near.select(*pair, F.struct("doc_row", "item_row", "anchor").alias("run"), "best.w", "best.own", "best.slots", "best.literal")
    whole = hits.groupBy(*pair, "w").agg(F.min(F.struct(n_slots, "own", "slots", "literal")).alias("best")).select(*pair, "w", "best.own", "best.slots", "best.literal")
    return near.unionByName(whole.withColumn("run", F.lit(None).cast(near.schema["run"].dataType)))


def _candidates(texts: DataFrame, wanted: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id) of all documents that hold the anchors of enough windows of an item, and (item_id) of items that have too few anchors for that.

    A window that has no anchor, or not the same one wherever it stands, counts as found.
    """
    by_window = wanted.groupBy("item_id", "w").agg(F.max("size").alias("size"), F.min("anchor").alias("anchor"), F.max("anchor").alias("other"), F.count("anchor").alias("known"), F.count("*").alias("n"))
    by_window = cut(by_window.withColumn("anchor", F.when((F.col("anchor") == F.col("other")) & (F.col("known") == F.col("n")), F.col("anchor"))))
    least = cut(by_window.groupBy("item_id").agg((share * F.count("*") - F.count(F.when(F.col("anchor").isNull(), 1)) - 1e-9).alias("least")))
    anchors = by_window.filter("anchor IS NOT NULL").groupBy("item_id", F.col("anchor.run").alias("run"), F.col("anchor.n").alias("length"))
    anchors = cut(anchors.agg(F.count("*").alias("n"), (F.max("size") == 1).alias("alone")).join(least.filter("least > 0"), "item_id"))
    lengths = sorted(r["length"] for r in anchors.select("length").distinct().collect())
    free = cut(least.filter("least <= 0").select("item_id"))
    if not lengths:
        return texts.select("doc_id").limit(0), free
    held = _runs_of(texts, lengths).join(bounded_broadcast(anchors.drop("length")), "run").filter("one OR NOT alone").dropDuplicates(["doc_id", "item_id", "run"])
    held = held.groupBy("doc_id", "item_id").agg(F.sum("n").alias("held"), F.first("least").alias("least"))
    return cut(held.filter("held >= least").select("doc_id").distinct()), free


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, agreement: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_slots, slot_agreement): what documents leak which benchmark items.

    A document leaks an item if it holds at least `share` of the item's distinct windows of `size` template words. Of
    the slots of the matched windows, at least `agreement` must follow the item's most frequent replacement of their
    value (slot_agreement is 1 without slots). Both are asked of each place where the item may stand, and of the
    document as a whole; the figures are those of the best. If less than two
    different words of the matched windows are literal, at least `agreement` of the slots must have the item's values.

    Items of less than `size` words are one window of as many words, which any document may hold; those of one word
    leak into documents of this word only. Capitalised words that open a sentence match as names or as they stand.

    Words are separated by white space, without case and without punctuation at their ends. Null or wordless texts,
    rows without doc_id or item_id, and empty tables give nothing; rows that repeat an id are one text together.
    Other columns are ignored. Items that hold almost nothing but names and units have no anchors: for these alone the
    templates of all documents are made.
    """
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = _windows(items, "item_id", [size], whole=True)
    wanted = cut(wanted.select("item_id", "size", "literal", F.col("row").alias("item_row"), F.col("at").alias("place"), "w", "h", F.col("slots").alias("own"), "anchor"))
    candidates, free = _candidates(texts, wanted, share)
    wanted = wanted.drop("anchor")
    totals = wanted.groupBy("item_id").agg(F.countDistinct("w").alias("n_windows"), F.floor((F.max("place") + size) / 2).alias("slack"))
    n = wanted.count()
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect()) or [size]

    def hits_of(own_texts: DataFrame, own_items: DataFrame) -> DataFrame:
        return _windows(own_texts, "doc_id", sizes).withColumnRenamed("row", "doc_row").join(bounded_broadcast(own_items, n), ["h", "size"]).drop("h", "size")

    n_free = free.count()
    hits = hits_of(texts.join(bounded_broadcast(candidates), "doc_id", "left_semi"), wanted.join(bounded_broadcast(free, n_free), "item_id", "left_anti"))
    if n_free:  # any document may hold items of names and units only
        hits = hits.unionByName(hits_of(texts, wanted.join(bounded_broadcast(free, n_free), "item_id", "left_semi")))
    hits = cut(hits)
    pair, enough = ["doc_id", "item_id"], F.col("n_found") >= share * F.col("n_windows")
    found = hits.groupBy(*pair).agg(F.countDistinct("w").alias("n_found")).join(bounded_broadcast(totals, n), "item_id").filter(enough).drop("n_found")
    runs = cut(_runs(hits.join(found, pair)))
    literal = F.size(F.array_remove(F.array_distinct(F.flatten(F.collect_set(F.split("literal", _BREAK)))), ""))
    found = runs.groupBy(*pair, "run").agg(F.countDistinct("w").alias("n_found"), literal.alias("n_literal")).join(bounded_broadcast(totals, n), "item_id").filter(enough)
    values = runs.filter("own != ''").select(*pair, "run", F.explode(F.arrays_zip(F.split("own", _BREAK).alias("own"), F.split("slots", _BREAK).alias("new"))).alias("z"))
    same = values.groupBy(*pair, "run", "z.own", "z.new").agg(F.count("*").alias("n"))
    equal = F.sum(F.when(F.col("own") == F.col("new"), F.col("n")).otherwise(0))
    same = same.groupBy(*pair, "run", "own").agg(F.sum("n").alias("n"), F.max("n").alias("most"), equal.alias("equal"))
    same = same.groupBy(*pair, "run").agg(F.sum("n").alias("n_slots"), (F.sum("equal") / F.sum("n")).alias("equal"), (F.sum("most") / F.sum("n")).alias("slot_agreement"))
    same = same.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"), F.col("run").alias("r"), "n_slots", "slot_agreement", "equal")
    out = found.join(same, (F.col("doc_id") == F.col("d")) & (F.col("item_id") == F.col("i")) & F.col("run").eqNullSafe(F.col("r")), "left")
    out = out.filter((F.col("n_literal") >= 2) | (F.coalesce("equal", F.lit(1.0)) >= agreement))
    out = out.select(*pair, "n_windows", "n_found", F.coalesce("n_slots", F.lit(0).cast("long")).alias("n_slots"), F.coalesce("slot_agreement", F.lit(1.0)).alias("slot_agreement"))
    out = out.filter(F.col("slot_agreement") >= agreement)
    best = out.groupBy(*pair).agg(F.max(F.struct("n_found", "slot_agreement", "n_slots", "n_windows")).alias("b"))
    return best.select(*pair, "b.n_windows", "b.n_found", "b.n_slots", "b.slot_agreement")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that leak no item; rows without doc_id stay. See leaks()."""
    (own,) = unused(docs, "_leaks")
    bad = cut(leaks(docs, benchmark, **parameters).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(bounded_broadcast(bad), F.col("doc_id").cast("long") == F.col(own), "left_anti")
