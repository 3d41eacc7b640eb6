"""Instants from timestamps as people write them: several formats, zones, and day and month in either order.

A wall time becomes an instant by enumerating offsets: every offset that its zone ever has is subtracted from it, and each
candidate is rendered in the zone again. One that gives the wall time back is the instant. None does in a gap, two do in
an overlap; then the offsets of the two adjacent transitions decide, and the one after the change counts.

All of it is expressions. Stamps with slashes, which need their source's votes, are the only rows that are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats. Groups: the date (y m d, y m d, d m y, d b y, and two numbers with the year last), then
# hour, minute, second, half of the day, offset.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
YEAR = "(20[0-9][0-9])"
TWO = "([0-9][0-9])"
TIME = rf"(?:[T\x20]{TWO}:{TWO}(?::{TWO})?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?"
DATES = f"(?:{YEAR}-{TWO}-{TWO}|{YEAR}{TWO}{TWO}|{TWO}[.]{TWO}[.]{YEAR}|{TWO} ({'|'.join(MONTHS)}) {YEAR})"
PLAIN = rf"^{DATES}{TIME}\z"
SLASHED = rf"^{TWO}/{TWO}/{YEAR}{TIME}\z"
SPACE = " \t\n\x0b\x0c\r"

DAY_US = 86_400_000_000
#: Instants at which the zones' offsets are looked up: every so many days from before 2000 to after 2099.
PROBE_DAYS, PROBES_FROM, PROBES_TO = 14, "1999-12-20", "2100-01-14"
#: Parts that the stamps of one source are dealt into when they meet its votes.
SALTS = 64
#: A side wins a vote with over so many times the votes of the other.
MAJORITY = 10


def zone_offsets(spark: SparkSession) -> DataFrame:
    """(zone, offsets): the distinct offsets in microseconds of each zone that the JVM knows, over this century.

    Its rows depend on the time zone database only, so it may be broadcast whatever the data.
    """
    names = spark._jvm.java.lang.String.join(" ", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split()
    days = F.sequence(F.lit(PROBES_FROM).cast("date"), F.lit(PROBES_TO).cast("date"), F.expr(f"INTERVAL {PROBE_DAYS} DAYS"))
    at = F.timestamp_micros(F.unix_date("day").cast("long") * DAY_US)
    probes = spark.createDataFrame([(n,) for n in sorted(names)], "zone string").repartition(8).select("zone", F.explode(days).alias("day"))
    seen = probes.select("zone", (F.unix_micros(F.from_utc_timestamp(at, F.col("zone"))) - F.unix_micros(at)).alias("offset"))
    return seen.groupBy("zone").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))


def _rendered(instant: Column, zone: Column) -> Column:
    """The wall time in the zone, as microseconds of a day count like UTC's."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone))


def resolved(x: DataFrame) -> DataFrame:
    """x(wall, zone, offsets, ...) with instant, and odd: whether the zone skips or repeats the wall time.

    instant is null where wall is null or the zone is unknown (offsets is null). Zones of one offset need no candidates.
    """
    at, name, offsets = F.col("wall"), F.col("zone"), F.col("offsets")
    # A column of its own, so that it is computed once for all that is asked of it.
    x = x.withColumn("fits", F.when(at.isNotNull() & (F.size(offsets) > 1), F.filter(F.transform(offsets, lambda o: at - o), lambda u: _rendered(u, name) == at)))
    # In a gap the earliest candidate lies before the change; with the offset there, the wall time lies after it.
    earliest = at - F.array_max(offsets)
    after = at - (_rendered(earliest, name) - earliest)
    in_gap = at - (_rendered(after, name) - after)
    several = F.col("fits").isNotNull()
    instant = F.when(several, F.when(F.size("fits") == 0, in_gap).otherwise(F.array_max("fits"))).otherwise(at - F.get(offsets, F.lit(0)))
    return x.withColumns({"instant": instant, "odd": several & (F.size("fits") != 1)})


def _number(part: Column) -> Column:
    return F.when(part != "", part.cast("int"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Microseconds from 1970 to the start of a date in 2000 to 2099; null if there is no such date."""
    ok = month.between(1, 12) & (day >= 1) & (day <= F.when(month == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31))
    iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(ok, F.unix_date(iso.try_cast("date")).cast("long") * DAY_US)


def _time(hour: Column, minute: Column, second: Column, half: Column) -> Column:
    """Microseconds of a time of day, 0 without one; null if there is no such time."""
    h, m, s = _number(hour), _number(minute), F.coalesce(_number(second), F.lit(0))
    h = F.when(half == "", F.when(h <= 23, h)).otherwise(F.when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0)))
    us = F.when((m <= 59) & (s <= 59), ((h * 60 + m) * 60 + s).cast("long") * 1_000_000)
    return F.when(hour == "", 0).otherwise(us)


def _offset(text: Column) -> Column:
    """Microseconds of an offset; null if there is none. Impossible ones are told by _offset_ok()."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    minutes = _number(F.substring(digits, 1, 2)) * 60 + _number(F.substring(digits, 3, 2))
    return F.when(text == "Z", 0).when(text != "", minutes.cast("long") * 60_000_000 * F.when(F.substring(text, 1, 1) == "-", -1).otherwise(1))


def _offset_ok(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (text == "") | (text == "Z") | ((_number(F.substring(digits, 1, 2)) <= 14) & (_number(F.substring(digits, 3, 2)) <= 59))


def _fields(core: Column, pattern: str, groups: str) -> Column:
    """The groups of a pattern as an array of strings, empty where a group took no part; null if the pattern doesn't fit."""
    return F.when(core.rlike(pattern), F.split(F.regexp_replace(core, pattern, groups), ","))


def _plain(stamps: DataFrame, zones: DataFrame) -> DataFrame:
    """Results of stamps that need no votes: epochs, dates in one order only, and what is no stamp."""
    core = F.col("core")
    x = stamps.withColumn("x", _fields(core, PLAIN, "$1$4$9$12,$2$5$8,$11,$3$6$7$10,$13,$14,$15,$16,$17"))
    at = lambda i: F.col("x")[i]
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), at(2)).cast("int")
    x = x.withColumn("date", _day(_number(at(0)), F.when(at(2) != "", named).otherwise(_number(at(1))), _number(at(3)))).withColumn("time", _time(at(4), at(5), at(6), at(7)))
    x = x.withColumn("wall", F.when(_offset_ok(at(8)), F.col("date") + F.col("time"))).withColumn("offset", _offset(at(8)))
    x = x.withColumn("epoch", F.when(core.rlike(r"^[0-9]{10}\z"), core.try_cast("long") * 1_000_000).when(core.rlike(r"^[0-9]{13}\z"), core.try_cast("long") * 1000)).drop("x")
    return _answers(x.withColumn("rule", F.when(F.col("epoch").isNotNull(), "epoch").otherwise("plain")), zones)


def _answers(x: DataFrame, zones: DataFrame) -> DataFrame:
    """(stamp_id, utc_us, rule, ambiguous) from wall, offset, epoch, rule and zone."""
    x = x.join(F.broadcast(zones), "zone", "left") if "offsets" not in x.columns else x
    local = F.when(F.col("offset").isNull(), F.col("wall"))  # what has an offset of its own needs no zone
    x = resolved(x.withColumns({"shifted": F.col("wall") - F.col("offset"), "wall": local}))
    x = x.withColumn("utc_us", F.when(F.col("rule") == "epoch", F.col("epoch")).otherwise(F.coalesce("shifted", "instant")))
    bad = F.col("utc_us").isNull()
    return x.select("stamp_id", "utc_us", F.when(bad, "bad").otherwise(F.col("rule")).alias("rule"), (~bad & (F.col("rule").isin("votes", "default") | F.col("odd"))).alias("ambiguous"))


def _slashed(stamps: DataFrame, zones: DataFrame) -> DataFrame:
    """Stamps with slashes that are possible in some order: wall times day first and month first, and the offset."""
    x = stamps.withColumn("x", _fields(F.col("core"), SLASHED, "$1,$2,$3,$4,$5,$6,$7,$8"))
    at = lambda i: F.col("x")[i]
    a, b, year = _number(at(0)), _number(at(1)), _number(at(2))
    time = F.when(_offset_ok(at(7)), _time(at(3), at(4), at(5), at(6)))
    x = x.select("*", time.alias("time"), _day(year, b, a).alias("day_first"), _day(year, a, b).alias("month_first"), _offset(at(7)).alias("offset"))
    x = x.withColumn("day_first", F.col("day_first") + F.col("time")).withColumn("month_first", F.col("month_first") + F.col("time"))
    x = x.join(F.broadcast(zones), "zone", "left")
    known = F.col("offset").isNotNull() | F.col("offsets").isNotNull()
    return x.select("stamp_id", "source", "zone", "offset", "offsets", *[F.when(known, F.col(c)).alias(c) for c in ("day_first", "month_first")])


def votes(slashed: DataFrame) -> DataFrame:
    """(source, winner): "day" or "month" where a source's stamps of one possible order have a majority; others are left out."""
    single = slashed.select("source", F.col("day_first").isNotNull().alias("d"), F.col("month_first").isNotNull().alias("m")).filter("d <> m")
    counts = single.groupBy("source").agg(F.count_if("d").alias("d"), F.count_if("m").alias("m"))
    winner = F.when(F.col("d") > MAJORITY * F.col("m"), "day").when(F.col("m") > MAJORITY * F.col("d"), "month")
    return counts.select("source", winner.alias("winner")).filter("winner IS NOT NULL")


def normalise(stamps: DataFrame) -> DataFrame:
    """(stamp_id, utc_us, rule, ambiguous) for each of stamps(stamp_id, source, zone, raw).

    utc_us: microseconds from 1970 in UTC. rule: epoch; votes or default, where both orders of a date with slashes are
    possible and differ; bad, with utc_us null; else plain. ambiguous: votes, default, or a wall time that the zone skips
    or repeats. Null, empty and impossible stamps are bad, and so are dates without offset whose zone is null or unknown
    to the JVM; bad stamps don't vote. A null source is a source like others. Repeated rows give a result and a vote
    each; rows without stamp_id keep their result. An empty table gives none. Other columns are not looked at.

    Votes are counted before the shuffle; the winners, at most SALTS narrow rows for each source that has one, meet its
    open stamps, which are dealt over the SALTS by their own values, so no source is one task's.
    """
    spark = stamps.sparkSession
    zones = zone_offsets(spark)
    own = stamps.select("stamp_id", "source", "zone", F.trim(F.col("raw"), F.lit(SPACE)).alias("core"))
    with_slash = F.coalesce(F.col("core").contains("/"), F.lit(False))
    plain = _plain(own.filter(~with_slash), zones)
    slashed = _slashed(own.filter(with_slash), zones)
    won = votes(slashed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    is_open = F.col("day_first").isNotNull() & F.col("month_first").isNotNull() & (F.col("day_first") != F.col("month_first"))
    # Only open stamps have a salt that votes have; the others are spread over the tasks by their values.
    by_value = F.xxhash64("stamp_id", "zone", "day_first", "month_first", "offset")
    salted = slashed.withColumn("open", F.coalesce(is_open, F.lit(False)))
    salted = salted.withColumn("salt", F.when(F.col("open"), F.pmod(by_value, F.lit(SALTS))).otherwise(-1 - F.abs(by_value % (1 << 20))))
    joined = salted.alias("s").join(won.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")) & (F.col("s.salt") == F.col("w.salt")), "left")
    by_month = F.col("open") & (F.col("w.winner") == "month") | F.col("day_first").isNull()
    rule = F.when(~F.col("open"), "plain").when(F.col("w.winner").isNotNull(), "votes").otherwise("default")
    chosen = joined.select("s.stamp_id", "s.zone", "offset", "offsets", F.lit(None).cast("long").alias("epoch"), F.when(F.coalesce(by_month, F.lit(False)), F.col("month_first")).otherwise(F.col("day_first")).alias("wall"), rule.alias("rule"))
    return plain.unionByName(_answers(chosen, zones))
