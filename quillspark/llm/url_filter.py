"""URL filters by sort-merge range joins of canonical keys. DataFrame operations only.

A host's key is its labels in reverse, each with a dot after it, so that a rule's host with all its subdomains is one
interval of keys. Rule starts and URL keys are sorted together; a sweep in key order keeps the stack of rules that are
open at each place: what the last rule start before a key has on its stack, without those that the key has left. A
first sweep over distinct hosts finds the nested rule hosts of each; a second one, over keys of rule host and path,
the innermost path rule for each of those. Keys are distinct in either sweep, so that no key is hot, and a range
partition begins with the stack that the partitions before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.frames import cut, partitions_for, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between a rule host's key and a path; below all other characters, so that a host's paths come right after it.
_END = "\x00"


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(rules: DataFrame, probes: DataFrame, parts: int) -> DataFrame:
    """probes(key) with stack: the keys of rules(key, stack) that are prefixes of key, outermost first.

    rules' own stack lists the rules that are prefixes of its key, itself last. Keys are distinct on either side.
    """
    events = rules.select("key", F.lit(0).alias("kind"), "stack").unionByName(probes.select("key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack")))
    events = cut(events.repartitionByRange(parts, "key", "kind").withColumn("part", F.spark_partition_id()))
    # One row for each range partition: the stack at its end. At most `parts` rows meet in one task.
    ends = events.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    every = events.select("part").distinct().join(ends, "part", "left")
    before = every.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(F.broadcast(before), "part").withColumn("open", F.coalesce(F.last("stack", ignorenulls=True).over(order), "carried"))
    probe = swept.filter("kind = 1")
    return probe.select("key", F.filter(F.coalesce("open", F.array().cast("array<string>")), lambda r: F.startswith(F.col("key"), r)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    rules(verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's. Of
    the rules that fit, the longest (host and path together; then the longer host) wins; rule is its host and path.
    Without one, rule is null and the verdict is default. Of equal rules, the least verdict in alphabetical order
    counts. Null URLs and those without :// have an empty host and path, which no rule fits. Rules with nulls are
    ignored; an empty path fits all. Repeated pages are judged alike; without rules all get the default.
    """
    spark = pages.sparkSession
    known = rules.filter("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL AND host != ''")
    known = known.groupBy(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("rule_verdict"))
    known = cut(known.withColumn("rule_key", host_key(F.col("rule_host"))))

    # Rule hosts, each with the rule hosts that contain it.
    hosts = known.select("rule_key").distinct()
    labels = F.split("rule_key", r"\.", -1)
    outer = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    nested = hosts.select(F.col("rule_key").alias("key"), F.explode(outer).alias("rule_key")).join(hosts, "rule_key")
    nested = nested.groupBy("key").agg(F.array_sort(F.collect_list("rule_key")).alias("stack"))  # prefixes sort by length

    seen = pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).distinct().filter("host != ''")
    seen = cut(seen.withColumn("key", host_key(F.col("host"))))
    parts = partitions_for(spark, seen.count())
    open_hosts = _sweep(nested, seen.select("key").distinct(), parts).filter(F.size("stack") > 0)

    # Path rules of one host, each with those that contain it.
    own = known.withColumn("key", F.concat("rule_key", F.lit(_END), "rule_path"))
    lengths = known.groupBy("rule_key").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    shorter = own.join(lengths, "rule_key").select("key", "rule_key", "rule_path", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("rule_path"))
    shorter = shorter.select("key", F.concat("rule_key", F.lit(_END), F.expr("substring(rule_path, 1, n)")).alias("prefix"))
    nested_paths = shorter.join(own.select(F.col("key").alias("prefix")), "prefix").groupBy("key").agg(F.array_sort(F.collect_list("prefix")).alias("stack"))

    probes = seen.join(open_hosts, "key").select("host", "path", F.explode("stack").alias("rule_key"))
    probes = cut(probes.withColumn("key", F.concat("rule_key", F.lit(_END), "path")))
    inner = _sweep(nested_paths, probes.select("key").distinct(), parts).select(F.col("key").alias("probe"), F.try_element_at("stack", F.lit(-1)).alias("key"))
    inner = inner.filter("key IS NOT NULL").join(own, "key").select("probe", "rule_host", "rule_path", "rule_verdict")
    fits = probes.withColumnRenamed("key", "probe").join(inner, "probe")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    found = fits.groupBy("host", "path").agg(best.alias("best"))
    # Pages without a host have no rule: each gets a key that none of the verdicts has, or all of them would be one key.
    added = ("host", "path", "rule", "verdict")
    others = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    key, own_host, own_path, chosen = unused(pages, "_key", "_host", "_path", "_best")
    nowhere = F.concat(F.lit("\x00"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    judged = pages.select(*others, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    judged = judged.withColumn(key, F.when(F.col("host") != "", F.col("host")).otherwise(nowhere))
    verdicts = found.select(F.col("host").alias(own_host), F.col("path").alias(own_path), F.col("best").alias(chosen))
    joined = judged.join(verdicts, (F.col(key) == F.col(own_host)) & (F.col("path") == F.col(own_path)), "left")
    return joined.select(*others, "host", "path", F.col(f"{chosen}.rule").alias("rule"), F.coalesce(F.col(f"{chosen}.verdict"), F.lit(default)).alias("verdict"))
