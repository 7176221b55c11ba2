"""URL rules by host suffix and path prefix, applied with a sort-merge sweep.

A rule (host, path) fits a url if the url's host is the rule's host or below it and the url's path starts with the rule's path.
Written as labels from the root down and then the path, a rule is a prefix, and the urls that it fits under one host form an
interval of the sorted keys. Each url takes part once for every level of its host at which some rule stands; the sorted rows are
swept, every row sees the rule opened last, and that rule carries the stack of the rules around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules whose keys are prefixes of its key, itself included, outermost first."""
    prefixes = rules.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("outer_key"))
    outer = rules.select(F.col("key").alias("outer_key"), F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("rule").alias("rule"), F.col("action").alias("action")).alias("entry"))
    return prefixes.join(outer, "outer_key").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def apply_url_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to pages; every row stays, other columns too.

    rules: (action, host, path). The longest rule that fits wins; of equally long ones that with the deeper host, then the smaller
    text. Rules given twice count once, the first action of them in order of text. No rule: default. A null url, or one without
    ://, has an empty host and path and fits no rule. An empty table gives an empty result; an empty rule list gives default.
    Columns of pages named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    seen = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return seen.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = {(h, p): a for a, h, p in sorted(rules, reverse=True)}
    depths = sorted({len(h.split(".")) for h, _ in listed})
    rows = [(".".join(reversed(h.split("."))) + "\x00" + p, ".".join(reversed(h.split("."))), h + p, a) for (h, p), a in sorted(listed.items())]
    table = spark.createDataFrame(rows, "key string, level string, rule string, action string")
    stacks = _rule_stacks(table)

    # One row for each url text and each level of its host at which a rule stands.
    urls = seen.select("host", "path").where((F.col("host") != "") & (F.col("path") != "")).distinct()
    labels = F.reverse(F.split("host", r"\."))
    levels = F.filter(F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.when(d <= F.size("labels"), F.array_join(F.slice(F.col("labels"), F.lit(1), d), "."))), lambda x: x.isNotNull())
    points = urls.withColumn("labels", labels).select("host", "path", F.explode(levels).alias("level")).join(table.select("level").distinct(), "level", "left_semi")
    points = points.select(F.concat_ws("\x00", "level", "path").alias("key"), "host", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))

    # Ranges of the sorted keys, opening rules before urls of the same key.
    events = points.unionByName(stacks.select("key", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the bounds are sampled, so two evaluations would disagree on which rows a range holds. One key may fill many ranges.
    ranged = cut(events.repartitionByRange(n, "key", "host", "path").withColumn("part", F.spark_partition_id()))
    # What is open where a range begins: the rules that are prefixes of its first key.
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    begun = firsts.select("part", "first", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring(F.col("first"), F.lit(1), i))).alias("key"))
    begun = begun.join(stacks, "key").groupBy("part").agg(F.max_by("stack", F.length("key")).alias("begun"))
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.where(F.col("host").isNotNull()).join(begun, "part", "left")
    live = F.filter(F.coalesce("open", "begun"), lambda r: F.startswith(F.col("key"), r["key"]))  # pops the rules whose interval has ended
    swept = swept.select("host", "path", F.transform(live, lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(F.substring_index(r["key"], "\x00", 1)).alias("deep"), r["rule"].alias("rule"), r["action"].alias("action"))).alias("live"))
    best = swept.where(F.size("live") > 0).groupBy("host", "path").agg(F.max(F.array_max("live")).alias("best"))
    judged = seen.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
