"""URL filters by a sort-merge range join (DataFrame functions only).

A host is keyed by its reversed labels, each closed by '/', the one character that no host holds:
www.example.com is com/example/www/. A rule's host and all its subdomains are then the interval
[key, key with '0' for the last '/'), and intervals of rules nest or are disjoint. One sorted sweep
over URLs and interval ends keeps the stack of rules that are open at each key; among these a URL
takes the longest one whose path begins its own path.

Hot hosts: the sweep runs in as many salted copies as there are shuffle partitions. URLs are dealt by
a hash of the whole row, so one host spreads evenly, and only the interval ends (two a rule) are
copied to each salt. No Python runs on executors.

Defined results: null URLs and URLs without '://' have empty host and path and get the default verdict;
equal rules count once and rules with a null don't count; of rules of one length the one with the longer host wins, then 'block';
an empty table gives an empty table; input columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import ascii_lower, col, others, parts_of

#: host, path, verdict
Rule = tuple[str, str, str]
OUTPUTS = ("host", "path", "rule", "verdict")
RULE_TYPE = "array<struct<length:int,host_length:int,verdict:string,path:string,rule:string>>"


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """A list of rules as a table (host, path, verdict): literals of the plan, so a short list."""
    given = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(given.cast("array<struct<host:string,path:string,verdict:string>>")))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules open from each interval end on, shortest first."""
    rows = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    rows = rows.withColumn("key", _key(F.col("host")))
    keys = rows.select("key").distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "/", -1)
    # a start opens the rules of its own key and of all its prefixes; an end leaves those of its proper prefixes
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "/"), F.lit("/")))
    starts = keys.select(F.col("key").alias("at"), F.explode(prefixes).alias("key"))
    ends = keys.select(F.expr("concat(substring(key, 1, length(key) - 1), '0')").alias("at"), F.explode(prefixes).alias("prefix"), F.col("key").alias("own"))
    ends = ends.select("at", F.when(F.col("prefix") != F.col("own"), F.col("prefix")).alias("key"))
    entry = F.struct(
        (F.length("host") + F.length("path")).cast("int").alias("length"), F.length("host").cast("int").alias("host_length"), "verdict", "path", F.concat("host", "path").alias("rule")
    )
    return starts.union(ends).join(rows.select("key", entry.alias("entry")), "key", "left").groupBy("at").agg(F.sort_array(F.collect_list("entry")).cast(RULE_TYPE).alias("stack")).withColumnRenamed("at", "key")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: a table (host, path, verdict) of any size, or a short list; only their intervals' ends are copied to each salt."""
    spark = pages.sparkSession
    url = col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    kept = others(pages, *OUTPUTS)
    row = F.struct(*map(col, kept)) if kept else F.struct(F.lit(1).alias("_"))
    split = pages.select(row.alias("_row"), F.coalesce(F.when(url.isNotNull(), rest), F.lit("")).alias("_rest"))
    split = split.select("_row", ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)).alias("_host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("_path"))
    if isinstance(rules, DataFrame) or rules:
        n = parts_of(spark)
        probes = split.select(F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int").alias("_salt"), _key(F.col("_host")).alias("_key"), F.lit(1).alias("_kind"), "_row", "_host", "_path", F.lit(None).cast(RULE_TYPE).alias("_open"))
        ends = _boundaries(rules if isinstance(rules, DataFrame) else rule_table(spark, rules)).select(
            F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_salt"), F.col("key").alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"), F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"), F.col("stack").alias("_open")
        )
        sweep = Window.partitionBy("_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        split = probes.unionByName(ends).withColumn("_stack", F.last("_open", ignorenulls=True).over(sweep)).filter("_kind = 1")
        split = split.withColumn("_best", F.expr("try_element_at(filter(_stack, r -> startswith(_path, r.path)), -1)"))
        rule, verdict = F.col("_best.rule"), F.coalesce(F.col("_best.verdict"), F.lit(default))
    else:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
    return split.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))
