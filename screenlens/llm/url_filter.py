"""URL rules by a sort-merge range join.

A prefix is an interval of sorted keys. Hosts are keyed by their labels in reverse order (``org.example.www.``), so a
rule's host and all its subdomains are one interval; below one rule host, a path prefix is an interval again. Two sweeps
follow: distinct hosts against rule hosts (every rule host that holds the host), then (rule host, path) against the
rules (the longest that holds). Each sweep range-partitions its points, sends each interval to the partitions that it
overlaps, sorts both together and passes over them once with a stack of the intervals that are open. Ties of the sort
are broken by the row's own id, so a URL that makes up a third of the table still spreads over partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlens.llm.common import ascii_lower, only
from screenlens.session import materialize

#: Sorts after whatever else may follow a prefix.
LAST = "\U0010ffff"
#: Verdict where no rule fits.
DEFAULT = "allow"

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(batches: Iterator[pd.DataFrame], longest: bool) -> Iterator[pd.DataFrame]:
    """Open prefixes of every point, in sorted rows (key, kind 0 for a prefix and 1 for a point, id)."""
    stack: list[str] = []
    for batch in batches:
        ids, found = [], []
        for key, kind, row_id in zip(batch["key"], batch["kind"], batch["id"], strict=True):
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            if not kind:
                if not stack or stack[-1] != key:  # an interval comes once for every partition it overlaps
                    stack.append(key)
            elif stack:
                ids.append(row_id)
                found.append(stack[-1:] if longest else list(stack))
        if ids:
            yield pd.DataFrame({"id": ids, "prefixes": found})


def open_prefixes(points: DataFrame, prefixes: DataFrame, longest: bool) -> DataFrame:
    """id, prefixes (array): the prefixes that each point's key starts with, or only the longest.

    ``points`` has id (long, unique) and key, ``prefixes`` has key. Points without any give no row.
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(
        points.select("id", "key").repartitionByRange(parts, "key", "id").withColumn("part", F.spark_partition_id()),
        "url-points",
    )
    # at most one row per partition: the first and last key of each, for sending intervals where they overlap
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect()
    own = prefixes.select("key").distinct()
    if not edges:
        return spark.createDataFrame([], "id long, prefixes array<string>")
    part, low, high = [e["part"] for e in edges], [e["low"] for e in edges], [e["high"] for e in edges]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to = [(k, p) for k in batch["key"] for p in part[bisect_left(high, k) : bisect_right(low, k + LAST)]]
            yield pd.DataFrame(to, columns=["key", "part"])

    sent = own.mapInPandas(send, "key string, part int")
    both = dealt.select("part", "key", F.lit(1).alias("kind"), "id").unionByName(
        sent.select("part", "key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("id"))
    )
    return (
        both.repartitionByRange(len(edges), "part")
        .sortWithinPartitions("part", "key", "kind")
        .select("key", "kind", "id")
        .mapInPandas(lambda batches: _sweep(batches, longest), "id long, prefixes array<string>")
    )


def url_filter(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """id_col, host, path, rule (host and path of the longest rule that fits, or null), verdict: one row per input row.

    A rule (verdict, host, path) fits its host and all its subdomains if the URL's path starts with the rule's; the
    longest text of host and path wins, among equally long ones the longer host. ``default`` is the verdict where no
    rule fits: a list of rules names what differs from what is otherwise done.

    A null URL or one without ``://`` has an empty host and path, which no rule fits. Of rules that repeat a host and
    path, ``block`` wins. Rules with a null or empty host are ignored, a null path is empty. Repeated pages and null ids
    stay rows of their own. Empty tables: no rows, or only the default. Columns that clash are ignored.
    """
    host, path = url_parts(F.col("url"))
    own = only(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "urls")
    known = (
        rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("host_key", host_key(F.col("host")))
        .withColumn("key", F.concat("host_key", F.lit("\n"), "path"))
    )
    hosts = own.where("host <> ''").groupBy("host").agg(F.min("row").alias("id"))
    held = open_prefixes(
        hosts.select("id", host_key(F.col("host")).alias("key")), known.select(F.col("host_key").alias("key")), False
    )
    by_host = hosts.join(held, "id").select(F.col("host").alias("h"), "prefixes")
    below = materialize(
        own.join(by_host, F.col("host") == F.col("h"))
        .select("row", "path", F.explode("prefixes").alias("host_key"))
        .select("row", F.concat("host_key", F.lit("\n"), "path").alias("key"))
        .withColumn("id", F.monotonically_increasing_id()),
        "urls-below-hosts",
    )
    fits = open_prefixes(below, known, True).select("id", F.col("prefixes")[0].alias("rule_key"))
    named = (
        fits.join(below.select("id", "row"), "id")
        .join(known.withColumnRenamed("key", "rule_key").withColumnRenamed("path", "rule_path"), "rule_key")
        .select("row", F.col("host").alias("rule_host"), "rule_path", F.col("verdict").alias("said"))
    )
    best = named.groupBy("row").agg(
        F.max_by(
            F.struct(F.concat("rule_host", "rule_path").alias("rule"), "said"),
            F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host")),
        ).alias("best")
    )
    return own.join(best.withColumnRenamed("row", "best_row"), F.col("row") == F.col("best_row"), "left").select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.said", F.lit(default)).alias("verdict"),
    )


#: DuckDB SQL for ``url_filter`` over pages with RULES; the longest rule is the first that fits.
SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0, 's') AS raw FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0, 's') AS path
  FROM h
), v AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
