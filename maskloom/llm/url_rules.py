"""Block and allow rules for urls by a sort-merge range join.

A key is the reversed host, a separator and the path, so a rule for a path prefix is an
interval of keys, and the intervals of all rules are nested or apart.  A rule also fits
subdomains, so a url asks with one key for each parent of its host.  Keys and the ends
of intervals are sorted together over the cluster; a sweep over each sorted run keeps a
stack of active rules, whose top is the longest rule for a key.  The stack is two window
functions: the depth is a running sum of starts and ends, and the entry at a depth is the
last start at that depth.  A rule that is active where a run begins is entered there again.

Runs are cut by key and row id, so that a host or url with a third of all rows spreads
over many runs.  Only built-in functions are used.

Results for odd input: a null url, and one without ``://``, has an empty host and path,
fits no rule and gets the default verdict; repeated rows are judged one by one and null
ids are kept; of rules with the same host and path, block wins; with no rules everything
gets the default; an empty host or path in a rule counts as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query: host, path, verdict.
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _ASK, _END = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Sorts as bytes; the separator is less than any character of a host."""
    return F.encode(F.concat(F.array_join(F.reverse(labels), "."), F.lit("\x00"), path), "utf-8")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def match(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict`` of every row.

    Of rules of equal length on different parents of a host, the one with the longer host wins.
    """
    spark = urls.sparkSession
    rows = urls.select(
        F.xxhash64(key, url).alias("row"), F.col(key).alias("key"), host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels) - i + 1))
    asked = rows.where("host <> ''").select("row", "path", F.explode(parents).alias("labels")).select(
        "row", _key(F.col("labels"), F.col("path")).alias("at"))
    known = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path").agg(F.max(F.col("verdict") == BLOCK).alias("blocks"))
        .select(_key(F.split("host", r"\."), F.col("path")).alias("first"),
                F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
                         F.concat("host", "path").alias("rule"), "blocks").alias("is"))
    )
    no_rule = F.lit(None).cast(known.schema["is"].dataType)
    ends = F.concat("first", F.lit(b"\xff"))  # no UTF-8 text holds this byte
    events = (
        asked.select("at", F.lit(_ASK).alias("kind"), "row", no_rule.alias("is"), F.lit(None).cast("binary").alias("first"))
        .unionByName(known.select(F.col("first").alias("at"), F.lit(_START).alias("kind"),
                                  F.length("first").cast("long").alias("row"), "is", "first"))
        # Of intervals that end together the inner one ends first.
        .unionByName(known.select(ends.alias("at"), F.lit(_END).alias("kind"),
                                  (-F.length("first")).cast("long").alias("row"), "is", "first"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: a run keeps its number and its rows if a task runs again.
    runs = cut_lineage(
        events.repartitionByRange(parts, "at", "kind", "row").withColumn("run", F.spark_partition_id()))
    open_at = runs.where(F.col("kind") == _START).select("first", "is", F.col("run").alias("opens")).join(
        runs.where(F.col("kind") == _END).select("first", F.col("run").alias("closes")), "first")
    # As many rows for a run as rules are nested where it begins.
    entered = open_at.where("closes > opens").select(
        F.explode(F.sequence(F.col("opens") + 1, "closes")).alias("run"), F.lit(b"").alias("at"),
        F.lit(_START).alias("kind"), F.length("first").cast("long").alias("row"), "is", "first")
    sweep = Window.partitionBy("run").orderBy("at", "kind", "row")
    level = Window.partitionBy("run", "depth").orderBy("at", "kind", "row")
    step = F.when(F.col("kind") == _START, 1).when(F.col("kind") == _END, -1).otherwise(0)
    found = (
        runs.unionByName(entered).withColumn("depth", F.sum(step).over(sweep))
        .withColumn("top", F.last(F.when(F.col("kind") == _START, F.col("is")), ignorenulls=True).over(level))
        .where((F.col("kind") == _ASK) & (F.col("depth") > 0))
        .groupBy("row").agg(F.max("top").alias("top"))
    )
    verdict = F.when(F.col("top").isNull(), default).when(F.col("top.blocks"), BLOCK).otherwise(ALLOW)
    return rows.join(found, "row", "left").select(
        F.col("key").alias(key), "host", "path", F.col("top.rule").alias("rule"), verdict.alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return match(pages, rule_table(pages.sparkSession, RULES))


ORACLE = rf"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         row_number() OVER () AS r FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (
  SELECT r, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
"""
