"""URL rules by expressions and hash prefixes.

Each URL becomes its host suffixes times its path prefixes, written as ``host/path`` expressions. Expressions meet
the rules on the first four bytes of their SHA-256 in an equi-join; the full digest then confirms a match, and the
longest rule wins.  Partial aggregation leaves one row for each URL before anything is shuffled by row.

Only DataFrame functions are used.  Spark broadcasts the rules only while their size is under its own threshold;
larger rule tables take a shuffled join of plain tables, whose skewed prefixes Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT_VERDICT = "allow"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules or [("", "", "")], "verdict string, host string, path string").filter("verdict != ''")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row for each input row: id, host, path, rule (null where none fits) and verdict.

    rules: verdict, host, path; lower-case hosts.  A rule fits its host and all subdomains where the path starts with the
    rule's.  The longest rule wins, then the longer host; of the same rule twice a block wins.  URLs that are
    null or have no ``://`` have an empty host and path and take the default verdict.
    """
    r = rules.select("verdict", "host", "path", F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).filter("host is not null and path is not null")
    r = r.withColumn("digest", F.sha2(F.concat_ws("\x00", "host", "path"), 256)).withColumn("prefix", F.substring("digest", 1, 8))
    # which expressions can meet any rule: numbers of labels and lengths of paths, both bounded by the length of a URL
    shapes = r.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("n")).alias("ns")).head()
    label_counts, path_lengths = list(shapes["labels"] or []), list(shapes["ns"] or [])

    src = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    src = src.select("rid", "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    texts = lambda xs: F.filter(F.array(*xs).cast("array<string>"), lambda x: x.isNotNull())
    suffixes = texts([F.when(F.size(labels) >= k, F.substring_index("host", ".", -k)) for k in label_counts])
    prefixes = texts([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in path_lengths])
    exprs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\x00", h, p))))
    asked = src.select("rid", "id", "host", "path", F.explode_outer(exprs).alias("expr")).withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.substring("digest", 1, 8)).drop("expr")
    hit = r.select("prefix", F.col("digest").alias("full"), "rule", "verdict", F.struct(F.length("rule"), F.length("host"), F.col("verdict") == "block", "rule", "verdict").alias("rank"))
    joined = asked.join(hit, "prefix", "left").withColumn("rank", F.when(F.col("digest") == F.col("full"), F.col("rank")))
    best = joined.groupBy("rid").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("rank").alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
