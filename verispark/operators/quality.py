"""Corpus quality: counts, duplicates, lengths, near duplicates, the composite score and its findings.

Chunks have id, text, vector (and what else they like).  Every statistic covers all rows; a sample is taken only where ``sample`` is given,
and the result then says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispark.functions import pii
from verispark.functions.scores import harmonic, score_from_ratio
from verispark.functions.text import blank_words, fingerprint, length, shingles, stripped

NEAR_EMPTY = 40
NEAR_DUPLICATE = 0.85
SHORT, LONG = 0.25, 4.0
SAMPLE = 2000


def _flags(chunks: DataFrame) -> DataFrame:
    body = F.length(stripped(F.col("text")))
    return chunks.select(
        "id", length(F.col("text")).alias("length"), (body == 0).alias("empty"), ((body > 0) & (body < NEAR_EMPTY)).alias("near_empty"),
        (F.coalesce(F.size("vector"), F.lit(0)) <= 0).alias("orphan"), F.when(body > 0, fingerprint(F.col("text"))).alias("fingerprint"),
    )


def quality_counts(chunks: DataFrame) -> DataFrame:
    """One row: total, empty, near_empty, orphans."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias({"orphan": "orphans"}.get(c, c))
    return _flags(chunks).agg(F.count(F.lit(1)).alias("total"), n("empty"), n("near_empty"), n("orphan"))


def exact_duplicates(chunks: DataFrame) -> DataFrame:
    """One row for each fingerprint of two or more chunks: fingerprint, copies and the first id.  Blank texts have none."""
    return _flags(chunks).filter("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def duplicate_summary(chunks: DataFrame) -> DataFrame:
    """One row: groups and redundant copies."""
    return exact_duplicates(chunks).agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_chunks"))


def dimension_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("dimension")).agg(F.count(F.lit(1)).alias("chunks"))


def length_stats(chunks: DataFrame) -> DataFrame:
    """One row over the chunks that have a length: min, max, mean, exact median, population deviation; nulls if there are none.

    The median counts equal lengths first, so it shuffles distinct lengths only."""
    return _size_stats(chunks.select(length(F.col("text")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k")))


def _size_stats(sizes: DataFrame) -> DataFrame:
    """From lengths n of k chunks each."""
    n = F.when(F.col("n") > 0, F.col("n"))
    k = F.when(F.col("n") > 0, F.col("k"))
    return sizes.agg(
        F.min(n).alias("min_length"), F.max(n).alias("max_length"), (F.sum(n * k) / F.sum(k)).alias("mean_length"), F.percentile(n, F.lit(0.5), F.coalesce(k, F.lit(0))).alias("median_length"),
        F.sqrt(F.greatest(F.lit(0.0), (F.sum(n.cast("double") * n * k) / F.sum(k)) - F.pow(F.sum(n.cast("double") * k) / F.sum(k), F.lit(2.0)))).alias("stdev_length"),
    )


def _tally(chunks: DataFrame) -> DataFrame:
    """One row: total, empty, near_empty, orphans, duplicate_chunks, short, oversized, dimensions.

    Chunks alike in all of these are counted once, in one pass over the texts; the parts read that exchange again, so no filter may reach below it."""
    keys = ["length", "empty", "near_empty", "orphan", "fingerprint"]
    rows = _flags(chunks.select("id", "text", "vector")).drop("id")
    dims = chunks.select(F.coalesce(F.size("vector"), F.lit(-1)).alias("dimension")).groupBy("dimension").agg(F.count(F.lit(1)).alias("k"))
    alike = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("k"))), F.lit(0))
    counts = alike.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), n("empty").alias("empty"), n("near_empty").alias("near_empty"), n("orphan").alias("orphans"))
    copies = alike.groupBy("fingerprint").agg((F.sum("k") - 1).alias("more")).agg(F.coalesce(F.sum(F.when(F.col("fingerprint").isNotNull(), F.col("more"))), F.lit(0)).alias("duplicate_chunks"))
    sizes = alike.groupBy(F.col("length").alias("n")).agg(F.sum("k").alias("k"))
    median = F.broadcast(_size_stats(sizes).select("median_length"))  # one row, as the others
    out = lambda when: F.coalesce(F.sum(F.when((F.col("n") > 0) & when, F.col("k"))), F.lit(0))
    odd = sizes.crossJoin(median).agg(out(F.col("n") < F.col("median_length") * SHORT).alias("short"), out(F.col("n") > F.col("median_length") * LONG).alias("oversized"))
    held = dims.agg(F.count(F.when(F.col("dimension") > 0, F.lit(1))).alias("dimensions"))
    return counts.crossJoin(F.broadcast(copies)).crossJoin(F.broadcast(odd)).crossJoin(F.broadcast(held))


def length_outliers(chunks: DataFrame) -> DataFrame:
    """id, length, kind (short or long) of the chunks below a quarter of the median or above four times it."""
    sized = chunks.select("id", length(F.col("text")).alias("length")).filter("length > 0")
    median = F.broadcast(length_stats(chunks).select("median_length"))  # one row
    kind = F.when(F.col("length") < F.col("median_length") * SHORT, "short").when(F.col("length") > F.col("median_length") * LONG, "long")
    return sized.crossJoin(median).withColumn("kind", kind).filter("kind is not null").select("id", "length", "kind")


def pii_chunks(chunks: DataFrame) -> DataFrame:
    """id and categories of the chunks that hold personal data."""
    return chunks.select("id", pii.categories(F.col("text")).alias("categories")).filter(F.size("categories") > 0)


def pii_rollup(chunks: DataFrame) -> DataFrame:
    """Chunks by category."""
    return pii_chunks(chunks).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))


def systematic_sample(chunks: DataFrame, sample: int) -> DataFrame:
    """Every (n / sample)-th chunk in the order of ids; all if there are no more.

    Positions come from counts of range partitions, so no task sees all rows."""
    ordered = chunks.repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = ordered.join(F.broadcast(before), "_part").withColumn("_pos", F.col("_before") + F.col("_at"))  # one row a partition
    nth = F.ceil(F.col("_pos") * sample / F.col("_total"))
    chosen = (F.col("_total") <= sample) | ((nth < sample) & (F.floor(nth * F.col("_total") / sample) == F.col("_pos")))
    return placed.filter(chosen).select(chunks.columns)


def near_duplicates(chunks: DataFrame, least: float = NEAR_DUPLICATE, sample: int | None = None) -> DataFrame:
    """Pairs (id_a < id_b, jaccard) of distinct texts whose 5-word shingles overlap by ``least`` or more.

    Of chunks with the same fingerprint the first stands for all; its copies are the rows of the duplicate groups. With ``sample`` only so many chunks
    are compared.  The join is exact: two sets this similar share one of their rarest shingles, so only the rarest
    ``n - ceil(least * n) + 1`` of each chunk are joined, then whole sets are compared.  Words are split once a text, and the sets are dealt by id
    once: what counts shingles, ranks them and compares whole sets reads the same exchange."""
    rows = chunks.select("id", "text").filter(F.col("id").isNotNull() & (stripped(F.col("text")) != ""))
    if sample:
        rows = systematic_sample(rows, sample)
    first = rows.withColumn("fp", fingerprint(F.col("text"))).groupBy("fp").agg(F.min(F.struct("id", "text")).alias("r")).select("r.id", "r.text")
    hashed = F.transform(shingles(F.col("words")), lambda s: F.xxhash64(s))
    cut = first.select("id", blank_words(F.col("text")).alias("words"))
    sets = cut.select("id", F.array_distinct(hashed).alias("set")).repartition("id").withColumn("n", F.size("set"))
    grams = sets.select("id", "n", F.explode("set").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = grams.join(often, "gram", "left").select("id", "n", "gram", F.coalesce("df", F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram"))
    keys = ranked.withColumn("place", place).filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1) & (F.col("df") > 1)).select("id", "n", "gram")
    a, b = keys.alias("a"), keys.alias("b")
    fits = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least)
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & fits).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    whole = pairs.join(sets.select(F.col("id").alias("id_a"), F.col("set").alias("sa")), "id_a").join(sets.select(F.col("id").alias("id_b"), F.col("set").alias("sb")), "id_b")
    both = F.size(F.array_intersect("sa", "sb"))
    return whole.select("id_a", "id_b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).filter(F.col("jaccard") >= least)


def quality_score(chunks: DataFrame) -> DataFrame:
    """One row: the four parts, whether mixed dimensions cap the score at 40, and the score; null over no chunks."""
    row = _tally(chunks).withColumn("outliers", F.col("short") + F.col("oversized"))
    n = F.greatest(F.col("total"), F.lit(1))
    part = lambda bad: score_from_ratio(1 - bad / n, 1.0, None)
    parts = row.select(
        "total", part(F.col("empty") + F.col("near_empty")).alias("content"), part(F.col("orphans")).alias("retrievable"), part(F.col("duplicate_chunks")).alias("distinct_"), part(F.col("outliers")).alias("sizing"),
        (F.col("dimensions") > 1).alias("capped"),
    )
    value = harmonic(F.col("content"), F.col("retrievable"), F.col("distinct_"), F.col("sizing"), digits=None)
    value = F.when(F.col("total") == 0, F.lit(None).cast("double")).when(F.col("capped"), F.least(value, F.lit(40.0))).otherwise(value)
    return parts.withColumn("quality_score", value).withColumnRenamed("distinct_", "distinctness")


def quality_findings(chunks: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """check, severity, action, article, count: one row for each condition that holds."""
    row = _tally(chunks).crossJoin(pii_chunks(chunks).agg(F.count(F.lit(1)).alias("personal")))
    row = row.crossJoin((near if near is not None else near_duplicates(chunks)).agg(F.count(F.lit(1)).alias("near")))

    def one(check: str, severity: Column | str, action: str, article: str | None, count: str, when: Column) -> Column:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(check).alias("check"), severity.alias("severity"), F.lit(action).alias("action"), F.lit(article).cast("string").alias("article"), F.col(count).cast("long").alias("count")))

    c, some = F.col, lambda x: F.col(x) > 0
    found = F.array(
        one("empty_corpus", "high", "flag", "Art. 10", "total", c("total") == 0),
        one("empty_chunks", "medium", "flag", "Art. 10", "empty", some("empty")),
        one("near_empty_chunks", "low", "flag", "Art. 10", "near_empty", some("near_empty")),
        one("unembedded_chunks", F.when(c("orphans") > c("total") * 0.02, "high").otherwise("medium"), "flag", "Art. 10", "orphans", some("orphans")),
        one("mixed_embedding_dimensions", "critical", "block", "Art. 15", "dimensions", c("dimensions") > 1),
        one("duplicate_chunks", F.when(c("duplicate_chunks") * 100 > c("total") * 10, "high").otherwise("medium"), "flag", "Art. 10", "duplicate_chunks", some("duplicate_chunks")),
        one("near_duplicate_chunks", "medium", "flag", "Art. 10", "near", some("near")),
        one("oversized_chunks", "low", "flag", None, "oversized", some("oversized")),
        one("personal_data_in_corpus", "high", "flag", "Art. 10 / GDPR Art. 5(1)(c)", "personal", some("personal")),
    )
    return row.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("f.*")


def finding_samples(chunks: DataFrame, near: DataFrame | None = None, most: int = 10, pairs: int = 5) -> DataFrame:
    """check, first, second: the first ``most`` ids of each finding about chunks, and the first ``pairs`` pairs of near duplicates.

    A top-k by id for each check, so no list of ids is gathered."""
    long_ = length_outliers(chunks).filter("kind = 'long'").select(F.col("id").alias("first"))
    flags = _flags(chunks)
    out = None
    for check, rows in (
        ("empty_chunks", flags.filter("empty").select(F.col("id").alias("first"))), ("near_empty_chunks", flags.filter("near_empty").select(F.col("id").alias("first"))),
        ("unembedded_chunks", flags.filter("orphan").select(F.col("id").alias("first"))), ("oversized_chunks", long_),
    ):
        own = rows.orderBy("first").limit(most).select(F.lit(check).alias("check"), "first", F.lit(None).cast("string").alias("second"))
        out = own if out is None else out.unionByName(own)
    if near is not None:
        a, b = near.columns[:2]
        out = out.unionByName(near.orderBy(a, b).limit(pairs).select(F.lit("near_duplicate_chunks").alias("check"), F.col(a).alias("first"), F.col(b).alias("second")))
    return out
