"""Drift of embeddings between two snapshots: centroids, population stability by dimension, volume and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispark.functions.vectors import magnitude

# Cosine cuts, PSI bands, least strength of a centroid that tells anything, least share of a bucket.
SHIFTED, STABLE = 0.90, 0.98
PSI_STABLE, PSI_MODERATE = 0.10, 0.25
INFORMATIVE = 0.15
EPSILON = 1e-6
BUCKETS = 10


def _long(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.posexplode("vector").alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))


def centroid(vectors: DataFrame) -> DataFrame:
    """pos, mean: mean by position over the vectors that have the smallest id's dimension."""
    usable = vectors.filter(F.size("vector") > 0)
    dim = usable.agg(F.min_by(F.size("vector"), "id").alias("dim"))
    same = usable.join(F.broadcast(dim), F.size("vector") == F.col("dim"))  # one row
    return _long(same).groupBy("pos").agg(F.avg("x").alias("mean"))


def centroid_strength(vectors: DataFrame) -> DataFrame:
    """One row: norm of the centroid over the mean norm; 0 without vectors."""
    top = centroid(vectors).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("c"))
    norms = vectors.filter(F.size("vector") > 0).agg(F.avg(magnitude(F.col("vector"))).alias("m"))
    return top.crossJoin(F.broadcast(norms)).select(F.when(F.col("m") > 0, F.col("c") / F.col("m")).otherwise(F.lit(0.0)).alias("strength"))


def centroid_similarity(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: cosine of the two centroids."""
    both = centroid(baseline).withColumnRenamed("mean", "a").join(centroid(current).withColumnRenamed("mean", "b"), "pos")
    norm = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return both.agg((F.sum(F.col("a") * F.col("b")) / norm).alias("similarity"))


def psi_by_dimension(baseline: DataFrame, current: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """pos, psi: buckets end at the baseline's values at the ranks int(n (i + 1) / buckets); null where the baseline has fewer values than buckets.

    Ranks come from counts of equal values, cumulated first over coarse and then within them, so one position's values never
    meet in one task."""
    base = _long(baseline.filter(F.size("vector") > 0))
    now = _long(current.filter(F.size("vector") > 0))
    coarse = F.floor(F.col("x") * 256).cast("long")
    counts = base.groupBy("pos", coarse.alias("cell"), "x").agg(F.count(F.lit(1)).alias("k"))
    cells = counts.groupBy("pos", "cell").agg(F.sum("k").alias("k"))
    within = Window.partitionBy("pos").orderBy("cell")
    cells = cells.select("pos", "cell", (F.sum("k").over(within) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("pos")).alias("n"))
    ranked = counts.join(cells, ["pos", "cell"]).withColumn("upto", F.sum("k").over(Window.partitionBy("pos", "cell").orderBy("x")) + F.col("before"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.floor(F.col("n") * i / buckets))
    hit = F.filter(cut, lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("k")))
    edges = ranked.filter(F.col("n") >= buckets).select("pos", F.explode(F.transform(hit, lambda r: F.col("x"))).alias("edge")).groupBy("pos").agg(F.array_sort(F.collect_list("edge")).alias("edges"))  # buckets - 1 each

    def shares(side: DataFrame) -> DataFrame:
        own = side.join(F.broadcast(edges), "pos").select("pos", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bucket"))
        by = own.groupBy("pos", "bucket").agg(F.count(F.lit(1)).alias("k"))
        return by.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("pos"))).select("pos", "bucket", "share")  # at most buckets rows each

    grid = edges.select("pos", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    met = grid.join(shares(base).withColumnRenamed("share", "b"), ["pos", "bucket"], "left").join(shares(now).withColumnRenamed("share", "c"), ["pos", "bucket"], "left")
    b, c = F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(EPSILON)), F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(EPSILON))
    measured = met.groupBy("pos").agg(F.round(F.sum((c - b) * F.log(c / b)), 4).alias("psi"))
    return cells.select("pos").distinct().join(measured, "pos", "left")


def drift(baseline: DataFrame, current: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: verdict (stable, drifting, shifted, unmeasurable) and what it rests on.

    Unmeasurable: no vectors on a side, or more than one dimension; the score is then null."""
    sizes = lambda s, p: s.agg(F.count(F.lit(1)).alias(f"{p}_count"), F.count(F.when(F.size("vector") > 0, 1)).alias(f"{p}_vectors"), F.min(F.when(F.size("vector") > 0, F.size("vector"))).alias(f"{p}_lo"), F.max(F.when(F.size("vector") > 0, F.size("vector"))).alias(f"{p}_hi"))
    psi = psi_by_dimension(baseline, current, buckets)
    n = F.least("b_vectors", "c_vectors")
    rows = sizes(baseline, "b").crossJoin(F.broadcast(sizes(current, "c"))).crossJoin(F.broadcast(centroid_similarity(baseline, current)))
    rows = rows.crossJoin(F.broadcast(centroid_strength(baseline).withColumnRenamed("strength", "bs"))).crossJoin(F.broadcast(centroid_strength(current).withColumnRenamed("strength", "cs")))
    rows = rows.crossJoin(F.broadcast(psi.agg(F.round(F.avg("psi"), 4).alias("psi_mean"), F.max("psi").alias("psi_max"), F.collect_list("psi").alias("psis"))))  # one value a dimension
    rows = rows.withColumn("noise_floor", F.round(2.0 * (buckets - 1) / F.greatest(F.lit(1), n), 4))
    rows = rows.withColumn("stable_at", F.greatest(F.lit(PSI_STABLE), F.col("noise_floor") * 2)).withColumn("moderate_at", F.greatest(F.lit(PSI_MODERATE), F.col("noise_floor") * 3))
    rows = rows.withColumn("informative", F.least("bs", "cs") >= INFORMATIVE).withColumn("similarity", F.round("similarity", 4))
    unmeasurable = (n == 0) | (F.col("b_lo") != F.col("b_hi")) | (F.col("c_lo") != F.col("c_hi")) | (F.col("b_lo") != F.col("c_lo")) | F.col("psi_mean").isNull()
    shifted = (F.col("informative") & (F.col("similarity") < SHIFTED)) | (F.col("psi_mean") > F.col("moderate_at"))
    drifting = (F.col("informative") & (F.col("similarity") < STABLE)) | (F.col("psi_mean") > F.col("stable_at"))
    verdict = F.when(unmeasurable, "unmeasurable").when(shifted, "shifted").when(drifting, "drifting").otherwise("stable")
    cos = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") - SHIFTED) / (1 - SHIFTED))) * 100
    by_psi = F.greatest(F.lit(0.0), 1 - F.col("psi_mean") / (F.col("moderate_at") * 2)) * 100
    score = F.when(verdict != "unmeasurable", F.round(F.when(F.col("informative"), F.least(cos, by_psi)).otherwise(by_psi), 1))
    unstable = F.size(F.filter("psis", lambda p: p > F.col("moderate_at")))
    return rows.select(
        verdict.alias("verdict"), "similarity", "informative", "psi_mean", "psi_max", "noise_floor", F.col("stable_at").alias("stable_threshold"), unstable.alias("unstable_dimensions"), F.col("b_count").alias("baseline_count"),
        F.col("c_count").alias("current_count"), F.when(F.col("b_count") > 0, F.round(F.col("c_count") / F.col("b_count"), 3)).alias("volume_ratio"), score.alias("drift_stability"),
    )


def drift_findings(report: DataFrame) -> DataFrame:
    f = lambda check, severity, article: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit("flag").alias("action"), F.lit(article).cast("string").alias("article"))
    v = F.col("volume_ratio")
    found = F.array(
        F.when(F.col("verdict") == "unmeasurable", f("drift_unmeasurable", "medium", "Art. 15")),
        F.when(F.col("verdict") == "shifted", f("corpus_semantic_shift", "high", "Art. 15")),
        F.when(F.col("verdict") == "drifting", f("corpus_drift", "medium", "Art. 15")),
        F.when((v > 2) | (v < 0.5), f("corpus_volume_change", "medium", None)),
    )
    return report.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.*")
