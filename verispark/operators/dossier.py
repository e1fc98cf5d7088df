"""Coverage of the sections of a technical file by narrative and machine evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, reference, sources of evidence.
SECTIONS: list[tuple[str, str, list[str]]] = [
    ("general_description", "Annex IV(1)", []),
    ("development_process", "Annex IV(2)(a-b)", ["core.models"]),
    ("data_requirements", "Annex IV(2)(d)", ["rag.quality", "rag.bias", "rag.drift"]),
    ("human_oversight", "Annex IV(2)(e)", ["guard.fallback", "guard.policy"]),
    ("performance_metrics", "Annex IV(2)(g)", ["guard.injection", "rag.drift"]),
    ("risk_management", "Annex IV(3)", ["euact.classifier", "vendor.assess"]),
    ("lifecycle_changes", "Annex IV(4)", []),
    ("standards_applied", "Annex IV(5)", []),
    ("post_market_monitoring", "Annex IV(8-9)", ["core.audit", "guard.ledger"]),
]


def section_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SECTIONS)], "ord int, section string, annex_ref string, sources array<string>")


def section_coverage(systems: DataFrame) -> DataFrame:
    """systems: system, narrative (section to text), evidence (array of sources).  One row for each system and section.

    covered: a narrative, with evidence or where no source gives any; partial: one of the two; else missing."""
    rows = systems.crossJoin(F.broadcast(section_table(systems.sparkSession)))  # nine rows
    present = F.array_intersect("sources", F.coalesce("evidence", F.array().cast("array<string>")))
    told = F.coalesce(F.element_at("narrative", F.col("section")), F.lit("")) != ""
    rows = rows.withColumn("present", present).withColumn("told", told)
    full = F.col("told") & ((F.size("present") > 0) | (F.size("sources") == 0))
    coverage = F.when(full, "covered").when(F.col("told") | (F.size("present") > 0), "partial").otherwise("missing")
    return rows.select("system", "ord", "section", "annex_ref", "sources", F.col("present").alias("evidence"), coverage.alias("coverage"))


def completeness(coverage: DataFrame) -> DataFrame:
    """Percent by system: covered 1, partial a half."""
    points = F.when(F.col("coverage") == "covered", 1.0).when(F.col("coverage") == "partial", 0.5).otherwise(0.0)
    return coverage.groupBy("system").agg(F.round(F.avg(points) * 100, 1).alias("completeness"))


def gap_findings(coverage: DataFrame) -> DataFrame:
    gaps = coverage.filter("coverage != 'covered'")
    return gaps.select("system", F.concat(F.lit("annex_iv_gap."), F.col("section")).alias("check"), F.when(F.col("coverage") == "missing", "high").otherwise("medium").alias("severity"), F.lit("flag").alias("action"), F.concat(F.lit("Art. 11 + "), F.col("annex_ref")).alias("article"))
