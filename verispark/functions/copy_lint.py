"""Lint of published pages for claims that no check can support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that no page may have, and the statements that an exempt page must make, by locale.
BANNED = [
    "fully compliant", "certified", "guaranteed compliant", "100% compliant",
    "no further action required", "compliance in one click", "risk-free",
    "tamamen uyumlu", "belgelendirilmiş", "uyum garantisi", "%100 uyumlu",
    "tek tıkla uyum", "risksiz",
    "iso/iec 42001 compliance", "iso 42001 compliance",
    "iso/iec 42001 compliant", "iso 42001 compliant",
    "iso/iec 42001 uyumluluğu", "iso 42001 uyumluluğu",
    "iso/iec 42001 uyumlu", "iso 42001 uyumlu",
    "42001 internal audit", "42001 iç denetim",
]
EXEMPT = ["honesty", "faq"]
STATEMENTS = {"en": ["it does not certify", "internal audit"], "tr": ["belgelendirme yapmaz", "iç denetim"]}


def lint(pages: DataFrame) -> DataFrame:
    """pages: page, locale, text.  page, locale, problem, phrase: one row for each banned phrase, or statement that an exempt page lacks.

    Null texts have no phrase; an exempt page of an unknown locale must make the English statements."""
    low = F.lower(F.coalesce("text", F.lit("")))
    exempt = F.coalesce(F.col("page").isin(EXEMPT), F.lit(False))
    said = F.filter(F.array(*[F.lit(b) for b in BANNED]), lambda b: F.contains(F.col("low"), b))
    wanted = F.when(F.col("locale") == "tr", F.array(*[F.lit(s) for s in STATEMENTS["tr"]])).otherwise(F.array(*[F.lit(s) for s in STATEMENTS["en"]]))
    lacking = F.filter(wanted, lambda s: ~F.contains(F.col("low"), s))
    rows = pages.select("page", "locale", low.alias("low")).select("page", "locale", F.when(exempt, "missing statement").otherwise("banned phrase").alias("problem"), F.explode(F.when(exempt, lacking).otherwise(said)).alias("phrase"))
    return rows
