"""Checks of model output: empty answers, refusals, claims of certainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verispark.functions.text import stripped

# Fixed values.
REFUSAL = r"\b(?:i(?:'m| am)\s+(?:sorry|unable|not\s+able)|i\s+cannot\s+(?:assist|help|comply|provide)|as\s+an\s+ai(?:\s+language)?\s+model,?\s+i\s+(?:cannot|can't|am\s+unable)|i\s+(?:can(?:not|'t))\s+(?:fulfill|complete)\s+(?:that|this)\s+request)\b"
OVERCLAIM = r"\b(?:fully|100%|completely|totally|guaranteed|certified)\s+compliant|\bguarantee[sd]?\s+compliance|\b(?:is|are)\s+certified\s+(?:under|for|to)|\bno\s+(?:further\s+)?(?:action|remediation)\s+(?:is\s+)?(?:required|needed)\b|\bthis\s+(?:system|model)\s+is\s+compliant\b"


def is_refusal(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("(?iuU)" + REFUSAL)), F.lit(False))


def is_overclaim(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("(?iuU)" + OVERCLAIM)), F.lit(False))


def _finding(check: str, severity: str, action: str) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(action).alias("action"))


def check_output(text: Column, refusal: bool = True, overclaim: bool = True) -> Column:
    """Array of findings (check, severity, action).  A blank answer has just that one."""
    found = F.array(
        F.when(is_refusal(text) & F.lit(refusal), _finding("provider_refusal", "low", "flag")),
        F.when(is_overclaim(text) & F.lit(overclaim), _finding("assurance_overclaim", "critical", "block")),
    )
    return F.when(stripped(text) == "", F.array(_finding("empty_response", "medium", "flag"))).otherwise(F.filter(found, lambda f: f.isNotNull()))
