"""Whole audits composed of the operators: a corpus audit and the gate over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.operators import bias, drift, gate, quality, remediation, report


def corpus_audit(chunks: DataFrame, baseline: DataFrame | None = None, near_sample: int | None = None) -> dict[str, Any]:
    """Findings (a DataFrame), scores, coverage and limits of a corpus.  What could not be measured is None and named in the limits."""
    spark = chunks.sparkSession
    near = quality.near_duplicates(chunks, sample=near_sample)
    groups = bias.group_mentions(chunks, bias.lexicon_table(spark))
    scored = bias.dimension_scores(groups)
    fair = bias.fairness_score(scored).head()
    scores: dict[str, float | None] = {"quality_score": quality.quality_score(chunks).head()["quality_score"], "fairness_score": fair["fairness_score"], "drift_stability": None}
    findings = quality.quality_findings(chunks, near).select("check", "severity", "action", "article").unionByName(bias.bias_findings(scored).withColumn("article", F.lit("Art. 10")))
    limits = ["Groups are found by words on their surface."]
    coverage = {"quality": "covered", "bias": "covered" if fair["assessed"] >= 3 else "partial" if fair["assessed"] else "missing", "drift": "missing"}
    if near_sample:
        limits.append(f"Near duplicates were looked for among {near_sample} chunks at most.")
    if fair["fairness_score"] is None:
        limits.append("No dimension reached the floor of mentions; that is not a pass.")
    if baseline is not None:
        d = drift.drift(baseline, chunks)
        scores["drift_stability"] = d.head()["drift_stability"]
        findings = findings.unionByName(drift.drift_findings(d))
        coverage["drift"] = "covered" if scores["drift_stability"] is not None else "missing"
    return {"findings": findings, "scores": scores, "coverage": coverage, "limits": limits, "recipes": remediation.recommend(findings), "document": report.collect(findings, scores, coverage, limits)}


def run_gate(scores: DataFrame, verdicts: DataFrame | None = None, classified: DataFrame | None = None, missing: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All outcomes and the one-row result."""
    spark = scores.sparkSession
    out = gate.score_outcomes(scores)
    if verdicts is not None:
        out = out.unionByName(gate.verdict_outcomes(verdicts))
    if classified is not None:
        out = out.unionByName(gate.certainty_outcomes(classified))
    if missing:
        out = out.unionByName(gate.not_configured(spark, missing))
    return out, gate.result(out)
