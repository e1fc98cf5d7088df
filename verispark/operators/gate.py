"""The gate: outcomes of checks against thresholds.  What was not measured blocks."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.operators import ledger

BLOCKING = ["fail", "unmeasured", "error"]


def compare(actual: Column, threshold: Column) -> Column:
    """skipped without a threshold, unmeasured without a value, else pass or fail."""
    return F.when(threshold.isNull(), "skipped").when(actual.isNull(), "unmeasured").when(actual < threshold, "fail").otherwise("pass")


def compare_cap(actual: Column, cap: Column) -> Column:
    """The same for a value that must not exceed a cap."""
    return F.when(cap.isNull(), "skipped").when(actual.isNull(), "unmeasured").when(actual > cap, "fail").otherwise("pass")


def member(actual: Column, bad: Column, unknown: list[str]) -> Column:
    """skipped without a list, unmeasured for the words that mean so, fail if listed."""
    return F.when(bad.isNull() | (F.size(bad) == 0), "skipped").when(actual.isNull() | actual.isin(unknown), "unmeasured").when(F.array_contains(bad, actual), "fail").otherwise("pass")


def score_outcomes(scores: DataFrame) -> DataFrame:
    """scores: name, value, threshold.  name, status, actual, threshold, blocking."""
    status = compare(F.col("value"), F.col("threshold"))
    return scores.select("name", status.alias("status"), F.col("value").cast("string").alias("actual"), F.col("threshold").cast("string").alias("threshold"), status.isin(BLOCKING).alias("blocking"))


def verdict_outcomes(verdicts: DataFrame, unknown: tuple[str, ...] = ("unmeasurable", "unknown")) -> DataFrame:
    """verdicts: name, value, bad (array).  The same columns."""
    status = member(F.col("value"), F.col("bad"), list(unknown))
    return verdicts.select("name", status.alias("status"), F.col("value").alias("actual"), F.array_join("bad", ",").alias("threshold"), status.isin(BLOCKING).alias("blocking"))


def certainty_outcomes(classified: DataFrame) -> DataFrame:
    """An unmeasured outcome for each classification in a grey zone."""
    rows = classified.filter("grey_zone")
    return rows.select(F.concat(F.lit("classification_certainty."), F.col("name")).alias("name"), F.lit("unmeasured").alias("status"), F.col("confidence").cast("string").alias("actual"), F.lit(None).cast("string").alias("threshold"), F.lit(True).alias("blocking"))


def not_configured(spark: SparkSession, names: list[str]) -> DataFrame:
    """Every check that did not run is an outcome too."""
    return spark.createDataFrame([(n, "skipped", None, None, False) for n in names], "name string, status string, actual string, threshold string, blocking boolean")


def result(outcomes: DataFrame) -> DataFrame:
    """One row: counts by status, whether it passed, the exit code (2 error, 1 blocked, 0)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    row = outcomes.agg(F.count(F.lit(1)).alias("checks"), n("pass"), n("fail"), n("unmeasured"), n("skipped"), n("error"), F.count_if("blocking").alias("blocking"))
    return row.withColumn("passed", F.col("blocking") == 0).withColumn("exit_code", F.when(F.col("error") > 0, 2).when(F.col("blocking") > 0, 1).otherwise(0))


def write_artefacts(outcomes: DataFrame, folder: str, ledger_path: str | None = None) -> list[str]:
    """Writes gate-report.json and gate-summary.md to a local folder of the driver and, if asked, a ledger entry; the paths written.

    Outcomes are one for each check, a bounded number."""
    rows = [r.asDict() for r in outcomes.orderBy("name").collect()]
    total = result(outcomes).head().asDict()
    doc = {"schema": "verispark.gate/v1", "passed": total["passed"], "exit_code": total["exit_code"], "checks": rows}
    text = [f"# Gate: {'passed' if total['passed'] else 'blocked'}", "", "| check | status | actual | threshold |", "|-|-|-|-|"]
    text += [f"| {r['name']} | {r['status']} | {'-' if r['actual'] is None else r['actual']} | {'-' if r['threshold'] is None else r['threshold']} |" for r in rows]
    os.makedirs(folder, exist_ok=True)
    done = []
    for name, body in (("gate-report.json", json.dumps(doc, indent=2, ensure_ascii=False)), ("gate-summary.md", "\n".join(text) + "\n")):
        done.append(os.path.join(folder, name))
        with open(done[-1], "w", encoding="utf-8") as out:
            out.write(body)
    if ledger_path:
        ledger.append(ledger_path, "cicd", "gate_run", {"passed": total["passed"], "exit_code": total["exit_code"], "checks": {r["name"]: r["status"] for r in rows}})
    return done
