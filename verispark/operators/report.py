"""Reports: bundles of small tables, rendered on the driver, without sensitive values."""

from __future__ import annotations

import html
import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.functions.scores import severity_rank

SCHEMA = "verispark.report/v1"
# Keys whose texts never leave.
SENSITIVE = ["value", "values", "raw", "raw_text", "text", "prompt", "response", "content", "matched_text", "secret", "token", "api_key", "vault", "sample_text"]
#: Keys that this engine adds to them.
MORE = ["original", "password", "email", "payload_text"]
REDACTED = "[redacted]"
#: Rows of findings that a rendered report lists; what remains is counted.
LISTED = 40


def redact(node: Any, key: str = "") -> Any:
    """Texts under sensitive keys, lists that hold one and non-empty objects are replaced; numbers stay."""
    held = any(isinstance(x, str) and x for x in node) if isinstance(node, list) else isinstance(node, (str, dict)) and bool(node)
    if held and key.lower() in (*SENSITIVE, *MORE):
        return REDACTED
    if isinstance(node, dict):
        return {k: redact(v, k) for k, v in node.items()}
    return [redact(x) for x in node] if isinstance(node, list) else node


def redact_column(name: str):
    """The same over a column of JSON texts."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else json.dumps(redact(json.loads(x)), ensure_ascii=False))

    return run(F.col(name))


def by_severity(findings: DataFrame, seq: str | None = None) -> DataFrame:
    """Strongest first, then by check (or by a given order)."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *([seq] if seq else ["check"]))


def collect(findings: DataFrame, scores: dict[str, float | None], coverage: dict[str, str] | None = None, limits: list[str] | None = None) -> dict[str, Any]:
    """The report as a document.  Findings are summaries, a bounded number a run; those beyond LISTED are counted."""
    rows = [r.asDict() for r in by_severity(findings).limit(LISTED).collect()]
    total = findings.count()
    return {"schema": SCHEMA, "scores": scores, "findings": [redact(r) for r in rows], "remaining_findings": max(0, total - len(rows)), "coverage": coverage or {}, "limits": limits or []}


def to_json(doc: dict[str, Any]) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False, default=str)


def to_markdown(doc: dict[str, Any]) -> str:
    shown = lambda v: "unmeasured" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    out = ["# Report", "", "| score | value |", "|-|-|", *[f"| {k} | {shown(v)} |" for k, v in doc["scores"].items()], "", "## Findings", ""]
    out += [f"- **{f['severity']}** `{f['check']}`" + (f" ({f['article']})" if f.get("article") else "") for f in doc["findings"]] or ["None."]
    out += [f"- and {doc['remaining_findings']} more"] if doc["remaining_findings"] else []
    out += ["", "## Limits", "", *[f"- {x}" for x in doc["limits"]]] if doc["limits"] else []
    return "\n".join(out) + "\n"


def to_html(doc: dict[str, Any]) -> str:
    body = "".join(f"<tr><td>{html.escape(str(f['severity']))}</td><td>{html.escape(f['check'])}</td></tr>" for f in doc["findings"])
    scores = "".join(f"<li>{html.escape(k)}: {'unmeasured' if v is None else v}</li>" for k, v in doc["scores"].items())
    return f"<!doctype html><meta charset='utf-8'><title>Report</title><h1>Report</h1><ul>{scores}</ul><table>{body}</table>"


RENDER = {"json": to_json, "md": to_markdown, "html": to_html}


def save(doc: dict[str, Any], folder: str, stem: str = "report", formats: tuple[str, ...] = ("json", "md")) -> list[str]:
    """Writes each known format to a local folder of the driver; the paths written."""
    os.makedirs(folder, exist_ok=True)
    done = []
    for f in formats:
        if f in RENDER:
            path = os.path.join(folder, f"{stem}.{f}")
            with open(path, "w", encoding="utf-8") as out:
                out.write(RENDER[f](doc))
            done.append(path)
    return done
