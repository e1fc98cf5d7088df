"""Command line: audits, classification, verification and the gate.  Exit codes: 0 passed, 1 blocked, 2 error, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _show(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def _audit(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators import report
    from verispark.plans.audit import corpus_audit
    from verispark.sources.chunks import from_json, from_parquet

    read = lambda p: from_parquet(spark, p) if p.endswith(".parquet") else from_json(spark, p)
    got = corpus_audit(read(a.chunks), read(a.baseline) if a.baseline else None, a.near_sample)
    print(report.to_markdown(got["document"]))
    if a.out:
        report.save(got["document"], a.out)
    fair = got["scores"]["fairness_score"]
    return 0 if fair is not None and fair >= a.floor else 1


def _classify(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators.classify import classify
    from verispark.sources.documents import system_specs

    out = classify(system_specs(spark, a.systems))
    _show(out)
    return 1 if out.filter("tier = 'unacceptable'").limit(1).count() else 0


def _questions(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators.classify import intake_schema

    _show(intake_schema(spark))
    return 0


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators import ledger

    broken = ledger.verify(ledger.lines(spark, a.ledger)).orderBy("line_no").limit(20)
    _show(broken)
    return 1 if broken.count() else 0


def _ledger(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators import ledger

    rows = ledger.entries(ledger.lines(spark, a.ledger)).filter("parsed").drop("raw", "parsed").orderBy("line_no")
    _show(rows.filter(F.col("module") == a.module) if a.module else rows)
    return 0


def _evidence(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.operators import ledger

    lines = ledger.lines(spark, a.ledger)
    events = ledger.entries(lines).filter("parsed")
    pack = ledger.evidence_pack(events, ledger.verify(lines), ledger.head(lines))
    _show(ledger.clause_coverage(events).orderBy("clause"))
    _show(pack)
    if a.out:
        ledger.write_pack(events, lines, a.out)
    return 0 if pack.head()["fit_to_hand_over"] else 1


def _gate(spark: SparkSession, a: argparse.Namespace) -> int:
    from verispark.plans.audit import run_gate

    outcomes, result = run_gate(spark.read.schema("name string, value double, threshold double").json(a.scores, multiLine=True))
    _show(outcomes.orderBy("name"))
    if a.out:
        from verispark.operators.gate import write_artefacts

        write_artefacts(outcomes, a.out, a.ledger)
    return int(result.head()["exit_code"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("verispark")
    sub = p.add_subparsers(required=True)

    def add(name, f, *options):
        s = sub.add_parser(name)
        s.set_defaults(run=f)
        for flag, how in options:
            s.add_argument(flag, **how)

    need = {"required": True}
    add("audit", _audit, ("--chunks", need), ("--baseline", {}), ("--near-sample", {"type": int}), ("--floor", {"type": float, "default": 70.0}), ("--out", {}))
    add("classify", _classify, ("--systems", need))
    add("questions", _questions)
    add("verify", _verify, ("--ledger", need))
    add("show", _ledger, ("--ledger", need), ("--module", {}))
    add("evidence", _evidence, ("--ledger", need), ("--out", {}))
    add("gate", _gate, ("--scores", need), ("--out", {}), ("--ledger", {}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("verispark").getOrCreate()
    try:
        return args.run(spark, args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the caller sees an exit code and one line
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
