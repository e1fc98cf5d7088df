"""The hash-chained event ledger: append, scan, tail, verification, roll-up by clause.

Appending is serial by nature: each entry's digest covers the one before it, so a driver-side writer holds a lock on the file.  Verification is parallel:
a line is checked against the previous hash that it states, and the stated link against the line before.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import uuid
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First link, clause of each module, and the clause table.
GENESIS = "GENESIS"
CLAUSE_OF = {
    "guard": "8.3 — Operational controls / AI system operation",
    "rag": "8.4 — Data for AI systems (and Art. 10 EU AI Act)",
    "euact": "6.1.2 — AI risk assessment",
    "vendor": "8.5 — Third-party and customer relationships",
    "cicd": "9.1 — Monitoring, measurement, analysis and evaluation",
    "core": "9.1 — Monitoring, measurement, analysis and evaluation",
}
CLAUSES: list[tuple[str, str, list[str]]] = [
    ("6.1.2", "input", ["euact"]),
    ("8.3", "record", ["guard"]),
    ("8.4", "record", ["rag"]),
    ("8.5", "record", ["vendor"]),
    ("9.1", "record", ["cicd", "core"]),
]


#: Line numbers that are compared in one task.
CELL = 100_000


def digest(entry: dict[str, Any], previous: str) -> str:
    """SHA-256 of the entry without its chain fields, as JSON with sorted keys, followed by the previous hash."""
    event = {k: v for k, v in entry.items() if k not in ("hash", "previous_hash")}
    return hashlib.sha256((json.dumps(event, sort_keys=True, ensure_ascii=False) + previous).encode()).hexdigest()


def new_session_id() -> str:
    return uuid.uuid4().hex[:16]


def _head(data: bytes) -> str:
    for line in reversed(data.decode(errors="replace").split("\n")):  # other line breaks stand inside of texts
        try:
            return json.loads(line)["hash"]
        except (ValueError, KeyError, TypeError):
            continue
    return GENESIS


def append(path: str, module: str, event_type: str, payload: dict[str, Any], session_id: str | None = None, now: str | None = None) -> dict[str, Any]:
    """Appends one entry to a local file under a lock and flushes it to disk."""
    entry: dict[str, Any] = {
        "timestamp": now or datetime.now(UTC).isoformat(), "session_id": session_id or "-", "module": module, "event_type": event_type,
        "iso_42001_clause": CLAUSE_OF.get(module, CLAUSE_OF["core"]), "payload": payload,
    }
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(max(0, size - 8192))
        tail = f.read()
        head = _head(tail)
        if head == GENESIS and size > len(tail):
            f.seek(0)
            head = _head(f.read())
        entry |= {"hash": digest(entry, head), "previous_hash": head}
        f.write((json.dumps(entry, ensure_ascii=False) + "\n").encode())
        f.flush()
        os.fsync(f.fileno())
    return entry


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, blank lines count) and raw line.  A ledger's order is that of its lines, so a file is one record that is then taken apart."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("n", "raw")).select((F.col("n") + 1).alias("line_no"), "raw").filter(F.trim("raw") != "")


_EMPTY = "timestamp string, session_id string, module string, event_type string, iso_42001_clause string, hash string, previous_hash string"


def entries(ledger: DataFrame) -> DataFrame:
    """Parsed columns of (line_no, raw); lines that don't parse have nulls and ``parsed`` false."""
    e = F.from_json("raw", _EMPTY)
    return ledger.withColumn("e", e).withColumn("payload", F.get_json_object("raw", "$.payload")).withColumn("parsed", F.try_parse_json("raw").isNotNull()).select("line_no", "raw", "parsed", "e.*", "payload")


def head(ledger: DataFrame) -> DataFrame:
    """One row: hash of the last line that has one, or the first link."""
    return entries(ledger).filter("hash is not null").agg(F.coalesce(F.max_by("hash", "line_no"), F.lit(GENESIS)).alias("head"))


def verify(ledger: DataFrame, chain: list[str] | None = None) -> DataFrame:
    """line_no and violation (unparseable, mismatch, altered), one row each.  ``chain``: columns that tell several ledgers apart.

    The line after an unparseable one is a mismatch, since its link can't be known.  A hash that is missing or no text is altered.  Lines are
    compared with the one before within cells of CELL line numbers, and a cell's first line with the last of the cell before, so no task sorts a whole ledger."""
    keys = chain or []

    @F.pandas_udf("struct<ok:boolean,stored:string,previous:string,actual:string>")
    def check(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for line in raw:
            try:
                entry = json.loads(line)
                stored, previous = (entry.get(k) if isinstance(entry.get(k), str) else "<none>" for k in ("hash", "previous_hash"))
                rows.append((True, stored, previous, digest(entry, previous)))
            except (ValueError, AttributeError, TypeError):
                rows.append((False, "<unparseable>", None, None))
        return pd.DataFrame(rows, columns=["ok", "stored", "previous", "actual"])

    rows = ledger.select(*keys, "line_no", check("raw").alias("c")).select(*keys, "line_no", F.floor(F.col("line_no") / CELL).alias("cell"), "c.*")
    lasts = rows.groupBy(*keys, "cell").agg(F.max_by("stored", "line_no").alias("last"))
    lasts = lasts.select(*keys, "cell", F.lag("last", 1, GENESIS).over(Window.partitionBy(*keys).orderBy("cell")).alias("carried"))
    own = F.lag("stored").over(Window.partitionBy(*keys, "cell").orderBy("line_no"))
    same = F.lit(True)
    for k in [*keys, "cell"]:  # a null key is a ledger too
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}"))
    rows = rows.withColumn("own", own).alias("r").join(lasts.alias("l"), same).select("r.*", F.coalesce("own", "carried").alias("expected"))
    found = F.array(
        F.when(~F.col("ok"), F.lit("unparseable")),
        F.when(F.col("ok") & ~F.col("previous").eqNullSafe(F.col("expected")), F.lit("mismatch")),
        F.when(F.col("ok") & ~F.col("actual").eqNullSafe(F.col("stored")), F.lit("altered")),
    )
    return rows.select(*keys, "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def clause_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLAUSES, "clause string, kind string, modules array<string>")


def clause_coverage(events: DataFrame) -> DataFrame:
    """events: timestamp (string), module, event_type.  One row for each clause: entries, first and last day, event types, status."""
    by = events.groupBy("module", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))  # counts first
    clauses = clause_table(events.sparkSession)
    met = clauses.join(by, F.expr("array_contains(modules, module)"), "left")
    types = met.groupBy("clause", "kind", "event_type").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = types.groupBy("clause", "kind").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.substring(F.min("first"), 1, 10).alias("first_day"), F.substring(F.max("last"), 1, 10).alias("last_day"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("event_type").alias("t"))))).alias("ts"),
    )
    status = F.when(F.col("entries") == 0, "no_records").when(F.col("kind") == "input", "input_only").otherwise("evidenced")
    return out.select("clause", "entries", "first_day", "last_day", F.array_join(F.transform("ts", lambda x: F.concat(x["t"], F.lit(":"), (-x["k"]).cast("string"))), ",").alias("event_types"), status.alias("status"))


def unattributed(events: DataFrame) -> DataFrame:
    """One row: events whose module has no clause."""
    known = [m for _, _, ms in CLAUSES for m in ms]
    return events.agg(F.count_if(~F.coalesce(F.col("module").isin(known), F.lit(False))).alias("unattributed"))


def evidence_pack(events: DataFrame, violations: DataFrame, head_: DataFrame) -> DataFrame:
    """One row: entries, evidenced clauses, whether the chain is intact, its head, and whether the pack can be handed over."""
    cover = clause_coverage(events).agg(F.count_if(F.col("status") == "evidenced").alias("evidenced"))
    total = events.agg(F.count(F.lit(1)).alias("entries"))
    broken = violations.agg(F.count(F.lit(1)).alias("violations"))
    row = total.crossJoin(cover).crossJoin(broken).crossJoin(head_).crossJoin(unattributed(events))  # one row each
    return row.withColumn("chain_intact", F.col("violations") == 0).withColumn("fit_to_hand_over", (F.col("violations") == 0) & (F.col("entries") > 0))


def pack_document(coverage: list[dict[str, Any]], pack: dict[str, Any]) -> dict[str, Any]:
    return {"schema": "verispark.evidence/v1", "clauses": coverage, "pack": pack, "note": "Records show that checks ran. They don't certify anything."}


def write_pack(events: DataFrame, ledger: DataFrame, folder: str, formats: tuple[str, ...] = ("md", "json")) -> list[str]:
    """Writes the evidence pack to a local folder of the driver: a row for each clause and the roll-up; the paths written."""
    coverage = [r.asDict() for r in clause_coverage(events).orderBy("clause").collect()]  # a row for each clause
    doc = pack_document(coverage, evidence_pack(events, verify(ledger), head(ledger)).head().asDict())
    lines_ = ["# Evidence", "", f"Chain {'intact' if doc['pack']['chain_intact'] else 'VIOLATED'}, {doc['pack']['entries']} entries, head `{doc['pack']['head']}`.", "", "| clause | entries | from | to | status |", "|-|-|-|-|-|"]
    lines_ += [f"| {c['clause']} | {c['entries']} | {c['first_day'] or '-'} | {c['last_day'] or '-'} | {c['status']} |" for c in coverage]
    texts = {"md": "\n".join([*lines_, "", doc["note"], ""]), "json": json.dumps(doc, indent=2, ensure_ascii=False, default=str) + "\n"}
    os.makedirs(folder, exist_ok=True)
    done = []
    for f in formats:
        if f in texts:
            done.append(os.path.join(folder, f"evidence.{f}"))
            with open(done[-1], "w", encoding="utf-8") as out:
                out.write(texts[f])
    return done


def listed(rows: DataFrame, by: str, cap: int = 25) -> DataFrame:
    """The first ``cap`` rows by ``by`` and, in each, how many more there are."""
    return rows.orderBy(by).limit(cap).crossJoin(F.broadcast(rows.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("remaining"))))
