"""Streams of conversation turns: an extension beyond batch replays.

Column functions apply to streams as they are; here are the two operations that need state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.functions import injection, output_gate
from verispark.functions.pii import SessionMasker
from verispark.functions.text import token_estimate


def windowed_guard(turns: DataFrame, ts: str = "ts", role: str = "role", text: str = "text", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns, tokens, blocked and flagged turns by window; turns later than the watermark are dropped by Spark."""
    found = injection.matches(F.col(text))
    gate = F.when(F.col(role) == "assistant", output_gate.check_output(F.col(text))).otherwise(F.array().cast("array<struct<check:string,severity:string,action:string>>"))
    act = F.when((injection.action(found) == "block") | F.exists(gate, lambda g: g["action"] == "block"), "block").when((injection.action(found) == "flag") | (F.size(gate) > 0), "flag").otherwise("pass")
    rows = turns.select(F.col(ts).alias("ts"), token_estimate(F.col(text)).alias("tokens"), act.alias("act")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), F.count_if(F.col("act") == "block").alias("blocked"), F.count_if(F.col("act") == "flag").alias("flagged")).select("window.start", "window.end", "turns", "tokens", "blocked", "flagged")


def masked_stream(turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text", ts: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Masks turns as they come; a session's placeholders are its state and end when the watermark is an hour past its last turn."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        masker = SessionMasker()
        if state.exists:
            for c, v, p in zip(*state.get, strict=True):
                masker.issued[c, v] = p
                masker.last[c] = masker.last.get(c, 0) + 1
        newest = 0
        for part in rows:
            part = part.sort_values(order, kind="stable")
            newest = max(newest, int(part["_ms"].max()))
            yield pd.DataFrame({session: key[0], order: part[order], "masked": [masker.mask(t)[0] for t in part[text]]})
        state.update(([c for c, _ in masker.issued], [v for _, v in masker.issued], list(masker.issued.values())))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    timed = turns.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts))
    return timed.groupBy(session).applyInPandasWithState(run, f"`{session}` {kinds[session]}, `{order}` {kinds[order]}, masked string", "category array<string>, value array<string>, placeholder array<string>", "append", "EventTimeTimeout")
