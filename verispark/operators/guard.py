"""Replays of guarded conversations: sessions, budgets and the whole chain of checks as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispark.functions import injection, output_gate, pii
from verispark.functions.text import token_estimate


@dataclass
class Policy:
    max_calls_per_session: int | None = None
    max_tokens_per_session: int | None = None
    max_tokens_per_day: int | None = None
    mask: bool = True
    scan_input: bool = True
    check_output: bool = True


def session_summary(calls: DataFrame) -> DataFrame:
    """One row for each session of invocation rows: calls, tokens, degraded, blocked, retries, by answerer, masked by category, signatures."""
    base = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.count_if("degraded").alias("degraded_calls"), F.count_if((F.col("input_action") == "block") | (F.col("output_action") == "block")).alias("blocked_calls"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.max("estimated").alias("any_estimated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("signatures")))).alias("signatures"),
    )
    pairs = lambda n: F.map_from_entries(F.array_sort(F.collect_list(n)))
    answered = calls.groupBy("session_id", "answered_by").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(pairs(F.struct("answered_by", "n")).alias("answered_by"))
    masked = calls.select("session_id", F.explode("masked_entities").alias("category", "n")).groupBy("session_id", "category").agg(F.sum("n").alias("n")).groupBy("session_id").agg(pairs(F.struct("category", "n")).alias("masked"))
    return base.join(answered, "session_id", "left").join(masked, "session_id", "left")


def daily_tokens(calls: DataFrame) -> DataFrame:
    return calls.groupBy("day").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def budget_breaches(calls: DataFrame, policy: Policy, at: str = "called_at") -> DataFrame:
    """Adds ``breach``: the first budget (calls, session tokens, day tokens) that the call would exceed, from what was spent before it.

    A session's running totals are a window by session.  A day's follow the clock of the column ``at``: totals by minute are summed first, and then
    the calls within each minute, so no day is one task.  Calls of one moment count in the order of session and index."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    before = Window.partitionBy("session_id").orderBy("call_index").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("calls_before", F.count(F.lit(1)).over(before)).withColumn("tokens_before", F.coalesce(F.sum(tokens).over(before), F.lit(0)))
    breach = F.lit(None).cast("string")
    if policy.max_tokens_per_day is not None:
        out = out.withColumn("minute", F.date_trunc("minute", F.col(at)))
        minutes = out.groupBy("day", "minute").agg(F.sum(tokens).alias("n"))
        minutes = minutes.select(F.col("day").alias("m_day"), F.col("minute").alias("m_minute"), (F.sum("n").over(Window.partitionBy("day").orderBy("minute")) - F.col("n")).alias("minutes_before"))
        own = Window.partitionBy("day", "minute").orderBy(at, "session_id", "call_index").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("own_before", F.coalesce(F.sum(tokens).over(own), F.lit(0)))
        out = out.join(minutes, F.col("day").eqNullSafe(F.col("m_day")) & F.col("minute").eqNullSafe(F.col("m_minute")))
        out = out.withColumn("day_tokens_before", F.col("minutes_before") + F.col("own_before"))
        breach = F.when(F.col("day_tokens_before") + tokens > policy.max_tokens_per_day, "max_tokens_per_day").otherwise(breach)
    if policy.max_tokens_per_session is not None:
        breach = F.when(F.col("tokens_before") + tokens > policy.max_tokens_per_session, "max_tokens_per_session").otherwise(breach)
    if policy.max_calls_per_session is not None:
        breach = F.when(F.col("calls_before") >= policy.max_calls_per_session, "max_calls_per_session").otherwise(breach)
    return out.withColumn("breach", breach).drop("minute", "m_day", "m_minute", "minutes_before", "own_before")


def replay(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", policy: Policy | None = None) -> DataFrame:
    """The guarded call over logged turns, in its order: scan, then mask, then the output gate on the answers.

    One row for each turn, repeated and null keys included: action, signatures, categories masked, tokens, and the text that would be passed
    on (null where blocked).  Masking carries the row along, so nothing is joined by key."""
    policy = policy or Policy()
    if policy.mask:
        rows = pii.mask_sessions(turns, session, order, text, reversible=False, carry=[role])
    else:
        rows = turns.select(session, order, role, text, F.col(text).alias("masked"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("entities"))
    scanned = injection.scan(rows, text) if policy.scan_input else rows.withColumn("matches", F.array().cast(f"array<{injection.MATCH}>")).withColumn("decoded_payloads", F.lit(0)).withColumn("action", F.lit("pass"))
    answers = F.coalesce(F.col(role) == "assistant", F.lit(False))
    gate = F.when(answers & F.lit(policy.check_output), output_gate.check_output(F.col(text))).otherwise(F.array().cast("array<struct<check:string,severity:string,action:string>>"))
    scanned = scanned.withColumn("gate", gate).withColumn("input_action", F.when(answers, "pass").otherwise(F.col("action")))
    gated = F.when(F.exists("gate", lambda g: g["action"] == "block"), "block").when(F.size("gate") > 0, "flag").otherwise("pass")
    out = scanned.withColumn("output_action", gated)
    blocked = (F.col("input_action") == "block") | (F.col("output_action") == "block")
    return out.select(
        session, order, role, "input_action", "output_action", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["check"]))).alias("signatures"), F.transform("gate", lambda g: g["check"]).alias("gate_findings"),
        "entities", token_estimate(F.col(text)).alias("tokens"), F.when(~blocked, F.col("masked")).alias("passed_on"),
    )
