"""Assessment of providers from tables that the caller gives: statuses, weights, regions, contract facts.

The criteria, weights and seed facts of a provider are inputs; nothing is assumed about a provider that is not in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a criterion's weight by status; unknown counts, but less than partial.
CREDIT = {"met": 1.0, "partial": 0.5, "unknown": 0.2, "not_met": 0.0}
STALE_DAYS = 180


def effective_statuses(providers: DataFrame, criteria: DataFrame, seed: DataFrame, overrides: DataFrame) -> DataFrame:
    """provider, criterion, grp, weight, critical, status: the override, else the seed, else unknown."""
    grid = providers.select("provider").distinct().crossJoin(F.broadcast(criteria))  # the criteria are a fixed list
    s = seed.select("provider", "criterion", F.col("status").alias("seeded"))
    o = overrides.select("provider", "criterion", F.col("status").alias("given"))
    rows = grid.join(s, ["provider", "criterion"], "left").join(o, ["provider", "criterion"], "left")
    return rows.select("provider", "criterion", "grp", "weight", "critical", F.coalesce("given", "seeded", F.lit("unknown")).alias("status"), F.col("given").isNotNull().alias("customer_verified"))


def credit(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CREDIT.items() for x in kv])
    return F.coalesce(table[status], F.lit(CREDIT["unknown"]))


def vendor_scores(statuses: DataFrame) -> DataFrame:
    """Score of 0 to 100 by provider, unknown criteria, and whether the customer has verified anything."""
    got = F.sum(F.col("weight") * credit(F.col("status"))) / F.sum("weight") * 100
    return statuses.groupBy("provider").agg(F.round(got, 1).alias("score"), F.count_if(F.col("status") == "unknown").alias("unknown_criteria"), F.max("customer_verified").alias("customer_verified"))


def group_scores(statuses: DataFrame) -> DataFrame:
    got = F.sum(F.col("weight") * credit(F.col("status"))) / F.sum("weight") * 100
    return statuses.groupBy("provider", "grp").agg(F.round(got, 1).alias("score"))


def vendor_gaps(statuses: DataFrame) -> DataFrame:
    """Findings for criteria that are not met; a critical one blocks."""
    gaps = statuses.filter("status = 'not_met'")
    return gaps.select("provider", F.concat(F.lit("vendor_gap."), F.col("criterion")).alias("check"), F.when(F.col("critical"), "critical").otherwise("medium").alias("severity"), F.when(F.col("critical"), "block").otherwise("flag").alias("action"))


def residency(facts: DataFrame, adequate: list[str], framework: list[str], required: list[str]) -> DataFrame:
    """facts: provider, regions, transfer_mechanism, dpf_certified.  Verdict: compliant, requires_scc, non_compliant, unknown.

    Regions outside the required and adequate ones need a mechanism: declared clauses come before the lack of a route; framework regions
    are adequate only where certification is confirmed."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    own = F.coalesce("regions", F.array().cast("array<string>"))
    outside = F.array_except(own, strings(required + adequate))
    covered = F.coalesce(F.col("dpf_certified"), F.lit(False))
    left = F.when(covered, F.array_except(outside, strings(framework))).otherwise(outside)
    in_framework = F.size(F.array_except(left, strings(framework))) == 0
    scc = F.coalesce(F.col("transfer_mechanism"), F.lit("unknown")).isin("scc", "bcr")
    verdict = F.when(F.lit(not required) | (F.size(own) == 0), "unknown").when(F.size(left) == 0, "compliant").when(scc | in_framework, "requires_scc").otherwise("non_compliant")
    return facts.select("provider", verdict.alias("verdict"), left.alias("uncovered_regions"))


def training_optout(facts: DataFrame) -> DataFrame:
    """facts: provider, optout_available, optout_enabled, optout_contractual.  Available is not yet enforced: both evidences are needed."""
    a = F.col("optout_available")
    proven = F.coalesce(F.col("optout_enabled") & F.col("optout_contractual"), F.lit(False))
    return facts.select("provider", F.when(a.isNull(), "unknown").when(~a, "not_available").when(proven, "enforced").otherwise("available_not_evidenced").alias("verdict"))


def stale(facts: DataFrame, today: Column) -> DataFrame:
    """facts: provider, as_of (date or null).  Facts without a date are stale."""
    return facts.select("provider", F.coalesce(F.datediff(today, F.col("as_of")) > STALE_DAYS, F.lit(True)).alias("stale"))
