"""Named queries over the standard tables and the SQL that each must equal.

Every query runs over its whole tables.  Where SQL can't express one there is none, and a test compares it with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.functions import copy_lint, injection, output_gate, pii, scores, text, vectors, watermark
from verispark.operators import bias, classify, dossier, drift, gate, guard, ledger, quality, remediation, report, vendor
from verispark.plans import samples
from verispark.sources.documents import chunks, snapshots, spread, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Texts and vectors.


@query
def chunk_functions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    words = text.blank_words(t)
    return table(spark, sf, "documents").select("doc_id", text.length(t).cast("long").alias("length"), text.token_estimate(t).cast("long").alias("tokens"), text.fingerprint(t).alias("fingerprint"), F.size(text.shingles(words)).cast("long").alias("shingles"))


@query
def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"))


@query
def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", F.round(vectors.magnitude(F.col("embedding")), 5).alias("norm"), F.round(vectors.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query
def js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the day of each event type against all events."""
    e = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(e.groupBy("h").agg(F.sum("n").alias("all_n"))))  # 24 rows
    rows = grid.join(e, ["event_type", "h"], "left")
    by = rows.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("h", F.coalesce("n", F.lit(0)).alias("n"), "all_n"))).alias("r"), F.sum("n").alias("k"), F.sum("all_n").alias("a"))
    p, q = F.transform("r", lambda x: x["n"] / F.col("k")), F.transform("r", lambda x: x["all_n"] / F.col("a"))
    return by.select("event_type", F.round(vectors.js_divergence(p, q), 6).alias("divergence"))


# Corpus quality.


@query
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.exact_duplicates(chunks(spark, sf))


@query
def duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_summary(chunks(spark, sf))


@query
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_counts(chunks(spark, sf))


@query
def dimension_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dimension_histogram(chunks(spark, sf)).select(F.col("dimension").cast("long").alias("dimension"), "chunks")


@query
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = quality.length_stats(chunks(spark, sf))
    return _rounded(s.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length")}), 4, "mean_length", "median_length", "stdev_length")


@query
def length_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.length_outliers(chunks(spark, sf)).withColumn("length", F.col("length").cast("long"))


@query
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quality.near_duplicates(chunks(spark, sf)), 6, "jaccard")


@query
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator itself: 500 of all chunks."""
    return quality.systematic_sample(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 500)


@query
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quality.quality_score(chunks(spark, sf)), 6, "content", "retrievable", "distinctness", "sizing", "quality_score")


@query
def finding_samples(spark: SparkSession, sf: str) -> DataFrame:
    return quality.finding_samples(chunks(spark, sf))


@query
def copy_findings(spark: SparkSession, sf: str) -> DataFrame:
    return copy_lint.lint(spark.createDataFrame(samples.PAGES, "page string, locale string, text string"))


@query
def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_findings(chunks(spark, sf))


@query
def quality_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return remediation.recommend(quality.quality_findings(chunks(spark, sf)))


# Personal data.


@query
def pii_categories(spark: SparkSession, sf: str) -> DataFrame:
    return quality.pii_chunks(chunks(spark, sf))


@query
def pii_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return quality.pii_rollup(chunks(spark, sf))


@query
def pii_email(spark: SparkSession, sf: str) -> DataFrame:
    return quality.pii_chunks(chunks(spark, sf)).filter(F.array_contains("categories", "EMAIL")).select("id")


@query
def pii_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    return quality.pii_chunks(chunks(spark, sf)).filter(F.array_contains("categories", "IPV4")).select("id")


@query
def pii_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.pii_chunks(chunks(spark, sf)).select("id", pii.secrets_found(F.col("categories")).alias("s"))
    return found.filter(F.size("s") > 0).select("id", F.array_join("s", ",").alias("secrets"))


@query
def masked_text(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mask_sessions(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "masked", "entities")


@query
def unmask_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, masked and unmasked, with the placeholders that were never issued."""
    m = pii.mask_sessions(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    back = m.select("conv_id", "turn", F.sha2(pii.unmask(F.col("masked"), F.col("vault")), 256).alias("restored_sha256"), F.size(pii.leaked_placeholders(F.col("masked"), F.col("vault"))).cast("long").alias("leaked"))
    return back


@query
def masking_totals(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.mask_sessions(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return m.select("conv_id", "turn", pii.masking_summary(F.col("entities")).alias("s")).select("conv_id", "turn", "s.total_masked", "s.secrets")


# Representation.


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return bias.group_mentions(chunks(spark, sf), bias.lexicon_table(spark))


@query
def bias_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_groups(spark, sf), 6, "sentiment")


@query
def bias_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = bias.dimension_scores(_groups(spark, sf))
    return _rounded(s, 4, "ratio", "spread").select("dimension", "mentions", "groups", "assessed", "ratio", "spread", "representation", "framing")


@query
def fairness_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(bias.fairness_score(bias.dimension_scores(_groups(spark, sf))), 1, "fairness_score")


@query
def flagged_groups(spark: SparkSession, sf: str) -> DataFrame:
    return bias.flagged_groups(_groups(spark, sf)).select("dimension", "grp", "underrepresented", "negatively_framed")


@query
def bias_findings(spark: SparkSession, sf: str) -> DataFrame:
    return bias.bias_findings(bias.dimension_scores(_groups(spark, sf)))


# Drift.


@query
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(drift.centroid(snapshots(spark, sf)[0]).withColumn("pos", F.col("pos").cast("long")), 6, "mean")


@query
def centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(drift.centroid_similarity(*snapshots(spark, sf)), 5, "similarity")


@query
def centroid_strength(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(drift.centroid_strength(snapshots(spark, sf)[0]), 5, "strength")


@query
def psi_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return drift.psi_by_dimension(*snapshots(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query
def drift_verdict(spark: SparkSession, sf: str) -> DataFrame:
    d = drift.drift(*snapshots(spark, sf))
    return d.select("verdict", "informative", "psi_mean", "psi_max", "noise_floor", F.col("unstable_dimensions").cast("long").alias("unstable_dimensions"), "baseline_count", "current_count", "volume_ratio")


@query
def drift_findings(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_findings(drift.drift(*snapshots(spark, sf)))


# Guard.


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as invocations: an answer is a call, charged with the tokens of the turn before it."""
    t = spread(table(spark, sf, "conversations"), "conv_id")
    asked = t.filter("role != 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), text.token_estimate(F.col("text")).cast("long").alias("prompt_tokens"))
    rows = t.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    rows = rows.withColumns({"found": injection.matches(F.col("text")), "out": output_gate.check_output(F.col("text"))})
    found, out = F.col("found"), F.col("out")
    act = F.when(F.exists(out, lambda g: g["action"] == "block"), "block").when(F.size(out) > 0, "flag").otherwise("pass")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("call_index"), F.lit("m").alias("model"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), text.token_estimate(F.col("text")).cast("long").alias("completion_tokens"),
        F.lit(True).alias("estimated"), F.lit(0.0).alias("latency_ms"), injection.action(found).alias("input_action"), act.alias("output_action"), none.alias("masked_entities"), F.transform(found, lambda m: m["check"]).alias("signatures"),
        F.lit(False).alias("degraded"), F.lit(None).cast("string").alias("fallback_reason"), F.lit("primary").alias("answered_by"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 7).cast("int")).alias("day"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") % 7) * 86400 + (F.col("conv_id") * 37 + F.col("turn") * 11) % 86400).alias("called_at"),
    )


@query
def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = injection.scan(spread(table(spark, sf, "conversations")), "text")
    return rows.select("conv_id", "turn", "action", F.size("matches").cast("long").alias("matches"))


@query
def document_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The documents and a few that hold injections, plain and encoded."""
    planted = spark.createDataFrame(samples.INJECTED, "doc_id long, text string")
    return injection.scan_documents(spread(table(spark, sf, "documents").select("doc_id", "text")).unionByName(planted), "doc_id", "text")


@query
def output_gate_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", output_gate.check_output(F.col("text")).alias("g"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("g", lambda g: g["check"]), ",").alias("findings"))


@query
def guard_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = guard.session_summary(_calls(spark, sf))
    return s.select("session_id", "calls", "prompt_tokens", "completion_tokens", "total_tokens", "blocked_calls", "degraded_calls")


@query
def daily_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return guard.daily_tokens(_calls(spark, sf))


@query
def budget_breaches(spark: SparkSession, sf: str) -> DataFrame:
    policy = guard.Policy(max_calls_per_session=3, max_tokens_per_session=200)
    return guard.budget_breaches(_calls(spark, sf), policy).select("session_id", F.col("call_index").cast("long").alias("call_index"), "calls_before", "tokens_before", "breach")


@query
def day_budget_breaches(spark: SparkSession, sf: str) -> DataFrame:
    out = guard.budget_breaches(_calls(spark, sf), guard.Policy(max_tokens_per_day=500))
    return out.select("session_id", F.col("call_index").cast("long").alias("call_index"), "day", "day_tokens_before", "breach")


@query
def guarded_replay(spark: SparkSession, sf: str) -> DataFrame:
    return guard.replay(spread(table(spark, sf, "conversations")))


@query
def watermark_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit("2024-06-01").cast("date")
    marked = spread(table(spark, sf, "documents").select("doc_id", "text", "source")).select("doc_id", "text", watermark.mark(F.col("text"), F.concat(F.lit("system-"), F.col("source")), day).alias("marked"))
    v = watermark.verify(F.col("marked"))
    return marked.select("doc_id", v["present"].alias("present"), v["tag"].alias("tag"), v["valid"].alias("valid"), (watermark.strip(F.col("marked")) == F.col("text")).alias("stripped"), watermark.content_hash(F.col("text")).alias("content_hash"), F.length("marked").cast("long").alias("marked_length"))


@query
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", watermark.provenance(F.col("source"), F.lit("m-001"), F.substring(F.sha2("text", 256), 1, 16), F.lit("2024-06-01T00:00:00+00:00")).alias("record"))


# Classification, files, recipes.


@query
def classify_systems(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.classify(samples.systems(spark))
    return c.select("name", "tier", "confidence", "grey_zone", "basis", F.size("obligations").cast("long").alias("obligations"), F.size("gpai_obligations").cast("long").alias("gpai_obligations"))


@query
def classification_findings(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classification_findings(classify.classify(samples.systems(spark)))


@query
def indicator_matches(spark: SparkSession, sf: str) -> DataFrame:
    return classify.indicator_table(samples.systems(spark)).select("name", "family", "category", F.array_join("hits", ",").alias("hits"))


@query
def intake_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = classify.answers_to_specs(samples.answers(spark))
    return s.select("name", "sector", F.array_join("use_cases", "|").alias("use_cases"), "autonomy", "generates_content", "is_gpai", "eu_market")


@query
def annex_iv_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = dossier.section_coverage(samples.dossiers(spark))
    return c.select("system", "section", "annex_ref", F.array_join("evidence", ",").alias("evidence"), "coverage")


@query
def annex_iv_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return dossier.completeness(dossier.section_coverage(samples.dossiers(spark)))


@query
def annex_iv_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return dossier.gap_findings(dossier.section_coverage(samples.dossiers(spark)))


@query
def recipes(spark: SparkSession, sf: str) -> DataFrame:
    return remediation.recipe_table(spark).withColumn("leverage", F.col("leverage").cast("long"))


@query
def model_pins(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in samples.MODELS], "model string").select("model", text.is_pinned(F.col("model")).alias("pinned"))


# Ledger and evidence.


def _events(spark: SparkSession, sf: str) -> DataFrame:
    module = F.create_map(*[F.lit(x) for kv in samples.EVENT_MODULE.items() for x in kv])
    return table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), module[F.col("event_type")].alias("module"), "event_type", "user_id", "event_id")


@query
def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger a user, chained on the executors from the events; the sixth line of every fifth user is altered afterwards."""
    import pandas as pd

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        import json

        previous, out = ledger.GENESIS, []
        for i, r in enumerate(rows.sort_values("event_id").itertuples(), 1):
            entry = {"timestamp": r.timestamp, "module": r.module, "event_type": r.event_type, "payload": {"event": int(r.event_id)}}
            entry |= {"hash": ledger.digest(entry, previous), "previous_hash": previous}
            previous = entry["hash"]
            if i == 6 and r.user_id % 5 == 0:
                entry["payload"] = {"event": -1}
            out.append((r.user_id, i, json.dumps(entry, ensure_ascii=False)))
        return pd.DataFrame(out, columns=["user_id", "line_no", "raw"])

    lines = _events(spark, sf).groupBy("user_id").applyInPandas(chain, "user_id long, line_no int, raw string")
    return ledger.verify(lines, ["user_id"]).select("user_id", F.col("line_no").cast("long").alias("line_no"), "violation")


@query
def clause_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.clause_coverage(_events(spark, sf))


@query
def unattributed_events(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.unattributed(_events(spark, sf))


@query
def events_by_module(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).filter("module = 'guard'").select("event_id", "event_type", "timestamp")


@query
def evidence_listed(spark: SparkSession, sf: str) -> DataFrame:
    """The capped list of a pack: the first 25 events of a module and how many remain (the cap is the feature)."""
    return ledger.listed(_events(spark, sf).filter("module = 'guard'").select("event_id", "event_type"), "event_id")


# Vendors.


def _statuses(spark: SparkSession) -> DataFrame:
    return vendor.effective_statuses(samples.vendors(spark), samples.criteria(spark), samples.seeded(spark), samples.given(spark))


@query
def vendor_scores(spark: SparkSession, sf: str) -> DataFrame:
    return vendor.vendor_scores(_statuses(spark))


@query
def vendor_group_scores(spark: SparkSession, sf: str) -> DataFrame:
    return vendor.group_scores(_statuses(spark))


@query
def vendor_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return vendor.vendor_gaps(_statuses(spark))


@query
def vendor_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = samples.vendors(spark)
    where = vendor.residency(v, ["UK", "JP"], ["US"], ["EU"]).select("provider", F.col("verdict").alias("residency"))
    out = vendor.training_optout(v).select("provider", F.col("verdict").alias("optout"))
    return where.join(out, "provider").join(vendor.stale(v, F.lit("2026-07-01").cast("date")), "provider")


# Gate.


def _gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    q = quality.quality_score(chunks(spark, sf)).select(F.lit("quality_score").alias("name"), F.round("quality_score", 1).alias("value"), F.lit(70.0).alias("threshold"))
    f = bias.fairness_score(bias.dimension_scores(_groups(spark, sf))).select(F.lit("fairness_score").alias("name"), F.round("fairness_score", 1).alias("value"), F.lit(70.0).alias("threshold"))
    v = vendor.vendor_scores(_statuses(spark)).select(F.concat(F.lit("vendor_score."), F.col("provider")).alias("name"), F.col("score").alias("value"), F.lit(40.0).alias("threshold"))
    return q.unionByName(f).unionByName(v).unionByName(spark.createDataFrame([("unset", 10.0, None), ("unknown", None, 50.0)], "name string, value double, threshold double"))


@query
def gate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = gate.score_outcomes(_gate_scores(spark, sf)).unionByName(gate.certainty_outcomes(classify.classify(samples.systems(spark)))).unionByName(gate.not_configured(spark, ["guard"]))
    return out.select("name", "status", "blocking")


@query
def gate_result(spark: SparkSession, sf: str) -> DataFrame:
    out = gate.score_outcomes(_gate_scores(spark, sf)).unionByName(gate.not_configured(spark, ["guard"]))
    return gate.result(out).select(*[F.col(c).cast("long").alias(c) for c in ("checks", "pass", "fail", "unmeasured", "skipped", "error", "blocking", "exit_code")], "passed")


@query
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = _gate_scores(spark, sf)
    return s.select("name", scores.band(F.col("value")).alias("band"), scores.passed(F.col("value"), F.col("threshold")).alias("passed"))


@query
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    f = bias.bias_findings(bias.dimension_scores(_groups(spark, sf)))
    return report.by_severity(f).select("check", "severity", scores.severity_rank(F.col("severity")).cast("long").alias("rank"))


@query
def worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    return bias.bias_findings(bias.dimension_scores(_groups(spark, sf))).agg(scores.worst(F.col("severity")).alias("worst"))


from verispark.plans.oracles import ORACLES  # noqa: E402, F401
