"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

CHUNK = "id STRING, text STRING, vector ARRAY<FLOAT>, metadata MAP<STRING,STRING>, ingested_at STRING"
FINDING = "check STRING, severity STRING, detail STRING, module STRING, action STRING, article STRING, evidence STRING, remediation STRING, params STRING"
SCORE = "name STRING, value DOUBLE, method STRING, degraded BOOLEAN, threshold DOUBLE, basis STRING"
OUTCOME = "name STRING, status STRING, actual STRING, threshold STRING, detail STRING"
SYSTEM = (
    "name STRING, sector STRING, use_cases ARRAY<STRING>, description STRING, deployment_context STRING, autonomy STRING, human_oversight STRING, "
    "affected_persons ARRAY<STRING>, is_gpai BOOLEAN, gpai_systemic_risk BOOLEAN, generates_content BOOLEAN, processes_biometrics BOOLEAN, infers_emotions BOOLEAN, "
    "safety_component BOOLEAN, eu_market BOOLEAN"
)
LEDGER = "timestamp STRING, session_id STRING, module STRING, event_type STRING, iso_42001_clause STRING, payload STRING, hash STRING, previous_hash STRING"
INVOCATION = (
    "session_id STRING, call_index INT, model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, estimated BOOLEAN, latency_ms DOUBLE, input_action STRING, output_action STRING, "
    "masked_entities MAP<STRING,INT>, signatures ARRAY<STRING>, degraded BOOLEAN, fallback_reason STRING, answered_by STRING, attempts INT, error STRING, day DATE"
)
