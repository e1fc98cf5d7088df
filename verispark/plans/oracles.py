"""DuckDB SQL for the queries of the catalogue, over views of the standard tables."""

from __future__ import annotations

from verispark.functions import copy_lint, lexicons, output_gate, vocabulary
from verispark.functions.injection import BASE64_BLOB, HEX_BLOB, SIGNATURES
from verispark.operators import dossier, ledger, remediation
from verispark.plans import samples


def q(x) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(q, x)) + "]::VARCHAR[]"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


COLLAPSED = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0B]+', ' ', 'g'))"
BLANK = r"(regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'))"
SHINGLES = f"""
words AS (SELECT doc_id, list_filter(string_split({COLLAPSED}, ' '), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words)
"""
CHUNKS = f"""
c AS (SELECT doc_id AS id, length(coalesce(text, '')) AS n, length({BLANK}) AS body, coalesce(len(embedding), 0) AS dim,
             substr(sha256({COLLAPSED}), 1, 16) AS fp
      FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
dup AS (SELECT fp, count(*) AS copies, min(id) AS first_id FROM c WHERE body > 0 GROUP BY fp HAVING count(*) > 1),
med AS (SELECT median(n) AS m FROM c WHERE n > 0),
o AS (SELECT id, n, CASE WHEN n < m * 0.25 THEN 'short' WHEN n > m * 4 THEN 'long' END AS kind FROM c, med WHERE n > 0),
cnt AS (SELECT count(*) AS total, count(*) FILTER (WHERE body = 0) AS empty, count(*) FILTER (WHERE body > 0 AND body < 40) AS near_empty, count(*) FILTER (WHERE dim = 0) AS orphans FROM c),
ds AS (SELECT count(*) AS duplicate_groups, coalesce(sum(copies - 1), 0)::BIGINT AS duplicate_chunks FROM dup)
"""
SCORED = f"""
{CHUNKS},
parts AS (SELECT total, (1 - (empty + near_empty) / total) * 100 AS content, (1 - orphans / total) * 100 AS retrievable, (1 - duplicate_chunks / total) * 100 AS distinctness,
                 (1 - (SELECT count(*) FROM o WHERE kind IS NOT NULL) / total) * 100 AS sizing, (SELECT count(DISTINCT dim) FROM c WHERE dim > 0) > 1 AS capped
          FROM cnt, ds),
qs AS (SELECT *, CASE WHEN least(content, retrievable, distinctness, sizing) <= 0 THEN 0 ELSE 4 / (1 / content + 1 / retrievable + 1 / distinctness + 1 / sizing) END AS h FROM parts),
qscore AS (SELECT total, round(content, 6) AS content, round(retrievable, 6) AS retrievable, round(distinctness, 6) AS distinctness, round(sizing, 6) AS sizing, capped,
                  round(CASE WHEN capped THEN least(h, 40) ELSE h END, 6) AS quality_score FROM qs)
"""

_LEX = [(d, g, t.rstrip("*"), "stem" if t.endswith("*") else "phrase" if " " in t else "word") for d, gs in lexicons.DIMENSIONS.items() for g, ts in gs.items() for t in ts]
GROUPS = f"""
lex(dimension, grp, term, kind) AS {values(_LEX)},
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{Nd}}_''’-]*') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM tok),
single AS (SELECT DISTINCT doc_id, dimension, grp, p FROM pos JOIN lex ON (kind = 'word' AND w = term) OR (kind = 'stem' AND starts_with(w, term))),
phr AS (SELECT doc_id, dimension, grp, len(string_split(substr(line, 1, strpos(line, term) - 1), ' ')) AS p FROM (SELECT doc_id, array_to_string(ws, ' ') AS line FROM tok) JOIN lex ON kind = 'phrase' AND contains(line, term)),
hit AS (SELECT * FROM single UNION ALL SELECT * FROM phr),
ctx AS (SELECT dimension, grp, ws[greatest(p - 12, 1):p + 12] AS near FROM hit JOIN tok USING (doc_id)),
feel AS (SELECT dimension, grp, len(list_filter(near, lambda x: list_contains({q(lexicons.POSITIVE)}, x))) AS pos, len(list_filter(near, lambda x: list_contains({q(lexicons.NEGATIVE)}, x))) AS neg FROM ctx),
cnts AS (SELECT dimension, grp, count(*) AS mentions, avg(CASE WHEN pos + neg = 0 THEN 0 ELSE (pos - neg) / (pos + neg) END) AS sentiment FROM feel GROUP BY ALL),
grps AS (SELECT dimension, grp, coalesce(mentions, 0) AS mentions, sentiment FROM (SELECT DISTINCT dimension, grp FROM lex) LEFT JOIN cnts USING (dimension, grp))
"""
DIMS = f"""
{GROUPS},
d0 AS (SELECT dimension, sum(mentions)::BIGINT AS mentions, count(*) FILTER (WHERE mentions > 0) AS groups, min(CASE WHEN mentions > 0 THEN mentions END) AS lo, max(CASE WHEN mentions > 0 THEN mentions END) AS hi, min(sentiment) AS slo, max(sentiment) AS shi FROM grps GROUP BY dimension),
d1 AS (SELECT *, mentions >= 20 AND groups >= 2 AS assessed FROM d0),
d2 AS (SELECT *, CASE WHEN assessed THEN lo / hi END AS ratio, CASE WHEN assessed THEN shi - slo END AS spread FROM d1),
d3 AS (SELECT *, CASE WHEN ratio >= 1 THEN 100.0 WHEN ratio IS NOT NULL THEN round(least(100.0, ratio / 0.8 * 100), 1) END::DOUBLE AS representation,
              CASE WHEN spread <= 0 THEN 100.0 WHEN spread >= 0.6 THEN 0.0 WHEN spread IS NOT NULL THEN round((1 - spread / 0.6) * 100, 1) END::DOUBLE AS framing FROM d2),
dims AS (SELECT *, CASE WHEN assessed THEN round(CASE WHEN framing IS NULL THEN representation WHEN least(representation, framing) <= 0 THEN 0 ELSE round(2 / (1 / representation + 1 / framing), 2) END, 1) END AS score FROM d3),
fair AS (SELECT count(score) AS assessed, CASE WHEN count(score) = 0 THEN NULL WHEN min(score) <= 0 THEN 0 ELSE round(count(score) / sum(1 / score), 1) END AS fairness_score FROM dims)
"""
BIAS_FINDINGS = f"""
{DIMS},
bf AS (
  SELECT 'bias_unassessable.' || dimension AS "check", 'low' AS severity FROM dims WHERE NOT assessed
  UNION ALL SELECT 'representation_imbalance.' || dimension, CASE WHEN representation < 50 THEN 'high' ELSE 'medium' END FROM dims WHERE representation < 80
  UNION ALL SELECT 'framing_skew.' || dimension, CASE WHEN framing < 40 THEN 'high' ELSE 'medium' END FROM dims WHERE framing < 70
  UNION ALL SELECT 'fairness_score_below_threshold', CASE WHEN fairness_score < 50 THEN 'high' ELSE 'medium' END FROM fair WHERE fairness_score < 70
)
"""
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

VECS = """
v AS (SELECT vec_id % 2 AS side, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::BIGINT AS pos FROM embeddings),
cen AS (SELECT side, pos, avg(x) AS mean FROM v GROUP BY ALL)
"""
PSI = f"""
{VECS},
b AS (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY x) AS r, count(*) OVER (PARTITION BY pos) AS n FROM v WHERE side = 0),
e AS (SELECT b.pos, x AS edge FROM b, range(1, 10) t(i) WHERE r = n * i // 10),
bk AS (SELECT side, v.pos, vec_id, count(edge) FILTER (WHERE edge < x) AS k FROM v JOIN e USING (pos) GROUP BY side, v.pos, vec_id),
sh AS (SELECT side, pos, k, count(*) / sum(count(*)) OVER (PARTITION BY side, pos) AS share FROM bk GROUP BY side, pos, k),
g AS (SELECT DISTINCT pos, k FROM (SELECT DISTINCT pos FROM e), range(0, 10) t(k)),
psi AS (SELECT pos, round(sum((greatest(coalesce(c.share, 0), 1e-6) - greatest(coalesce(a.share, 0), 1e-6)) * ln(greatest(coalesce(c.share, 0), 1e-6) / greatest(coalesce(a.share, 0), 1e-6))), 4) AS psi
        FROM g LEFT JOIN (SELECT * FROM sh WHERE side = 0) a USING (pos, k) LEFT JOIN (SELECT * FROM sh WHERE side = 1) c USING (pos, k) GROUP BY pos)
"""
STRENGTH = """
nrm AS (SELECT vec_id % 2 AS side, avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS m FROM embeddings GROUP BY 1),
str AS (SELECT side, sqrt(sum(mean * mean)) / any_value(m) AS strength FROM cen JOIN nrm USING (side) GROUP BY side),
sim AS (SELECT sum(a.mean * b.mean) / (sqrt(sum(a.mean * a.mean)) * sqrt(sum(b.mean * b.mean))) AS s FROM cen a JOIN cen b ON a.pos = b.pos AND a.side = 0 AND b.side = 1)
"""
DRIFT = f"""
{PSI}, {STRENGTH},
n AS (SELECT count(*) FILTER (WHERE vec_id % 2 = 0) AS b, count(*) FILTER (WHERE vec_id % 2 = 1) AS c FROM embeddings),
f AS (SELECT *, round(18.0 / greatest(1, least(b, c)), 4) AS noise_floor, (SELECT min(strength) FROM str) >= 0.15 AS informative, round((SELECT s FROM sim), 4) AS s, (SELECT round(avg(psi), 4) FROM psi) AS psi_mean, (SELECT max(psi) FROM psi) AS psi_max FROM n),
t AS (SELECT *, greatest(0.10, noise_floor * 2) AS stable_at, greatest(0.25, noise_floor * 3) AS moderate_at FROM f),
dr AS (SELECT CASE WHEN (informative AND s < 0.90) OR psi_mean > moderate_at THEN 'shifted' WHEN (informative AND s < 0.98) OR psi_mean > stable_at THEN 'drifting' ELSE 'stable' END AS verdict, informative, psi_mean, psi_max, noise_floor::DOUBLE AS noise_floor,
              (SELECT count(*) FROM psi, t t2 WHERE psi.psi > t2.moderate_at) AS unstable_dimensions, b AS baseline_count, c AS current_count, round(c / b, 3) AS volume_ratio FROM t)
"""

_RE = [(n, a, "(?is)" + p.replace(r"\w", r"[\p{L}\p{M}\p{Nd}_]")) for n, a, _, p in SIGNATURES]
_HITS = " + ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN 1 ELSE 0 END" for _, _, p in _RE)
_ANY = lambda act: "(" + " OR ".join(f"regexp_matches(text, {q(p)})" for _, a, p in _RE if a == act) + ")"
GATE_LIST = f"""CASE WHEN {BLANK} = '' THEN 'empty_response' ELSE concat_ws(',', CASE WHEN regexp_matches(text, {q("(?i)" + output_gate.REFUSAL)}) THEN 'provider_refusal' END, CASE WHEN regexp_matches(text, {q("(?i)" + output_gate.OVERCLAIM)}) THEN 'assurance_overclaim' END) END"""
CALLS = f"""
est AS (SELECT conv_id, turn, role, text, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations),
calls AS (SELECT a.conv_id, a.turn, coalesce(p.tokens, 0) AS prompt_tokens, a.tokens AS completion_tokens, {_ANY("block").replace("(text,", "(a.text,")} OR contains({GATE_LIST.replace("text", "a.text").replace("a.a.", "a.")}, 'overclaim') AS blocked
          FROM est a LEFT JOIN est p ON p.conv_id = a.conv_id AND p.turn + 1 = a.turn AND p.role <> 'assistant' WHERE a.role = 'assistant')
"""

_SYS = [(s[0], " ".join([s[0], s[1], s[3], s[4], *s[2], *s[7]]).lower().replace("_", " ").replace("-", " "), s[1].lower(), s[5], s[6], *s[8:]) for s in samples.SYSTEMS]
_IND = [(f, c, t, t.replace("-", " ").replace("_", " "), i, j) for f, cs in vocabulary.INDICATORS.items() for i, (c, ts) in enumerate(cs.items()) for j, t in enumerate(ts)]
SYSTEMS = f"""
s(name, hay, sector, autonomy, oversight, is_gpai, systemic, content, biometrics, emotions, safety, market) AS {values(_SYS)},
ind(family, category, term, needle, i, j) AS {values(_IND)},
m AS (SELECT name, sector, family, category, string_agg(term, ',' ORDER BY j) AS hits FROM s JOIN ind ON contains(trim(regexp_replace(hay, '\\s+', ' ', 'g')), needle) GROUP BY name, sector, family, category),
k AS (SELECT s.*, (SELECT count(*) FROM m WHERE m.name = s.name AND family = 'unacceptable' AND (category <> 'emotion_workplace_education' OR regexp_matches(s.sector, 'employment|hr|education|recruitment'))) AS banned,
             (SELECT count(*) FROM m WHERE m.name = s.name AND family = 'annex_iii') AS a3, (SELECT count(*) FROM m WHERE m.name = s.name AND family = 'annex_i') AS a1,
             (SELECT count(*) FROM m WHERE m.name = s.name AND family = 'limited') AS lim, list_contains({q(vocabulary.HIGH_RISK_SECTORS)}, replace(replace(sector, '-', '_'), ' ', '_')) AS insec FROM s),
lc AS (SELECT name, category FROM m WHERE family = 'limited' UNION SELECT name, 'synthetic_content' FROM s WHERE content UNION SELECT name, 'emotion_recognition' FROM s WHERE emotions UNION SELECT name, 'biometric_categorisation' FROM s WHERE biometrics),
duty AS (SELECT name, count(DISTINCT CASE category WHEN 'emotion_recognition' THEN 'x' WHEN 'biometric_categorisation' THEN 'x' ELSE category END) AS n FROM lc GROUP BY name),
br AS (SELECT k.*, coalesce(n, 0) AS duties, CASE WHEN banned > 0 THEN 'banned' WHEN a3 + a1 > 0 THEN 'high' WHEN insec THEN 'sector' WHEN coalesce(n, 0) > 0 THEN 'limited' ELSE 'minimal' END AS branch FROM k LEFT JOIN duty USING (name)),
cls AS (SELECT name, CASE branch WHEN 'banned' THEN 'unacceptable' WHEN 'high' THEN 'high' WHEN 'sector' THEN CASE WHEN lim > 0 THEN 'limited' ELSE 'unknown' END ELSE branch END AS tier,
               (CASE branch WHEN 'banned' THEN 0.95 WHEN 'high' THEN round(CASE WHEN a1 > 0 AND a3 > 0 THEN 0.6 WHEN a3 >= 2 THEN 0.65 ELSE 0.85 END - CASE WHEN autonomy = 'autonomous' AND oversight IN ('none', 'unknown') THEN 0.05 ELSE 0 END, 2) WHEN 'sector' THEN 0.45 WHEN 'limited' THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence,
               CASE branch WHEN 'high' THEN a3 >= 2 OR (a1 > 0 AND a3 > 0) OR is_gpai WHEN 'sector' THEN TRUE ELSE FALSE END AS grey_zone,
               CASE branch WHEN 'sector' THEN 'sector_only' WHEN 'minimal' THEN 'no_indicator_matched' ELSE 'indicator_matched' END AS basis,
               (CASE branch WHEN 'banned' THEN 1 WHEN 'high' THEN 10 WHEN 'sector' THEN CASE WHEN lim > 0 THEN 4 ELSE 0 END WHEN 'limited' THEN duties ELSE 2 END)::BIGINT AS obligations,
               (CASE WHEN is_gpai AND systemic THEN 2 WHEN is_gpai THEN 1 ELSE 0 END)::BIGINT AS gpai_obligations FROM br)
"""
_DOS = [(s, k in n and bool(n[k]), k, r, [x for x in src if x in ev], bool(src)) for s, n, ev in samples.DOSSIERS for k, r, src in dossier.SECTIONS]
SECTIONS = f"""
x(system, told, section, annex_ref, evidence, has_sources) AS {values(_DOS)},
cov AS (SELECT system, section, annex_ref, array_to_string(evidence, ',') AS evidence, CASE WHEN told AND (len(evidence) > 0 OR NOT has_sources) THEN 'covered' WHEN told OR len(evidence) > 0 THEN 'partial' ELSE 'missing' END AS coverage FROM x)
"""
_MOD = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in samples.EVENT_MODULE.items()) + " END"
EVENTS = f"ev AS (SELECT event_id, user_id, event_type, {_MOD} AS module, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events), cl(clause, kind, module) AS {values([(c, k, m) for c, k, ms in ledger.CLAUSES for m in ms])}"
STATUSES = f"""
vn(provider, regions, mechanism, certified, optout, enabled, contractual, as_of) AS {values(samples.VENDORS)},
cr(criterion, grp, weight, critical) AS {values(samples.CRITERIA)}, seed(provider, criterion, status) AS {values(samples.SEEDED)}, given(provider, criterion, status) AS {values(samples.GIVEN)},
st AS (SELECT vn.provider, cr.*, coalesce(g.status, sd.status, 'unknown') AS status, g.status IS NOT NULL AS verified FROM vn CROSS JOIN cr LEFT JOIN seed sd USING (provider, criterion) LEFT JOIN given g ON g.provider = vn.provider AND g.criterion = cr.criterion),
pt AS (SELECT *, weight * CASE status WHEN 'met' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'unknown' THEN 0.2 ELSE 0 END AS pts FROM st),
vs AS (SELECT provider, round((sum(pts) / sum(weight) * 100)::DOUBLE, 1) AS score, count(*) FILTER (WHERE status = 'unknown') AS unknown_criteria, bool_or(verified) AS customer_verified FROM pt GROUP BY provider)
"""
GATE = f"""
{SCORED}, {DIMS}, {STATUSES},
sc AS (SELECT 'quality_score' AS name, round(quality_score, 1) AS value, 70.0 AS threshold FROM qscore UNION ALL SELECT 'fairness_score', fairness_score, 70 FROM fair
       UNION ALL SELECT 'vendor_score.' || provider, score, 40 FROM vs UNION ALL SELECT 'unset', 10, NULL UNION ALL SELECT 'unknown', NULL, 50),
oc AS (SELECT name, CASE WHEN threshold IS NULL THEN 'skipped' WHEN value IS NULL THEN 'unmeasured' WHEN value < threshold THEN 'fail' ELSE 'pass' END AS status FROM sc)
"""
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+[A-Za-z0-9_]"
IPV4 = r"(?:^|[^\p{L}\p{Nd}_])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[^\p{L}\p{Nd}_]|$)"

ORACLES: dict[str, str] = {
    "chunk_functions": f"WITH {SHINGLES} SELECT doc_id, length(coalesce(text, '')) AS length, greatest(1, length(coalesce(text, '')) // 4) AS tokens, substr(sha256({COLLAPSED}), 1, 16) AS fingerprint, len(s)::BIGINT AS shingles FROM documents JOIN sh USING (doc_id)",
    "chunk_words": "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}[\\p{L}\\p{M}\\p{Nd}_''’-]*'))::BIGINT AS words FROM documents",
    "vector_functions": "SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "js_divergence": """WITH e AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT h, sum(n) AS n FROM e GROUP BY h),
        r AS (SELECT t.event_type, a.h, coalesce(e.n, 0) / sum(coalesce(e.n, 0)) OVER (PARTITION BY t.event_type) AS p, a.n / sum(a.n) OVER (PARTITION BY t.event_type) AS q FROM (SELECT DISTINCT event_type FROM e) t CROSS JOIN a LEFT JOIN e ON e.event_type = t.event_type AND e.h = a.h)
        SELECT event_type, round(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS divergence FROM r GROUP BY event_type""",
    "exact_duplicates": f"WITH {CHUNKS} SELECT fp AS fingerprint, copies, first_id FROM dup",
    "duplicate_summary": f"WITH {CHUNKS} SELECT * FROM ds",
    "quality_counts": f"WITH {CHUNKS} SELECT * FROM cnt",
    "dimension_histogram": "SELECT len(embedding)::BIGINT AS dimension, count(*) AS chunks FROM documents JOIN embeddings ON doc_id = vec_id WHERE len(embedding) > 0 GROUP BY 1",
    "length_stats": f"WITH {CHUNKS} SELECT min(n) AS min_length, max(n) AS max_length, round(avg(n), 4) AS mean_length, round(median(n), 4) AS median_length, round(stddev_pop(n), 4) AS stdev_length FROM c WHERE n > 0",
    "finding_samples": f"""WITH {CHUNKS}, x AS (
            SELECT 'empty_chunks' AS chk, id FROM c WHERE body = 0 UNION ALL SELECT 'near_empty_chunks', id FROM c WHERE body > 0 AND body < 40
            UNION ALL SELECT 'unembedded_chunks', id FROM c WHERE dim = 0 UNION ALL SELECT 'oversized_chunks', id FROM o WHERE kind = 'long'),
        r AS (SELECT *, row_number() OVER (PARTITION BY chk ORDER BY id) AS k FROM x)
        SELECT chk AS "check", id AS "first", NULL::VARCHAR AS "second" FROM r WHERE k <= 10""",
    "copy_findings": f"""WITH p(page, locale, text) AS {values(samples.PAGES)}, l AS (SELECT page, locale, lower(coalesce(text, '')) AS low, page IN ('honesty', 'faq') AS exempt FROM p),
        b(phrase) AS {values([(x,) for x in copy_lint.BANNED])}, s(locale, phrase) AS {values([(k, x) for k, v in copy_lint.STATEMENTS.items() for x in v])}
        SELECT page, locale, 'banned phrase' AS problem, phrase FROM l, b WHERE NOT exempt AND contains(low, phrase)
        UNION ALL SELECT page, l.locale, 'missing statement', phrase FROM l JOIN s ON s.locale = CASE WHEN l.locale = 'tr' THEN 'tr' ELSE 'en' END WHERE exempt AND NOT contains(low, phrase)""",
    "length_outliers": f"WITH {CHUNKS} SELECT id, n AS length, kind FROM o WHERE kind IS NOT NULL",
    "near_duplicates": f"""WITH {CHUNKS}, {SHINGLES}, f AS (SELECT min(id) AS id FROM c WHERE body > 0 GROUP BY fp), g AS (SELECT id, len(s) AS k, unnest(s) AS gram FROM f JOIN sh ON id = doc_id),
        pr AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS joint, any_value(a.k) AS ka, any_value(b.k) AS kb FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id)
        SELECT id_a, id_b, round(joint / (ka + kb - joint), 6) AS jaccard FROM pr WHERE joint / (ka + kb - joint) >= 0.85""",
    "systematic_sample": "WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT id FROM r WHERE n <= 500 OR p IN (SELECT i * (SELECT count(*) FROM documents) // 500 FROM range(0, 500) t(i))",
    "quality_score": f"WITH {SCORED} SELECT * FROM qscore",
    "pii_email": f"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, {q(EMAIL)})",
    "pii_ipv4": f"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, {q(IPV4)})",
    "pii_secrets": r"""WITH s AS (SELECT doc_id AS id, concat_ws(',', CASE WHEN regexp_matches(text, '\b(?:sk|pk|rk)-[A-Za-z0-9_-]{15,}[A-Za-z0-9_]') THEN 'API_KEY' END, CASE WHEN regexp_matches(text, '(?:^|[^\p{L}\p{Nd}_])(?:AKIA|ASIA)[0-9A-Z]{16}(?:[^\p{L}\p{Nd}_]|$)') THEN 'AWS_KEY' END,
        CASE WHEN regexp_matches(text, '\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{7,}[A-Za-z0-9_]') THEN 'JWT' END) AS secrets FROM documents) SELECT * FROM s WHERE secrets <> ''""",
    "unmask_round_trip": "SELECT conv_id, turn, sha256(coalesce(text, '')) AS restored_sha256, 0::BIGINT AS leaked FROM conversations",
    "bias_mentions": f"WITH {GROUPS} SELECT dimension, grp, mentions, round(sentiment, 6) AS sentiment FROM grps",
    "bias_scores": f"WITH {DIMS} SELECT dimension, mentions, groups, assessed, round(ratio, 4) AS ratio, round(spread, 4) AS spread, representation, framing FROM dims",
    "fairness_score": f"WITH {DIMS} SELECT * FROM fair",
    "flagged_groups": f"WITH {GROUPS} SELECT dimension, grp, mentions < 0.8 * max(mentions) OVER w AS underrepresented, coalesce(sentiment < avg(sentiment) OVER w - 0.15, FALSE) AS negatively_framed FROM grps WINDOW w AS (PARTITION BY dimension)",
    "bias_findings": f"WITH {BIAS_FINDINGS} SELECT *, 'flag' AS action FROM bf",
    "findings_by_severity": f"WITH {BIAS_FINDINGS} SELECT *, ({RANK})::BIGINT AS rank FROM bf",
    "worst_severity": f"WITH {BIAS_FINDINGS} SELECT max_by(severity, {RANK}) AS worst FROM bf",
    "centroid": f"WITH {VECS} SELECT pos, round(mean, 6) AS mean FROM cen WHERE side = 0",
    "centroid_similarity": f"WITH {VECS}, {STRENGTH} SELECT round(s, 5) AS similarity FROM sim",
    "centroid_strength": f"WITH {VECS}, {STRENGTH} SELECT round(strength, 5) AS strength FROM str WHERE side = 0",
    "psi_by_dimension": f"WITH {PSI} SELECT * FROM psi",
    "drift_verdict": f"WITH {DRIFT} SELECT * FROM dr",
    "drift_findings": f"""WITH {DRIFT} SELECT * FROM (SELECT CASE verdict WHEN 'shifted' THEN 'corpus_semantic_shift' WHEN 'drifting' THEN 'corpus_drift' END AS "check", CASE verdict WHEN 'shifted' THEN 'high' ELSE 'medium' END AS severity, 'flag' AS action, 'Art. 15' AS article FROM dr
        UNION ALL SELECT 'corpus_volume_change', 'medium', 'flag', NULL FROM dr WHERE volume_ratio > 2 OR volume_ratio < 0.5) WHERE "check" IS NOT NULL""",
    "injection_scan": f"SELECT conv_id, turn, CASE WHEN {_ANY('block')} THEN 'block' WHEN {_ANY('flag')} THEN 'flag' ELSE 'pass' END AS action, ({_HITS})::BIGINT AS matches FROM conversations WHERE NOT regexp_matches(text, {q(BASE64_BLOB)}) AND NOT regexp_matches(text, {q(HEX_BLOB)}) UNION ALL SELECT conv_id, turn, CASE WHEN {_ANY('block')} THEN 'block' WHEN {_ANY('flag')} THEN 'flag' ELSE 'pass' END, ({_HITS})::BIGINT FROM conversations WHERE regexp_matches(text, {q(BASE64_BLOB)}) OR regexp_matches(text, {q(HEX_BLOB)})",
    "output_gate_findings": f"SELECT conv_id, turn, {GATE_LIST} AS findings FROM conversations WHERE role = 'assistant'",
    "guard_summary": f"WITH {CALLS} SELECT conv_id::VARCHAR AS session_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) FILTER (WHERE blocked) AS blocked_calls, 0::BIGINT AS degraded_calls FROM calls GROUP BY 1",
    "daily_tokens": f"WITH {CALLS} SELECT DATE '2024-01-01' + (conv_id % 7)::INTEGER AS day, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens FROM calls GROUP BY 1",
    "budget_breaches": f"""WITH {CALLS}, w AS (SELECT conv_id::VARCHAR AS session_id, turn AS call_index, prompt_tokens + completion_tokens AS tk, count(*) OVER o AS calls_before, coalesce(sum(prompt_tokens + completion_tokens) OVER o, 0)::BIGINT AS tokens_before FROM calls WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT session_id, call_index, calls_before, tokens_before, CASE WHEN calls_before >= 3 THEN 'max_calls_per_session' WHEN tokens_before + tk > 200 THEN 'max_tokens_per_session' END AS breach FROM w""",
    "day_budget_breaches": f"""WITH {CALLS}, c AS (SELECT conv_id::VARCHAR AS session_id, turn AS call_index, DATE '2024-01-01' + (conv_id % 7)::INTEGER AS day, (conv_id * 37 + turn * 11) % 86400 AS called, prompt_tokens + completion_tokens AS tk FROM calls),
        w AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY day ORDER BY called, session_id, call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS day_tokens_before FROM c)
        SELECT session_id, call_index, day, day_tokens_before, CASE WHEN day_tokens_before + tk > 500 THEN 'max_tokens_per_day' END AS breach FROM w""",
    "watermark_round_trip": "SELECT doc_id, TRUE AS present, 'AAI|' || substr('system-' || source, 1, 24) || '|2024-06-01' AS tag, TRUE AS valid, TRUE AS stripped, substr(sha256(text), 1, 16) AS content_hash, (length(text) + 2 + 8 * strlen('AAI|' || substr('system-' || source, 1, 24) || '|2024-06-01'))::BIGINT AS marked_length FROM documents",
    "classify_systems": f"WITH {SYSTEMS} SELECT * FROM cls",
    "classification_findings": f"""WITH {SYSTEMS} SELECT name, 'eu_ai_act_tier' AS "check", CASE tier WHEN 'unacceptable' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'minimal' THEN 'info' ELSE 'medium' END AS severity, CASE tier WHEN 'unacceptable' THEN 'block' ELSE 'flag' END AS action FROM cls
        UNION ALL SELECT name, 'classification_grey_zone', 'medium', 'flag' FROM cls WHERE grey_zone""",
    "indicator_matches": f"WITH {SYSTEMS} SELECT name, family, category, hits FROM m",
    "intake_answers": "SELECT * FROM (VALUES ('lift', 'transport', 'lift control|door timing', 'assistive', TRUE, FALSE, TRUE), ('writer', 'media', 'generates text|edits text', 'assistive', TRUE, TRUE, TRUE), ('unnamed-system', 'media', '', 'assistive', FALSE, FALSE, FALSE)) t(name, sector, use_cases, autonomy, generates_content, is_gpai, eu_market)",
    "annex_iv_coverage": f"WITH {SECTIONS} SELECT * FROM cov",
    "annex_iv_completeness": f"WITH {SECTIONS} SELECT system, round(avg(CASE coverage WHEN 'covered' THEN 1 WHEN 'partial' THEN 0.5 ELSE 0 END) * 100, 1) AS completeness FROM cov GROUP BY system",
    "annex_iv_gaps": f"""WITH {SECTIONS} SELECT system, 'annex_iv_gap.' || section AS "check", CASE coverage WHEN 'missing' THEN 'high' ELSE 'medium' END AS severity, 'flag' AS action, 'Art. 11 + ' || annex_ref AS article FROM cov WHERE coverage <> 'covered'""",
    "recipes": f"WITH r(check_root, recipe, impact, effort) AS {values(remediation.RECIPES)} SELECT *, (3 * CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END - CASE effort WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::BIGINT AS leverage FROM r",
    "model_pins": f"WITH m(model) AS {values([(m,) for m in samples.MODELS])} SELECT model, model NOT IN ('', 'deterministic') AND NOT regexp_matches(model, '-(latest|exp|preview|nightly)$') AND regexp_matches(model, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{3,}})$') AS pinned FROM m",
    "clause_coverage": f"""WITH {EVENTS}, t AS (SELECT clause, kind, event_type, count(event_id) AS n, min(timestamp) AS a, max(timestamp) AS z FROM cl LEFT JOIN ev USING (module) GROUP BY ALL)
        SELECT clause, sum(n)::BIGINT AS entries, substr(min(a), 1, 10) AS first_day, substr(max(z), 1, 10) AS last_day, coalesce(string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FILTER (WHERE n > 0), '') AS event_types,
               CASE WHEN sum(n) = 0 THEN 'no_records' WHEN kind = 'input' THEN 'input_only' ELSE 'evidenced' END AS status FROM t GROUP BY clause, kind""",
    "unattributed_events": f"WITH {EVENTS} SELECT count(*) AS unattributed FROM ev WHERE module IS NULL OR module NOT IN (SELECT module FROM cl)",
    "events_by_module": f"WITH {EVENTS} SELECT event_id, event_type, timestamp FROM ev WHERE module = 'guard'",
    "evidence_listed": f"WITH {EVENTS} SELECT event_id, event_type, (SELECT greatest(count(*) - 25, 0) FROM ev WHERE module = 'guard') AS remaining FROM ev WHERE module = 'guard' ORDER BY event_id LIMIT 25",
    "vendor_scores": f"WITH {STATUSES} SELECT * FROM vs",
    "vendor_group_scores": f"WITH {STATUSES} SELECT provider, grp, round((sum(pts) / sum(weight) * 100)::DOUBLE, 1) AS score FROM pt GROUP BY provider, grp",
    "vendor_gaps": f"""WITH {STATUSES} SELECT provider, 'vendor_gap.' || criterion AS "check", CASE WHEN critical THEN 'critical' ELSE 'medium' END AS severity, CASE WHEN critical THEN 'block' ELSE 'flag' END AS action FROM st WHERE status = 'not_met'""",
    "vendor_verdicts": f"""WITH {STATUSES}, l AS (SELECT *, list_filter(regions, lambda r: r NOT IN ('EU', 'UK', 'JP') AND NOT (r = 'US' AND coalesce(certified::BOOLEAN, FALSE))) AS rest FROM vn)
        SELECT provider, CASE WHEN len(regions) = 0 THEN 'unknown' WHEN len(rest) = 0 THEN 'compliant' WHEN mechanism IN ('scc', 'bcr') OR len(list_filter(rest, lambda r: r <> 'US')) = 0 THEN 'requires_scc' ELSE 'non_compliant' END AS residency,
               CASE WHEN optout IS NULL THEN 'unknown' WHEN NOT optout THEN 'not_available' WHEN coalesce(enabled AND contractual, FALSE) THEN 'enforced' ELSE 'available_not_evidenced' END AS optout, coalesce(DATE '2026-07-01' - as_of::DATE > 180, TRUE) AS stale FROM l""",
    "gate_outcomes": f"WITH {GATE}, {SYSTEMS.replace('parts', 'parts')} SELECT name, status, status IN ('fail', 'unmeasured', 'error') AS blocking FROM oc UNION ALL SELECT 'classification_certainty.' || name, 'unmeasured', TRUE FROM cls WHERE grey_zone UNION ALL SELECT 'guard', 'skipped', FALSE",
    "gate_result": f"""WITH {GATE}, al AS (SELECT status FROM oc UNION ALL SELECT 'skipped'), r AS (SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'unmeasured') AS unmeasured, count(*) FILTER (WHERE status = 'skipped') AS skipped, 0::BIGINT AS error FROM al)
        SELECT *, fail + unmeasured AS blocking, (CASE WHEN fail + unmeasured > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code, fail + unmeasured = 0 AS passed FROM r""",
    "score_bands": f"WITH {GATE} SELECT name, CASE WHEN value IS NULL THEN 'unmeasured' WHEN value >= 85 THEN 'good' WHEN value >= 70 THEN 'watch' WHEN value >= 50 THEN 'poor' ELSE 'critical' END AS band, value >= threshold AS passed FROM sc",
}
