"""Risk classification of AI systems by indicator phrases, declared facts and sector.

Hyphens are read as spaces on both sides, so hyphenated indicators can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.functions import vocabulary as V
from verispark.schemas import SYSTEM

_NONE = "array<string>"


def subject(spec: str = "") -> Column:
    """The text that indicators are looked up in."""
    c = lambda n: F.coalesce(F.col(spec + n), F.lit(""))
    lists = [F.array_join(F.coalesce(F.col(spec + n), F.array().cast(_NONE)), " ") for n in ("use_cases", "affected_persons")]
    return F.concat_ws(" ", c("name"), c("sector"), c("description"), c("deployment_context"), *lists)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  "), r"(?U)\s+", " "))


def article(a: Column) -> Column:
    """An article's number in the final text."""
    aliases = F.create_map(*[F.lit(x) for kv in V.ARTICLE_ALIASES.items() for x in kv])
    return F.coalesce(aliases[F.trim(a)], F.trim(a))


def indicators(hay: Column, family: str) -> Column:
    """Array of (category, hits) in the order of the vocabulary; hay is normalised."""
    rows = []
    for category, terms in V.INDICATORS[family].items():
        hits = F.filter(F.array(*[F.when(F.contains(hay, F.lit(t.replace("-", " ").replace("_", " "))), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
        rows.append(F.struct(F.lit(category).alias("category"), hits.alias("hits")))
    return F.filter(F.array(*rows), lambda r: F.size(r["hits"]) > 0)


def indicator_table(systems: DataFrame) -> DataFrame:
    """name, family, category, hits: one row for each category that matches."""
    hay = systems.select("name", normalised(subject()).alias("hay"))

    def of(family: str) -> Column:
        return F.transform(indicators(F.col("hay"), family), lambda r: F.struct(F.lit(family).alias("family"), r["category"].alias("category"), r["hits"].alias("hits")))

    every = F.concat(*[of(f) for f in V.INDICATORS])
    return hay.select("name", F.explode(every).alias("r")).select("name", "r.*")


def _duties(tier: str) -> Column:
    return F.array(*[F.lit(a) for t, a, _ in V.OBLIGATIONS if t == tier])


def classify(systems: DataFrame) -> DataFrame:
    """One row for each system: tier, confidence, grey_zone, articles, categories, basis, obligations, gpai_obligations.

    Cascade: prohibited, high by product or use case, sector alone, transparency, minimal.  Null flags are false, a null market is the EU's."""
    flag = lambda n, d=False: F.coalesce(F.col(n), F.lit(d))
    s = systems.withColumn("hay", normalised(subject())).withColumn("sec", F.lower(F.coalesce("sector", F.lit(""))))
    cats = lambda f: F.transform(indicators(F.col("hay"), f), lambda r: r["category"])
    at_work = F.exists(F.array(*[F.lit(x) for x in V.CONTEXT_SECTORS]), lambda x: F.contains(F.col("sec"), x))
    s = s.withColumn("banned", F.filter(cats("unacceptable"), lambda c: (c != "emotion_workplace_education") | at_work))
    s = s.withColumn("a3", cats("annex_iii")).withColumn("a1", cats("annex_i")).withColumn("lim", cats("limited"))
    s = s.withColumn("in_sector", F.regexp_replace("sec", "[- ]", "_").isin(V.HIGH_RISK_SECTORS))
    declared = F.filter(F.array(F.when(flag("generates_content"), "synthetic_content"), F.when(flag("infers_emotions"), "emotion_recognition"), F.when(flag("processes_biometrics"), "biometric_categorisation")), lambda x: x.isNotNull())
    s = s.withColumn("lim_all", F.array_union("lim", declared))
    some = lambda c: F.size(c) > 0
    branch = F.when(some("banned"), "banned").when(some("a3") | some("a1"), "high").when(F.col("in_sector"), "sector").when(some("lim_all"), "limited").otherwise("minimal")
    s = s.withColumn("branch", branch)
    pick = lambda **v: F.coalesce(*[F.when(F.col("branch") == k, x) for k, x in v.items()])
    high_conf = F.when(some("a1") & some("a3"), 0.6).when(F.size("a3") >= 2, 0.65).otherwise(0.85)
    unwatched = (F.coalesce("autonomy", F.lit("assistive")) == "autonomous") & F.coalesce("human_oversight", F.lit("unknown")).isin("none", "unknown")
    high_conf = F.round(high_conf - F.when(unwatched, 0.05).otherwise(0.0), 2)
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast(_NONE)
    arts = F.array_sort(F.array_distinct(F.concat(F.when(some("a1"), strings("Art. 6(1)", "Annex I")).otherwise(none), F.when(some("a3"), strings("Annex III")).otherwise(none), F.when(F.col("in_sector"), strings("Art. 6(2)")).otherwise(none))))
    fits = F.filter(F.array(*[F.when(F.arrays_overlap(F.col("lim_all"), strings(*c)), F.lit(a)) for a, c in V.DUTY_CATEGORIES.items()]), lambda x: x.isNotNull())
    limited_duties = F.when(F.size(fits) > 0, fits).otherwise(_duties("limited"))
    gpai = F.when(flag("is_gpai"), F.when(flag("gpai_systemic_risk"), _duties("gpai")).otherwise(strings("Art. 53"))).otherwise(none)
    return s.select(
        "name",
        pick(banned=F.lit("unacceptable"), high=F.lit("high"), sector=F.when(some("lim"), "limited").otherwise("unknown"), limited=F.lit("limited"), minimal=F.lit("minimal")).alias("tier"),
        pick(banned=F.lit(0.95), high=high_conf, sector=F.lit(0.45), limited=F.lit(0.8), minimal=F.lit(0.6)).alias("confidence"),
        pick(banned=F.lit(False), high=(F.size("a3") >= 2) | (some("a1") & some("a3")) | flag("is_gpai"), sector=F.lit(True), limited=F.lit(False), minimal=F.lit(False)).alias("grey_zone"),
        pick(banned=strings("Art. 5"), high=arts, sector=F.when(some("lim"), strings("Art. 6(2)", "Art. 50")).otherwise(strings("Art. 6(2)")), limited=strings("Art. 50"), minimal=strings("Art. 6(3)")).alias("articles"),
        pick(banned=none, high=F.concat(F.array_sort("a3"), F.array_sort("a1")), sector=none, limited=none, minimal=none).alias("categories"),
        pick(banned=F.lit("indicator_matched"), high=F.lit("indicator_matched"), sector=F.lit("sector_only"), limited=F.lit("indicator_matched"), minimal=F.lit("no_indicator_matched")).alias("basis"),
        pick(banned=_duties("unacceptable"), high=_duties("high"), sector=F.when(some("lim"), _duties("limited")).otherwise(none), limited=limited_duties, minimal=_duties("minimal")).alias("obligations"),
        gpai.alias("gpai_obligations"), flag("eu_market", True).alias("eu_market"), F.lit(V.VERSION).alias("regulation_version"),
    )


def classification_findings(classified: DataFrame) -> DataFrame:
    """name, check, severity, action: the tier, and the grey zone where there is one."""
    tier = F.col("tier")
    severity = F.when(tier == "unacceptable", "critical").when(tier == "high", "high").when(tier.isin("limited", "unknown"), "medium").otherwise("info")
    f = lambda check, sev, act: F.struct(F.lit(check).alias("check"), sev.alias("severity"), act.alias("action"))
    found = F.array(f("eu_ai_act_tier", severity, F.when(tier == "unacceptable", "block").otherwise("flag")), F.when(F.col("grey_zone"), f("classification_grey_zone", F.lit("medium"), F.lit("flag"))))
    return classified.select("name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("name", "f.*")


def obligation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.OBLIGATIONS, "tier string, article string, evidence_source string")


#: Intake: key, kind, choices, required, the key it depends on.
QUESTIONS: list[tuple[str, str, list[str], bool, str | None]] = [
    ("name", "text", [], True, None),
    ("sector", "text", [], True, None),
    ("use_cases", "list", [], True, None),
    ("description", "text", [], False, None),
    ("deployment_context", "choice", ["internal tool", "customer-facing", "public sector", "public-facing eu"], False, None),
    ("affected_persons", "list", [], False, None),
    ("autonomy", "choice", ["assistive", "human_in_the_loop", "autonomous"], False, None),
    ("human_oversight", "choice", ["none", "review", "approval", "unknown"], False, None),
    ("generates_content", "bool", [], False, None),
    ("processes_biometrics", "bool", [], False, None),
    ("infers_emotions", "bool", [], False, None),
    ("safety_component", "bool", [], False, None),
    ("is_gpai", "bool", [], False, None),
    ("gpai_systemic_risk", "bool", [], False, "is_gpai"),
    ("eu_market", "bool", [], False, None),
]
TRUE_WORDS = ["y", "yes", "true", "1", "evet", "on"]


def intake_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "key string, kind string, choices array<string>, required boolean, depends_on string")


def answers_to_specs(answers: DataFrame) -> DataFrame:
    """Answers as strings, one column a key, become system rows: lists by lines or else commas, yes in several forms; missing columns take defaults."""
    defaults = {"name": "unnamed-system", "autonomy": "assistive", "human_oversight": "unknown"}
    have = set(answers.columns)
    out = []
    for key, kind, *_ in QUESTIONS:
        raw = F.col(key).cast("string") if key in have else F.lit(None).cast("string")
        if kind == "list":
            parts = F.when(F.contains(raw, F.lit("\n")), F.split(raw, "\n")).otherwise(F.split(raw, ","))
            value = F.coalesce(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), F.array().cast(_NONE))
        elif kind == "bool":
            value = F.coalesce(F.lower(F.trim(raw)).isin(TRUE_WORDS), F.lit(key == "eu_market"))
        else:
            value = F.when(F.coalesce(raw, F.lit("")) == "", F.lit(defaults.get(key, ""))).otherwise(raw)
        out.append(value.alias(key))
    return answers.select(*out).to(_schema(answers.sparkSession))


def _schema(spark: SparkSession):
    return spark.createDataFrame([], SYSTEM).schema


def missing_required(answers: DataFrame) -> Column:
    """Array of the required keys without an answer."""
    have = set(answers.columns)
    gap = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", F.lit(k)) if k in have else F.lit(k) for k, _, _, required, _ in QUESTIONS if required]
    return F.filter(F.array(*gap), lambda x: x.isNotNull())
