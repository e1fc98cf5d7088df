"""Vocabulary of the risk classification, as versioned data."""

from __future__ import annotations

# Fixed values throughout.
VERSION = "EU-2024/1689:2024-07-12"
ARTICLE_ALIASES = {"Art. 52": "Art. 50", "Art. 52a": "Art. 50"}

INDICATORS: dict[str, dict[str, list[str]]] = {
    "unacceptable": {
        "subliminal_manipulation": ["subliminal", "manipulative technique", "deceptive technique", "exploit vulnerability", "behavioural manipulation"],
        "vulnerability_exploitation": ["exploit age", "exploit disability", "target children", "vulnerable group targeting"],
        "social_scoring": ["social score", "social scoring", "citizen score", "trustworthiness score", "social credit"],
        "predictive_policing_individual": ["predict criminal", "criminal prediction", "predictive policing", "recidivism prediction", "crime likelihood"],
        "facial_scraping": ["facial recognition database", "scrape facial", "untargeted scraping", "facial image scraping"],
        "emotion_workplace_education": ["emotion recognition workplace", "emotion detection employee", "emotion recognition school", "student emotion"],
        "biometric_categorisation_sensitive": ["infer race", "infer ethnicity", "infer sexual orientation", "infer political opinion", "infer religious belief", "biometric categorisation"],
        "realtime_remote_biometric_public": ["real-time remote biometric", "live facial recognition public", "realtime biometric identification public"],
    },
    "annex_iii": {
        "1. Biometrics": ["biometric identification", "biometric verification", "face recognition", "fingerprint", "iris scan", "voice identification", "gait recognition"],
        "2. Critical infrastructure": ["critical infrastructure", "traffic management", "water supply", "gas supply", "electricity supply", "heating supply", "digital infrastructure safety"],
        "3. Education and vocational training": ["student admission", "exam scoring", "exam proctoring", "grading", "educational assessment", "learning outcome prediction", "student evaluation", "admission decision", "school placement"],
        "4. Employment and worker management": ["cv screening", "resume screening", "candidate ranking", "recruitment", "hiring decision", "job applicant", "promotion decision", "termination decision", "task allocation", "worker monitoring", "performance evaluation", "employee evaluation"],
        "5. Essential services and benefits": ["credit scoring", "creditworthiness", "loan approval", "loan decision", "insurance pricing", "life insurance", "health insurance risk", "public benefit", "social benefit eligibility", "emergency dispatch", "triage"],
        "6. Law enforcement": ["law enforcement", "polygraph", "evidence reliability", "crime analytics", "criminal investigation", "victim risk assessment"],
        "7. Migration, asylum and border control": ["asylum application", "visa application", "border control", "migration", "immigration risk", "residence permit"],
        "8. Administration of justice": ["judicial decision", "court decision support", "legal reasoning assistance", "sentencing", "democratic process", "election influence"],
    },
    "annex_i": {
        "machinery": ["machinery safety", "industrial machine control"],
        "medical_device": ["medical device", "diagnosis support", "clinical decision support", "in vitro diagnostic", "patient triage"],
        "vehicle": ["autonomous driving", "vehicle safety", "adas", "driver assistance"],
        "aviation": ["aircraft system", "air traffic"],
        "toys": ["toy safety", "children's toy"],
        "lifts": ["lift control", "elevator control"],
        "radio_equipment": ["radio equipment"],
    },
    "limited": {
        "human_interaction": ["chatbot", "conversational agent", "virtual assistant", "customer support bot", "interacts with humans"],
        "synthetic_content": ["generates text", "generates image", "generates video", "generates audio", "synthetic media", "generative"],
        "deepfake": ["deepfake", "face swap", "voice cloning", "synthetic person"],
        "emotion_recognition": ["emotion recognition", "sentiment of individuals", "affect detection"],
        "biometric_categorisation": ["biometric categorisation", "demographic inference"],
    },
}
HIGH_RISK_SECTORS = ["healthcare", "health", "finance", "fintech", "banking", "insurance", "employment", "hr", "recruitment", "education", "law_enforcement", "justice", "migration", "critical_infrastructure", "energy", "utilities"]
CONTEXT_SECTORS = ["employment", "hr", "education", "recruitment"]

#: tier, article, source of evidence.
OBLIGATIONS: list[tuple[str, str, str]] = [
    ("unacceptable", "Art. 5", "—"),
    ("high", "Art. 9", "euact.dossier"),
    ("high", "Art. 10", "rag.bias + rag.quality"),
    ("high", "Art. 11 + Annex IV", "euact.dossier"),
    ("high", "Art. 12", "core.audit + guard.ledger"),
    ("high", "Art. 13", "euact.dossier"),
    ("high", "Art. 14", "guard.fallback"),
    ("high", "Art. 15", "guard.injection"),
    ("high", "Art. 17", "cicd.gate"),
    ("high", "Art. 26", "guard.ledger"),
    ("high", "Art. 27", "euact.dossier"),
    ("limited", "Art. 50(1)", "euact.transparency"),
    ("limited", "Art. 50(2)", "euact.transparency"),
    ("limited", "Art. 50(3)", "euact.transparency"),
    ("limited", "Art. 50(4)", "euact.transparency"),
    ("minimal", "Art. 4", "—"),
    ("minimal", "—", "—"),
    ("gpai", "Art. 53", "euact.dossier"),
    ("gpai", "Art. 55", "guard.injection"),
]
#: Which limited-risk categories call for which duty.
DUTY_CATEGORIES = {
    "Art. 50(1)": ["human_interaction"],
    "Art. 50(2)": ["synthetic_content"],
    "Art. 50(3)": ["emotion_recognition", "biometric_categorisation"],
    "Art. 50(4)": ["deepfake"],
}
