"""Prompt-injection signatures over columns of text, plain and inside encoded blobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, action, severity and pattern, in the order in which they report.
SIGNATURES: list[tuple[str, str, str, str]] = [
    ("instruction_override", "block", "critical", r"ignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+(?:instruction|prompt|rule|direction)"),
    ("instruction_disregard", "block", "critical", r"disregard\s+(?:the\s+)?(?:previous|prior|above|system|earlier|all)"),
    ("instruction_forget", "block", "critical", r"forget\s+(?:everything|all\s+(?:of\s+)?(?:the\s+)?above|your\s+(?:instructions|rules|training))"),
    ("prompt_exfiltration", "block", "critical", r"(?:reveal|print|show|repeat|output|display|echo)\s+(?:me\s+)?(?:your\s+|the\s+)?(?:system\s+|initial\s+|original\s+)?(?:prompt|instructions|directive|rules)"),
    ("verbatim_exfiltration", "block", "high", r"repeat\s+(?:the\s+)?(?:text|words|content)\s+above\s+verbatim"),
    ("persona_override", "flag", "high", r"you\s+are\s+now\s+(?:a|an|the)\s+\w+|act\s+as\s+(?:if\s+you\s+(?:are|were)|a\s+\w+\s+with\s+no)"),
    ("dan_style", "block", "high", r"\b(?:DAN|do\s+anything\s+now|developer\s+mode|jailbreak(?:en)?|unfiltered\s+mode)\b"),
    ("restriction_removal", "block", "high", r"(?:without|ignore|bypass|remove|disable)\s+(?:any\s+|all\s+|your\s+)?(?:restrictions|limitations|guardrails|safety|filters|content\s+polic)"),
    ("verdict_override", "block", "critical", r"(?:mark|assess|classify|report|rate|treat|consider)\s+(?:\w+\s+){0,3}as\s+(?:compliant|low[-\s]?risk|minimal|safe|passing|acceptable)"),
    ("classification_override", "block", "critical", r"override\s+(?:the\s+)?(?:classification|assessment|tier|risk\s+level|score)"),
    ("finding_suppression", "block", "critical", r"(?:do\s+not|don't|never)\s+(?:report|mention|include|flag|list)\s+(?:any\s+)?(?:findings?|issues?|gaps?|violations?|problems?)"),
    ("delimiter_spoof", "block", "high", r"(?:<\|?(?:im_start|im_end|system|endoftext)\|?>|\[/?INST\]|<<SYS>>|###\s*System:)"),
    ("role_spoof", "flag", "medium", r"^\s*(?:system|assistant)\s*:\s*\S"),
    ("tool_smuggling", "flag", "medium", r"(?:call|invoke|execute|run)\s+(?:the\s+)?(?:function|tool|command)\s+[\w.]+\s*\("),
    ("exfil_destination", "block", "critical", r"(?:send|post|upload|forward)\s+(?:the\s+|this\s+|all\s+)?(?:data|results?|context|conversation|output)\s+to\s+(?:https?://|\S+@)"),
    ("instruction_override_tr", "block", "critical", r"(?:[öo]nceki|[öo]nceden|yukar[ıi]daki|[öo]nce\s+verilen)\s+(?:t[üu]m\s+)?(?:talimat|y[öo]nerge|kural|komut)\w*\s*(?:[ıi])?\s*(?:yok\s?say|g[öo]z\s?ard[ıi]\s+et|dikkate\s+alma|unut)"),
    ("instruction_disregard_tr", "block", "critical", r"(?:t[üu]m\s+)?(?:talimat|y[öo]nerge|kural|sistem\s+istemi)\w*\s*(?:[ıi])?\s*(?:yok\s?say|g[öo]z\s?ard[ıi]\s+et|dikkate\s+alma|iptal\s+et)"),
    ("instruction_forget_tr", "block", "critical", r"(?:her\s?[şs]eyi|yukar[ıi]dakilerin?\s+hepsini|t[üu]m\s+kurallar[ıi]n[ıi])\s+unut"),
    ("prompt_exfiltration_tr", "block", "critical", r"(?:sistem\s+)?(?:istemini|promptunu|talimatlar[ıi]n[ıi]|y[öo]nergeleri?ni)\s*(?:bana\s+)?(?:g[öo]ster|yazd[ıi]r|payla[şs]|s[öo]yle|tekrarla|a[çc][ıi]kla)"),
    ("persona_override_tr", "flag", "high", r"(?:art[ıi]k|[şs]u\s+andan\s+itibaren)\s+(?:sen\s+)?bir\s+\w+|sen\s+art[ıi]k\s+\w+"),
    ("restriction_removal_tr", "block", "high", r"(?:k[ıi]s[ıi]tlama|s[ıi]n[ıi]rlama|g[üu]venlik|filtre|kural)\w*\s*(?:[ıi]|s[ıi]z)?\s*(?:olmadan|kald[ıi]r|devre\s?d[ıi][şs][ıi]\s+b[ıi]rak|yok\s?say|a[şs])"),
    ("verdict_override_tr", "block", "critical", r"(?:bu(?:nu)?|sistemi|modeli|onu)?\s*(?:uyumlu|d[üu][şs][üu]k\s+riskli|minimal|asgari|g[üu]venli|ge[çc]er)\s*(?:olarak\s+)?(?:i[şs]aretle|s[ıi]n[ıi]fland[ıi]r|de[ğg]erlendir|raporla|kabul\s+et)\w*"),
    ("classification_override_tr", "block", "critical", r"(?:s[ıi]n[ıi]fland[ıi]rmay[ıi]|de[ğg]erlendirmeyi|risk\s+seviyesini|skoru)\s*(?:ge[çc]ersiz\s+k[ıi]l|de[ğg]i[şs]tir|ez|zorla)"),
    ("finding_suppression_tr", "block", "critical", r"(?:hi[çc]bir\s+)?(?:bulgu|sorun|eksik|ihlal|a[çc][ıi]k)\w*\s*(?:[ıi]|u)?\s*(?:raporlama|bildirme|listeleme|belirtme|g[öo]sterme|yazma)"),
    ("exfil_destination_tr", "block", "critical", r"(?:veriyi|sonu[çc]lar[ıi]|[çc][ıi]kt[ıi]y[ıi]|konu[şs]may[ıi]|ba[ğg]lam[ıi])\s+(?:[şs]u\s+adrese\s+)?(?:g[öo]nder|ilet|y[üu]kle|aktar)\w*\s*(?::|\s)?\s*(?:https?://|\S+@)"),
]
#: For each signature, words of which a match holds all of some entry, in lower case with a dotted i; only texts that hold them meet the pattern.
NEEDS: dict[str, list[str]] = {
    "instruction_override": ["ignore"],
    "instruction_disregard": ["disregard"],
    "instruction_forget": ["forget"],
    "prompt_exfiltration": ["prompt", "instructions", "directive", "rules"],
    "verbatim_exfiltration": ["repeat above verbatim"],
    "persona_override": ["you are now", "act as"],
    "dan_style": ["dan", "anything now", "developer mode", "jailbreak", "unfiltered mode"],
    "restriction_removal": ["restrictions", "limitations", "guardrails", "safety", "filters", "content polic"],
    "verdict_override": ["compliant", "risk", "minimal", "safe", "passing", "acceptable"],
    "classification_override": ["override"],
    "finding_suppression": ["finding", "issue", "gap", "violation", "problem"],
    "delimiter_spoof": ["im_start", "im_end", "system", "endoftext", "inst]", "<<sys>>"],
    "role_spoof": ["system :", "assistant :"],
    "tool_smuggling": ["function (", "tool (", "command ("],
    "exfil_destination": ["to ://", "to @"],
    "instruction_override_tr": ["yok", "ard", "dikkate", "unut"],
    "instruction_disregard_tr": ["yok", "ard", "dikkate", "iptal"],
    "instruction_forget_tr": ["unut"],
    "prompt_exfiltration_tr": ["istemini", "promptunu", "talimatlar", "nergeler"],
    "persona_override_tr": ["artik", "itibaren"],
    "restriction_removal_tr": ["kisitlama", "sinirlama", "venlik", "filtre", "kural"],
    "verdict_override_tr": ["aretle", "siniflandir", "erlendir", "raporla", "kabul"],
    "classification_override_tr": ["siniflandirmayi", "erlendirmeyi", "seviyesini", "skoru"],
    "finding_suppression_tr": ["raporlama", "bildirme", "listeleme", "belirtme", "sterme", "yazma"],
    "exfil_destination_tr": ["://", "@"],
}
BASE64_BLOB = r"\b[A-Za-z0-9+/]{40,}={0,2}\b"
HEX_BLOB = r"\b(?:[0-9a-fA-F]{2}){20,}\b"
BLOBS = 6
MATCH = "struct<check:string,action:string,severity:string,carrier:string,offset:int,length:int>"


def _java(pattern: str) -> str:
    return "(?iusU)" + pattern


def _folded(text: Column) -> Column:
    """Lower case, with the letters that the patterns take for i, s and k (lower of upper is no way: the optimizer makes it lower)."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def _may_match(name: str, folded: Column) -> Column:
    out = F.lit(False)
    for entry in NEEDS[name]:
        held = F.lit(True)
        for word in entry.split(" "):
            held = held & F.contains(folded, F.lit(word))
        out = out | held
    return out


def matches(text: Column, carrier: str = "plain") -> Column:
    """First match of each signature: check, action, severity, carrier, offset and length; never the text.

    The text is folded once, in an array of one element, and a pattern runs only where the words that it needs occur."""
    t = F.coalesce(text, F.lit(""))

    def one(folded: Column, name: str, action: str, severity: str, pattern: str) -> Column:
        p = F.lit(_java(pattern))
        place = F.struct(
            F.lit(name).alias("check"), F.lit(action).alias("action"), F.lit(severity).alias("severity"), F.lit(carrier).alias("carrier"),
            (F.regexp_instr(t, p) - 1).cast("int").alias("offset"), F.length(F.regexp_extract(t, _java(pattern), 0)).alias("length"),
        )
        return F.when(_may_match(name, folded) & F.rlike(t, p), place)

    return F.transform(F.array(_folded(t)), lambda f: F.filter(F.array(*[one(f, *s) for s in SIGNATURES]), lambda m: m.isNotNull()))[0]


def blobs(text: Column, limit: int = BLOBS) -> Column:
    """Decoded texts of up to ``limit`` base64 and as many hex blobs: valid UTF-8 that is printable or has a line break."""

    @F.pandas_udf("array<string>")
    def readable(found: pd.Series) -> pd.Series:
        def keep(raw):
            try:
                s = bytes(raw).decode()
            except UnicodeDecodeError:
                return None
            return s if s.isprintable() or "\n" in s else None

        return found.map(lambda xs: [s for s in map(keep, xs if xs is not None else []) if s is not None])

    t = F.coalesce(text, F.lit(""))
    b64 = F.transform(F.slice(F.regexp_extract_all(t, F.lit(BASE64_BLOB), F.lit(0)), 1, limit), lambda b: F.try_to_binary(F.concat(F.regexp_replace(b, "=+$", ""), F.repeat(F.lit("="), F.pmod(-F.length(F.regexp_replace(b, "=+$", "")), F.lit(4)).cast("int"))), F.lit("base64")))
    hexed = F.transform(F.slice(F.regexp_extract_all(t, F.lit(HEX_BLOB), F.lit(0)), 1, limit), lambda b: F.unhex(b))
    return readable(F.filter(F.concat(b64, hexed), lambda x: x.isNotNull()))


def action(found: Column) -> Column:
    """The strongest action of an array of matches."""
    has = lambda a: F.exists(found, lambda m: m["action"] == a)
    return F.when(has("block"), "block").when(has("flag"), "flag").otherwise("pass")


def scan(rows: DataFrame, text: str, encoded: bool = True) -> DataFrame:
    """Adds ``matches`` (plain, then encoded, then one ``encoded_payload`` for each decoded blob that matched), ``decoded_payloads`` and ``action``.

    The table is read once.  Of a text only its blobs reach Python."""
    if not encoded:
        out = rows.withColumn("matches", matches(F.col(text))).withColumn("decoded_payloads", F.lit(0))
        return out.withColumn("action", action(F.col("matches")))
    marker = F.from_json(F.lit('{"check":"encoded_payload","action":"block","severity":"high","carrier":"encoded"}'), MATCH)
    deep = rows.withColumn("_blobs", blobs(F.col(text)))
    inside = F.transform("_blobs", lambda b: matches(b, "encoded"))
    deep = deep.withColumn("_inside", F.flatten(F.transform(inside, lambda ms: F.when(F.size(ms) > 0, F.concat(ms, F.array(marker))).otherwise(ms))))
    out = deep.withColumn("matches", F.concat(matches(F.col(text)), F.col("_inside"))).withColumn("decoded_payloads", F.size("_blobs")).drop("_blobs", "_inside")
    return out.withColumn("action", action(F.col("matches")))


def scan_documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each match, with the id of the document that holds it."""
    return scan(docs, text).select(F.col(id_col).alias("chunk_id"), F.explode("matches").alias("m")).select("chunk_id", "m.*")
