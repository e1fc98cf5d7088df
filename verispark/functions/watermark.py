"""Invisible marks on generated texts, and detached provenance records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits 0 and 1, the mark's ends, its prefix and the disclosures.
ZERO, ONE, END = "​", "‌", "⁠"
PREFIX = "AAI|"
DISCLOSURE = {"en": "This content was generated by an AI system.", "tr": "Bu içerik bir yapay zekâ sistemi tarafından üretilmiştir."}
MARK = f"{END}[{ZERO}{ONE}]{{16,}}{END}"


def tag(system: Column, day: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.substring(system, 1, 24), F.lit("|"), F.date_format(day, "yyyy-MM-dd"))


def encode(payload: Column) -> Column:
    """UTF-8 bits between the ends."""
    bits = F.array_join(F.transform(F.filter(F.split(F.hex(F.encode(payload, "UTF-8")), ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    return F.concat(F.lit(END), F.translate(bits, "01", ZERO + ONE), F.lit(END))


def mark(text: Column, system: Column, day: Column, disclosure: Column | None = None) -> Column:
    out = F.concat(F.coalesce(text, F.lit("")), encode(tag(system, day)))
    return out if disclosure is None else F.concat(out, F.lit("\n\n"), disclosure)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def _bound(c: Column, body) -> Column:
    """body(c) with c computed once; named inside a lambda it would be computed again for each element."""
    return F.transform(F.array(c), body)[0]


def verify(text: Column) -> Column:
    """present, tag (null if its bits are no UTF-8 text) and valid.  Absence of a mark says nothing about the origin."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), MARK, 0)
    bits = F.translate(F.regexp_replace(found, END, ""), ZERO + ONE, "01")

    def told(b: Column) -> Column:
        octets = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b)), F.lit(8)), lambda i: F.lpad(F.conv(F.substring(b, i, 8), 2, 16), 2, "0"))
        whole = (F.length(b) > 0) & (F.length(b) % 8 == 0)

        def read(raw: Column) -> Column:
            tag_ = F.when(whole & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
            return _bound(tag_, lambda t: F.struct((F.length(b) > 0).alias("present"), t.alias("tag"), F.coalesce(t.startswith(PREFIX), F.lit(False)).alias("valid")))

        return _bound(F.unhex(F.array_join(octets, "")), read)

    return _bound(bits, told)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARK, "")


def provenance(system: Column, model: Column, prompt_hash: Column, issued_at: Column, generator: str = "verispark", locale: str = "en", content_type: str = "text") -> Column:
    """A detached assertion as JSON; it has the prompt's hash and never the prompt."""
    made = F.struct(F.lit("c2pa.ai_generated").alias("label"), F.to_json(F.struct(model.alias("generated_by"), system.alias("system"), F.lit(content_type).alias("content_type"))).alias("data"))
    told = F.struct(F.lit("eu.ai_act.transparency").alias("label"), F.to_json(F.struct(F.lit("Art. 50(2)").alias("article"), F.lit(DISCLOSURE[locale]).alias("disclosure"), F.lit(True).alias("machine_readable"))).alias("data"))
    return F.to_json(F.struct(F.lit("https://c2pa.org/statements/v1").alias("@context"), F.lit(generator).alias("claim_generator"), F.array(made, told).alias("assertions"), prompt_hash.alias("prompt_hash"), issued_at.alias("issued_at")))
