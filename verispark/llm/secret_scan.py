"""Secret scanning: base patterns and multipart credential linking.

Base kinds are found by pattern.  Linking then looks at weaker parts: login names, short secrets and opaque
tokens, endpoints.  A weak part alone says nothing; it is reported only if a complementary part lies within
``scope`` code points of it.  That is an interval join: each part goes to the cells of ``scope`` code points that its
widened interval meets, parts of one document and cell meet in an equi-join, and the distance confirms the pair.  A cell
holds a bounded number of parts because parts of one kind don't overlap, so no document makes a hot key.

Only DataFrame functions are used.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hex digits is matched whole, so a run of 16 or more is what a longer pattern finds as well.
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
#: Weak parts: kind, role, pattern.
WEAK = [
    ("login", "id", r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""),
    ("opaque", "secret", r"\b(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"),
    ("endpoint", "endpoint", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}"),
]
SCOPE = 256
#: Matches whose positions are summed in one run.
PART = 512


def _bound(c: Column, body) -> Column:
    """body(c) with c computed once: inside a lambda an expression would be computed again for each element."""
    return F.transform(F.array(c), body)[0]


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches; positions are sums over the pieces between them.

    The sums run within parts of ``PART`` matches and then over the parts, so a text of many matches is not copied once a match."""
    spans = "array<struct<start:int,kind:string,end:int>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.transform(F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: z["m"].isNotNull()), lambda z: F.struct(z["g"].alias("g"), F.length(z["m"]).alias("n"), (keep(z["m"]) if keep else F.lit(True)).alias("ok")))

    def one(acc: Column, x: Column) -> Column:
        a, z = acc["at"] + x["g"], acc["at"] + x["g"] + x["n"]
        own = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), z.alias("end")))
        return F.struct(z.alias("at"), F.when(x["ok"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(part, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))
    nested = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out"))
    parts = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / PART).cast("int")), lambda i: F.aggregate(F.slice(z, i * PART + 1, F.lit(PART)), none, one))
    whole = lambda p: F.flatten(F.aggregate(p, nested, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved(x["out"], acc["at"]))).alias("out")), lambda acc: acc["out"]))
    return F.when(F.rlike(text, F.lit(pattern)), _bound(steps, lambda z: _bound(parts(z), whole))).otherwise(F.array().cast(spans))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _ordered(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate([*BASE_KINDS, *(w[0] for w in WEAK)]) for x in (F.lit(k), F.lit(i))])
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each input row: id, base (array of spans), linked (array of spans of weak parts that linking confirms).

    A null text is empty.  A weak part is confirmed by a part of another role within ``scope`` code points; base spans
    have the roles secret (assign, hex) and id (access).  A weak part that overlaps a base span is left out.  Repeated rows each
    get their row, and an empty table gives an empty result.
    """
    text = F.col("t")
    scratch = Scratch(docs.sparkSession, "secrets")
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = F.concat(_spans(text, ASSIGN, "assign", group2), _spans(text, ACCESS, "access", lambda m: F.length(m) >= 18), _spans(text, HEX, "hex"))
    weak = F.concat(*[_spans(text, p, k) for k, _, p in WEAK])
    found = scratch.save(src.select("rid", "id", base.alias("base"), weak.alias("weak")).withColumn("base", _ordered(F.col("base"))), "found")

    roles = {"assign": "secret", "access": "id", "hex": "secret"} | {k: role for k, role, _ in WEAK}
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    parts = found.filter(F.size("weak") > 0).withColumn("weak", clear).filter((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    parts = parts.select("rid", F.explode(F.concat(F.transform("weak", lambda s: F.struct(F.lit(True).alias("weak"), s.alias("s"))), F.transform("base", lambda s: F.struct(F.lit(False).alias("weak"), s.alias("s"))))).alias("p"))
    parts = parts.select("rid", F.col("p.weak").alias("weak"), F.col("p.s.start").alias("start"), F.col("p.s.end").alias("end"), F.col("p.s.kind").alias("kind"), role[F.col("p.s.kind")].alias("role"))
    asked = parts.filter("weak").select("rid", "start", "end", "kind", F.col("role").alias("own_role"), F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("cell"))
    there = parts.select("rid", F.col("start").alias("o_start"), F.col("end").alias("o_end"), "role", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("cell"))
    linked = asked.join(there, ["rid", "cell"]).filter((F.col("role") != F.col("own_role")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope))
    linked = scratch.save(linked.groupBy("rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked")), "linked")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return found.select("rid", "id", "base").join(linked, "rid", "left").select(F.col("id").alias(id_col), "base", _ordered(F.coalesce("linked", none)).alias("linked"))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col(id_col), *[n(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_ordered(F.concat("base", "linked"))).alias("spans"))
