"""Representation and framing by word lists: mentions of groups and the words around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispark.functions import lexicons
from verispark.functions.scores import harmonic, harmonic_agg, score_from_diff, score_from_ratio
from verispark.functions.text import sentiment, words

Lexicon = dict[str, dict[str, list[str]]]


def lexicon_table(spark: SparkSession, only: list[str] | None = None, extra: Lexicon | None = None) -> DataFrame:
    """dimension, grp, term, kind (word, stem or phrase); an extra dimension replaces one of the same name."""
    whole = lexicons.DIMENSIONS | (extra or {})
    rows = [(d, g, t.rstrip("*"), "stem" if t.endswith("*") else "phrase" if " " in t else "word") for d, groups in whole.items() if not only or d in only for g, terms in groups.items() for t in terms]
    return spark.createDataFrame(rows, "dimension string, grp string, term string, kind string")


def group_table(spark: SparkSession, only: list[str] | None = None, extra: Lexicon | None = None) -> DataFrame:
    return lexicon_table(spark, only, extra).select("dimension", "grp").distinct()


def mentions(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row for each mention: id, dimension, grp, pos, feeling (of up to 12 words on each side).

    A word counts for a group once, whether as a listed word or by a beginning; a phrase counts once a chunk, where it first occurs.
    Words are tested within their array, so only mentions become rows, each with its own context; the lists are fixed data of a few
    hundred terms and then tell the groups in a broadcast join."""
    rows = chunks.select("id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    terms = lexicon.filter("kind != 'phrase'").select("kind", "term").distinct().collect()
    whole = [r["term"] for r in terms if r["kind"] == "word"]
    stems: dict[int, list[str]] = {}
    for r in terms:
        if r["kind"] == "stem":
            stems.setdefault(len(r["term"]), []).append(r["term"])

    def listed_word(w):
        test = w.isin(whole) if whole else F.lit(False)
        for n, ss in sorted(stems.items()):
            test = test | F.substring(w, 1, n).isin(ss)
        return test

    def near(pos):
        low = F.greatest(pos - lexicons.CONTEXT, F.lit(0))
        return F.slice("ws", low + 1, pos + lexicons.CONTEXT + 1 - low)

    single = lexicon.filter("kind != 'phrase'").select("dimension", "grp", F.col("term").alias("key"), (F.col("kind") == "stem").alias("stem"))
    spots = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda s: listed_word(s["w"]))
    found = rows.select("id", F.explode(F.transform(spots, lambda s: F.struct(s["pos"].alias("pos"), s["w"].alias("w"), near(s["pos"]).alias("near")))).alias("s")).select("id", "s.*")
    keys = F.array(F.struct(F.col("w").alias("key"), F.lit(False).alias("stem")), *[F.struct(F.substring("w", 1, n).alias("key"), F.lit(True).alias("stem")) for n in sorted(stems)])
    asked = found.select("id", "pos", "near", F.inline(F.array_distinct(keys)))
    hits = asked.join(F.broadcast(single), ["key", "stem"]).select("id", "dimension", "grp", "pos", "near").dropDuplicates(["id", "dimension", "grp", "pos"])
    phrases = lexicon.filter("kind = 'phrase'").select("dimension", "grp", "term").collect()
    if phrases:
        listed = F.array(*[F.struct(F.lit(p["dimension"]).alias("dimension"), F.lit(p["grp"]).alias("grp"), F.lit(p["term"]).alias("term")) for p in phrases])
        joined = rows.withColumn("line", F.array_join("ws", " "))
        found = joined.select("id", "ws", "line", F.explode(F.filter(listed, lambda p: F.contains(F.col("line"), p["term"]))).alias("p"))
        found = found.select("id", "ws", "p.dimension", "p.grp", (F.size(F.split(F.expr("substring(line, 1, instr(line, p.term) - 1)"), " ")) - 1).alias("pos"))
        hits = hits.unionByName(found.select("id", "dimension", "grp", "pos", near(F.col("pos")).alias("near")))
    return hits.select("id", "dimension", "grp", "pos", sentiment(F.col("near"), lexicons.POSITIVE, lexicons.NEGATIVE).alias("feeling"))


def group_mentions(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """dimension, grp, mentions and mean sentiment (null without a mention) for every group of the lexicon."""
    counted = mentions(chunks, lexicon).groupBy("dimension", "grp").agg(F.count(F.lit(1)).alias("mentions"), F.avg("feeling").alias("sentiment"))
    groups = lexicon.select("dimension", "grp").distinct()
    return groups.join(F.broadcast(counted), ["dimension", "grp"], "left").select("dimension", "grp", F.coalesce("mentions", F.lit(0)).alias("mentions"), "sentiment")


def dimension_scores(groups: DataFrame) -> DataFrame:
    """From group_mentions: totals, representation and framing by dimension; scores are null below the floor of mentions or with one group."""
    present = F.when(F.col("mentions") > 0, F.col("mentions"))
    by = groups.groupBy("dimension").agg(F.sum("mentions").alias("total"), F.count(present).alias("groups"), F.min(present).alias("low"), F.max(present).alias("high"), F.min("sentiment").alias("s_low"), F.max("sentiment").alias("s_high"))
    assessed = (F.col("total") >= lexicons.FLOOR) & (F.col("groups") >= 2)
    by = by.withColumn("assessed", assessed).withColumn("ratio", F.when(assessed, F.col("low") / F.col("high"))).withColumn("spread", F.when(assessed, F.col("s_high") - F.col("s_low")))
    by = by.withColumn("representation", score_from_ratio(F.col("ratio"))).withColumn("framing", score_from_diff(F.col("spread"), 0.3))
    score = F.when(F.col("assessed"), F.round(harmonic(F.col("representation"), F.col("framing")), 1))
    return by.select("dimension", F.col("total").alias("mentions"), "groups", "assessed", "ratio", "spread", "representation", "framing", score.alias("score"))


def fairness_score(scores: DataFrame) -> DataFrame:
    """One row: number of assessed dimensions and the harmonic mean of their scores, null if there is none."""
    s = F.when(F.col("assessed"), F.col("score"))
    return scores.agg(F.count(s).alias("assessed"), F.when(F.count(s) > 0, harmonic_agg(s)).alias("fairness_score"))


def flagged_groups(groups: DataFrame) -> DataFrame:
    """Groups under four fifths of the largest, and groups framed 0.15 below the mean of their dimension."""
    w = Window.partitionBy("dimension")  # a handful of groups each
    rows = groups.withColumn("top", F.max("mentions").over(w)).withColumn("mean", F.avg("sentiment").over(w))
    return rows.select("dimension", "grp", "mentions", "sentiment", (F.col("mentions") < 0.8 * F.col("top")).alias("underrepresented"), F.coalesce(F.col("sentiment") < F.col("mean") - 0.15, F.lit(False)).alias("negatively_framed"))


def bias_findings(scores: DataFrame) -> DataFrame:
    """check, severity, action for dimensions that could not be assessed, are unbalanced or framed apart, and for the whole."""
    of = lambda check, severity: F.struct(F.concat(F.lit(check + "."), F.col("dimension")).alias("check"), severity.alias("severity"), F.lit("flag").alias("action"))
    rows = F.array(
        F.when(~F.col("assessed"), of("bias_unassessable", F.lit("low"))),
        F.when(F.col("representation") < 80, of("representation_imbalance", F.when(F.col("representation") < 50, "high").otherwise("medium"))),
        F.when(F.col("framing") < 70, of("framing_skew", F.when(F.col("framing") < 40, "high").otherwise("medium"))),
    )
    by_dim = scores.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select("f.*")
    whole = fairness_score(scores).filter("fairness_score < 70").select(F.lit("fairness_score_below_threshold").alias("check"), F.when(F.col("fairness_score") < 50, "high").otherwise("medium").alias("severity"), F.lit("flag").alias("action"))
    return by_dim.unionByName(whole)
