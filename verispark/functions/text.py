"""Column functions over texts.  Blanks and words are Unicode's unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
WORD = r"(?U)[\p{L}][\w'’-]*"
EDGE_SPACES = r"(?U)^\s+|\s+$"


def length(text: Column) -> Column:
    """Code points; null is 0."""
    return F.length(F.coalesce(text, F.lit("")))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, 1 at least."""
    return F.greatest(F.lit(1), F.floor(length(text) / 4).cast("int"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), EDGE_SPACES, "")


def collapsed(text: Column) -> Column:
    """Lower case, inner blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the collapsed text."""
    return F.substring(F.sha2(collapsed(text), 256), 1, 16)


def blank_words(text: Column) -> Column:
    """Blank-separated lower-case words; no words in a blank text."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct n-word shingles of an array of words; fewer words are one shingle, none give none.

    Shifted slices are zipped, so the array is evaluated n times a row and never once for each shingle."""
    many = F.size(words) - (n - 1)
    joined = F.slice(words, 1, F.greatest(many, F.lit(1)))
    for i in range(2, n + 1):
        joined = F.zip_with(joined, F.slice(words, i, F.greatest(many, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    few = F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(words, " ")))
    return F.when(many > 0, F.array_distinct(joined)).otherwise(few)


def words(text: Column) -> Column:
    """Letters followed by letters, digits, apostrophes and hyphens, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def sentiment(context: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) over an array of words, 0 if there is neither."""
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    pos = F.size(F.filter(context, lambda w: F.array_contains(listed(positive), w)))
    neg = F.size(F.filter(context, lambda w: F.array_contains(listed(negative), w)))
    return F.when(pos + neg == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg))


#: Endings of model names that move.
FLOATING = ["-latest", "-exp", "-preview", "-nightly"]


def is_pinned(model: Column) -> Column:
    """A model name that names one version: no moving end, and an ISO date or three digits at its end."""
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    moving = F.lit(False)
    for end in FLOATING:
        moving = moving | name.endswith(end)
    return ~name.isin("", "deterministic") & ~moving & F.rlike(name, F.lit(r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3,})$"))
