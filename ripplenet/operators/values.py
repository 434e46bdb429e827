"""Vertex values ``(v, k)`` other than degrees: counts and features of users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.functions.dates import is_off_hours, years_since_1900
from ripplenet.functions.text import profile_tokens

# The four published keyword lists and the registration year taken for users without one.
SYMPTOM_WORDS = (
    "anxiety withdrawal severe delusions adhd weight insomnia drowsiness suicidal appetite dizziness nausea episodes "
    "attacks sleep seizures addictive weaned swings dysfunction blurred irritability headache fatigue imbalance "
    "nervousness psychosis drowsy"
).split()
DISCLOSURE_WORDS = (
    "fun play helped god answer wants leave beautiful suffer sorry tolerance agree hate helpful haha enjoy social talk "
    "save win care love like hold cope amazing discuss"
).split()
TREATMENT_WORDS = (
    "medication side-effects doctor doses effective prescribed therapy inhibitor stimulant antidepressant patients "
    "neurotransmitters prescriptions psychotherapy diagnosis clinical pills chemical counteract toxicity "
    "hospitalization sedative 150mg 40mg drugs"
).split()
RELATIONSHIP_WORDS = (
    "home woman she him girl game men friends sexual boy someone movie favorite jesus house music religion her songs "
    "party bible relationship hell young style church lord father season heaven dating"
).split()
KEYWORDS = {
    "symptom": SYMPTOM_WORDS,
    "disclosure": DISCLOSURE_WORDS,
    "treatment": TREATMENT_WORDS,
    "relationship": RELATIONSHIP_WORDS,
}
MISSING_YEAR = 108


def topic_values(ratings: DataFrame, topic: int | str) -> DataFrame:
    """``ratings(user, topic)``: 1 + number of a user's rows on the topic. Users without one are absent, see below."""
    return ratings.where(F.col("topic") == topic).groupBy(F.col("user").alias("v")).agg(
        (F.count(F.lit(1)) + 1).alias("k")
    )


def with_default(values: DataFrame, members: DataFrame, default: int = 1) -> DataFrame:
    """Every member ``v`` with its value, or the default."""
    return members.select("v").join(values, "v", "left").select("v", F.coalesce("k", F.lit(default)).cast("bigint").alias("k"))


def clean_keywords(words: Sequence[str]) -> list[str]:
    """Keywords put through the rule of the profile tokens, so that each of them can match."""
    kept = ("".join(c if c.isascii() and c.isalnum() else " " for c in w.lower()).split() for w in words)
    return sorted({t for tokens in kept for t in tokens if len(t) > 1})


def keyword_values(texts: DataFrame, members: DataFrame, words: Sequence[str]) -> DataFrame:
    """``texts(v, text)``: 1 + occurrences of the listed words in a member's texts.

    Texts are counted row by row where they lie and only the counts are summed, so a user with a third of all texts
    costs no more shuffle than any other.
    """
    listed = clean_keywords(words)
    hits = F.size(F.filter(profile_tokens(F.col("text")), lambda t: t.isin(listed)))
    found = texts.select("v", hits.alias("hits")).groupBy("v").agg((F.sum("hits") + 1).alias("k"))
    return with_default(found, members)


def off_hours_values(activity: DataFrame, members: DataFrame) -> DataFrame:
    """``activity(v, ts)``: 1 + events of a member before six or after twenty-one; members without events get 1."""
    found = activity.where(is_off_hours(F.col("ts"))).groupBy("v").agg((F.count(F.lit(1)) + 1).alias("k"))
    return with_default(found, members)


def year_values(registered: DataFrame, members: DataFrame, missing: int = MISSING_YEAR) -> DataFrame:
    """``registered(v, ts)``, one row per user: years since 1900, ``missing`` for members without a date."""
    found = registered.select("v", years_since_1900(F.col("ts")).cast("bigint").alias("k"))
    return with_default(found, members, missing)


def length_values(names: DataFrame, name: Column | None = None) -> DataFrame:
    """``names(v, name)``: length of the name."""
    text = F.col("name") if name is None else name
    return names.select("v", F.length(text).cast("bigint").alias("k"))
