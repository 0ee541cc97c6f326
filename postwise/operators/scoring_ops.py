"""Scoring with a cache, request building and a pluggable scorer.

Only cache misses are scored: the anti join comes first, so the rule score or a
user scorer never runs on a posting whose score is already known.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import config as C
from ..functions.scoring import clamp_score, full_text, rule_score, rule_score_of, title_text
from ..functions.text import truncate
from .merge import KEY, salt_empty_key, score_table, with_key


def score_with_cache(postings: DataFrame, scores: DataFrame, scorer: Callable[[DataFrame], Column] | None = None,
                     notes: Column | None = None) -> DataFrame:
    """cached score when the key has one, else the rule score (or ``scorer``).
    Adds ``score`` and ``from_cache``."""
    table = score_table(scores)
    keyed = salt_empty_key(with_key(postings)).join(table, KEY, "left")
    if notes is None:
        notes = F.col("notes") if "notes" in postings.columns else F.lit(None).cast("string")
    keyed = keyed.withColumn("__title", title_text(notes=notes)).withColumn("__text", full_text(F.col("__title")))
    fresh = rule_score_of(F.col("__title"), F.col("__text"))
    hit = F.col("__score").isNotNull()
    return (keyed.withColumn("from_cache", hit)
            .withColumn("score", F.when(hit, F.col("__score").cast("int")).otherwise(fresh))
            .drop("__score", "__title", "__text", KEY))


def new_score_entries(scored: DataFrame) -> DataFrame:
    """Cache rows for computed scores (non-empty keys only; one per key)."""
    keyed = with_key(scored).filter((F.col(KEY) != "") & ~F.col("from_cache"))
    return keyed.groupBy(F.col(KEY).alias("job_url")).agg(F.max("score").cast("int").alias("score"))


# The request text around the posting fields (the profile is supplied by the user). Fixed
# value: the form of the reply, which ``parse_score_reply`` reads.
REPLY_FORM = '{"score": <integer 0-100>, "reason": "<one sentence>"}'
PROMPT_TEMPLATE = (
    "%s\n\nHow well does the opening below suit this candidate? Rate it from 0 (not at all) to 100 (ideal).\n\n"
    "Title: %s\nEmployer: %s\nPlace: %s\nAbout: %s\n\nReply with this JSON object and nothing else: " + REPLY_FORM
)
DEFAULT_PROFILE_TEXT = "Candidate profile: (supplied by the user)"


def score_requests(postings: DataFrame, scores: DataFrame, profile_text: str = DEFAULT_PROFILE_TEXT) -> DataFrame:
    """F8: one request text per cache miss (description cut at 2000 characters)."""
    keyed = with_key(postings)
    misses = keyed.join(score_table(scores), KEY, "left_anti")

    def txt(c):
        return F.coalesce(F.col(c), F.lit("")) if c in postings.columns else F.lit("")

    prompt = F.format_string(PROMPT_TEMPLATE, F.lit(profile_text), txt("job_title"), txt("company"),
                             txt("location"), truncate(txt("description"), C.PROMPT_DESCRIPTION_MAX))
    return misses.withColumn("prompt", prompt).drop(KEY)


def score_with(postings: DataFrame, scores: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series],
               columns=("job_title", "company", "location", "description")) -> DataFrame:
    """User scorer (pandas in, one score per row out) run through
    ``mapInPandas`` on cache misses only; NULL or a failing batch falls back to
    the rule score. Adds ``score`` and ``from_cache``."""
    table = score_table(scores)
    keyed = salt_empty_key(with_key(postings)).join(table, KEY, "left")
    hit = F.col("__score").isNotNull()
    hits = keyed.filter(hit).withColumn("score", F.col("__score").cast("int"))
    misses = keyed.filter(~hit)
    schema = StructType(misses.schema.fields + [StructField("__plugin", IntegerType())])

    def run(batches):
        for pdf in batches:
            try:
                out = scorer(pdf[list(columns)])
                pdf["__plugin"] = pd.to_numeric(out, errors="coerce").astype("Int32")
            except Exception:
                pdf["__plugin"] = pd.Series([None] * len(pdf), dtype="Int32")
            yield pdf

    notes = F.col("notes") if "notes" in postings.columns else F.lit(None).cast("string")
    scored = misses.mapInPandas(run, schema).withColumn(
        "score", F.coalesce(clamp_score("__plugin"), rule_score(notes=notes)).cast("int")).drop("__plugin")
    out = hits.withColumn("from_cache", F.lit(True)).unionByName(scored.withColumn("from_cache", F.lit(False)))
    return out.drop("__score", KEY)


def fetch_missing(keys: DataFrame, fetch: Callable[[pd.Series], pd.Series], key: str = "key") -> DataFrame:
    """Call ``fetch`` once per distinct missing key (through ``mapInPandas``)."""
    distinct = keys.select(key).filter(F.col(key) != "").distinct()

    def run(batches):
        for pdf in batches:
            pdf["body"] = fetch(pdf[key]).astype("string")
            yield pdf

    return distinct.mapInPandas(run, f"{key} string, body string").filter(F.col("body") != "")
