"""Keyword predicates (P1-P4, P7, P12, P14) as native Column expressions.

Keyword tests are plain lower-case substring tests (no word boundary), written as
one OR of ``contains`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile


def lower_text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def any_contains(text: Column, words) -> Column:
    """True iff ``text`` contains any of ``words`` (text assumed non-null)."""
    words = list(words)
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def any_contains_regex(text: Column, words) -> Column:
    """Same test as one alternation regex of quoted literals. The text appears
    once in the expression, so it stays small when Catalyst inlines a computed
    text into a pushed-down filter (35 ``contains`` would copy it 35 times)."""
    words = list(words)
    if not words:
        return F.lit(False)
    return text.rlike("|".join("\\Q" + w + "\\E" for w in words))


def is_location(location: Column, profile: Profile = DEFAULT_PROFILE, compact: bool = False) -> Column:
    """Location contains one of the location words (``compact``: one regex)."""
    test = any_contains_regex if compact else any_contains
    return test(lower_text(location), profile.locations)


def is_target_role(title: Column, profile: Profile = DEFAULT_PROFILE, compact: bool = False) -> Column:
    """Any role phrase, or (any seniority word and any craft word)."""
    t = lower_text(title)
    test = any_contains_regex if compact else any_contains
    return test(t, profile.roles) | (test(t, profile.seniority) & test(t, profile.crafts))


def title_regex(title: Column, words=C.SEARCH_TITLE_WORDS) -> Column:
    """Whole-word, case-insensitive title match."""
    return F.coalesce(title, F.lit("")).rlike("(?i)\\b(" + "|".join(words) + ")\\b")


def name_matches_any(name: Column, keywords) -> Column:
    """Keyword subset of employers; no keywords means all."""
    kws = [k.lower() for k in (keywords or [])]
    if not kws:
        return F.lit(True)
    return any_contains(lower_text(name), kws)


def remote_ok(location: Column, profile: Profile = DEFAULT_PROFILE) -> Column:
    """Keep if empty, 'remote', 'hybrid', or a location match."""
    low = lower_text(location)
    return low.isin("", "remote", "hybrid") | is_location(location, profile)


def is_apply_form(html: Column, profile: Profile = DEFAULT_PROFILE) -> Column:
    """The page has the application-form marker and lacks both content words."""
    low = lower_text(html)
    out = low.contains(profile.apply_form_marker)
    for w in profile.apply_form_content_words:
        out = out & ~low.contains(w)
    return out


def support_flag(description: Column, words) -> Column:
    """True when any keyword is present, else NULL (never False)."""
    return F.when(any_contains(lower_text(description), words), F.lit(True)).otherwise(
        F.lit(None).cast("boolean")
    )


def visa_flag(description: Column) -> Column:
    return support_flag(description, C.VISA_WORDS)


def relocation_flag(description: Column) -> Column:
    return support_flag(description, C.RELOCATION_WORDS)
