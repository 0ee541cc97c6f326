"""Rule score, band and reply parsing (F4, F5, F7, A8, A9) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile
from .predicates import any_contains
from .values import col


def _text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def rule_score(job_title="job_title", notes="notes", company="company", description="description",
               visa_support="visa_support", relocation_support="relocation_support",
               profile: Profile = DEFAULT_PROFILE) -> Column:
    """max role weight (on title+notes+company) + min(3 x distinct skills, 70)
    - staff/principal - explicit 'no visa' - explicit 'no relocation' - language
    requirement, clamped to 0..99."""
    title = title_text(job_title, notes, company)
    return rule_score_of(title, full_text(title, description), visa_support, relocation_support, profile)


def title_text(job_title="job_title", notes="notes", company="company") -> Column:
    """The text the role phrases are looked up in."""
    return F.lower(F.concat_ws(" ", _text(job_title), _text(notes), _text(company)))


def full_text(title: Column, description="description") -> Column:
    """The text the skills and language phrases are looked up in."""
    return F.concat(title, F.lit(" "), F.lower(_text(description)))


def rule_score_of(title: Column, text: Column, visa_support="visa_support", relocation_support="relocation_support",
                  profile: Profile = DEFAULT_PROFILE) -> Column:
    """F4 of the two texts. Under a condition (WHEN, IF) Spark repeats the expression of a text
    for every phrase looked up in it; columns of a projection below are computed once."""
    role_pts = role_points(title, profile)
    skill_pts = skill_points(text, profile)
    senior = title.contains("staff ") | title.contains(" staff") | title.contains("principal")
    score = (
        role_pts
        + skill_pts
        - F.when(senior, C.SENIOR_TITLE_PENALTY).otherwise(0)
        - F.when(col(visa_support) == F.lit(False), C.VISA_FALSE_PENALTY).otherwise(0)
        - F.when(col(relocation_support) == F.lit(False), C.RELOCATION_FALSE_PENALTY).otherwise(0)
        - F.when(any_contains(text, profile.language_phrases), C.LANGUAGE_PENALTY).otherwise(0)
    )
    return F.least(F.greatest(score, F.lit(C.SCORE_MIN)), F.lit(C.SCORE_MAX)).cast("int")


def role_points(title_text: Column, profile: Profile = DEFAULT_PROFILE) -> Column:
    """The largest weight among the role phrases the text contains (0 if none)."""
    return F.greatest(F.lit(0), *[F.when(title_text.contains(r), F.lit(p)).otherwise(F.lit(0))
                                  for r, p in profile.role_weights])


def skill_points(text: Column, profile: Profile = DEFAULT_PROFILE) -> Column:
    """3 points per distinct skill term in the text, at most 70."""
    skills = list(dict.fromkeys(profile.skills))
    hits = sum((F.when(text.contains(s), F.lit(1)).otherwise(F.lit(0)) for s in skills), F.lit(0))
    return F.least(hits * C.SKILL_POINTS, F.lit(C.SKILL_CAP))


def score_band(score) -> Column:
    """colour band of a score."""
    out = None
    for threshold, colour in C.SCORE_BANDS:
        cond = col(score) >= threshold
        out = F.when(cond, F.lit(colour)) if out is None else out.when(cond, F.lit(colour))
    return out.otherwise(F.lit(C.SCORE_BAND_DEFAULT))


def clamp_score(x) -> Column:
    """V7: clamp to 0..99."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(C.SCORE_MIN)), F.lit(C.SCORE_MAX)))


def parse_reply(reply) -> Column:
    """score from a model reply. A reply starting with a code fence keeps the
    text between the first two fences minus leading 'j','s','o','n' characters; the
    rest must parse as JSON with an integer 'score', which is clamped. NULL otherwise
    (the caller falls back to the rule score)."""
    r = F.trim(F.coalesce(col(reply), F.lit("")))
    fenced = F.ltrim(F.split_part(r, F.lit("```"), F.lit(2)), F.lit("json"))
    body = F.trim(F.when(r.startswith("```"), fenced).otherwise(r))
    score = F.try_variant_get(F.try_parse_json(body), "$.score", "int")
    # whole numbers beyond 32 bits clamp as well
    wide = F.try_variant_get(F.try_parse_json(body), "$.score", "double")
    far = F.when(wide >= 2147483648.0, C.SCORE_MAX).when(wide <= -2147483649.0, C.SCORE_MIN)
    return F.coalesce(clamp_score(score), far).cast("int")
