"""Value helpers: falsy-coalesce, locations, URLs, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """A string value that counts as present: not NULL and not ''."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cols, default=None) -> Column:
    """P5: ``a or b or c`` on strings — '' and NULL both count as missing."""
    parts = [truthy(c) for c in cols]
    if default is not None:
        parts.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def posting_key(df_columns, job_url="job_url", url="url") -> Column:
    """Duplicate key ``job_url`` → ``url`` → ''."""
    if url in df_columns:
        return first_truthy(job_url, url, default="")
    return first_truthy(job_url, default="")


def with_country(location) -> Column:
    """P6 (suffix form): add ', Netherlands' when the text has no comma."""
    loc = F.coalesce(col(location), F.lit(""))
    return F.when(F.instr(loc, ",") > 0, loc).otherwise(F.concat(loc, F.lit(", " + C.DEFAULT_COUNTRY)))


def join_place(city, country) -> Column:
    """P6 (join form): ``f"{city}, {country}".strip(', ')``."""
    return F.btrim(
        F.concat(F.coalesce(col(city), F.lit("")), F.lit(", "), F.coalesce(col(country), F.lit(""))),
        F.lit(", "),
    )


def url_origin(url) -> Column:
    """``scheme://authority`` of a URL (NULL when it does not parse)."""
    u = col(url)
    return F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"),
                    F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.lit("")))


def resolve_url(url, base) -> Column:
    """A site-relative URL ('/...') is resolved on the base's scheme and authority."""
    u = col(url)
    return F.when(u.startswith("/"), F.concat(url_origin(base), u)).otherwise(u)


def canonical_url(*raw_cols, template: str = C.URL_FORMATS["icims_job"]) -> Column:
    """URL rebuilt from the numeric id in '/jobs/<n>', else the raw URL, else NULL."""
    raw = first_truthy(*raw_cols, default="")
    job_id = F.regexp_extract(raw, C.NUMERIC_JOB_ID_PATTERN, 1)
    head, tail = template.split("{id}")
    return F.when(job_id != "", F.concat(F.lit(head), job_id, F.lit(tail))).otherwise(truthy(raw))


def slugify(title) -> Column:
    """P10: lower-case, runs of non [a-z0-9] become '-', trimmed of '-'."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), C.SLUG_CHARS_PATTERN, "-"), F.lit("-"))


def slug_to_title(slug) -> Column:
    """P11: 'senior-java-dev' → 'Senior Java Dev'."""
    return F.initcap(F.replace(col(slug), F.lit("-"), F.lit(" ")))


def fmt_date(raw, epoch_ms: bool = False) -> Column:
    """ISO-ish text → 'YYYY-MM-DD' (the local date; no zone shift), else NULL.

    Extended form: the first 'dddd-dd-dd' in the text. Basic form: exactly
    'yyyymmdd' (optionally followed by a 'T' time) when it is a valid date. ISO
    week dates ('2024-W01-1', '2024W011', '2024-W01'). Epoch milliseconds only
    with ``epoch_ms``.
    """
    s = F.btrim(F.coalesce(col(raw).cast("string"), F.lit("")))
    ext = truthy(F.regexp_extract(s, C.ISO_DATE_PATTERN, 1))
    basic_txt = F.regexp_extract(s, r"^(\d{8})(T.*)?$", 1)
    basic = F.date_format(F.try_to_date(truthy(basic_txt), "yyyyMMdd"), "yyyy-MM-dd")
    out = F.coalesce(ext, basic, _iso_week_date(s))
    if epoch_ms:
        ms = F.when(s.rlike(r"^\d{12,13}$"), s.cast("long"))
        out = F.coalesce(out, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))
    return out


def _iso_week_date(s: Column) -> Column:
    """'YYYY-Www[-D]' / 'YYYYWww[D]' (optionally with a time) → 'YYYY-MM-DD'; NULL
    when the week does not exist in that ISO year or the text is not a week date."""
    pat = C.ISO_WEEK_DATE_PATTERN
    year = F.regexp_extract(s, pat, 1).cast("int")
    week = F.coalesce(truthy(F.regexp_extract(s, pat, 2)), truthy(F.regexp_extract(s, pat, 4))).cast("int")
    day = F.coalesce(truthy(F.regexp_extract(s, pat, 3)), truthy(F.regexp_extract(s, pat, 5)), F.lit("1")).cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    monday1 = F.date_sub(jan4, F.weekday(jan4))          # Monday of ISO week 1
    d = F.date_add(monday1, (week - 1) * 7 + (day - 1))
    valid = week.between(1, 53) & (F.weekofyear(d) == week)
    return F.when(s.rlike(pat), F.when(valid, F.date_format(d, "yyyy-MM-dd")))


def date_prefix(c) -> Column:
    """first ten characters of a timestamp text."""
    return F.substring(col(c).cast("string"), 1, 10)


def ts_date_text(c) -> Column:
    """Date text of a timestamp column in the session zone (UTC)."""
    return F.date_format(col(c), "yyyy-MM-dd")


def quote_param(c) -> Column:
    """percent-encode a query value, spaces as %20, '/' and '~' kept, '*' encoded."""
    enc = F.url_encode(col(c))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("%2F"), F.lit("/"))
    enc = F.replace(enc, F.lit("%7E"), F.lit("~"))
    return F.replace(enc, F.lit("*"), F.lit("%2A"))
