"""Queries: predicates, scalar/text functions, dedup, ranking (P*, F*, W*, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions import scoring as S
from ..functions import text as T
from ..functions import values as V
from ..operators import dedup as W
from ..operators import merge as J
from ..operators import ranking as O
from ..sources.fixtures import fixture, fixtures
from . import sqlgen as Q
from .catalog import query

def null_str():
    return F.lit(None).cast("string")


def scored_new(spark, sf):
    """Minimum slice: matched → first per URL → unseen → rule score."""
    posting, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    matched = posting.filter(P.is_location(F.col("location")) & P.is_target_role(F.col("job_title")))
    fresh = J.new_postings(W.dedup_first_by_url(matched), seen)
    return fresh.select(
        "seq", "job_url", "company", "job_title", "location",
        S.rule_score(notes=null_str()).alias("score"),
    ).withColumn("band", S.score_band("score"))


_SCORED_NEW_SQL = f"""
, m AS (SELECT * FROM fx_posting WHERE {Q.is_loc('location')} AND {Q.is_role('job_title')}),
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq) AS rn
      FROM m WHERE coalesce(job_url, '') <> '') WHERE rn = 1),
n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = f.job_url)),
s AS (SELECT seq, job_url, company, job_title, location,
      {Q.rule_score(notes='NULL')} AS score FROM n)
"""


@query("ranked_new_postings", fixtures=["fx_posting", "fx_seen"], oracle=_SCORED_NEW_SQL + f"""
SELECT job_url, company, job_title, location, score, {Q.band('score')} AS band,
  row_number() OVER (ORDER BY score DESC, job_url) AS rank
FROM s""")
def ranked_new_postings(spark, sf):
    """Flagship: unseen matching postings, scored and ranked."""
    return O.rank_by_score(scored_new(spark, sf)).select(
        "job_url", "company", "job_title", "location", "score", "band", "rank")


# ------------------------------------------------------------------ P1-P14

@query("filter_location", fixtures=["fx_posting"], oracle=f"""
SELECT seq, location FROM fx_posting WHERE {Q.is_loc('location')}""")
def filter_location(spark, sf):
    """Postings whose location contains a location word."""
    p = fixture(spark, sf, "fx_posting")
    return p.filter(P.is_location(F.col("location"))).select("seq", "location")


@query("filter_role", fixtures=["fx_posting"], oracle=f"""
SELECT seq, job_title FROM fx_posting WHERE {Q.is_role('job_title')}""")
def filter_role(spark, sf):
    """Postings whose title is a target role."""
    p = fixture(spark, sf, "fx_posting")
    return p.filter(P.is_target_role(F.col("job_title"))).select("seq", "job_title")


@query("filter_title_regex", fixtures=["fx_search"], oracle=f"""
SELECT seq, title FROM fx_search
WHERE regexp_matches(coalesce(title, ''), '(?i)\\b({'|'.join(C.SEARCH_TITLE_WORDS)})\\b')""")
def filter_title_regex(spark, sf):
    """Whole-word title pattern on search rows."""
    s = fixture(spark, sf, "fx_search")
    return s.filter(P.title_regex(F.col("title"))).select("seq", "title")


COMPANY_KEYWORDS = ("customer#0000001", "77")


@query("filter_company_kw", fixtures=["fx_company"], oracle=f"""
SELECT ind_name, ord FROM fx_company WHERE {Q.any_contains(Q.low('ind_name'), COMPANY_KEYWORDS)}""")
def filter_company_kw(spark, sf):
    """Employer subset by name keywords."""
    c = fixture(spark, sf, "fx_company")
    return c.filter(P.name_matches_any(F.col("ind_name"), COMPANY_KEYWORDS)).select("ind_name", "ord")


@query("first_truthy", fixtures=["fx_posting"], oracle="""
SELECT seq, coalesce(nullif(job_url, ''), nullif(description, ''), nullif(location, ''), 'none') AS value
FROM fx_posting""")
def first_truthy_q(spark, sf):
    """P5: falsy-coalesce over three columns and a default."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", V.first_truthy("job_url", "description", "location", default="none").alias("value"))


@query("normalize_location", fixtures=["fx_posting"], oracle="""
SELECT seq,
  CASE WHEN contains(coalesce(location, ''), ',') THEN coalesce(location, '') ELSE coalesce(location, '') || ', Netherlands' END AS with_country,
  trim(coalesce(location, '') || ', ' || coalesce(job_title, ''), ', ') AS joined
FROM fx_posting""")
def normalize_location(spark, sf):
    """Country suffix when there is no comma; joined parts trimmed of ', '."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", V.with_country("location").alias("with_country"),
                    V.join_place("location", "job_title").alias("joined"))


@query("filter_remote_ok", fixtures=["fx_posting"], oracle=f"""
SELECT seq, location FROM fx_posting
WHERE lower(coalesce(location, '')) IN ('', 'remote', 'hybrid') OR {Q.is_loc('location')}""")
def filter_remote_ok(spark, sf):
    """Empty, remote, hybrid or a location match."""
    p = fixture(spark, sf, "fx_posting")
    return p.filter(P.remote_ok(F.col("location"))).select("seq", "location")


@query("resolve_url", fixtures=["fx_urls"], oracle="""
SELECT seq, CASE WHEN starts_with(link, '/') THEN regexp_extract(careers_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link
  ELSE link END AS resolved
FROM fx_urls""")
def resolve_url(spark, sf):
    """Site-relative links resolved on the employer URL's scheme and authority."""
    u = fixture(spark, sf, "fx_urls")
    return u.select("seq", V.resolve_url("link", "careers_url").alias("resolved"))


@query("canonical_url", fixtures=["fx_urls"], oracle="""
SELECT seq, CASE WHEN regexp_extract(coalesce(nullif(apply_url, ''), nullif(absolute_url, ''), nullif(url, ''), ''), '/jobs/(\\d+)', 1) <> ''
  THEN 'https://jobs.booking.com/booking/jobs/' || regexp_extract(coalesce(nullif(apply_url, ''), nullif(absolute_url, ''), nullif(url, ''), ''), '/jobs/(\\d+)', 1)
  ELSE coalesce(nullif(apply_url, ''), nullif(absolute_url, ''), nullif(url, '')) END AS job_url
FROM fx_urls""")
def canonical_url(spark, sf):
    """Canonical URL from a numeric '/jobs/<n>' id, else the raw URL, else NULL."""
    u = fixture(spark, sf, "fx_urls")
    return u.select("seq", V.canonical_url("apply_url", "absolute_url", "url").alias("job_url"))


@query("slugify", fixtures=["fx_posting"], oracle="""
SELECT seq, trim(regexp_replace(lower(coalesce(job_title, '') || ' @ ' || company), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM fx_posting""")
def slugify(spark, sf):
    """P10: slug of title and company."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", V.slugify(F.concat(F.coalesce("job_title", F.lit("")), F.lit(" @ "), "company")).alias("slug"))


@query("slug_to_title", fixtures=["fx_posting"], oracle="""
SELECT seq, slug, array_to_string(list_transform(string_split(replace(slug, '-', ' '), ' '),
  lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') AS title
FROM (SELECT seq, trim(regexp_replace(lower(coalesce(job_title, '') || ' ' || company), '[^a-z0-9]+', '-', 'g'), '-') AS slug
      FROM fx_posting)""")
def slug_to_title(spark, sf):
    """Slug back to a title-cased text."""
    p = fixture(spark, sf, "fx_posting")
    s = p.select("seq", V.slugify(F.concat(F.coalesce("job_title", F.lit("")), F.lit(" "), "company")).alias("slug"))
    return s.select("seq", "slug", V.slug_to_title("slug").alias("title"))


@query("detect_apply_form", fixtures=["fx_apply_page"], oracle="""
SELECT page_id, contains(lower(html), 'autofill with mygreenhouse') AND NOT contains(lower(html), 'responsibilities')
  AND NOT contains(lower(html), 'requirements') AS is_apply_form
FROM fx_apply_page""")
def detect_apply_form(spark, sf):
    """Application-form pages."""
    pg = fixture(spark, sf, "fx_apply_page")
    return pg.select("page_id", P.is_apply_form(F.col("html")).alias("is_apply_form"))


@query("support_flags", fixtures=["fx_posting"], oracle=f"""
SELECT seq, CASE WHEN {Q.any_contains(Q.low('description'), C.VISA_WORDS)} THEN TRUE END AS visa_support,
  CASE WHEN {Q.any_contains(Q.low('description'), C.RELOCATION_WORDS)} THEN TRUE END AS relocation_support
FROM fx_posting""")
def support_flags(spark, sf):
    """Visa / relocation flags, TRUE or NULL."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", P.visa_flag(F.col("description")).alias("visa_support"),
                    P.relocation_flag(F.col("description")).alias("relocation_support"))


# ------------------------------------------------------------------ F1-F8, F14

# The references that the tables hold, and some more, for SQL without
# a decoder of its own ('&amp;' last, so nested replaces equal one pass for this set)
_SQL_REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&euro;", "€"), ("&#47;", "/"), ("&amp;", "&"),
)


def _html_to_text_sql(expr: str, n: int) -> str:
    s = f"coalesce({expr}, '')"
    s = f"regexp_replace({s}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    for ent, ch in _SQL_REFERENCES:
        s = f"replace({s}, {Q.lit(ent)}, {Q.lit(ch)})"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return f"substr({s}, 1, {n})"


@query("html_to_text", oracle=f"""
SELECT page_id, {_html_to_text_sql('html', C.PAGE_TEXT_MAX)} AS text FROM pages""")
def html_to_text(spark, sf):
    """page text (whole page cleaned, result cut at the page-text length)."""
    from ..sources.fixtures import table
    pg = table(spark, sf, "pages")
    return pg.select("page_id", T.html_to_text(F.col("html"), C.PAGE_TEXT_MAX).alias("text"))


_REFERENCES_SQL = f"""
, pieces AS (SELECT seq, i, p FROM (SELECT seq, string_split(text, '&') AS ps FROM fx_entity_text), LATERAL (
    SELECT unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p)),
named AS (SELECT q.*, regexp_extract(p, '^([A-Za-z][A-Za-z0-9]{{0,31}};)', 1) AS w,
    regexp_extract(p, '^(#([0-9]{{1,8}}|[xX][0-9a-fA-F]{{1,7}});?)', 1) AS num FROM pieces q),
best AS (SELECT n.seq, n.i, arg_max(e.name, length(e.name)) AS name, arg_max(e.chars, length(e.name)) AS chars
  FROM named n JOIN fx_entity e ON n.i > 1 AND e.name NOT LIKE '%;' AND starts_with(n.p, e.name) GROUP BY n.seq, n.i),
coded AS (SELECT *, CASE WHEN lower(num) LIKE '#x%' THEN CAST('0x' || rtrim(substr(num, 3), ';') AS BIGINT)
    WHEN num <> '' THEN CAST(rtrim(substr(num, 2), ';') AS BIGINT) END AS code FROM named),
read AS (SELECT c.seq, c.i, CASE WHEN c.i = 1 THEN c.p
    WHEN e.chars IS NOT NULL THEN e.chars || substr(c.p, length(c.w) + 1)
    WHEN code IS NOT NULL THEN CASE WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533)
        WHEN code BETWEEN 128 AND 159 THEN substr({Q.lit(''.join(bytes([i]).decode('cp1252', 'ignore') or chr(i) for i in range(128, 160)))}, CAST(code - 127 AS INTEGER), 1)
        WHEN code BETWEEN 1 AND 8 OR code BETWEEN 14 AND 31 OR code IN (11, 127) OR code BETWEEN 64976 AND 65007 OR code & 65534 = 65534 THEN ''
        ELSE chr(CAST(code AS INTEGER)) END || substr(c.p, length(num) + 1)
    WHEN b.name IS NOT NULL THEN b.chars || substr(c.p, length(b.name) + 1)
    ELSE '&' || c.p END AS piece
  FROM coded c LEFT JOIN fx_entity e ON e.name = c.w LEFT JOIN best b ON b.seq = c.seq AND b.i = c.i)
SELECT seq, string_agg(piece, '' ORDER BY i) AS text FROM read GROUP BY seq"""


@query("unescape_references", fixtures=["fx_entity_text", "fx_entity"], oracle=_REFERENCES_SQL)
def unescape_references(spark, sf):
    """every named, legacy and numeric character reference, with and without ';'."""
    t = fixture(spark, sf, "fx_entity_text")
    return t.select("seq", T.unescape(F.col("text")).alias("text"))


@query("fmt_date", fixtures=["fx_dates"], oracle=f"""
SELECT seq, date_raw, {Q.fmt_date('date_raw')} AS date_posted FROM fx_dates""")
def fmt_date(spark, sf):
    """ISO-ish date text → YYYY-MM-DD."""
    d = fixture(spark, sf, "fx_dates")
    return d.select("seq", "date_raw", V.fmt_date("date_raw").alias("date_posted"))


_EMAIL_SQL = f"""
, found AS (
  SELECT doc_id, lower(trim(e)) AS email FROM (
    SELECT doc_id, unnest(list_concat(
      regexp_extract_all(html, {Q.lit(T.MAILTO_PATTERN)}, 1),
      regexp_extract_all(html, {Q.lit(T.ADDRESS_PATTERN)}, 1))) AS e
    FROM fx_email_text)),
ok AS (
  SELECT DISTINCT doc_id, email FROM found
  WHERE NOT regexp_matches(split_part(email, '@', 1), {Q.lit(T.ROLE_ACCOUNT_PATTERN)})
    AND NOT {Q.any_contains("CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) ELSE '' END", C.EMAIL_BLOCKED_DOMAIN_PARTS)}
    AND length(split_part(email, '@', 1)) >= 3
    AND contains(CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) ELSE '' END, '.'))
"""


@query("extract_emails", fixtures=["fx_email_text"], oracle=_EMAIL_SQL + "SELECT doc_id, email FROM ok")
def extract_emails(spark, sf):
    """one row per (document, recruiter address)."""
    t = fixture(spark, sf, "fx_email_text")
    return t.select("doc_id", F.explode(T.extract_emails(F.col("html"))).alias("email"))


SWAPPED = C.Profile(roles=("account manager", "data analyst"), seniority=(), crafts=(), locations=("berlin", "remote"),
                    role_accounts="(?i)^(jane)", email_blocked_domain_parts=("nowhere",), email_min_local=2,
                    apply_form_marker="requirements", apply_form_content_words=("<footer",))


@query("swapped_profile", fixtures=["fx_posting", "fx_email_text", "fx_apply_page"], oracle=f"""
, found AS (SELECT DISTINCT doc_id, lower(trim(e)) AS email FROM (SELECT doc_id, unnest(list_concat(
    regexp_extract_all(html, {Q.lit(T.MAILTO_PATTERN)}, 1), regexp_extract_all(html, {Q.lit(T.ADDRESS_PATTERN)}, 1))) AS e
    FROM fx_email_text))
SELECT 'posting' AS kind, seq AS id, CAST(NULL AS VARCHAR) AS email FROM fx_posting
  WHERE regexp_matches(lower(coalesce(job_title, '')), 'account manager|data analyst')
    AND regexp_matches(lower(coalesce(location, '')), 'berlin|remote')
UNION ALL SELECT 'email', doc_id, email FROM found WHERE NOT starts_with(email, 'jane') AND length(split_part(email, '@', 1)) >= 2
    AND NOT contains(split_part(email, '@', 2), 'nowhere') AND contains(split_part(email, '@', 2), '.')
UNION ALL SELECT 'form', page_id, NULL FROM fx_apply_page
  WHERE contains(lower(html), 'requirements') AND NOT contains(lower(html), '<footer')""")
def swapped_profile(spark, sf):
    """Other keyword lists for roles, locations, e-mail filters and the form detector."""
    p, t, a = (fixture(spark, sf, n) for n in ("fx_posting", "fx_email_text", "fx_apply_page"))
    none = F.lit(None).cast("string").alias("email")
    kept = p.filter(P.is_target_role(F.col("job_title"), SWAPPED) & P.is_location(F.col("location"), SWAPPED))
    mails = t.select(F.lit("email").alias("kind"), F.col("doc_id").alias("id"),
                     F.explode(T.extract_emails(F.col("html"), SWAPPED)).alias("email"))
    forms = a.filter(P.is_apply_form(F.col("html"), SWAPPED)).select(F.lit("form").alias("kind"), F.col("page_id").alias("id"), none)
    return kept.select(F.lit("posting").alias("kind"), F.col("seq").alias("id"), none).unionByName(mails).unionByName(forms)


@query("recruiter_email", fixtures=["fx_email_text"], oracle=_EMAIL_SQL + """
SELECT t.doc_id, min(ok.email) AS recruiter_email FROM fx_email_text t LEFT JOIN ok ON ok.doc_id = t.doc_id
GROUP BY t.doc_id""")
def recruiter_email(spark, sf):
    """One address per document (the smallest), NULL when none."""
    t = fixture(spark, sf, "fx_email_text")
    return t.select("doc_id", T.first_email(F.col("html")).alias("recruiter_email"))


@query("rule_score", fixtures=["fx_posting"], oracle=f"""
SELECT seq, {Q.rule_score(notes="'Via Greenhouse board.'")} AS score FROM fx_posting""")
def rule_score(spark, sf):
    """rule score of every posting."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", S.rule_score(notes=F.lit(C.NOTES["greenhouse"])).alias("score"))


@query("score_band", fixtures=["fx_posting"], oracle=f"""
SELECT seq, score, {Q.band('score')} AS band FROM (SELECT seq, {Q.rule_score(notes='NULL')} AS score FROM fx_posting)""")
def score_band(spark, sf):
    """colour band of the rule score."""
    p = fixture(spark, sf, "fx_posting")
    s = p.select("seq", S.rule_score(notes=null_str()).alias("score"))
    return s.select("seq", "score", S.score_band("score").alias("band"))


@query("parse_score_reply", fixtures=["fx_reply", "fx_posting"], oracle=f"""
SELECT r.seq, CASE r.seq % 4 WHEN 0 THEN CAST(r.seq % 90 AS INTEGER) WHEN 1 THEN CAST(r.seq % 70 AS INTEGER)
  WHEN 2 THEN 99 ELSE NULL END AS parsed,
  coalesce(CASE r.seq % 4 WHEN 0 THEN CAST(r.seq % 90 AS INTEGER) WHEN 1 THEN CAST(r.seq % 70 AS INTEGER)
  WHEN 2 THEN 99 ELSE NULL END, {Q.rule_score(title='p.job_title', notes='NULL', company='p.company', description='p.description', visa='p.visa_support', reloc='p.relocation_support')}) AS score
FROM fx_reply r JOIN fx_posting p ON p.seq = r.seq""")
def parse_score_reply(spark, sf):
    """score parsed from a model reply, rule score when it does not parse."""
    r, p = fixtures(spark, sf, "fx_reply", "fx_posting")
    j = r.select("seq", "reply").join(p, "seq")
    parsed = S.parse_reply(F.col("reply"))
    return j.select("seq", parsed.alias("parsed"),
                    F.coalesce(parsed, S.rule_score(notes=null_str())).alias("score"))


# ------------------------------------------------------------------ W1-W6

@query("dedup_first_by_url", fixtures=["fx_posting"], oracle="""
SELECT seq, job_url FROM (SELECT seq, job_url, row_number() OVER (PARTITION BY job_url ORDER BY seq) AS rn
  FROM fx_posting WHERE coalesce(job_url, '') <> '') WHERE rn = 1""")
def dedup_first_by_url(spark, sf):
    """First posting per URL in arrival order; empty URLs dropped."""
    p = fixture(spark, sf, "fx_posting")
    return W.dedup_first_by_url(p).select("seq", "job_url")


@query("dedup_null_passthrough", fixtures=["fx_posting"], oracle="""
SELECT seq, company, job_url FROM (SELECT seq, company, job_url,
  row_number() OVER (PARTITION BY company, job_url ORDER BY seq) AS rn FROM fx_posting WHERE coalesce(job_url, '') <> '') WHERE rn = 1
UNION ALL SELECT seq, company, job_url FROM fx_posting WHERE coalesce(job_url, '') = ''""")
def dedup_null_passthrough(spark, sf):
    """First row per id within an employer; rows without an id all kept."""
    p = fixture(spark, sf, "fx_posting")
    return W.dedup_null_passthrough(p, "job_url", scope=["company"]).select("seq", "company", "job_url")


@query("dedup_coalesced_key", fixtures=["fx_posting"], oracle="""
SELECT seq, job_url, job_title FROM (SELECT *, row_number() OVER (
  PARTITION BY coalesce(nullif(job_url, ''), nullif(job_title, ''), '') ORDER BY seq) AS rn FROM fx_posting) WHERE rn = 1""")
def dedup_coalesced_key(spark, sf):
    """First row per first_truthy(job_url, job_title, '')."""
    p = fixture(spark, sf, "fx_posting")
    return W.dedup_coalesced_key(p, ["job_url", "job_title"]).select("seq", "job_url", "job_title")


@query("dedup_last_by_key", fixtures=["fx_prev"], oracle="""
SELECT job_url, seq, first_seen, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq DESC) AS rn
  FROM fx_prev WHERE coalesce(job_url, '') <> '') WHERE rn = 1""")
def dedup_last_by_key(spark, sf):
    """Last row per key of the previous snapshot."""
    p = fixture(spark, sf, "fx_prev")
    return W.dedup_last_by_key(p, "job_url").select("job_url", "seq", "first_seen", "last_seen")


@query("distinct_ordered", oracle="""
SELECT page_id, x AS link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS pos
FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
      FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS l FROM pages))
GROUP BY page_id, x""")
def distinct_ordered(spark, sf):
    """Distinct page links in first-seen order, with their position."""
    from ..sources.fixtures import table
    pg = table(spark, sf, "pages")
    links = W.distinct_ordered(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1))
    return pg.select("page_id", F.posexplode(links).alias("pos", "link"))


@query("cap_per_group", fixtures=["fx_search"], oracle=f"""
SELECT search_term, seq, job_url FROM (SELECT *, row_number() OVER (PARTITION BY search_term ORDER BY seq) AS rn
  FROM fx_search) WHERE rn <= {C.SEARCH_ROWS_PER_TERM}""")
def cap_per_group(spark, sf):
    """At most 25 search rows per term."""
    s = fixture(spark, sf, "fx_search")
    return W.cap_per_group(s, "search_term", "seq", C.SEARCH_ROWS_PER_TERM).select("search_term", "seq", "job_url")


# ------------------------------------------------------------------ O1 / O2

@query("rank_scored", fixtures=["fx_posting"], oracle=f"""
SELECT seq, job_url, score, row_number() OVER (ORDER BY score DESC, job_url, seq) AS rank
FROM (SELECT seq, job_url, {Q.rule_score(notes='NULL')} AS score FROM fx_posting)""")
def rank_scored(spark, sf):
    """O1: every posting ranked by score (ties: URL, then arrival)."""
    p = fixture(spark, sf, "fx_posting")
    s = p.select("seq", "job_url", S.rule_score(notes=null_str()).alias("score"))
    return O.rank_by_score(s)


@query("top_k_scored", fixtures=["fx_posting"], oracle=f"""
SELECT seq, job_url, score, row_number() OVER (ORDER BY score DESC, job_url, seq) AS rank
FROM (SELECT seq, job_url, {Q.rule_score(notes='NULL')} AS score FROM fx_posting)
QUALIFY rank <= {C.DIGEST_TOP_K}""")
def top_k_scored(spark, sf):
    """O2: the ten best postings."""
    p = fixture(spark, sf, "fx_posting")
    s = p.select("seq", "job_url", S.rule_score(notes=null_str()).alias("score"))
    return O.top_k(s, C.DIGEST_TOP_K, [F.col("score").desc(), F.col("job_url"), F.col("seq")])


# ------------------------------------------------------------------ A1, A2, A7, A10

@query("count_by_company", fixtures=["fx_posting"], oracle="""
SELECT company, count(*) AS n_jobs FROM fx_posting GROUP BY company""")
def count_by_company(spark, sf):
    """A1: postings per employer."""
    p = fixture(spark, sf, "fx_posting")
    return p.groupBy("company").agg(F.count(F.lit(1)).alias("n_jobs"))


@query("field_coverage", fixtures=["fx_posting"], oracle=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {Q.fmt_date('date_raw')} IS NOT NULL) AS dated,
  count(*) FILTER (WHERE coalesce(description, '') <> '') AS described
FROM fx_posting""")
def field_coverage(spark, sf):
    """A2: rows with a date / with a description, over all rows."""
    p = fixture(spark, sf, "fx_posting")
    return p.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(V.fmt_date("date_raw").isNotNull()).alias("dated"),
        F.count_if(V.truthy("description").isNotNull()).alias("described"),
    )


@query("match_funnel", fixtures=["fx_posting"], oracle=f"""
SELECT company, count(*) AS raw_postings,
  count(*) FILTER (WHERE {Q.is_loc('location')} AND {Q.is_role('job_title')}) AS matched
FROM fx_posting GROUP BY company""")
def match_funnel(spark, sf):
    """Per source, postings read vs postings kept by the filters."""
    p = fixture(spark, sf, "fx_posting")
    return p.groupBy("company").agg(
        F.count(F.lit(1)).alias("raw_postings"),
        F.count_if(P.is_location(F.col("location")) & P.is_target_role(F.col("job_title"))).alias("matched"),
    )


@query("score_components", fixtures=["fx_posting"], oracle=f"""
SELECT seq,
  greatest(0, {', '.join(f"CASE WHEN contains(lower(concat_ws(' ', coalesce(job_title, ''), '', coalesce(company, ''))), {Q.lit(r)}) THEN {p} ELSE 0 END" for r, p in C.ROLE_WEIGHTS)}) AS role_points,
  least(3 * ({' + '.join(f"CASE WHEN contains(lower(concat_ws(' ', coalesce(job_title, ''), '', coalesce(company, ''))) || ' ' || lower(coalesce(description, '')), {Q.lit(k)}) THEN 1 ELSE 0 END" for k in dict.fromkeys(C.SKILL_TERMS))}), 70) AS skill_points
FROM fx_posting""")
def score_components(spark, sf):
    """A8 + A9: the rule score's role points (max matching weight) and skill
    points (3 per distinct skill, at most 70)."""
    p = fixture(spark, sf, "fx_posting")
    title = F.lower(F.concat_ws(" ", F.coalesce("job_title", F.lit("")), F.lit(""), F.coalesce("company", F.lit(""))))
    text = F.concat(title, F.lit(" "), F.lower(F.coalesce("description", F.lit(""))))
    return p.select("seq", S.role_points(title).alias("role_points"), S.skill_points(text).alias("skill_points"))
