"""Queries: joins, snapshot merge, stores, scoring with a cache, digests, PII
(J*, U*, A3, A6, A10, F6, F8, G2, K4, K5, T3, P17, A4, A5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions import scoring as S
from ..functions import text as T
from ..functions import values as V
from ..operators import merge as J
from ..operators import privacy as PV
from ..operators import ranking as O
from ..operators import reports as R
from ..operators import scoring_ops as SO
from ..sources.fixtures import fixtures
from . import sqlgen as Q
from .catalog import query
from .q_core import COMPANY_KEYWORDS, _html_to_text_sql, null_str

AS_OF_SEEN = "2024-01-16 00:00:00"     # 24-hour family (seen store runs over January 2024)
CUTOFF_SEEN = "2024-01-15 00:00:00"
AS_OF_MERGE = "1998-01-20"             # snapshot merge (cut-off 1998-01-10)
CUTOFF_MERGE = "1998-01-10"

_SEEN_DATES = """
, sd AS (SELECT job_url, strftime(max(seen_at), '%Y-%m-%d') AS d FROM fx_seen WHERE coalesce(job_url, '') <> '' GROUP BY job_url)
"""
_SCORES = """
, sc AS (SELECT job_url, CAST(max(score) AS INTEGER) AS score FROM fx_score WHERE coalesce(job_url, '') <> '' GROUP BY job_url)
"""


@query("new_postings", fixtures=["fx_posting", "fx_seen"], oracle="""
SELECT seq, job_url FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)""")
def new_postings(spark, sf):
    """Postings not in the seen store."""
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    return J.new_postings(p, seen).select("seq", "job_url")


@query("seen_last_24h", fixtures=["fx_posting", "fx_seen"], oracle=f"""
SELECT seq, job_url FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url AND s.seen_at >= TIMESTAMP '{CUTOFF_SEEN}')""")
def seen_last_24h(spark, sf):
    """Postings seen in the 24 hours before as_of."""
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    return J.seen_within(p, seen, AS_OF_SEEN).select("seq", "job_url")


@query("attach_scores", fixtures=["fx_posting", "fx_score"], oracle=_SCORES + """
SELECT p.seq, p.job_url, sc.score AS ai_score FROM fx_posting p LEFT JOIN sc ON sc.job_url = p.job_url""")
def attach_scores(spark, sf):
    """Cached score attached where present."""
    p, sc = fixtures(spark, sf, "fx_posting", "fx_score")
    return J.attach_scores(p, sc).select("seq", "job_url", "ai_score")


@query("backfill_first_seen", fixtures=["fx_posting", "fx_seen"], oracle=_SEEN_DATES + f"""
SELECT p.seq, coalesce(sd.d, nullif(substr(coalesce(p.date_raw, ''), 1, 10), ''), '{AS_OF_SEEN[:10]}') AS first_seen
FROM fx_posting p LEFT JOIN sd ON sd.job_url = p.job_url""")
def backfill_first_seen(spark, sf):
    """first_seen = existing, else seen date, else date_posted[:10], else as_of."""
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    p = p.withColumnRenamed("date_raw", "date_posted")
    return J.backfill_first_seen(p, seen, AS_OF_SEEN).select("seq", "first_seen")


_MERGE_SQL = _SEEN_DATES + f"""
, prev1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq DESC) AS rn
    FROM fx_prev WHERE coalesce(job_url, '') <> '') WHERE rn = 1),
stamped AS (SELECT n.job_url, n.seq, n.job_title,
    coalesce(nullif(p.first_seen, ''), sd.d, '{AS_OF_MERGE}') AS first_seen, '{AS_OF_MERGE}' AS last_seen,
    CAST(NULL AS BOOLEAN) AS stale
  FROM fx_posting n LEFT JOIN prev1 p ON p.job_url = coalesce(nullif(n.job_url, ''), '')
  LEFT JOIN sd ON sd.job_url = coalesce(nullif(n.job_url, ''), '')),
carried AS (SELECT p.job_url, p.seq, p.job_title, p.first_seen, p.last_seen, TRUE AS stale
  FROM prev1 p LEFT JOIN sd ON sd.job_url = p.job_url
  WHERE p.job_url NOT IN (SELECT coalesce(nullif(job_url, ''), '') FROM fx_posting)
    AND coalesce(nullif(p.last_seen, ''), nullif(p.first_seen, ''), sd.d, '') <> ''
    AND coalesce(nullif(p.last_seen, ''), nullif(p.first_seen, ''), sd.d, '') >= '{CUTOFF_MERGE}'),
merged AS (SELECT * FROM stamped UNION ALL SELECT * FROM carried)
"""


def _merged(spark, sf, retain=True):
    new, prev, seen = fixtures(spark, sf, "fx_posting", "fx_prev", "fx_seen")
    return J.stamp_and_retain(new.select("seq", "job_url", "job_title", "company"), prev, seen, AS_OF_MERGE,
                              retain=retain)


@query("stamp_and_retain", fixtures=["fx_posting", "fx_prev", "fx_seen"],
       oracle=_MERGE_SQL + "SELECT job_url, seq, job_title, first_seen, last_seen, stale FROM merged")
def stamp_and_retain(spark, sf):
    """Snapshot merge with carry-forward of recently seen rows."""
    return _merged(spark, sf).select("job_url", "seq", "job_title", "first_seen", "last_seen", "stale")


@query("stamp_only", fixtures=["fx_posting", "fx_prev", "fx_seen"],
       oracle=_MERGE_SQL + "SELECT job_url, seq, job_title, first_seen, last_seen, stale FROM stamped")
def stamp_only(spark, sf):
    """J5 without retention (keyword-subset runs)."""
    return _merged(spark, sf, retain=False).select("job_url", "seq", "job_title", "first_seen", "last_seen", "stale")


@query("carried_count", fixtures=["fx_posting", "fx_prev", "fx_seen"],
       oracle=_MERGE_SQL + "SELECT count(*) FILTER (WHERE coalesce(stale, FALSE)) AS carried FROM merged")
def carried_count(spark, sf):
    """A3: rows carried forward by the merge."""
    return R.carried_count(_merged(spark, sf))


@query("key_difference", fixtures=["fx_posting", "fx_prev"], oracle="""
SELECT DISTINCT job_url FROM fx_prev WHERE coalesce(job_url, '') <> ''
  AND job_url NOT IN (SELECT coalesce(nullif(job_url, ''), '') FROM fx_posting)""")
def key_difference(spark, sf):
    """Previous keys the new load lacks."""
    new, prev = fixtures(spark, sf, "fx_posting", "fx_prev")
    return J.key_difference(prev, new)


_SPONSOR_SQL = """
, eff AS (SELECT kvk, careers_url AS new_url FROM (SELECT *, row_number() OVER (PARTITION BY kvk ORDER BY ord DESC) AS rn
    FROM fx_company WHERE coalesce(kvk, '') <> '' AND coalesce(careers_url, '') <> '') WHERE rn = 1),
firsts AS (SELECT kvk, min(ord) AS first_ord FROM fx_sponsor GROUP BY kvk),
upd AS (SELECT f.first_ord AS ord, e.new_url FROM firsts f JOIN eff e ON e.kvk = f.kvk),
res AS (SELECT s.ord, s.kvk, coalesce(u.new_url, s.careers_url) AS careers_url,
    (u.new_url IS NOT NULL AND s.careers_url IS DISTINCT FROM u.new_url) AS changed
  FROM fx_sponsor s LEFT JOIN upd u ON u.ord = s.ord)
"""


@query("sponsor_update", fixtures=["fx_sponsor", "fx_company"], oracle=_SPONSOR_SQL + "SELECT * FROM res")
def sponsor_update(spark, sf):
    """Employer careers URLs written into the sponsor register."""
    sp, co = fixtures(spark, sf, "fx_sponsor", "fx_company")
    return J.sponsor_update(sp, co).select("ord", "kvk", "careers_url", "changed")


@query("sponsor_update_count", fixtures=["fx_sponsor", "fx_company"],
       oracle=_SPONSOR_SQL + "SELECT count(*) FILTER (WHERE changed) AS updated FROM res")
def sponsor_update_count(spark, sf):
    """Register rows whose URL changed."""
    sp, co = fixtures(spark, sf, "fx_sponsor", "fx_company")
    return J.sponsor_update(sp, co).agg(F.count_if("changed").alias("updated"))


@query("cache_hits", fixtures=["fx_company", "fx_cache"], oracle=f"""
SELECT ind_name, ord FROM fx_company c WHERE EXISTS (SELECT 1 FROM fx_cache k WHERE k.ind_name = c.ind_name
  AND k.cached_at > TIMESTAMP '{CUTOFF_SEEN}')""")
def cache_hits(spark, sf):
    """Employers whose cache entry is younger than 24 hours."""
    co, cache = fixtures(spark, sf, "fx_company", "fx_cache")
    return J.cache_hits(co, cache, AS_OF_SEEN).select("ind_name", "ord")


@query("cache_misses", fixtures=["fx_company", "fx_cache"], oracle=f"""
SELECT ind_name, ord FROM fx_company c WHERE NOT EXISTS (SELECT 1 FROM fx_cache k WHERE k.ind_name = c.ind_name
  AND k.cached_at > TIMESTAMP '{CUTOFF_SEEN}')""")
def cache_misses(spark, sf):
    """Employers to fetch again."""
    co, cache = fixtures(spark, sf, "fx_company", "fx_cache")
    return J.cache_misses(co, cache, AS_OF_SEEN).select("ind_name", "ord")


_REFRESHED = f"SELECT ind_name FROM fx_company WHERE {Q.any_contains(Q.low('ind_name'), COMPANY_KEYWORDS)}"


@query("partial_refresh", fixtures=["fx_posting", "fx_company"], oracle=f"""
SELECT seq, company, 'existing' AS src FROM fx_posting WHERE company NOT IN ({_REFRESHED})
UNION ALL SELECT seq, company, 'fresh' AS src FROM fx_posting WHERE company IN ({_REFRESHED})""")
def partial_refresh(spark, sf):
    """Refreshed employers' rows replaced, all others kept."""
    p, co = fixtures(spark, sf, "fx_posting", "fx_company")
    names = co.filter(P.name_matches_any(F.col("ind_name"), COMPANY_KEYWORDS))
    fresh = p.join(names.select(F.col("ind_name").alias("company")), "company", "left_semi")
    out = J.partial_refresh(p.withColumn("src", F.lit("existing")), fresh.withColumn("src", F.lit("fresh")), names)
    return out.select("seq", "company", "src")


@query("company_order_concat", fixtures=["fx_posting", "fx_company"], oracle="""
SELECT d.ord, p.seq, p.company FROM fx_posting p JOIN (SELECT ind_name, min(ord) AS ord FROM fx_company GROUP BY ind_name) d
  ON d.ind_name = p.company""")
def company_order_concat(spark, sf):
    """Results in dimension order."""
    p, co = fixtures(spark, sf, "fx_posting", "fx_company")
    return J.company_order_concat(p.select("seq", "company"), co).select("ord", "seq", "company")


@query("description_cache_lookup", fixtures=["fx_posting", "fx_desc_cache"], oracle=f"""
, dc AS (SELECT key, max(body) AS body FROM fx_desc_cache WHERE coalesce(key, '') <> '' GROUP BY key)
SELECT p.seq, CASE WHEN dc.body IS NOT NULL THEN dc.body ELSE {_html_to_text_sql('p.description', C.DESCRIPTION_MAX)} END AS description,
  dc.body IS NOT NULL AS from_cache
FROM fx_posting p LEFT JOIN dc ON dc.key = coalesce(nullif(p.job_url, ''), '')""")
def description_cache_lookup(spark, sf):
    """Cached description, else the cleaned text of the posting."""
    p, dc = fixtures(spark, sf, "fx_posting", "fx_desc_cache")
    out = J.description_cache_lookup(p.select("seq", "job_url", "description"), dc,
                                     T.html_to_text(F.col("description")))
    return out.select("seq", "description", "from_cache")


@query("posting_page_join", fixtures=["fx_posting", "fx_job_page"], oracle=f"""
SELECT p.seq, p.job_url, g.html IS NOT NULL AS has_page,
  CASE WHEN g.html IS NOT NULL THEN {_html_to_text_sql('g.html', C.PAGE_TEXT_MAX)} END AS page_text
FROM fx_posting p LEFT JOIN fx_job_page g ON g.url = p.job_url""")
def posting_page_join(spark, sf):
    """Posting ⋈ its page (by URL), page text for the description ladder."""
    p, pg = fixtures(spark, sf, "fx_posting", "fx_job_page")
    j = J.posting_page_join(p.select("seq", "job_url"), pg, F.col("job_url"))
    return j.select("seq", "job_url", F.col("page_html").isNotNull().alias("has_page"),
                    F.when(F.col("page_html").isNotNull(), T.html_to_text(F.col("page_html"), C.PAGE_TEXT_MAX))
                    .alias("page_text"))


@query("union_feeds", fixtures=["fx_posting", "fx_search"], oracle="""
SELECT seq, job_url, CAST(NULL AS VARCHAR) AS search_term, 'portal' AS feed FROM fx_posting
UNION ALL SELECT seq, job_url, search_term, 'search' AS feed FROM fx_search""")
def union_feeds(spark, sf):
    """Bag union of the two feeds (different columns)."""
    p, s = fixtures(spark, sf, "fx_posting", "fx_search")
    return J.union_feeds(p.select("seq", "job_url", F.lit("portal").alias("feed")),
                         s.select("seq", "job_url", "search_term", F.lit("search").alias("feed"))).select(
        "seq", "job_url", "search_term", "feed")


@query("digest_counts", fixtures=["fx_posting", "fx_seen"], oracle=f"""
SELECT 'new' AS metric, count(*) AS n FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)
UNION ALL SELECT 'daily', count(*) FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url AND s.seen_at >= TIMESTAMP '{CUTOFF_SEEN}')
UNION ALL SELECT 'seen', count(DISTINCT job_url) FROM fx_seen WHERE coalesce(job_url, '') <> ''""")
def digest_counts(spark, sf):
    """A10: new postings, postings of the daily window, size of the seen store."""
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    n = F.count(F.lit(1)).alias("n")
    return (J.new_postings(p, seen).agg(F.lit("new").alias("metric"), n)
            .unionByName(J.seen_within(p, seen, AS_OF_SEEN).agg(F.lit("daily").alias("metric"), n))
            .unionByName(J.seen_keys(seen).agg(F.lit("seen").alias("metric"), n)))


_RULE_P = Q.rule_score(title="p.job_title", notes="NULL", company="p.company", description="p.description",
                       visa="p.visa_support", reloc="p.relocation_support")


@query("score_with_cache", fixtures=["fx_posting", "fx_score"], oracle=_SCORES + f"""
SELECT p.seq, p.job_url, CASE WHEN sc.score IS NOT NULL THEN sc.score ELSE {_RULE_P} END AS score,
  sc.score IS NOT NULL AS from_cache
FROM fx_posting p LEFT JOIN sc ON sc.job_url = p.job_url""")
def score_with_cache(spark, sf):
    """cached score, else the rule score."""
    p, sc = fixtures(spark, sf, "fx_posting", "fx_score")
    return SO.score_with_cache(p, sc, notes=null_str()).select("seq", "job_url", "score", "from_cache")


def _prompt_sql() -> str:
    parts = SO.PROMPT_TEMPLATE.split("%s")
    vals = [Q.lit(SO.DEFAULT_PROFILE_TEXT), "coalesce(p.job_title, '')", "coalesce(p.company, '')",
            "coalesce(p.location, '')", f"substr(coalesce(p.description, ''), 1, {C.PROMPT_DESCRIPTION_MAX})"]
    out = []
    for i, part in enumerate(parts):
        out.append(Q.lit(part))
        if i < len(vals):
            out.append(vals[i])
    return "concat(" + ", ".join(out) + ")"


@query("score_requests", fixtures=["fx_posting", "fx_score"], oracle=f"""
SELECT p.seq, p.job_url, {_prompt_sql()} AS prompt FROM fx_posting p
WHERE NOT EXISTS (SELECT 1 FROM fx_score s WHERE s.job_url = coalesce(nullif(p.job_url, ''), ''))""")
def score_requests(spark, sf):
    """F8: request texts for postings without a cached score."""
    p, sc = fixtures(spark, sf, "fx_posting", "fx_score")
    return SO.score_requests(p, sc).select("seq", "job_url", "prompt")


def demo_scorer(pdf: pd.DataFrame) -> pd.Series:
    """A deterministic stand-in for a model: scores titles with 'Engineer', else no answer."""
    title = pdf["job_title"].fillna("")
    company = pdf["company"].fillna("")
    score = (title.str.len() * 7 + company.str.len()) % 100
    return score.where(title.str.contains("Engineer", regex=False))


@query("score_plugin", fixtures=["fx_posting", "fx_score"], oracle=_SCORES + f"""
SELECT p.seq, p.job_url, CASE WHEN sc.score IS NOT NULL THEN sc.score
  ELSE coalesce(CASE WHEN contains(coalesce(p.job_title, ''), 'Engineer')
    THEN CAST(least(greatest((length(coalesce(p.job_title, '')) * 7 + length(coalesce(p.company, ''))) % 100, 0), 99) AS INTEGER) END,
    {_RULE_P}) END AS score,
  sc.score IS NOT NULL AS from_cache
FROM fx_posting p LEFT JOIN sc ON sc.job_url = p.job_url""")
def score_plugin(spark, sf):
    """User scorer on cache misses (pandas batches), rule score as fallback."""
    p, sc = fixtures(spark, sf, "fx_posting", "fx_score")
    return SO.score_with(p, sc, demo_scorer).select("seq", "job_url", "score", "from_cache")


def _new_ranked(spark, sf):
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    fresh = J.new_postings(p, seen).withColumn("date_posted", V.fmt_date("date_raw"))
    scored = fresh.withColumn("score", S.rule_score(notes=null_str()))
    return O.rank_by_score(scored)


_NEW_RANKED_SQL = f"""
, nw AS (SELECT p.*, {Q.fmt_date('p.date_raw')} AS date_posted, {_RULE_P} AS score FROM fx_posting p
   WHERE coalesce(job_url, '') <> '' AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, job_url, seq) AS rank FROM nw)
"""


@query("digest_rows", fixtures=["fx_posting", "fx_seen"], oracle=_NEW_RANKED_SQL + f"""
SELECT seq, rank, coalesce(nullif(job_url, ''), '#') AS link, coalesce(nullif(job_title, ''), 'Unknown') AS title,
  coalesce(company, '') AS company, coalesce(nullif(location, ''), 'Netherlands') AS location,
  coalesce(date_posted, '') AS posted, score, {Q.band('score')} AS band
FROM rk""")
def digest_rows(spark, sf):
    """K4: digest rows of the new postings, ranked."""
    return R.digest_rows(_new_ranked(spark, sf))


@query("digest_header", fixtures=["fx_posting", "fx_seen"], oracle=f"""
, c AS (SELECT
   (SELECT count(*) FROM fx_posting p WHERE coalesce(job_url, '') <> ''
     AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)) AS n_new,
   (SELECT count(*) FROM fx_posting p WHERE coalesce(job_url, '') <> ''
     AND EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url AND s.seen_at >= TIMESTAMP '{CUTOFF_SEEN}')) AS n_day)
SELECT 'hourly' AS kind, n_new AS n, CAST(n_new AS VARCHAR) || ' new job' || CASE WHEN n_new <> 1 THEN 's' ELSE '' END || ' found' AS heading,
  CAST(n_new AS VARCHAR) || ' new NL jobs | ' || strftime(TIMESTAMP '{AS_OF_SEEN}', '%b %d %H:%M') || ' UTC' AS subject FROM c
UNION ALL
SELECT 'daily', n_day, 'Daily Report: ' || CAST(n_day AS VARCHAR) || ' jobs in the last 24 hours',
  'Daily job report | ' || CAST(n_day AS VARCHAR) || ' jobs | ' || strftime(TIMESTAMP '{AS_OF_SEEN}', '%b %d, %Y') FROM c""")
def digest_header(spark, sf):
    """K5: digest count, heading and subject (hourly and daily)."""
    p, seen = fixtures(spark, sf, "fx_posting", "fx_seen")
    return (R.digest_header(J.new_postings(p, seen), AS_OF_SEEN, "hourly")
            .unionByName(R.digest_header(J.seen_within(p, seen, AS_OF_SEEN), AS_OF_SEEN, "daily")))


@query("daily_report", fixtures=["fx_posting", "fx_seen", "fx_score"], oracle=_SCORES + f"""
, d AS (SELECT p.seq, p.job_url, CASE WHEN sc.score IS NOT NULL THEN sc.score ELSE {_RULE_P} END AS score
  FROM fx_posting p LEFT JOIN sc ON sc.job_url = p.job_url
  WHERE coalesce(p.job_url, '') <> '' AND EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url
    AND s.seen_at >= TIMESTAMP '{CUTOFF_SEEN}'))
SELECT seq, job_url, score, row_number() OVER (ORDER BY score DESC, job_url, seq) AS rank FROM d""")
def daily_report(spark, sf):
    """Postings seen in the last 24 hours, scored (cache first) and ranked."""
    p, seen, sc = fixtures(spark, sf, "fx_posting", "fx_seen", "fx_score")
    day = J.seen_within(p, seen, AS_OF_SEEN)
    scored = SO.score_with_cache(day, sc, notes=null_str())
    return O.rank_by_score(scored.select("seq", "job_url", "score"))


# ------------------------------------------------------------------ PII

def pii_records(spark, sf):
    """Both feeds as JSON records: the e-mail key absent, null or set by seq % 3."""
    p, s = fixtures(spark, sf, "fx_posting", "fx_search")

    def records(df, title):
        base = [F.col("seq"), F.col("job_url"), F.col("company"), F.col(title).alias("job_title")]
        email = F.concat(F.lit("r"), F.col("seq").cast("string"), F.lit("@corp.nl"))
        body = (F.when(F.col("seq") % 3 == 0, F.to_json(F.struct(*base)))
                .when(F.col("seq") % 3 == 1, F.to_json(F.struct(*base, F.lit(None).cast("string").alias("recruiter_email")),
                                                       {"ignoreNullFields": "false"}))
                .otherwise(F.to_json(F.struct(*base, email.alias("recruiter_email")))))
        return df.select("seq", body.alias("body"))

    return records(p, "job_title"), records(s, "title")


PII_SCHEMA = "seq bigint, job_url string, company string, job_title string, recruiter_email string"


@query("strip_pii", fixtures=["fx_posting"], oracle="SELECT seq, job_url, company, job_title FROM fx_posting")
def strip_pii(spark, sf):
    """Personal-data fields removed from the portal feed."""
    portal, _ = pii_records(spark, sf)
    return PV.scrub_json(portal, schema=PII_SCHEMA)


_PII_SQL = """
, audit AS (
  SELECT 'portal' AS target, 'recruiter_email' AS field, count(*) FILTER (WHERE seq % 3 <> 0) AS removed_keys,
    count(*) FILTER (WHERE seq % 3 = 2) AS removed_values FROM fx_posting
  UNION ALL
  SELECT 'search', 'recruiter_email', count(*) FILTER (WHERE seq % 3 <> 0), count(*) FILTER (WHERE seq % 3 = 2) FROM fx_search)
"""


@query("pii_audit", fixtures=["fx_posting", "fx_search"], oracle=_PII_SQL + "SELECT * FROM audit")
def pii_audit(spark, sf):
    """A4: keys and non-null values removed per target."""
    portal, search = pii_records(spark, sf)
    return PV.pii_audit(portal, "portal").unionByName(PV.pii_audit(search, "search"))


@query("pii_audit_total", fixtures=["fx_posting", "fx_search"],
       oracle=_PII_SQL + "SELECT CAST(sum(removed_values) AS BIGINT) AS total_removed FROM audit")
def pii_audit_total(spark, sf):
    """A5: values removed over all targets."""
    portal, search = pii_records(spark, sf)
    return PV.pii_audit_total(PV.pii_audit(portal, "portal").unionByName(PV.pii_audit(search, "search")))


def demo_fetch(urls: pd.Series) -> pd.Series:
    """A deterministic stand-in for a page fetch (derives the text from the URL)."""
    return "Fetched description of " + urls.astype(str)


@query("description_fetch", fixtures=["fx_posting", "fx_desc_cache"], oracle="""
, dc AS (SELECT key, max(body) AS body FROM fx_desc_cache WHERE coalesce(key, '') <> '' GROUP BY key)
SELECT p.seq, CASE WHEN dc.body IS NOT NULL THEN dc.body
  WHEN coalesce(p.job_url, '') <> '' THEN 'Fetched description of ' || p.job_url END AS description,
  CASE WHEN dc.body IS NOT NULL THEN 'cache' WHEN coalesce(p.job_url, '') <> '' THEN 'fetch' END AS source
FROM fx_posting p LEFT JOIN dc ON dc.key = p.job_url""")
def description_fetch(spark, sf):
    """G3 + J10: cached description, else one fetch per distinct missing key (user
    function through mapInPandas); the fetched rows are what K2 appends to the cache."""
    p, dc = fixtures(spark, sf, "fx_posting", "fx_desc_cache")
    cache = dc.filter(V.truthy("key").isNotNull()).groupBy("key").agg(F.max("body").alias("body"))
    keyed = J.with_key(p.select("seq", "job_url"))
    hits = keyed.join(cache.withColumnRenamed("key", J.KEY), J.KEY, "left")
    misses = hits.filter(F.col("body").isNull() & (F.col(J.KEY) != "")).select(F.col(J.KEY).alias("key"))
    fetched = SO.fetch_missing(misses, demo_fetch)  # one call per distinct missing key; empty results dropped
    out = hits.join(fetched.select(F.col("key").alias(J.KEY), F.col("body").alias("__f")), J.KEY, "left")
    return out.select("seq", F.coalesce("body", "__f").alias("description"),
                      F.when(F.col("body").isNotNull(), F.lit("cache")).when(F.col("__f").isNotNull(), F.lit("fetch"))
                      .alias("source"))


@query("cache_age_hours", fixtures=["fx_company", "fx_cache"], oracle=f"""
SELECT c.ind_name, CAST(floor(epoch(TIMESTAMP '{AS_OF_SEEN}' - k.cached_at)) AS BIGINT) AS age_seconds,
  epoch(TIMESTAMP '{AS_OF_SEEN}' - k.cached_at) / 3600.0 < 24 AS fresh
FROM fx_company c JOIN fx_cache k ON k.ind_name = c.ind_name""")
def cache_age_hours(spark, sf):
    """F10 + F11: age of every cache entry at as_of (whole seconds), and the 24-hour freshness test."""
    co, cache = fixtures(spark, sf, "fx_company", "fx_cache")
    age = J.cache_age_hours(cache, AS_OF_SEEN)
    return co.select("ind_name").join(age, "ind_name").select(
        "ind_name", F.floor((F.unix_micros(J.as_of_ts(AS_OF_SEEN)) - F.unix_micros(F.col("cached_at").cast("timestamp")))
                            / F.lit(1_000_000)).cast("bigint").alias("age_seconds"),
        (F.col("age_hours") < C.CACHE_TTL_HOURS).alias("fresh"))


@query("stamp_and_retain_bucketed", fixtures=["fx_posting", "fx_prev", "fx_seen"],
       oracle=_MERGE_SQL + "SELECT job_url, seq, job_title, first_seen, last_seen, stale FROM merged")
def stamp_and_retain_bucketed(spark, sf):
    """J5 over stores kept as tables bucketed on job_url (the recurring layout):
    the previous snapshot and the seen store are read without any shuffle."""
    import uuid

    from ..session import scratch_path
    from ..sources import snapshots as SN

    new, prev, seen = fixtures(spark, sf, "fx_posting", "fx_prev", "fx_seen")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = uuid.uuid4().hex[:8]
    pp, sp = scratch_path(spark, "bucketed-prev"), scratch_path(spark, "bucketed-seen")
    SN.write_bucketed(prev, f"postwise_prev_{tag}", pp, buckets=n)
    SN.write_bucketed(seen, f"postwise_seen_{tag}", sp, buckets=n)
    bprev = SN.read_bucketed(spark, f"postwise_prev_{tag}", pp, prev.schema, buckets=n)
    bseen = SN.read_bucketed(spark, f"postwise_seen_{tag}", sp, seen.schema, buckets=n)
    out = J.stamp_and_retain(new.select("seq", "job_url", "job_title", "company"), bprev, bseen, AS_OF_MERGE)
    return out.select("job_url", "seq", "job_title", "first_seen", "last_seen", "stale")
