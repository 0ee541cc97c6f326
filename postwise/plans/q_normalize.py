"""Queries: payload normalisers.

Spark path: the format's payload is *built* from ``fx_posting`` (pages of at most
64 postings, JSON/HTML text as a fetcher would land it) and parsed back by the
normaliser. Oracle path: the expected postings computed straight from
``fx_posting`` in SQL — no JSON involved, so the two paths are independent.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions import values as V
from ..operators import normalize as N
from ..sources import payloads as PL
from ..session import scratch_path
from ..sources.fixtures import fixture, fixtures, landed
from . import sqlgen as Q
from .catalog import query
from .q_core import _html_to_text_sql

PAGE = 64
COLS = list(N.POSTING_COLS)


def nz(c) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def seq_mod(n: int) -> Column:
    return F.col("seq") % n


def base(spark, sf, only=None):
    """Postings with their employer's columns; with ``only`` those of a part of the employers."""
    if only is not None:
        return only.postings
    p, c = fixtures(spark, sf, "fx_posting", "fx_company")
    return p.join(c.select(F.col("ind_name").alias("company"), "careers_url", "board", "ord"), "company")


class Dealt:
    """The rows of ``base`` and their employers, dealt by employer name into parts with a
    folder each: pages wanted of one part of the employers are built from that part alone.
    ``part`` is a column of fx_company; a name listed in several parts is in all of them."""

    def __init__(self, spark, sf, name: str, part: Column):
        def employers():
            c = fixture(spark, sf, "fx_company").withColumn("part", part)
            row = F.struct("careers_url", "board", "ord")
            named = c.filter(F.col("ind_name").isNotNull()).groupBy(F.col("ind_name").alias("company")).agg(
                F.collect_list(row).alias("rows"), F.collect_set("part").alias("parts"))
            return named.select("company", F.explode("parts").alias("part"), "rows").select(
                "company", "part", F.inline("rows"))

        self._employers = landed(spark, sf, name + "_employers", employers, partition_by=["part"])
        # whole, an employer table can look small enough to broadcast and be millions of rows
        self._postings = landed(spark, sf, name + "_postings", lambda: fixture(spark, sf, "fx_posting").join(
            self._employers.hint("merge"), "company"), partition_by=["part"])

    def of(self, part: str) -> "Dealt":
        one = object.__new__(Dealt)
        one.postings = self._postings.filter(F.col("part") == part).drop("part")
        one.employers = self._employers.filter(F.col("part") == part).drop("part")
        return one


def dims(spark, sf):
    c = fixture(spark, sf, "fx_company").withColumn("workday_tenant", F.col("board"))
    return PL.company_dimension(c, ("board", "location_filter", "workday_tenant", "jd_base_url"))


def pages_json(spark, sf, item: Column, wrap, page_size: int = PAGE, source_type: str = "", only=None):
    return PL.build_pages(base(spark, sf, only), item, wrap, page_size=page_size, source_type=source_type)


def with_page_url(spark, sf, pages, only=None):
    if only is not None:
        return pages.join(only.employers.select("company", F.col("careers_url").alias("url")), "company")
    c = fixture(spark, sf, "fx_company")
    return pages.join(c.select(F.col("ind_name").alias("company"), F.col("careers_url").alias("url")), "company")


_BASE_SQL = """
, base AS (SELECT p.*, c.careers_url, c.board, c.ord, c.source_type, c.jd_base_url FROM fx_posting p JOIN fx_company c ON c.ind_name = p.company)
"""
_FX = ["fx_posting", "fx_company"]
_NULLS = "CAST(NULL AS BOOLEAN) AS visa_support, CAST(NULL AS BOOLEAN) AS relocation_support"


def _cols_sql(**kw) -> str:
    """SELECT list in posting order; missing ones are NULL."""
    out = []
    for c in COLS:
        if c in kw:
            out.append(f"{kw[c]} AS {c}")
        elif c in ("visa_support", "relocation_support"):
            out.append(f"CAST(NULL AS BOOLEAN) AS {c}")
        else:
            out.append(f"CAST(NULL AS VARCHAR) AS {c}")
    return ", ".join(out)


def _html(expr, n=C.DESCRIPTION_MAX):
    return _html_to_text_sql(expr, n)


def landed_input(build):
    """A builder of landed input: its result is written once per session, scale factor
    and arguments, and read as a table from then on. Of a part of the employers (``only``)
    it is a plan: what it is built for is landed itself."""
    @functools.wraps(build)
    def read(spark, sf, *args, **kw):
        if kw.get("only") is not None:
            return build(spark, sf, *args, **kw)
        key = build.__name__ + (repr((args, sorted(kw.items()))) if args or kw else "")
        return landed(spark, sf, key, lambda: build(spark, sf, *args, **kw))

    return read


# ------------------------------------------------------------------ N1 greenhouse

@landed_input
def greenhouse_pages(spark, sf, only=None):
    dept_t = "array<struct<name: string>>"
    depts = (F.when(seq_mod(3) == 0, F.array(F.struct(F.lit("Engineering").alias("name"))))
             .when(seq_mod(3) == 1, F.array(F.struct(F.lit("").alias("name"))))
             .otherwise(F.array().cast(dept_t)))
    item = F.struct(F.col("seq").alias("id"), F.col("job_title").alias("title"),
                    F.struct(F.col("location").alias("name")).alias("location"), nz("job_url").alias("absolute_url"),
                    F.col("date_raw").alias("first_published"), F.lit("2021-06-30T12:00:00Z").alias("updated_at"),
                    depts.alias("departments"), F.col("description").alias("content"))
    return pages_json(spark, sf, item, lambda arr: F.to_json(F.struct(arr.alias("jobs"))), source_type="greenhouse", only=only)


_GH_SQL = _BASE_SQL + f"""
, gh AS (SELECT company, seq, {_cols_sql(
    job_title="job_title",
    location="CASE WHEN contains(location, ',') THEN location ELSE location || ', Netherlands' END",
    careers_url="careers_url",
    job_url="coalesce(nullif(job_url, ''), 'https://job-boards.greenhouse.io/' || board || '/jobs/' || CAST(seq AS VARCHAR))",
    date_posted=Q.fmt_date("coalesce(nullif(date_raw, ''), '2021-06-30T12:00:00Z')"),
    description=f"CASE WHEN seq <> 0 THEN {_html('description')} END",
    notes="CASE WHEN seq % 3 = 0 THEN 'Dept: Engineering. Via Greenhouse board.' ELSE 'Via Greenhouse board.' END",
    company="company")}
  FROM base WHERE {Q.is_loc('location')} AND {Q.is_role('job_title')})
"""


@query("norm_greenhouse", fixtures=_FX, oracle=_GH_SQL + f"SELECT {', '.join(COLS)} FROM gh")
def norm_greenhouse(spark, sf):
    """Greenhouse board payloads → postings."""
    return N.normalize_greenhouse(greenhouse_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N2 icims

@landed_input
def icims_pages(spark, sf, only=None):
    fields = [nz(F.regexp_extract("job_url", r"(\d+)$", 1)).alias("req_id"), F.lit(None).cast("string").alias("id"),
              F.lit(None).cast("string").alias("slug"), F.col("job_title").alias("title"),
              F.col("location").alias("city"), F.when(seq_mod(2) == 0, F.lit("Netherlands")).alias("country"),
              F.when(seq_mod(2) == 1, F.lit("NL")).alias("country_name"),
              F.when(seq_mod(3) == 0, F.replace("job_url", F.lit("/p/"), F.lit("/jobs/"))).alias("apply_url"),
              F.when(seq_mod(3) == 1, nz("job_url")).alias("absolute_url"), nz("job_url").alias("url"),
              F.col("date_raw").alias("posted_date"), F.lit(None).cast("string").alias("date_posted"),
              F.col("description").alias("description")]
    inner = F.struct(*fields)
    wrapped = seq_mod(2) == 0
    names = ["req_id", "id", "slug", "title", "city", "country", "country_name", "apply_url", "absolute_url",
             "url", "posted_date", "date_posted", "description"]
    item = F.struct(F.when(wrapped, inner).alias("data"), *[F.when(~wrapped, inner[n]).alias(n) for n in names])
    return pages_json(spark, sf, item, lambda arr: F.to_json(F.struct(arr.alias("jobs"))), source_type="icims", only=only)


_VISA = Q.any_contains(Q.low("description"), C.VISA_WORDS)
_RELOC = Q.any_contains(Q.low("description"), C.RELOCATION_WORDS)
_IC_SQL = _BASE_SQL + """
, ic AS (SELECT b.*, coalesce(nullif(regexp_extract(job_url, '(\\d+)$', 1), ''), '') AS uid,
    trim(coalesce(location, '') || ', ' || CASE WHEN seq % 2 = 0 THEN 'Netherlands' ELSE 'NL' END, ', ') AS loc,
    coalesce(nullif(CASE WHEN seq % 3 = 0 THEN replace(job_url, '/p/', '/jobs/') END, ''),
             nullif(CASE WHEN seq % 3 = 1 THEN job_url END, ''), nullif(job_url, ''), '') AS raw
  FROM base b),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company, uid ORDER BY seq) AS rn
         FROM ic WHERE uid <> '') WHERE rn = 1
       UNION ALL SELECT * FROM ic WHERE uid = '')
"""


@query("norm_icims", fixtures=_FX, oracle=_IC_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location="loc", careers_url="careers_url",
    job_url="CASE WHEN regexp_extract(raw, '/jobs/(\\d+)', 1) <> '' THEN 'https://jobs.booking.com/booking/jobs/' || regexp_extract(raw, '/jobs/(\\d+)', 1) ELSE nullif(raw, '') END",
    visa_support=f"CASE WHEN {_VISA} THEN TRUE END", relocation_support=f"CASE WHEN {_RELOC} THEN TRUE END",
    date_posted=Q.fmt_date('date_raw'), notes="'Via iCIMS/Jibe API.'")}
FROM dd WHERE {Q.is_loc('loc')} AND {Q.is_role('job_title')}""")
def norm_icims(spark, sf):
    """Icims pages (wrapped and flat items) → deduplicated postings."""
    return N.normalize_icims(icims_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N3 lever

@landed_input
def lever_pages(spark, sf, only=None):
    item = F.struct(
        F.col("job_title").alias("text"),
        F.struct(F.when(seq_mod(5) != 0, F.col("location")).alias("location"),
                 F.when(seq_mod(5) == 0, F.array(F.lit("Amsterdam"))).otherwise(F.array(F.lit("Berlin")))
                 .alias("allLocations")).alias("categories"),
        F.when(seq_mod(5) == 0, F.lit("Remote")).alias("workplaceType"),
        nz("job_url").alias("hostedUrl"),
        F.concat(F.lit("https://apply.example.org/"), F.col("seq").cast("string")).alias("applyUrl"),
        (F.lit(1600000000000) + F.col("seq")).alias("createdAt"),
        F.when(F.col("description").isNotNull(), F.concat(F.lit("<p>"), "description", F.lit("</p>"))).alias(
            "description"))
    return pages_json(spark, sf, item, lambda arr: F.to_json(arr), source_type="lever", only=only)


_LV_LOC = "CASE WHEN seq % 5 = 0 THEN 'Remote' ELSE coalesce(location, '') END"


@query("norm_lever", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location=_LV_LOC, careers_url="careers_url",
    job_url="coalesce(nullif(job_url, ''), 'https://apply.example.org/' || CAST(seq AS VARCHAR))",
    description=_html("CASE WHEN description IS NULL THEN '' ELSE '<p>' || description || '</p>' END"),
    notes="'Via Lever API.'")}
FROM base WHERE ({Q.is_loc(_LV_LOC)} OR seq % 5 = 0) AND {Q.is_role('job_title')}""")
def norm_lever(spark, sf):
    """Lever arrays (epoch-ms dates give no date)."""
    return N.normalize_lever(lever_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N4 smartrecruiters

@landed_input
def smartrecruiters_pages(spark, sf, only=None):
    item = F.struct(F.col("job_title").alias("name"),
                    F.struct(F.col("location").alias("city"),
                             F.when(seq_mod(2) == 0, F.lit("nl")).alias("country")).alias("location"),
                    F.col("job_url").alias("ref"), F.col("date_raw").alias("releasedDate"),
                    F.lit("2022-02-02").alias("updatedOn"))
    return pages_json(spark, sf, item, lambda arr: F.to_json(F.struct(arr.alias("content"))), only=only)


@query("norm_smartrecruiters", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title",
    location="trim(coalesce(location, '') || ', ' || CASE WHEN seq % 2 = 0 THEN 'nl' ELSE 'Netherlands' END, ', ')",
    careers_url="careers_url", job_url="job_url",
    date_posted=Q.fmt_date("coalesce(nullif(date_raw, ''), '2022-02-02')"), notes="'Via SmartRecruiters API.'")}
FROM base WHERE {Q.is_role('job_title')}""")
def norm_smartrecruiters(spark, sf):
    """Smartrecruiters content → postings (role filter only)."""
    return N.normalize_smartrecruiters(smartrecruiters_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N5 ashby

@landed_input
def ashby_pages(spark, sf, only=None):
    addr = F.struct(F.struct(F.lit("Utrecht").alias("addressLocality"), F.lit("NL").alias("addressCountry"))
                    .alias("postalAddress"))
    item = F.struct(F.col("job_title").alias("title"), F.when(seq_mod(4) != 0, F.col("location")).alias("location"),
                    F.when(seq_mod(4) == 0, F.lit("Hybrid")).alias("locationName"),
                    F.when(seq_mod(4) == 1, addr).alias("address"), nz("job_url").alias("jobUrl"),
                    F.col("date_raw").alias("publishedAt"), F.lit("2023-03-03").alias("createdAt"),
                    F.col("description").alias("descriptionHtml"))
    return pages_json(spark, sf, item, lambda arr: F.when(F.col("page") % 2 == 0, F.to_json(F.struct(arr.alias("jobs"))))
                      .otherwise(F.to_json(F.struct(arr.alias("jobPostings")))), only=only)


_AB_LOC = "CASE WHEN seq % 4 = 0 THEN 'Hybrid' ELSE coalesce(location, '') END"
_AB_FULL = f"trim({_AB_LOC} || ' ' || CASE WHEN seq % 4 = 1 THEN 'Utrecht NL' ELSE '' END)"


@query("norm_ashby", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location=f"coalesce(nullif({_AB_LOC}, ''), 'Netherlands')",
    careers_url="careers_url", job_url="coalesce(nullif(job_url, ''), '')",
    date_posted=Q.fmt_date("coalesce(nullif(date_raw, ''), '2023-03-03')"),
    description=_html("coalesce(description, '')"), notes="'Via Ashby API.'")}
FROM base WHERE {Q.is_role('job_title')}
  AND ({_AB_FULL} = '' OR {Q.is_loc(_AB_FULL)} OR lower({_AB_LOC}) IN ('remote', 'hybrid', ''))""")
def norm_ashby(spark, sf):
    """Ashby 'jobs' / 'jobPostings' payloads → postings."""
    return N.normalize_ashby(ashby_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N6 recruitee

@landed_input
def recruitee_pages(spark, sf, only=None):
    item = F.struct(F.col("job_title").alias("title"), F.col("location").alias("city"),
                    F.when(seq_mod(3) == 0, F.lit("Netherlands")).alias("country"), nz("job_url").alias("careers_url"),
                    F.concat(F.lit("o-"), F.col("seq").cast("string")).alias("slug"),
                    F.col("date_raw").alias("published_at"), F.col("description").alias("description"))
    return pages_json(spark, sf, item, lambda arr: F.to_json(F.struct(arr.alias("offers"))), only=only)


_RC_LOC = "trim(coalesce(location, '') || ', ' || CASE WHEN seq % 3 = 0 THEN 'Netherlands' ELSE '' END, ', ')"


@query("norm_recruitee", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location=f"coalesce(nullif({_RC_LOC}, ''), 'Netherlands')",
    careers_url="careers_url",
    job_url="coalesce(nullif(job_url, ''), 'https://' || board || '.recruitee.com/o/o-' || CAST(seq AS VARCHAR))",
    date_posted=Q.fmt_date('date_raw'), description=_html("coalesce(description, '')"), notes="'Via Recruitee API.'")}
FROM base WHERE {Q.is_role('job_title')} AND ({_RC_LOC} = '' OR {Q.is_loc(_RC_LOC)})""")
def norm_recruitee(spark, sf):
    """Recruitee offers → postings."""
    return N.normalize_recruitee(recruitee_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N9 static search index

@landed_input
def index_pages(spark, sf, only=None):
    item = F.struct(F.when(seq_mod(2) == 0, F.col("job_title")).alias("title"),
                    F.when(seq_mod(2) == 1, F.col("job_title")).alias("vacancyTitle"),
                    F.when(seq_mod(4) != 0, F.col("location")).alias("location"),
                    F.when(seq_mod(2) == 0, F.concat(F.lit("/vacature/"), F.col("seq").cast("string")))
                    .otherwise(nz("job_url")).alias("url"),
                    F.col("date_raw").alias("date"), F.col("description").alias("description"))

    def wrap(arr):
        return (F.when(F.col("page") % 3 == 0, F.to_json(F.struct(arr.alias("docs"))))
                .when(F.col("page") % 3 == 1, F.to_json(F.struct(F.size(arr).alias("total"), arr.alias("results"))))
                .otherwise(F.to_json(arr)))

    return pages_json(spark, sf, item, wrap, only=only)


@query("norm_search_index", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="trim(job_title)",
    location="coalesce(nullif(CASE WHEN seq % 4 <> 0 THEN location END, ''), 'Netherlands')", careers_url="careers_url",
    job_url="CASE WHEN seq % 2 = 0 THEN 'https://www.werkenbijkpmg.nl/vacature/' || CAST(seq AS VARCHAR) ELSE coalesce(nullif(job_url, ''), careers_url) END",
    date_posted=Q.fmt_date("coalesce(nullif(date_raw, ''), '')"), description=_html("coalesce(description, '')"),
    notes="'Via KPMG lunr JSON.'")}
FROM base WHERE {Q.is_role('trim(job_title)')}""")
def norm_search_index(spark, sf):
    """Static search index (three layouts) → postings, no location filter."""
    return N.normalize_search_index(index_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N10 workday

@landed_input
def workday_pages(spark, sf, page_size=20, only=None):
    ext = F.when(F.col("job_url") != "", F.concat(F.lit("/job/"), F.regexp_extract("job_url", r"(\d+)$", 1)))
    item = F.struct(F.col("job_title").alias("title"), ext.alias("externalPath"),
                    F.col("location").alias("locationsText"), F.lit("Posted 2 Days Ago").alias("postedOn"))
    return pages_json(spark, sf, item, lambda arr: F.to_json(F.struct(arr.alias("jobPostings"), F.lit(100).alias("total"))),
                      page_size=page_size, source_type="workday", only=only)


_WD_EXT = "CASE WHEN job_url <> '' THEN '/job/' || regexp_extract(job_url, '(\\d+)$', 1) ELSE '' END"
_WD_SQL = _BASE_SQL + f"""
, wd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {_WD_EXT} AS ext, row_number() OVER (
    PARTITION BY company, coalesce(nullif({_WD_EXT}, ''), nullif(job_title, ''), '') ORDER BY seq) AS rn FROM base) WHERE rn = 1)
"""


@query("norm_workday", fixtures=_FX, oracle=_WD_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location="coalesce(nullif(location, ''), 'Netherlands')",
    careers_url="careers_url",
    job_url="CASE WHEN ext <> '' THEN 'https://' || board || '.wd5.myworkdayjobs.com' || ext ELSE careers_url END",
    notes="'Via Workday API.'")}
FROM wd WHERE {Q.is_role('job_title')} AND (coalesce(location, '') = '' OR {Q.is_loc('location')})""")
def norm_workday(spark, sf):
    """Workday pages → postings deduplicated by external path (else title)."""
    return N.normalize_workday(workday_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N13 embedded array

@landed_input
def embedded_pages(spark, sf, only=None):
    nested = (F.floor(F.col("seq") / PAGE) % 4) == 0
    item = F.struct(F.col("job_title").alias("title"), F.when(seq_mod(3) != 0, F.col("location")).alias("locationName"),
                    F.when(seq_mod(2) == 0, F.concat(F.lit("/role/"), F.col("seq").cast("string")))
                    .otherwise(nz("job_url")).alias("link"),
                    F.when(seq_mod(4) == 1, F.lit("Tech")).alias("departmentName"),
                    F.when(nested, F.array(F.lit("x"))).alias("tags"))
    return pages_json(spark, sf, item, lambda arr: F.concat(
        F.lit('0:["$","div",null,{"props":{"jobs":'), F.to_json(arr), F.lit("}}]")), only=only)


_EM_LOC = "coalesce(nullif(CASE WHEN seq % 3 <> 0 THEN location END, ''), 'Amsterdam, Netherlands')"
_EM_LINK = "CASE WHEN seq % 2 = 0 THEN '/role/' || CAST(seq AS VARCHAR) ELSE coalesce(job_url, '') END"


@query("norm_embedded_array", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title",
    location=f"CASE WHEN contains({_EM_LOC}, ',') THEN {_EM_LOC} ELSE {_EM_LOC} || ', Netherlands' END",
    careers_url="careers_url",
    job_url=f"CASE WHEN starts_with({_EM_LINK}, '/') THEN 'https://jobs.bitvavo.com' || {_EM_LINK} ELSE {_EM_LINK} END",
    notes="'Dept: ' || CASE WHEN seq % 4 = 1 THEN 'Tech' ELSE '' END || '. Via Bitvavo RSC endpoint.'")}
FROM base WHERE floor(seq / 64) % 4 <> 0 AND {Q.is_role('job_title')}""")
def norm_embedded_array(spark, sf):
    """JSON array embedded in text; pages whose items hold nested arrays yield nothing."""
    return N.normalize_embedded_array(embedded_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N16 page-state pairs

def _state_item() -> Column:
    return F.struct(F.coalesce(nz("job_title"), F.lit("Untitled")).alias("title"), F.col("seq").alias("id"),
                    F.when(F.col("job_url") == "", F.concat(F.lit("https://jobs.example.org/none/"),
                                                            F.col("seq").cast("string")))
                    .otherwise(F.col("job_url")).alias("url"))


def _state_page(arr) -> Column:
    return F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'),
                    F.to_json(F.struct(F.struct(F.struct(arr.alias("jobs")).alias("pageProps")).alias("props"))),
                    F.lit("</script></html>"))


@landed_input
def nextdata_pages(spark, sf, only=None):
    return with_page_url(spark, sf, pages_json(spark, sf, _state_item(), _state_page, only=only), only)


_ND_TITLE = "coalesce(nullif(job_title, ''), 'Untitled')"


@query("nextdata_pairs", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title=_ND_TITLE, location="'Netherlands'", careers_url="careers_url",
    job_url="CASE WHEN job_url = '' THEN 'https://jobs.example.org/none/' || CAST(seq AS VARCHAR) ELSE job_url END",
    notes="'Via __NEXT_DATA__.'")}
FROM base WHERE {Q.is_role(_ND_TITLE)}""")
def nextdata_pairs(spark, sf):
    """title/url pairs from embedded page state."""
    return N.nextdata_pairs(nextdata_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N18 aggregator rows

@query("norm_search_rows", fixtures=["fx_search"], oracle=f"""
SELECT search_term, seq, {_cols_sql(company="company", job_title="title", location="location", careers_url="job_url",
    job_url="job_url", date_posted="coalesce(date_posted, '')", description="coalesce(description, '')",
    notes="'Via LinkedIn / JobSpy.'")}
FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq) AS rn FROM fx_search WHERE coalesce(job_url, '') <> '')
WHERE rn = 1 AND regexp_matches(coalesce(title, ''), '(?i)\\b({'|'.join(C.SEARCH_TITLE_WORDS)})\\b')""")
def norm_search_rows(spark, sf):
    """Aggregator search rows → postings."""
    return N.normalize_search_rows(fixture(spark, sf, "fx_search"))


# ------------------------------------------------------------------ J11

@query("payload_company_join", fixtures=_FX, oracle="""
SELECT p.company, CAST(floor(p.seq / 64) AS INTEGER) AS page, c.careers_url, c.board
FROM fx_posting p JOIN fx_company c ON c.ind_name = p.company GROUP BY ALL""")
def payload_company_join(spark, sf):
    """Landed payload pages ⋈ employer dimension (size-checked broadcast)."""
    pages = greenhouse_pages(spark, sf)
    j = N.with_company(pages, dims(spark, sf))
    return j.select("company", "page", "careers_url", F.try_element_at("params", F.lit("board")).alias("board"))


# ------------------------------------------------------------------ N7 slug list

SLUGS = ("senior-python-engineer", "java-developer", "account-manager", "lead-ios-developer",
         "staff-software-engineer", "data-analyst", "platform-engineer", "")
SLUG_SQL = "CASE seq % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SLUGS)) + " END"
DETAIL_PAGES = {
    "java-developer": "<html><head><title>Java Developer (Backend) | Careers</title></head></html>",
    "lead-ios-developer": ('<html><head><title>Lead iOS Developer</title><script type="application/ld+json">'
                           '{"@type": "JobPosting", "title": "Lead iOS Engineer"}</script></head></html>'),
    "platform-engineer": "<html><head><title>Ops</title></head></html>",
}


@landed_input
def slug_listing(spark, sf, only=None):
    slug = V.slugify("job_title")
    item = F.concat(F.lit('<a href="/en/jobs/engineering/'), slug, F.lit('/amsterdam">'), F.col("job_title"), F.lit("</a>"))
    return pages_json(spark, sf, item, lambda arr: F.concat(F.lit("<html><body>"), F.array_join(arr, ""),
                                                            F.lit("</body></html>")), only=only)


@landed_input
def slug_details(spark, sf):
    slugs = base(spark, sf).select(V.slugify("job_title").alias("slug")).distinct()
    html = None
    for s, h in DETAIL_PAGES.items():
        html = (F.when(F.col("slug") == s, F.lit(h)) if html is None else html.when(F.col("slug") == s, F.lit(h)))
    head, tail = C.URL_FORMATS["picnic_job"].split("{slug}")
    return slugs.select(F.concat(F.lit(head), "slug", F.lit(tail)).alias("url"), html.alias("html")).filter(
        F.col("html").isNotNull())


_SLUG_TITLE = ("CASE slug WHEN 'java-developer' THEN 'Java Developer (Backend)' WHEN 'lead-ios-developer' "
               f"THEN 'Lead iOS Engineer' ELSE {Q.initcap_slug('slug')} END")
_PICNIC_HEAD, _PICNIC_TAIL = C.URL_FORMATS["picnic_job"].split("{slug}")


@query("norm_slug_page", fixtures=_FX, oracle=_BASE_SQL + f"""
, sl AS (SELECT company, careers_url, CAST(floor(seq / 64) AS INTEGER) AS page, seq, {SLUG_SQL} AS slug FROM base),
fs AS (SELECT company, careers_url, page, slug, min(seq) AS s FROM sl WHERE slug <> '' GROUP BY ALL),
tt AS (SELECT *, {_SLUG_TITLE} AS title FROM fs)
SELECT {_cols_sql(company="company", job_title="title", location="'Amsterdam, Netherlands'", careers_url="careers_url",
    job_url=f"'{_PICNIC_HEAD}' || slug || '{_PICNIC_TAIL}'", description="''", notes="'Via Picnic RSC slug extraction.'")}
FROM tt WHERE {Q.is_role('title')}""")
def norm_slug_page(spark, sf):
    """Slugs listed in a page, titles from detail pages (<title>, JSON-LD)."""
    return N.normalize_slug_page(slug_listing(spark, sf), slug_details(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N8 JSON in an attribute

@landed_input
def attr_pages(spark, sf, only=None):
    item = F.struct(F.when(seq_mod(2) == 0, F.col("job_title")).alias("title"),
                    F.when(seq_mod(2) == 1, F.col("job_title")).alias("name"),
                    F.when(seq_mod(3) != 0, F.col("location")).alias("location"),
                    F.when(seq_mod(3) == 0, F.concat(F.lit("/vacancy/"), F.col("seq").cast("string")))
                    .when(seq_mod(3) == 1, nz("job_url")).alias("url"),
                    F.col("date_raw").alias("published_at"), F.col("description").alias("description"))

    def wrap(arr):
        esc = F.replace(F.replace(F.to_json(arr), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        return F.concat(F.lit('<html><body><div id="app" data-jobs="'), esc, F.lit('"></div></body></html>'))

    return with_page_url(spark, sf, pages_json(spark, sf, item, wrap, only=only), only)


_AT_LOC = "coalesce(nullif(CASE WHEN seq % 3 <> 0 THEN location END, ''), 'Netherlands')"
_AT_PATH = "CASE seq % 3 WHEN 0 THEN '/vacancy/' || CAST(seq AS VARCHAR) WHEN 1 THEN coalesce(job_url, '') ELSE '' END"


@query("norm_attr_json", fixtures=_FX, oracle=_BASE_SQL + f"""
SELECT {_cols_sql(company="company", job_title="job_title", location=_AT_LOC, careers_url="careers_url",
    job_url=f"CASE WHEN starts_with({_AT_PATH}, '/') THEN {Q.origin('careers_url')} || {_AT_PATH} WHEN starts_with({_AT_PATH}, 'http') THEN {_AT_PATH} ELSE careers_url END",
    date_posted=Q.fmt_date("coalesce(nullif(date_raw, ''), '')"), description=_html("coalesce(description, '')"),
    notes="'Via Homerun.'")}
FROM base WHERE {Q.is_role('job_title')} AND (lower({_AT_LOC}) IN ('remote', 'hybrid', '') OR {Q.is_loc(_AT_LOC)})""")
def norm_attr_json(spark, sf):
    """Entity-encoded JSON in a page attribute."""
    return N.normalize_attr_json(attr_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N15 JSON-LD

def _ld_desc():
    return F.when(seq_mod(4) == 0, F.concat(F.lit('Contact <a href="mailto:Recruiter'), F.col("seq").cast("string"),
                                            F.lit('@corp.nl">us</a>'))).otherwise(F.col("description"))


def _ld_lists() -> list[Column]:
    """Aggregates ``a`` and ``b`` of a page: its even and its odd postings as JSON-LD items."""
    common = [F.when(seq_mod(7) == 0, F.lit("Organization")).otherwise(F.lit("JobPosting")).alias("@type"),
              F.col("job_title").alias("title"), nz("job_url").alias("url"), F.col("date_raw").alias("datePosted"),
              _ld_desc().alias("description")]
    a_item = F.struct(*common, F.array(F.struct(F.struct(F.col("location").alias("addressLocality"),
                                                         F.lit("NL").alias("addressCountry")).alias("address")))
                      .alias("jobLocation"))
    b_item = F.struct(*common, F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address"))
                      .alias("jobLocation"))
    return [F.array_sort(F.collect_list(F.when(seq_mod(2) == k, F.struct(F.col("seq").alias("o"), item.alias("i")))))
            .alias(name) for k, item, name in ((0, a_item, "a"), (1, b_item, "b"))]


def _ld_texts() -> list[Column]:
    """The two scripts of a page, from its lists."""
    def js(arr):
        items = F.transform(arr, lambda x: x["i"])
        return F.when(F.size(items) == 1, F.to_json(F.try_element_at(items, F.lit(1)))).otherwise(F.to_json(items))

    a_json = F.when(F.col("page") % 10 == 9, F.substring(js(F.col("a")), 1, 30)).otherwise(js(F.col("a")))

    def script(x):
        return F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))

    return [script(a_json).alias("ld_a"), script(js(F.col("b"))).alias("ld_b")]


@landed_input
def ld_scripts(spark, sf, only=None):
    """Per page two ld+json scripts (even / odd postings; a lone item is written
    as an object); the first script of every tenth page is cut short."""
    b = base(spark, sf, only).withColumn("page", PL.page_of(F.col("seq"), PAGE))
    return b.groupBy("company", "page").agg(*_ld_lists()).select("company", "page", *_ld_texts())


@landed_input
def ld_pages(spark, sf):
    s = ld_scripts(spark, sf)
    pages = s.select("company", "page", F.concat(F.lit("<html><head>"), "ld_a", "ld_b",
                                                 F.lit("</head><body>ok</body></html>")).alias("body"))
    return with_page_url(spark, sf, pages)


def _ld_cte(extra: str = "TRUE") -> str:
    return f"""
, ld AS (SELECT b.*, CAST(floor(seq / 64) AS INTEGER) AS page,
    CASE WHEN seq % 4 = 0 THEN 'Contact <a href="mailto:Recruiter' || CAST(seq AS VARCHAR) || '@corp.nl">us</a>' ELSE description END AS ld_desc
  FROM base b WHERE seq % 7 <> 0 AND NOT (floor(seq / 64) % 10 = 9 AND seq % 2 = 0) AND ({extra}))
"""


_LD_STRICT_LOC = "coalesce(location, '') || ', ' || CASE WHEN seq % 2 = 0 THEN 'NL' ELSE '' END"
_LD_STRICT = f"""SELECT {_cols_sql(company="company", job_title="job_title", location=_LD_STRICT_LOC, careers_url="careers_url",
    job_url="coalesce(nullif(job_url, ''), careers_url)", date_posted=Q.fmt_date('date_raw'),
    recruiter_email="CASE WHEN seq % 4 = 0 THEN 'recruiter' || CAST(seq AS VARCHAR) || '@corp.nl' END",
    notes="'Via JSON-LD schema.'")}
FROM ld WHERE {Q.is_loc(_LD_STRICT_LOC)} AND {Q.is_role('job_title')}"""

_LD_LEN_LOC = "trim(coalesce(location, '') || ' ' || CASE WHEN seq % 2 = 0 THEN 'NL' ELSE '' END)"
_LD_LEN_PASS = f"({Q.is_role('job_title')} AND ({_LD_LEN_LOC} = '' OR {Q.is_loc(_LD_LEN_LOC)}))"
_LD_LENIENT = f"""SELECT {_cols_sql(company="company", job_title="job_title",
    location=f"coalesce(nullif({_LD_LEN_LOC}, ''), 'Netherlands')", careers_url="careers_url",
    job_url="coalesce(nullif(job_url, ''), careers_url)", date_posted=Q.fmt_date("coalesce(date_raw, '')"),
    description=_html("coalesce(ld_desc, '')"), notes="'Via JSON-LD (Playwright).'")}
FROM (SELECT *, bool_or(CASE WHEN seq % 2 = 0 THEN {_LD_LEN_PASS} ELSE FALSE END) OVER (PARTITION BY company, page) AS a_yields
      FROM ld) l
WHERE {_LD_LEN_PASS} AND (seq % 2) = CASE WHEN a_yields THEN 0 ELSE 1 END"""


@query("jsonld_postings", fixtures=_FX, oracle=_BASE_SQL + _ld_cte() + _LD_STRICT)
def jsonld_postings(spark, sf):
    """N15 (strict) + P22: JSON-LD JobPosting items of plain pages; malformed scripts yield nothing."""
    return N.jsonld_postings(ld_pages(spark, sf), dims(spark, sf)).select(*COLS)


@query("jsonld_postings_lenient", fixtures=_FX, oracle=_BASE_SQL + _ld_cte() + _LD_LENIENT)
def jsonld_postings_lenient(spark, sf):
    """N15 (lenient): rendered pages, first script that yields."""
    return N.jsonld_postings(ld_pages(spark, sf), dims(spark, sf), lenient=True).select(*COLS)


# ------------------------------------------------------------------ N17 anchors


def _anchor():
    s = F.col("seq").cast("string")
    href = (F.when(seq_mod(4) == 0, F.concat(F.lit("/jobs/"), s))
            .when(seq_mod(4) == 1, F.concat(F.lit("/about/"), s))
            .when(seq_mod(4) == 2, F.concat(F.lit("https://x.example.org/careers/"), s))
            .otherwise(F.concat(F.lit("/vacatures/"), s)))
    label = F.when(seq_mod(3) == 0, F.concat(F.lit(' aria-label="'), F.col("job_title"), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit('<a href="'), href, F.lit('"'), label, F.lit("><span>"), F.col("job_title"),
                    F.lit(" role</span></a>"))


@landed_input
def anchor_pages(spark, sf, chunk: int = 300, per_company: bool = False, only=None):
    b = base(spark, sf, only)
    group = ["company", PL.page_of(F.col("seq"), chunk).alias("page")] if per_company else \
        [PL.page_of(F.col("seq"), chunk).alias("page")]
    g = b.groupBy(*group).agg(
        *([] if per_company else [F.min_by("company", "seq").alias("company")]),
        F.array_sort(F.collect_list(F.struct("seq", _anchor().alias("a")))).alias("x"))
    pages = g.select("company", "page", F.concat(F.lit("<html><body>"),
                                                 F.array_join(F.transform("x", lambda v: v["a"]), "\n"),
                                                 F.lit("</body></html>")).alias("body"))
    return with_page_url(spark, sf, pages, only)


def _dom_sql(chunk: int = 300, per_company: bool = False, extra: str = "TRUE") -> str:
    part = "company, page" if per_company else "page"
    pc = ("" if per_company else
          f", pc AS (SELECT page, arg_min(company, seq) AS company FROM an GROUP BY page)")
    src = "an" if per_company else "an JOIN pc USING (page)"
    comp = "an.company" if per_company else "pc.company"
    return f"""
, an AS (SELECT company, seq, job_title, CAST(floor(seq / {chunk}) AS INTEGER) AS page,
    CASE seq % 4 WHEN 0 THEN '/jobs/' || CAST(seq AS VARCHAR) WHEN 1 THEN '/about/' || CAST(seq AS VARCHAR)
      WHEN 2 THEN 'https://x.example.org/careers/' || CAST(seq AS VARCHAR) ELSE '/vacatures/' || CAST(seq AS VARCHAR) END AS href
  FROM base WHERE {extra}){pc},
m AS (SELECT {comp} AS pcompany, an.*, row_number() OVER (PARTITION BY {"an.company, an.page" if per_company else "an.page"} ORDER BY an.seq) AS k
  FROM {src} WHERE an.seq % 4 <> 1),
t AS (SELECT m.*, c.careers_url AS page_url, trim(coalesce(nullif(CASE WHEN seq % 3 = 0 THEN job_title END, ''),
    nullif(trim(job_title || ' role'), ''), '')) AS title
  FROM m JOIN fx_company c ON c.ind_name = m.pcompany WHERE k <= 200)
"""


_DOM_SELECT = f"""SELECT {_cols_sql(company="pcompany", job_title="substr(title, 1, 120)", location="'Netherlands'",
    careers_url="page_url",
    job_url=f"CASE WHEN starts_with(href, '/') THEN {Q.origin('page_url')} || href ELSE href END",
    description="''", notes="'Via DOM link heuristic (Playwright).'")}
FROM t WHERE title <> '' AND {Q.is_role('title')}"""


@query("dom_link_postings", fixtures=_FX, oracle=_BASE_SQL + _dom_sql() + _DOM_SELECT)
def dom_link_postings(spark, sf):
    """N17 + W6: job-like anchors, at most 200 per page (pages of 300 anchors)."""
    return N.dom_link_postings(anchor_pages(spark, sf), dims(spark, sf), max_links=200).select(*COLS)


@query("dom_link_postings_all", fixtures=_FX, oracle=_BASE_SQL + _dom_sql().replace("WHERE k <= 200", "") + _DOM_SELECT)
def dom_link_postings_all(spark, sf):
    """N17 without a cap: every job-like anchor."""
    return N.dom_link_postings(anchor_pages(spark, sf), dims(spark, sf)).select(*COLS)


# ------------------------------------------------------------------ N14 recursive JSON search

@landed_input
def free_json_docs(spark, sf, page_size: int = PAGE, only=None):
    """Postings nested under data.jobs.items (found), x.y.z.w.v (too deep by plain
    keys) and inside list elements (never searched)."""
    b = base(spark, sf, only).withColumn("page", PL.page_of(F.col("seq"), page_size))
    s = F.col("seq").cast("string")
    item = F.struct(F.col("job_title").alias("title"),
                    F.when(seq_mod(4) != 0, F.col("location")).alias("location"),
                    F.when(seq_mod(4) == 0, F.struct(F.col("location").alias("name"))).alias("city"),
                    F.when(seq_mod(2) == 0, F.concat(F.lit("/p/"), s)).otherwise(nz("job_url")).alias("url"),
                    F.col("date_raw").alias("datePosted"), F.col("description").alias("description"))

    def coll(k):
        return F.transform(F.array_sort(F.collect_list(F.when(seq_mod(3) == k, F.struct(F.col("seq").alias("o"),
                                                                                        item.alias("i"))))),
                           lambda x: x["i"])

    g = b.groupBy("company", "page").agg(coll(0).alias("a0"), coll(1).alias("a1"), coll(2).alias("a2"))
    body = F.to_json(F.struct(
        F.struct(F.struct(F.col("a0").alias("items")).alias("jobs")).alias("data"),
        F.struct(F.struct(F.struct(F.struct(F.col("a1").alias("v")).alias("w")).alias("z")).alias("y")).alias("x"),
        F.array(F.struct(F.col("a2").alias("jobs"))).alias("groups")))
    return g.select(F.concat_ws(":", "company", F.col("page").cast("string")).alias("doc_id"), "company", "page",
                    body.alias("body"))


def _json_search_sql(extra: str = "TRUE", note: str = "Via XHR interception (Playwright).", sfx: str = "") -> str:
    return f"""
, fj{sfx} AS (SELECT b.*, CAST(floor(seq / 64) AS INTEGER) AS page, coalesce(location, '') AS loc,
    CASE WHEN seq % 2 = 0 THEN {Q.origin('careers_url')} || '/p/' || CAST(seq AS VARCHAR) ELSE coalesce(nullif(job_url, ''), '') END AS url
  FROM base b WHERE seq % 3 = 0 AND ({extra})),
fr{sfx} AS (SELECT * FROM fj{sfx} WHERE job_title <> '' AND {Q.is_role('job_title')}
  AND CASE WHEN loc = '' THEN {Q.is_loc('careers_url')} ELSE lower(loc) IN ('remote', 'hybrid') OR {Q.is_loc('loc')} END),
fd{sfx} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company, page, url ORDER BY seq) AS rn
  FROM fr{sfx}) WHERE rn = 1),
js{sfx} AS (SELECT company, page, seq, {_cols_sql(company="company", job_title="job_title",
    location="coalesce(nullif(loc, ''), 'Netherlands')", careers_url="careers_url", job_url="url",
    date_posted=Q.fmt_date("coalesce(date_raw, '')"), description=_html("coalesce(description, '')"),
    notes=Q.lit(note))} FROM fd{sfx})
"""


@query("json_job_search", fixtures=_FX, oracle=_BASE_SQL + _json_search_sql() + f"SELECT {', '.join(COLS)} FROM js")
def json_job_search(spark, sf):
    """Job arrays found anywhere allowed in free-form JSON."""
    from ..operators.jsonsearch import json_job_search as search

    docs = free_json_docs(spark, sf)
    return search(docs.select("doc_id", "company", "body"), dims(spark, sf), C.NOTES["xhr"]).select(*COLS)


# ------------------------------------------------------------------ N11 HTML ladder / P16

@landed_input
def html_pages(spark, sf, nextdata_page_size: int = PAGE, only=None):
    """Pages holding two ld+json scripts and a page-state script, built by one grouping. An
    employer listed n times has n state pages a page, each at its n URLs; pages without a
    number are left out. The URLs are joined on the employer, on which the pages stand already."""
    b = base(spark, sf, only).withColumn("page", PL.page_of(F.col("seq"), PAGE)).filter(F.col("page").isNotNull())
    items = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("o"), _state_item().alias("i")))).alias("items")
    pages = b.groupBy("company", "page").agg(*_ld_lists(), items).select("company", "page", F.concat(
        F.lit("<html><head>"), *_ld_texts(), _state_page(F.transform("items", lambda x: x["i"])),
        F.lit("</head></html>")).alias("body"))
    c = fixture(spark, sf, "fx_company").withColumnRenamed("ind_name", "company") if only is None else only.employers
    urls = c.groupBy("company").agg(F.collect_list(F.struct(F.col("careers_url").alias("url"))).alias("urls"))
    urls = urls.select("company", F.inline(F.flatten(F.array_repeat("urls", F.size("urls")))))
    return pages.join(urls, "company")


def _html_ladder_sql(extra: str = "TRUE") -> str:
    nd = f"""SELECT {_cols_sql(company="company", job_title=_ND_TITLE, location="'Netherlands'", careers_url="careers_url",
    job_url="CASE WHEN job_url = '' THEN 'https://jobs.example.org/none/' || CAST(seq AS VARCHAR) ELSE job_url END",
    notes="'Via __NEXT_DATA__.'")} FROM base WHERE {Q.is_role(_ND_TITLE)} AND ({extra})"""
    return _ld_cte(extra) + f"""
, strict AS ({_LD_STRICT}),
nd AS ({nd}),
ladder AS (SELECT * FROM strict UNION ALL SELECT * FROM nd WHERE company NOT IN (SELECT company FROM strict))
"""


@query("norm_html_ladder", fixtures=_FX, oracle=_BASE_SQL + _html_ladder_sql() + f"SELECT {', '.join(COLS)} FROM ladder")
def norm_html_ladder(spark, sf):
    """N11 + P16: JSON-LD postings per employer, else page-state pairs."""
    return N.html_ladder(html_pages(spark, sf), dims(spark, sf)).select(*COLS)


@query("first_strategy", fixtures=_FX, oracle=_BASE_SQL + _html_ladder_sql() + """
SELECT company, count(*) AS n_rows, CASE WHEN company IN (SELECT company FROM strict) THEN 1 ELSE 2 END AS strategy
FROM ladder GROUP BY company""")
def first_strategy(spark, sf):
    """The winning strategy per employer and its row count."""
    rows = N.html_ladder(html_pages(spark, sf), dims(spark, sf))
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n_rows"), F.min("strategy").alias("strategy"))


# ------------------------------------------------------------------ N12 rendered-page ladder

def spa_captures(spark, sf):
    """Captures per employer page: JSON responses (ord % 4 = 0), page state
    (ord % 4 = 1), rendered ld+json (all but ord % 4 = 3), anchors (all)."""
    c = fixture(spark, sf, "fx_company").select(F.col("ind_name").alias("company"), "ord", F.col("careers_url").alias("url"))
    docs = free_json_docs(spark, sf).join(c, "company")
    xhr = docs.filter(F.col("ord") % 4 == 0).select("company", F.lit(1).alias("strategy"), F.col("page").alias("seq"),
                                                    "body", "url", F.lit("").alias("var"))
    state = docs.filter(F.col("ord") % 4 == 1).select("company", F.lit(2).alias("strategy"), F.col("page").alias("seq"),
                                                      "body", "url", F.lit("__NEXT_DATA__").alias("var"))
    ld = ld_pages(spark, sf).join(c.select("company", "ord"), "company").filter(F.col("ord") % 4 != 3).select(
        "company", F.lit(3).alias("strategy"), F.col("page").alias("seq"), "body", "url", F.lit("").alias("var"))
    dom = anchor_pages(spark, sf, chunk=PAGE, per_company=True).select(
        "company", F.lit(4).alias("strategy"), F.col("page").alias("seq"), "body", "url", F.lit("").alias("var"))
    caps = xhr.unionByName(state).unionByName(ld).unionByName(dom)
    # captures are landed data: written once, read back as a table
    path = scratch_path(spark, "captures")
    caps.write.parquet(path)
    return spark.read.parquet(path)


def _spa_sql() -> str:
    s1 = _json_search_sql("ord % 4 = 0", sfx="1")
    s2 = _json_search_sql("ord % 4 = 1", "Via __NEXT_DATA__ (Playwright).", sfx="2")
    cols = ", ".join(COLS)
    return (s1 + s2 + _ld_cte("ord % 4 <> 3") + _dom_sql(PAGE, True) + f"""
, j1 AS (SELECT {cols} FROM js1 WHERE page = (SELECT min(page) FROM js1 x WHERE x.company = js1.company)),
j2 AS (SELECT {cols} FROM js2 WHERE page = (SELECT min(page) FROM js2 x WHERE x.company = js2.company)),
l3 AS ({_LD_LENIENT}),
d4 AS ({_DOM_SELECT}),
cand AS (SELECT *, 1 AS strategy FROM j1 UNION ALL SELECT *, 2 FROM j2 UNION ALL SELECT *, 3 FROM l3
         UNION ALL SELECT *, 4 FROM d4),
best AS (SELECT company, min(strategy) AS strategy FROM cand GROUP BY company)
SELECT {', '.join('c.' + x for x in COLS)}, c.strategy FROM cand c JOIN best b ON b.company = c.company AND b.strategy = c.strategy""")


@query("norm_spa_ladder", fixtures=_FX, oracle=_BASE_SQL + _spa_sql())
def norm_spa_ladder(spark, sf):
    """Rendered-page captures, first strategy that yields per employer."""
    return N.spa_ladder(spa_captures(spark, sf), dims(spark, sf)).select(*COLS, "strategy")


# ------------------------------------------------------------------ P13 description ladder

def ladder_pages(spark, sf):
    """The pages the ladder may read: slug pages and job pages."""
    return fixture(spark, sf, "fx_slug_page").unionByName(fixture(spark, sf, "fx_job_page").select("url", "html"))


_LADDER_SQL = f"""
, g0 AS (SELECT b.*, CASE WHEN contains(location, ',') THEN location ELSE location || ', Netherlands' END AS loc,
    coalesce(nullif(job_url, ''), 'https://job-boards.greenhouse.io/' || board || '/jobs/' || CAST(seq AS VARCHAR)) AS url0,
    {_html('description')} AS desc0, {SLUG_SQL} AS slug
  FROM base b WHERE seq <> 0 AND {Q.is_loc('location')} AND {Q.is_role('job_title')}),
g1 AS (SELECT g0.*, length(trim(desc0)) < 100 AS short,
    CASE WHEN length(trim(desc0)) < 100 AND jd_base_url <> '' THEN jd_base_url || '/' || slug || '/' END AS slug_url FROM g0),
g2 AS (SELECT g1.*, sp.html AS slug_html, {_html('sp.html', C.PAGE_TEXT_MAX)} AS slug_text FROM g1 LEFT JOIN fx_slug_page sp ON sp.url = g1.slug_url),
g3 AS (SELECT g2.*, slug_html IS NOT NULL AND length(slug_text) > 100 AS slug_ok FROM g2),
g4 AS (SELECT g3.*, CASE WHEN slug_ok THEN slug_text ELSE desc0 END AS desc1, CASE WHEN slug_ok THEN slug_url ELSE url0 END AS url1,
    CASE WHEN slug_ok THEN {Q.first_email('slug_html')} END AS email1 FROM g3),
g5 AS (SELECT g4.*, CASE WHEN ((short AND length(trim(desc1)) < 100) OR NOT short) AND coalesce(url1, '') <> '' THEN url1 END AS page_url FROM g4),
g6 AS (SELECT g5.*, jp.html AS page_html, {_html('jp.html', C.PAGE_TEXT_MAX)} AS page_text FROM g5 LEFT JOIN fx_job_page jp ON jp.url = g5.page_url),
g7 AS (SELECT company, seq, job_title, url1 AS job_url,
  CASE WHEN short AND page_html IS NOT NULL AND NOT (contains(lower(page_html), 'autofill with mygreenhouse')
      AND NOT contains(lower(page_html), 'responsibilities') AND NOT contains(lower(page_html), 'requirements'))
      AND length(page_text) > length(desc1) THEN page_text ELSE desc1 END AS description,
  CASE WHEN short AND page_html IS NOT NULL THEN {Q.first_email('page_html')} WHEN short THEN email1
       WHEN page_html IS NOT NULL THEN {Q.first_email('page_html')} END AS recruiter_email
FROM g6)
"""


@query("description_ladder", fixtures=_FX + ["fx_slug_page", "fx_job_page"], oracle=_BASE_SQL + _LADDER_SQL + """
SELECT company, job_title, job_url, description, recruiter_email FROM g7""")
def description_ladder(spark, sf):
    """P13 + J12: placeholder descriptions replaced from slug pages, else job pages."""
    gh = N.normalize_greenhouse(greenhouse_pages(spark, sf), dims(spark, sf))
    out = N.description_ladder(gh.filter(F.col("has_id")), ladder_pages(spark, sf))
    return out.select("company", "job_title", "job_url", "description", "recruiter_email")


@query("coverage_summary", fixtures=_FX, oracle=_BASE_SQL + _ld_cte() + f"""
, strict AS ({_LD_STRICT})
SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(date_posted, '') <> '') AS dated,
  count(*) FILTER (WHERE coalesce(recruiter_email, '') <> '') AS emailed
FROM strict""")
def coverage_summary(spark, sf):
    """A2: postings with a date and with a recruiter e-mail, over all postings of a run."""
    rows = N.jsonld_postings(ld_pages(spark, sf), dims(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(V.truthy("date_posted").isNotNull()).alias("dated"),
                    F.count_if(V.truthy("recruiter_email").isNotNull()).alias("emailed"))
