"""Queries: G1 over all formats, and end-to-end ingest runs.

The landed payloads of these queries are of all 13 formats, a null and an unknown
type: employer by employer the format is dealt by ``ord``. icims pages come from two
categories and workday pages from two search terms; half of the page employers have
pages in which only the second chance finds postings; one payload of every employer
is broken. They land in a payload store, and every run reads the store.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import normalize as N
from ..operators.merge import as_of_ts
from ..session import scratch_path
from ..sources.fixtures import fixture, fixtures
from ..sources.payload_store import PayloadStore
from ..sources.result_cache import ResultCache
from . import flows as FL
from . import q_normalize as QN
from . import sqlgen as Q
from .catalog import REGISTRY, query
from .q_merge import AS_OF_MERGE, CUTOFF_MERGE
from .q_normalize import _BASE_SQL, _FX, COLS, PAGE, landed_input

TYPES = ("greenhouse", "icims", "lever", "smartrecruiters", "ashby", "recruitee", "picnic", "homerun", "kpmg_lunr",
         "workday", "bitvavo", "spa", "html", "unheard_of", None)
_PAGES = ("html", "unheard_of", None)


def _kind():
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("ord") % len(TYPES) + 1).cast("int"))


def employers(spark, sf):
    return fixture(spark, sf, "fx_company").select(F.col("ind_name").alias("company"), "ord", F.col("careers_url").alias("url"),
                                                   _kind().alias("source_type"))


def _part(kind):
    """The part of the mixed payloads an employer's pages belong to; none without an ord."""
    page = F.when(kind.isNull() | kind.isin("html", "unheard_of"), F.lit("html")).otherwise(kind)
    odd = page.isin("spa", "html") & (F.col("ord") % 2 != 0)
    return F.when(F.col("ord").isNotNull(), F.when(odd, F.concat(page, F.lit(" anchors"))).otherwise(page))


@landed_input
def mixed_payloads(spark, sf):
    """(company, source_type, category, term_rank, page, url, body) of all formats, part by part."""
    c = employers(spark, sf)
    kinds = c.select("company", "ord", F.col("url").alias("page_url"), "source_type")
    none = F.lit(None).cast("string")
    # an employer's pages are built in the one part its type belongs to
    dealt = QN.Dealt(spark, sf, "mixed", _part(_kind()))

    def part(name, pages, page=F.col("page"), category=none, term=F.lit(None).cast("int"), **kw):
        built = pages(spark, sf, only=dealt.of(name), **kw)
        rows = built.select("company", "page", "body").join(kinds.filter(_part(F.col("source_type")) == name), "company")
        return rows.select("company", "source_type", category.alias("category"), term.alias("term_rank"),
                           page.cast("int").alias("page"), F.col("page_url").alias("url"), "body")

    half = F.floor(F.col("page") / 2)
    yield part("greenhouse", QN.greenhouse_pages)
    yield part("icims", QN.icims_pages, half,
               F.element_at(F.array(F.lit("Engineering"), F.lit("Machine Learning")), (F.col("page") % 2 + 1).cast("int")))
    yield part("lever", QN.lever_pages)
    yield part("smartrecruiters", QN.smartrecruiters_pages)
    yield part("ashby", QN.ashby_pages)
    yield part("recruitee", QN.recruitee_pages)
    yield part("picnic", QN.slug_listing)
    yield part("homerun", QN.attr_pages)
    yield part("kpmg_lunr", QN.index_pages)
    yield part("workday", QN.workday_pages, half, term=(F.col("page") % 2).cast("int"))
    yield part("bitvavo", QN.embedded_pages)
    yield part("spa", QN.free_json_docs)
    yield part("spa anchors", QN.anchor_pages, chunk=PAGE, per_company=True)
    yield part("html", QN.html_pages)
    yield part("html anchors", QN.anchor_pages, chunk=PAGE, per_company=True)
    body = F.when(F.col("source_type").isin(*N.JSON_TYPES), F.lit('{"jobs": [')).when(F.col("source_type").isNull(), F.lit("  "))
    yield c.select("company", "source_type", none.alias("category"), F.lit(None).cast("int").alias("term_rank"),
                   F.lit(1_000_000).alias("page"), "url", body.alias("body"))


_LANDED: dict = {}


def landed_store(spark, sf) -> PayloadStore:
    """The mixed payloads, landed as load 1 of a payload store (once per session)."""
    payloads = mixed_payloads(spark, sf)
    key = (id(spark), payloads.inputFiles()[0])
    if key not in _LANDED:
        store = PayloadStore(scratch_path(spark, "payload-store"))
        _LANDED[key] = store, store.land(payloads, 1)
    return _LANDED[key][0]


# ------------------------------------------------------------------ SQL over the same employers

_KIND = "list_extract([" + ", ".join("NULL" if t is None else Q.lit(t) for t in TYPES) + f"], CAST(c.ord % {len(TYPES)} + 1 AS INTEGER))"
_ALL_SQL = f"""
, allbase AS (SELECT p.*, c.careers_url, c.board, c.ord, c.source_type, c.jd_base_url, {_KIND} AS kind
  FROM fx_posting p JOIN fx_company c ON c.ind_name = p.company)
"""


def _tail(name: str) -> str:
    """The SQL of a registered query after its ``base`` table."""
    return REGISTRY[name].oracle.split(_BASE_SQL.strip(), 1)[1]


def _of(condition: str, tail: str, kind: str, columns=COLS) -> str:
    return (f"SELECT {', '.join(columns)}, {Q.lit(kind)} AS kind FROM (WITH base AS (SELECT * FROM allbase "
            f"WHERE {condition}) {tail})")


_GH_FULL = (QN._GH_SQL[len(_BASE_SQL):] + QN._LADDER_SQL + f"""
SELECT {', '.join('gh.' + x if x not in ('job_url', 'description', 'recruiter_email') else
                  'CASE WHEN g7.seq IS NULL THEN gh.' + x + ' ELSE g7.' + x + ' END AS ' + x for x in COLS)}
FROM gh LEFT JOIN g7 ON g7.seq = gh.seq""")
_JSON_FIRST = QN._json_search_sql() + f"""SELECT {', '.join(COLS)} FROM js
WHERE page = (SELECT min(page) FROM js x WHERE x.company = js.company)"""
_ANCHORS = QN._dom_sql(PAGE, True) + QN._DOM_SELECT
_LADDER = QN._html_ladder_sql() + f"SELECT {', '.join(COLS)} FROM ladder"
_WHOLE = "(kind IS NULL OR kind IN ('html', 'unheard_of'))"


def formats_sql(ladder: bool) -> str:
    """Postings of all formats: SELECTs of (posting columns, kind)."""
    parts = [_of("kind = 'greenhouse'", _GH_FULL if ladder else _tail("norm_greenhouse"), "greenhouse")]
    in_terms = {"norm_icims": ("ORDER BY seq", f"ORDER BY floor(seq / {PAGE}) % 2, seq"),
                "norm_workday": ("ORDER BY seq", "ORDER BY floor(seq / 20) % 2, seq")}
    for kind, name in (("icims", "norm_icims"), ("lever", "norm_lever"), ("smartrecruiters", "norm_smartrecruiters"),
                       ("ashby", "norm_ashby"), ("recruitee", "norm_recruitee"), ("picnic", "norm_slug_page"),
                       ("homerun", "norm_attr_json"), ("kpmg_lunr", "norm_search_index"), ("workday", "norm_workday"),
                       ("bitvavo", "norm_embedded_array")):
        parts.append(_of(f"kind = '{kind}'", _tail(name).replace(*in_terms.get(name, ("", ""))), kind))
    parts += [_of("kind = 'spa' AND ord % 2 = 0", _JSON_FIRST, "spa"), _of("kind = 'spa' AND ord % 2 = 1", _ANCHORS, "spa"),
              _of(f"{_WHOLE} AND ord % 2 = 0", _LADDER, "html"), _of(f"{_WHOLE} AND ord % 2 = 1", _ANCHORS, "html")]
    return "\nUNION ALL ".join(parts)


# ------------------------------------------------------------------ G1

@query("normalize_all", fixtures=_FX, oracle=_ALL_SQL + f"""
SELECT {', '.join(COLS)}, kind AS source_type FROM ({formats_sql(False)})""")
def normalize_all(spark, sf):
    """G1: payloads of all formats, a null and an unknown type, from a payload store."""
    payloads = landed_store(spark, sf).read(spark, 1)
    return N.normalize_all(payloads, QN.dims(spark, sf), details=QN.slug_details(spark, sf), written=True).select(
        *COLS, "source_type")


# ------------------------------------------------------------------ ingest runs

_LADDER_FX = ["fx_posting", "fx_company", "fx_prev", "fx_seen", "fx_slug_page", "fx_job_page"]


def _merge_sql(new: str) -> str:
    """J5 of ``nu`` (the SELECT ``new``): ``stamped`` and ``carried``."""
    return f"""
, nu AS ({new}),
sd AS (SELECT job_url, strftime(max(seen_at), '%Y-%m-%d') AS d FROM fx_seen WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
prev1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq DESC) AS rn
    FROM fx_prev WHERE coalesce(job_url, '') <> '') WHERE rn = 1),
stamped AS (SELECT nu.*, coalesce(nullif(p.first_seen, ''), sd.d, '{AS_OF_MERGE}') AS first_seen, '{AS_OF_MERGE}' AS last_seen
  FROM nu LEFT JOIN prev1 p ON p.job_url = nu.job_url LEFT JOIN sd ON sd.job_url = nu.job_url),
carried AS (SELECT p.* FROM prev1 p LEFT JOIN sd ON sd.job_url = p.job_url
  WHERE p.job_url NOT IN (SELECT coalesce(nullif(job_url, ''), '') FROM nu)
    AND coalesce(nullif(p.last_seen, ''), nullif(p.first_seen, ''), sd.d, '') >= '{CUTOFF_MERGE}')
"""


@query("portal_ingest_counts", fixtures=["fx_posting", "fx_company", "fx_prev", "fx_seen"],
       oracle=_ALL_SQL + _merge_sql(f"SELECT company, job_url FROM ({formats_sql(False)})") + """
SELECT company, count(*) AS n_jobs, count(*) FILTER (WHERE stale) AS n_stale
FROM (SELECT company, FALSE AS stale FROM stamped UNION ALL SELECT company, TRUE FROM carried) GROUP BY company""")
def portal_ingest_counts(spark, sf):
    """End to end (G1 → J5 → A1/A3): the payloads of all formats normalised, merged
    with the previous snapshot, counted per employer."""
    prev, seen = fixtures(spark, sf, "fx_prev", "fx_seen")
    run = FL.ingest_load(landed_store(spark, sf), 1, QN.dims(spark, sf), prev, seen, AS_OF_MERGE,
                         details=QN.slug_details(spark, sf))
    return run.snapshot.groupBy("company").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.coalesce("stale", F.lit(False))).alias("n_stale"))


@query("portal_ingest_rejects", fixtures=["fx_posting", "fx_company", "fx_prev", "fx_seen"], oracle=f"""
SELECT ind_name AS company, {_KIND} AS source_type, 1000000 AS page,
  CASE WHEN {_KIND} IN ({', '.join(Q.lit(t) for t in N.JSON_TYPES)}) THEN 'malformed' ELSE 'empty' END AS reason
FROM fx_company c""")
def portal_ingest_rejects(spark, sf):
    """P22 of an ingest run over all formats: the broken payload of every employer
    (cut short, null or blank) with its reason, from the load's reject folder."""
    prev, seen = fixtures(spark, sf, "fx_prev", "fx_seen")
    run = FL.ingest_load(landed_store(spark, sf), 1, QN.dims(spark, sf), prev, seen, AS_OF_MERGE)
    return run.rejected.select("company", "source_type", F.col("page").cast("int").alias("page"), "reason")


# ------------------------------------------------------------------ ingest with cache and description ladder

#: What the result cache keeps of a posting.
CACHED = T.StructType([T.StructField(c, T.BooleanType() if c in ("visa_support", "relocation_support") else T.StringType())
                       for c in COLS])


def cached_results(spark, sf, root: str) -> ResultCache:
    """A cache whose version 1 holds, of every even employer, the postings of the run
    before under cached URLs: written 3 hours ago where 4 divides ord, else 30 hours ago."""
    p = QN.base(spark, sf).filter(F.col("ord") % 2 == 0)
    old = p.select("ord", "company", "job_title", "location", "careers_url",
                   F.concat(F.lit("https://cached.example.org/"), F.col("seq").cast("string")).alias("job_url"))
    rows = old.select("ord", *[F.col(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name)
                               for f in CACHED.fields])
    cache = ResultCache(root, CACHED, buckets=16)
    as_of = as_of_ts(AS_OF_MERGE)
    cache.write_back(rows.filter(F.col("ord") % 4 != 0).drop("ord"), 0, None, as_of - F.expr("INTERVAL 30 HOURS"))
    cache.write_back(rows.filter(F.col("ord") % 4 == 0).drop("ord"), 1, 0, as_of - F.expr("INTERVAL 3 HOURS"))
    return cache


def _full_run(spark, sf):
    """A run of the payload store with cache, forced employers and the pages of the ladder."""
    prev, seen = fixtures(spark, sf, "fx_prev", "fx_seen")
    cache = cached_results(spark, sf, scratch_path(spark, "result-cache"))
    forced = fixture(spark, sf, "fx_company").filter(F.col("ord") % 8 == 0).select("ind_name")
    run = FL.ingest_load(landed_store(spark, sf), 1, QN.dims(spark, sf), prev, seen, AS_OF_MERGE,
                         details=QN.slug_details(spark, sf), pages=QN.ladder_pages(spark, sf),
                         cached=FL.CacheRun(cache, 1, 2, forced))
    return run, cache


# answered: a fresh entry of an employer that has postings and is not forced
_CACHE_SQL = _ALL_SQL + f"""
, entries AS (SELECT company, ord, 'https://cached.example.org/' || CAST(seq AS VARCHAR) AS url, job_title, location, careers_url
  FROM allbase WHERE ord % 2 = 0),
answered AS (SELECT DISTINCT company FROM entries WHERE ord % 4 = 0 AND ord % 8 <> 0),
fetched AS (SELECT * FROM ({formats_sql(True)}) WHERE company NOT IN (SELECT company FROM answered))
"""
_FULL_COLS = ["company", "job_title", "location", "job_url", "date_posted", "recruiter_email", "description", "notes"]


@query("portal_ingest_full", fixtures=_LADDER_FX, oracle=_CACHE_SQL + _merge_sql(f"""
SELECT {', '.join(_FULL_COLS)} FROM fetched
UNION ALL SELECT company, job_title, location, url, NULL, NULL, NULL, NULL FROM entries WHERE company IN (SELECT company FROM answered)""") + f"""
SELECT {', '.join(_FULL_COLS)}, first_seen, last_seen, CAST(NULL AS BOOLEAN) AS stale FROM stamped
UNION ALL SELECT company, job_title, NULL, job_url, NULL, NULL, NULL, NULL, first_seen, last_seen, TRUE FROM carried""")
def portal_ingest_full(spark, sf):
    """An ingest run with everything: all formats from the payload store, fresh employers
    answered from the result cache (stale and forced ones fetched), descriptions
    completed by the ladder, merged with the previous snapshot."""
    run, _ = _full_run(spark, sf)
    return run.snapshot.select(*_FULL_COLS, "first_seen", "last_seen", "stale")


@query("portal_ingest_cache", fixtures=_LADDER_FX, oracle=_CACHE_SQL + f"""
, after AS (SELECT company, '{AS_OF_MERGE} 00:00:00' AS cached_at FROM fetched
  UNION ALL SELECT company, CASE WHEN company IN (SELECT company FROM answered) THEN '{AS_OF_MERGE} 00:00:00'
      WHEN ord % 4 = 0 THEN '1998-01-19 21:00:00' ELSE '1998-01-18 18:00:00' END
    FROM entries WHERE company NOT IN (SELECT company FROM fetched))
SELECT company, cached_at, count(*) AS n FROM after GROUP BY company, cached_at""")
def portal_ingest_cache(spark, sf):
    """The result cache after that run: employer, time of the entry, postings held."""
    _, cache = _full_run(spark, sf)
    rows = cache.read(spark, 2).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    at = F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at")
    return cache.stamps(spark, 2).join(rows, "company").select("company", at, "n")
