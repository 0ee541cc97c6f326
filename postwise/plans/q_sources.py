"""Queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from .. import schemas
from ..functions import values as V
from ..operators import dedup as W
from ..operators import merge as J
from ..operators import privacy as PV
from ..functions import scoring as S
from ..session import scratch_path
from ..sources import payloads as PL
from ..sources import snapshots as SN
from ..sources.fixtures import fixture, fixtures, table
from . import sqlgen as Q
from .q_core import _html_to_text_sql
from ..functions import text as T
from .catalog import query
from .q_core import null_str
from .q_merge import AS_OF_SEEN

_TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def portal_postings(spark, sf):
    """fx_posting in the posting schema (plus arrival ``seq``)."""
    p = fixture(spark, sf, "fx_posting")
    return p.select("seq", "company", "job_title", "location", "job_url", "visa_support", "relocation_support",
                    F.col("date_raw").alias("date_posted"), "description",
                    F.lit(C.NOTES["greenhouse"]).alias("notes"))


def search_postings(spark, sf):
    s = fixture(spark, sf, "fx_search")
    return s.select("seq", "company", F.col("title").alias("job_title"), "location", "job_url",
                    F.col("job_url").alias("careers_url"), "date_posted", "description",
                    F.lit(C.NOTES["search"]).alias("notes"))


@query("load_all_postings", fixtures=["fx_posting", "fx_search"], oracle="""
SELECT seq, job_url, company, job_title FROM fx_posting
UNION ALL SELECT seq, job_url, company, title FROM fx_search""")
def load_all_postings(spark, sf):
    """Both snapshots read back and stacked."""
    a = SN.write_snapshot(portal_postings(spark, sf), scratch_path(spark, "portal"))
    b = SN.write_snapshot(search_postings(spark, sf), scratch_path(spark, "aggregator"))
    return SN.load_all_postings(spark, a, b).select("seq", "job_url", "company", "job_title")


def _corrupt_json_lines(spark, sf):
    """Posting JSON lines; the records without a URL are cut short (malformed)."""
    p = portal_postings(spark, sf)
    js = F.to_json(F.struct(*[F.col(c) for c in p.columns]))
    line = F.when(F.coalesce(F.col("job_url"), F.lit("")) == "", F.substring(js, 1, 25)).otherwise(js)
    path = scratch_path(spark, "json-lines")
    p.select(line.alias("value")).write.text(path)
    return path


@query("snapshot_read_tolerant", fixtures=["fx_posting"], oracle="""
SELECT seq, job_url, company FROM fx_posting WHERE coalesce(job_url, '') <> ''""")
def snapshot_read_tolerant(spark, sf):
    """JSON snapshot read with an explicit schema; malformed records dropped."""
    path = _corrupt_json_lines(spark, sf)
    return SN.read_json_tolerant(spark, path, schemas.POSTING_SEQ).select("seq", "job_url", "company")


@query("reject_malformed", fixtures=["fx_posting"], oracle="""
SELECT count(*) AS rejected FROM fx_posting WHERE coalesce(job_url, '') = ''""")
def reject_malformed(spark, sf):
    """The rejected-records side of the tolerant reader."""
    path = _corrupt_json_lines(spark, sf)
    bad = SN.read_json_tolerant(spark, path, schemas.POSTING_SEQ, rejected=True)
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


@query("json_lines_split", fixtures=["fx_posting"], oracle="""
SELECT coalesce(job_url, '') <> '' AS readable, count(*) AS n, count(CASE WHEN coalesce(job_url, '') <> '' THEN seq END) AS n_seq
FROM fx_posting GROUP BY 1""")
def json_lines_split(spark, sf):
    """S2 + P22: good and rejected records of one parse, written by one job."""
    root = scratch_path(spark, "json-lines")
    SN.land_json_lines(spark, _corrupt_json_lines(spark, sf), schemas.POSTING_SEQ, root)
    return spark.read.parquet(root).groupBy((F.col("readable") == F.lit("true")).alias("readable")).agg(
        F.count(F.lit(1)).alias("n"), F.count("record.seq").alias("n_seq"))


def _seen_map_texts(spark, sf):
    """The seen store as JSON object texts {url: iso time}, in chunks of at most
    1000 entries (chunk = numeric URL id div 1000)."""
    seen = fixture(spark, sf, "fx_seen")
    chunk = F.floor(F.regexp_extract("job_url", r"(\d+)$", 1).cast("long") / 1000)
    entries = F.map_from_entries(F.collect_list(F.struct("job_url", F.date_format("seen_at", _TS_TEXT))))
    return seen.groupBy(chunk.alias("chunk")).agg(F.to_json(entries).alias("body"))


@query("kv_store_explode", fixtures=["fx_seen"], oracle="""
SELECT job_url, strftime(seen_at, '%Y-%m-%dT%H:%M:%S.%f') AS seen_at, strftime(seen_at, '%Y-%m-%d') AS seen_date
FROM fx_seen""")
def kv_store_explode(spark, sf):
    """S3: key→value JSON texts as a two-column table."""
    kv = SN.kv_map_explode(_seen_map_texts(spark, sf), key="job_url", value="seen_at")
    return kv.select("job_url", "seen_at", V.date_prefix("seen_at").alias("seen_date"))


CACHE_JOB = "struct<seq: bigint, job_url: string, job_title: string>"


@query("crawl_cache_flatten", fixtures=["fx_posting", "fx_cache"], oracle="""
SELECT k.ind_name AS name, strftime(k.cached_at, '%Y-%m-%dT%H:%M:%S.%f') AS cached_at, p.seq, p.job_url
FROM fx_posting p JOIN fx_cache k ON k.ind_name = p.company""")
def crawl_cache_flatten(spark, sf):
    """Cache texts {name: {cached_at, jobs}} (written in chunks of at most 64
    postings) flattened to one row per cached posting."""
    p, cache = fixtures(spark, sf, "fx_posting", "fx_cache")
    rows = p.join(cache.withColumnRenamed("ind_name", "company"), "company")
    entry = F.struct(F.first(F.date_format("cached_at", _TS_TEXT)).alias("cached_at"),
                     F.transform(F.array_sort(F.collect_list(F.struct("seq", "job_url", "job_title"))),
                                 lambda x: x).alias("jobs"))
    texts = (rows.groupBy("company", F.floor(F.col("seq") / 64).alias("chunk")).agg(entry.alias("entry"))
             .select(F.to_json(F.create_map(F.col("company"), F.col("entry"))).alias("body")))
    flat = SN.crawl_cache_flatten(texts, job_schema=CACHE_JOB)
    return flat.select("name", "cached_at", "seq", "job_url")


@query("company_dimension", fixtures=["fx_company"], oracle="""
SELECT ord, ind_name, kvk, source_type, careers_url, board, nullif(location_filter, '') AS location_filter
FROM fx_company""")
def company_dimension(spark, sf):
    """Employer dimension with a parameter map."""
    dim = PL.company_dimension(fixture(spark, sf, "fx_company"))
    return dim.select("ord", "ind_name", "kvk", "source_type", "careers_url",
                      F.try_element_at("params", F.lit("board")).alias("board"),
                      F.try_element_at("params", F.lit("location_filter")).alias("location_filter"))


def _status(page):
    return (F.when(page % 7 == 3, F.lit(404)).when(page % 11 == 5, F.lit(500)).otherwise(F.lit(200)))


@query("raw_payload_scan", fixtures=["fx_posting"], oracle="""
SELECT company, page, count(*) AS n_jobs FROM (
  SELECT company, CAST(floor(seq / 64) AS INTEGER) AS page FROM fx_posting)
WHERE NOT (page % 7 = 3 OR page % 11 = 5)
GROUP BY company, page""")
def raw_payload_scan(spark, sf):
    """Only 2xx payloads are read; bodies parsed to count their postings."""
    p = fixture(spark, sf, "fx_posting")
    pages = PL.build_pages(p, F.struct("seq", "job_url"), lambda arr: F.to_json(F.struct(arr.alias("jobs"))),
                           status=_status(F.col("page")))
    ok = PL.raw_payload_scan(pages)
    n = F.size(F.from_json("body", "struct<jobs: array<struct<seq: bigint>>>")["jobs"])
    return ok.select("company", "page", n.cast("bigint").alias("n_jobs"))


@query("search_results_union", fixtures=["fx_search"], oracle="""
SELECT search_term, seq, job_url FROM fx_search""")
def search_results_union(spark, sf):
    """Result sets landed per term, stacked with their term, whatever the terms."""
    root = scratch_path(spark, "result-sets")
    PL.land_result_sets(fixture(spark, sf, "fx_search").select("search_term", "seq", "job_url"), root)
    return PL.search_results_union(spark, root).select("search_term", "seq", "job_url")


_PAGES_SQL = """
, pg AS (SELECT l_orderkey AS term, l_linenumber AS page, CASE WHEN l_quantity > 45 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS n_jobs,
   CASE WHEN l_discount = 0.1 THEN 500 ELSE 200 END AS status, CAST(floor(l_extendedprice) AS BIGINT) % 130 AS total FROM lineitem),
st AS (SELECT term,
   min(CASE WHEN status NOT BETWEEN 200 AND 299 OR n_jobs = 0 THEN page END) AS first_bad,
   min(CASE WHEN NOT (status NOT BETWEEN 200 AND 299 OR n_jobs = 0) AND n_jobs < 10 THEN page END) AS last_short,
   min(CASE WHEN NOT (status NOT BETWEEN 200 AND 299 OR n_jobs = 0) AND page * 20 >= least(total, 100) THEN page END) AS last_off
   FROM pg GROUP BY term)
"""


def _lineitem_pages(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("term"), F.col("l_linenumber").alias("page"),
                     F.when(F.col("l_quantity") > 45, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("n_jobs"),
                     F.when(F.col("l_discount") == 0.1, F.lit(500)).otherwise(F.lit(200)).alias("status"),
                     (F.floor("l_extendedprice").cast("bigint") % 130).alias("total"))


@query("paged_payload_prefix", oracle=_PAGES_SQL.replace(", pg AS", "WITH pg AS", 1) + """
SELECT 'short_page' AS rule, pg.term, pg.page, pg.n_jobs FROM pg JOIN st ON st.term = pg.term
WHERE (st.first_bad IS NULL OR pg.page < st.first_bad) AND (st.last_short IS NULL OR pg.page <= st.last_short)
UNION ALL
SELECT 'offset', pg.term, pg.page, pg.n_jobs FROM pg JOIN st ON st.term = pg.term
WHERE (st.first_bad IS NULL OR pg.page < st.first_bad) AND (st.last_off IS NULL OR pg.page <= st.last_off)""")
def paged_payload_prefix(spark, sf):
    """Pages a paging loop reads, per term (short-page and offset stop rules)."""
    pages = _lineitem_pages(spark, sf)
    a = PL.paged_prefix(pages, rule="short_page").select(F.lit("short_page").alias("rule"), "term", "page", "n_jobs")
    b = PL.paged_prefix(pages, rule="offset", cap=100).select(F.lit("offset").alias("rule"), "term", "page", "n_jobs")
    return a.unionByName(b)


@query("paged_payload_all", oracle=_PAGES_SQL.replace(", pg AS", "WITH pg AS", 1).replace("least(total, 100)", "total") + """
SELECT pg.term, pg.page, pg.n_jobs FROM pg JOIN st ON st.term = pg.term
WHERE (st.first_bad IS NULL OR pg.page < st.first_bad) AND (st.last_off IS NULL OR pg.page <= st.last_off)""")
def paged_payload_all(spark, sf):
    """S9 by offset without the fetch loop's cap: every landed page up to the total."""
    return PL.paged_prefix(_lineitem_pages(spark, sf), rule="offset").select("term", "page", "n_jobs")


@query("snapshot_write_roundtrip", fixtures=["fx_posting"], oracle=f"""
SELECT seq, job_url, company, job_title, {Q.fmt_date('date_raw')} AS date_posted FROM fx_posting""")
def snapshot_write_roundtrip(spark, sf):
    """K1: two snapshot versions written to new folders; the latest is read back."""
    snap = portal_postings(spark, sf).withColumn("date_posted", V.fmt_date("date_posted"))
    root = SN.new_version_path(spark, "snapshot")
    SN.write_version(snap.filter(F.col("job_url") == ""), root, 1)   # an older, smaller version
    SN.write_version(snap, root, 2)
    return SN.read_latest(spark, root).select("seq", "job_url", "company", "job_title", "date_posted")


@query("page_files_scan", oracle=f"""
SELECT page_id, {_html_to_text_sql('html', C.PAGE_TEXT_MAX)} AS text FROM pages""")
def page_files_scan(spark, sf):
    """S7 + F1: pages landed in packed files (many pages a file), read and cleaned."""
    pages = table(spark, sf, "pages")
    root = SN.write_page_files(pages, scratch_path(spark, "page-files"), ("page_id", "url", "html"))
    files = SN.read_page_files(spark, root, "page_id bigint, url string, html string")
    return files.select("page_id", T.html_to_text(F.col("html"), C.PAGE_TEXT_MAX).alias("text"))


@query("kv_upsert", fixtures=["fx_posting", "fx_score"], oracle=f"""
, nw AS (SELECT job_url, {Q.rule_score(notes='NULL')} AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq) AS rn FROM fx_posting WHERE coalesce(job_url, '') <> '')
  WHERE rn = 1)
SELECT job_url, score FROM fx_score WHERE job_url NOT IN (SELECT job_url FROM nw)
UNION ALL SELECT job_url, score FROM nw""")
def kv_upsert(spark, sf):
    """K2: score store upserted with freshly computed scores, written as a new version."""
    p, old = fixtures(spark, sf, "fx_posting", "fx_score")
    # scored on the way in, so the rows that are sorted by key hold the score, not the texts
    scored = p.select("seq", "job_url", S.rule_score(notes=null_str()).alias("score"))
    new = W.dedup_first_by_url(scored).select("job_url", "score")
    store = SN.kv_upsert(old.select("job_url", "score"), new)
    path = SN.write_snapshot(store, SN.new_version_path(spark, "score-store"))
    return SN.read_table(spark, path, schemas.SCORE)


@query("dashboard_export", fixtures=["fx_posting", "fx_search", "fx_seen", "fx_score"], oracle=f"""
, sd AS (SELECT job_url, strftime(max(seen_at), '%Y-%m-%d') AS d FROM fx_seen WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
sc AS (SELECT job_url, CAST(max(score) AS INTEGER) AS score FROM fx_score WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
feeds AS (SELECT seq, 'portal' AS feed, job_url, date_raw AS date_posted FROM fx_posting
  UNION ALL SELECT seq, 'search', job_url, date_posted FROM fx_search)
SELECT f.seq, f.feed, f.job_url,
  coalesce(sd.d, nullif(substr(coalesce(f.date_posted, ''), 1, 10), ''), '{AS_OF_SEEN[:10]}') AS first_seen,
  sc.score AS ai_score
FROM feeds f LEFT JOIN sd ON sd.job_url = f.job_url LEFT JOIN sc ON sc.job_url = f.job_url""")
def dashboard_export(spark, sf):
    """K3: both feeds, first_seen backfilled, scores attached, PII removed,
    written as a dataset partitioned by feed and read back."""
    seen, sc = fixtures(spark, sf, "fx_seen", "fx_score")
    portal = portal_postings(spark, sf).withColumn("feed", F.lit("portal")).withColumn(
        "recruiter_email", F.lit("x@corp.nl"))
    search = search_postings(spark, sf).withColumn("feed", F.lit("search"))
    both = J.union_feeds(portal, search)
    export = PV.strip_pii(J.attach_scores(J.backfill_first_seen(both, seen, AS_OF_SEEN), sc))
    path = SN.write_snapshot(export, SN.new_version_path(spark, "export"), partition_by=["feed"])
    back = spark.read.parquet(path)
    assert "recruiter_email" not in back.columns
    return back.select("seq", "feed", "job_url", "first_seen", "ai_score")


@query("request_plan", fixtures=["fx_company"], oracle="""
SELECT ord, source_type, CASE source_type
  WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || board || '/jobs?content=true'
  WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || board || '?mode=json'
     || CASE WHEN coalesce(location_filter, '') <> '' THEN '&location=' || replace(url_encode(location_filter), '%2F', '/') ELSE '' END
  WHEN 'workday' THEN 'https://' || board || '.wd5.myworkdayjobs.com/wday/cxs/' || board || '/' || board || '/jobs'
  ELSE careers_url END AS request_url
FROM fx_company""")
def request_plan(spark, sf):
    """the request URL of every employer (a fetch plan)."""
    dim = PL.company_dimension(fixture(spark, sf, "fx_company"))
    return PL.request_plan(dim).select("ord", "source_type", "request_url")


_FORMATS = ("greenhouse", "icims", "lever", "smartrecruiters", "ashby", "recruitee", "workday", "kpmg_lunr", "bitvavo",
            "picnic", "homerun", "spa", "html")


@query("request_plan_formats", fixtures=["fx_company"], oracle=f"""
, c AS (SELECT *, list_extract({list(_FORMATS)}, CAST(ord % {len(_FORMATS)} + 1 AS INTEGER)) AS kind FROM fx_company),
t AS (SELECT *, unnest(CASE WHEN kind = 'icims' THEN ['Engineering', 'Machine+Learning'] ELSE [''] END) AS term FROM c)
SELECT ord, kind AS source_type, CASE kind
  WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || board || '/jobs?content=true'
  WHEN 'icims' THEN jd_base_url || '?location=Netherlands&woe=12&regionCode=NL&stretchUnit=MILES&stretch=25&categories='
     || term || '&page=2'
  WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || board || '?mode=json'
     || CASE WHEN coalesce(location_filter, '') <> '' THEN '&location=' || replace(url_encode(location_filter), '%2F', '/') ELSE '' END
  WHEN 'smartrecruiters' THEN 'https://api.smartrecruiters.com/v1/companies/' || board || '/postings?limit=100&country=NLD'
  WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || board
  WHEN 'recruitee' THEN 'https://' || board || '.recruitee.com/api/offers/'
  WHEN 'workday' THEN 'https://' || board || '.wd5.myworkdayjobs.com/wday/cxs/' || board || '/' || board || '/jobs'
  WHEN 'kpmg_lunr' THEN 'https://www.werkenbijkpmg.nl/en/_lunr/vacancies_en'
  WHEN 'bitvavo' THEN 'https://jobs.bitvavo.com/find-your-role'
  ELSE careers_url END AS request_url
FROM t
UNION ALL SELECT ord, 'detail', 'https://boards-api.greenhouse.io/v1/boards/' || board || '/jobs/' || nullif(kvk, '')
FROM fx_company WHERE kvk <> ''""")
def request_plan_formats(spark, sf):
    """second-page requests of every format, and the detail requests of listed jobs."""
    rows = fixture(spark, sf, "fx_company")
    kind = F.element_at(F.array(*[F.lit(t) for t in _FORMATS]), (F.col("ord") % len(_FORMATS) + 1).cast("int"))
    named = rows.withColumn("source_type", kind).withColumn("api_url", F.col("jd_base_url"))
    dim = PL.company_dimension(named, ("board", "location_filter", "api_url"))
    details = PL.detail_requests(rows.select("ord", F.lit("detail").alias("source_type"), "board", F.col("kvk").alias("job_id")))
    cols = ["ord", "source_type", "request_url"]
    return PL.request_plan(dim, page=2).select(*cols).unionAll(details.select(*cols))
