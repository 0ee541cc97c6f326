"""Derived fixtures: posting-shaped tables computed from the driver's tables.

Each fixture is SQL text that runs unchanged on Spark SQL and DuckDB; the text
names its inputs as ``{table}`` placeholders. On Spark the placeholders become
DataFrames (``spark.sql(text, orders=df, ...)``); for the DuckDB oracle they
become CTE / view names. Every fixture reads whole tables, so its size grows
with the scale factor.
"""

from __future__ import annotations

import os
import re
from html.entities import html5 as _html5

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {}

# D1 postings: shared URLs (first arrival wins), empty URLs, offset/relative/null
# dates, null text, tri-state visa flag. Arrival order = seq.
FIXTURES["fx_posting"] = """
SELECT o.o_orderkey AS seq,
  CASE WHEN o.o_orderkey % 50 = 7 THEN '' ELSE concat('https://jobs.example.org/p/', CAST(o.o_orderkey - (CASE WHEN o.o_orderkey % 11 = 3 THEN 1 ELSE 0 END) AS STRING)) END AS job_url,
  c.c_name AS company,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'Senior Python Engineer' WHEN 1 THEN 'Java Developer' WHEN 2 THEN 'Account Manager'
    WHEN 3 THEN 'Lead iOS Developer' WHEN 4 THEN 'Staff Software Engineer' WHEN 5 THEN 'Data Analyst' WHEN 6 THEN 'Platform Engineer' ELSE '' END AS job_title,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Amsterdam' WHEN 1 THEN 'Berlin, Germany' WHEN 2 THEN 'Utrecht, NL' WHEN 3 THEN 'Remote' WHEN 4 THEN '' ELSE 'Den Haag' END AS location,
  CASE o.o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 'T23:30:00-0400') WHEN 2 THEN 'Posted 3 Days Ago' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS date_raw,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Java, Kafka and Kubernetes on AWS. Visa sponsor.' WHEN 1 THEN 'Dutch speaking required' WHEN 2 THEN NULL ELSE 'REST api, relocation package' END AS description,
  CASE o.o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS visa_support,
  CASE o.o_orderkey % 7 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END AS relocation_support,
  c.c_custkey AS company_ord
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# D7 seen store: postings with a view or click event count as seen at the event time.
FIXTURES["fx_seen"] = """
SELECT concat('https://jobs.example.org/p/', CAST(event_id AS STRING)) AS job_url, ts AS seen_at
FROM {events} WHERE event_type IN ('view', 'click')
"""

# D8 score cache.
FIXTURES["fx_score"] = """
SELECT concat('https://jobs.example.org/p/', CAST(p_partkey AS STRING)) AS job_url, CAST(p_size * 2 AS INT) AS score FROM {part}
"""

# D2 previous snapshot: every order gives a row, and a shifted copy arriving later
# gives most keys a second row (the later one wins). Null and '' stamps included.
FIXTURES["fx_prev"] = """
SELECT concat('https://jobs.example.org/p/', CAST(o_orderkey * 2 AS STRING)) AS job_url, o_orderkey AS seq,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS first_seen,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('1998-01-', lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0')) END AS last_seen,
  concat('Prev ', CAST(o_orderkey AS STRING)) AS job_title, 'Prev Co' AS company
FROM {orders}
UNION ALL
SELECT concat('https://jobs.example.org/p/', CAST((o_orderkey + 1) * 2 AS STRING)) AS job_url, o_orderkey + 1000000000 AS seq,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '1997-12-31' END AS first_seen,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('1998-01-', lpad(CAST((o_orderkey + 5) % 28 + 1 AS STRING), 2, '0')) END AS last_seen,
  concat('Shifted ', CAST(o_orderkey AS STRING)) AS job_title, 'Prev Co' AS company
FROM {orders} WHERE o_orderstatus = 'F'
"""

# D4 employer dimension: empty and repeated kvk, URLs with and without a location hit.
FIXTURES["fx_company"] = """
SELECT c_name AS ind_name, c_custkey AS ord,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lpad(CAST(c_custkey % 40 AS STRING), 8, '0') END AS kvk,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'html' WHEN 'HOUSEHOLD' THEN 'workday'
    WHEN 'AUTOMOBILE' THEN 'lever' ELSE 'other' END AS source_type,
  concat('https://careers.example.org/', CAST(c_custkey AS STRING), CASE WHEN c_nationkey % 2 = 0 THEN '?location=Amsterdam' ELSE '' END) AS careers_url,
  concat('b', CAST(c_custkey AS STRING)) AS board,
  CASE c_nationkey % 3 WHEN 0 THEN 'Amsterdam, North Holland' WHEN 1 THEN 'Den Haag/NL*~' ELSE '' END AS location_filter,
  CASE WHEN c_custkey % 3 = 0 THEN concat('https://jd.example.org/c', CAST(c_custkey AS STRING)) ELSE '' END AS jd_base_url
FROM {customer}
"""

# D9 sponsor register: repeated kvk (the first row wins).
FIXTURES["fx_sponsor"] = """
SELECT s_suppkey AS ord, s_name AS sponsor_name, lpad(CAST(s_suppkey % 60 AS STRING), 8, '0') AS kvk,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('https://careers.example.org/', CAST(s_suppkey AS STRING)) ELSE NULL END AS careers_url
FROM {supplier}
"""

# D11 text for e-mail extraction: mailto in mixed case, role accounts, a short local
# part, a test. domain, one good plain address, then the document text.
FIXTURES["fx_email_text"] = """
SELECT doc_id, concat('<a href="mailto:Jane', CAST(doc_id AS STRING), '@Corp.nl?subject=x">m</a> info@corp.nl hr-team@corp.nl ab@corp.nl x@test.corp.nl Bob.', CAST(doc_id AS STRING), '@corp.nl ', text) AS html
FROM {documents}
"""

# Model replies: fenced JSON, plain JSON, out-of-range score, broken text.
FIXTURES["fx_reply"] = """
SELECT p.job_url, p.seq,
  CASE p.seq % 4
    WHEN 0 THEN concat('```json', chr(10), chr(123), '"score": ', CAST(p.seq % 90 AS STRING), ', "reason": "fit"', chr(125), chr(10), '```')
    WHEN 1 THEN concat(chr(123), '"score": ', CAST(p.seq % 70 AS STRING), ', "reason": "ok"', chr(125))
    WHEN 2 THEN concat(chr(123), '"score": ', CAST(100 + p.seq % 50 AS STRING), chr(125))
    ELSE concat('Sorry, no score for ', p.job_title) END AS reply
FROM {fx_posting} p
"""

# Aggregator search rows: posting rows with a search term.
FIXTURES["fx_search"] = """
SELECT concat('term', CAST(p.seq % 5 AS STRING)) AS search_term, p.seq, p.job_url, p.job_title AS title,
  p.company, p.location, p.date_raw AS date_posted, p.description
FROM {fx_posting} p
"""

# Crawl cache entries: employers with a cache time from the events stream
# (events outnumber employers about 6.7 to 1 at every scale factor).
FIXTURES["fx_cache"] = """
SELECT c.ind_name, e.ts AS cached_at
FROM {fx_company} c JOIN {events} e ON e.event_id = c.ord * 6
"""

# URL shapes: '/jobs/<n>' ids, absolute and site-relative links, employer base URL.
FIXTURES["fx_urls"] = """
SELECT p.seq,
  CASE WHEN p.seq % 3 = 0 THEN replace(p.job_url, '/p/', '/jobs/') ELSE NULL END AS apply_url,
  CASE WHEN p.seq % 3 = 1 THEN p.job_url ELSE '' END AS absolute_url,
  CASE WHEN p.seq % 4 = 0 THEN NULL ELSE p.job_url END AS url,
  CASE WHEN p.seq % 2 = 0 THEN replace(p.job_url, 'https://jobs.example.org', '') ELSE p.job_url END AS link,
  c.careers_url
FROM {fx_posting} p JOIN {fx_company} c ON c.ind_name = p.company
"""

# Pages with and without the application-form marker and content words.
FIXTURES["fx_apply_page"] = """
SELECT page_id, url, concat(CASE WHEN page_id % 3 = 0 THEN 'Autofill with MyGreenhouse ' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN '<h2>Responsibilities</h2>' ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN 'Requirements: ' ELSE '' END, html) AS html
FROM {pages}
"""

# Date texts: extended, offset, Z, basic, basic with time, invalid basic, epoch ms, relative.
FIXTURES["fx_dates"] = """
SELECT o_orderkey AS seq, CASE o_orderkey % 9
  WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T23:30:00-04:00')
  WHEN 2 THEN concat(' ', CAST(CAST(o_orderdate AS DATE) AS STRING), 'T01:02:03Z ')
  WHEN 3 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')
  WHEN 4 THEN concat(replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''), 'T101010')
  WHEN 5 THEN concat(substr(replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''), 1, 4), '1399')
  WHEN 6 THEN concat('1', lpad(CAST(o_orderkey AS STRING), 12, '0'))
  WHEN 7 THEN 'Posted 30+ Days Ago'
  ELSE NULL END AS date_raw
FROM {orders}
"""


def _sql_text(s: str) -> str:
    """A SQL expression of the text ``s`` that Spark and DuckDB read alike."""
    return "concat(" + ", ".join(f"chr({ord(c)})" if c in "'\\" or ord(c) < 32 else f"'{c}'" for c in s) + ")"


# Character references: the names of HTML5 (from the standard library), with their characters.
_NAMES = sorted(_html5.items())
FIXTURES["fx_entity"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', {_sql_text(chars)})" for i, (name, chars) in enumerate(_NAMES)) + ") AS t(n, name, chars)"

# Texts that hold each name whole, cut short and before other characters, and numbers
# from control codes to beyond the last character, with and without ';'.
FIXTURES["fx_entity_text"] = f"""
SELECT o.o_orderkey AS seq, concat('a & b &', e.name, 'x &', f.name, ' &', replace(e.name, ';', ''), 'Z; &', substr(f.name, 1, 3),
  ' &#', CAST(o.o_orderkey * 37 % 1200000 AS STRING), ' &#', CAST(o.o_orderkey % 300 AS STRING), ';c &#x',
  CASE o.o_orderkey % 4 WHEN 0 THEN '41' WHEN 1 THEN 'd800' WHEN 2 THEN 'FDD0;' ELSE '1F600;' END, 'g &; &#; &#x; &nosuchname; &') AS text
FROM {{orders}} o JOIN {{fx_entity}} e ON e.n = o.o_orderkey % {len(_NAMES)}
JOIN {{fx_entity}} f ON f.n = (o.o_orderkey * 7 + 3) % {len(_NAMES)}
"""

# Description cache: document texts keyed by posting URLs.
FIXTURES["fx_desc_cache"] = """
SELECT concat('https://jobs.example.org/p/', CAST(doc_id * 3 AS STRING)) AS key, text AS body FROM {documents}
"""

# Job pages: raw pages addressed by posting URLs.
FIXTURES["fx_job_page"] = """
SELECT page_id, concat('https://jobs.example.org/p/', CAST(page_id * 7 AS STRING)) AS url, html FROM {pages}
"""

# Employer slug pages (long text for two titles, short for the rest), one per
# (employer, title slug), each with a recruiter mailto.
FIXTURES["fx_slug_page"] = """
SELECT DISTINCT concat(c.jd_base_url, '/', CASE p.seq % 8 WHEN 0 THEN 'senior-python-engineer' WHEN 1 THEN 'java-developer'
    WHEN 2 THEN 'account-manager' WHEN 3 THEN 'lead-ios-developer' WHEN 4 THEN 'staff-software-engineer'
    WHEN 5 THEN 'data-analyst' WHEN 6 THEN 'platform-engineer' ELSE 'x' END, '/') AS url,
  concat('<html><body><p>', repeat('Great team and product. ', CASE WHEN p.seq % 8 IN (0, 6) THEN 10 ELSE 1 END),
    '</p><a href="mailto:lead', CAST(c.ord AS STRING), '@corp.nl">Mail</a></body></html>') AS html
FROM {fx_posting} p JOIN {fx_company} c ON c.ind_name = p.company WHERE c.jd_base_url <> ''
"""

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def deps(name: str) -> list[str]:
    return list(dict.fromkeys(_PLACEHOLDER.findall(FIXTURES[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..operators.sizing import spread

    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


_WRITTEN: dict = {}


def _session_key(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return str(id(spark))


def fixture(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    """Fixture ``name`` as a Spark DataFrame.

    A fixture is landed input: it is derived once per session and scale factor
    from the driver's tables, written as parquet under the shared folder and
    read back, so every query scans a real table (pushdown into its columns,
    several files) instead of re-deriving synthetic CASE columns.
    """
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in BASE_TABLES:
        memo[name] = table(spark, sf_dir, name)
        return memo[name]
    key = (_session_key(spark), os.path.abspath(sf_dir), name)
    path = _WRITTEN.get(key)
    if path is not None:
        try:
            df = spark.read.parquet(path)
            df.schema
            memo[name] = df
            return df
        except Exception:
            _WRITTEN.pop(key, None)
    from ..session import scratch_path

    args = {d: fixture(spark, sf_dir, d, memo) for d in deps(name)}
    path = scratch_path(spark, f"fixture-{name}")
    spark.sql(FIXTURES[name], **args).write.parquet(path)
    _WRITTEN[key] = path
    memo[name] = spark.read.parquet(path)
    return memo[name]


def landed(spark: SparkSession, sf_dir: str, name: str, build, partition_by=()) -> DataFrame:
    """Landed input built by ``build()`` (payload pages, captures): written once
    per session and scale factor under the shared folder, then read as a table.
    Built in parts (an iterator of frames), it is written by a job a part."""
    key = (_session_key(spark), os.path.abspath(sf_dir), "landed:" + name)
    path = _WRITTEN.get(key)
    if path is not None:
        try:
            df = spark.read.parquet(path)
            df.schema
            return df
        except Exception:
            _WRITTEN.pop(key, None)
    from ..session import append_parts, scratch_path

    import hashlib

    tag = re.sub(r"[^A-Za-z0-9_]+", "", name.split("(")[0]) + "-" + hashlib.sha1(name.encode()).hexdigest()[:8]
    path = scratch_path(spark, f"landed-{tag}")
    rows = build()
    if not isinstance(rows, DataFrame):
        append_parts(rows, path)
    else:
        writer = rows.hint("rebalance", *partition_by).write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    memo: dict = {}
    return [fixture(spark, sf_dir, n, memo) for n in names]


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in BASE_TABLES or n in out:
            return
        for d in deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_with(names, body: str) -> str:
    """DuckDB text: the needed fixtures as CTEs in front of ``body``."""
    ctes = []
    for n in _closure(names):
        text = _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURES[n]).strip()
        ctes.append(f"{n} AS (\n{text}\n)")
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
