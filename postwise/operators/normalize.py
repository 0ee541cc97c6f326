"""Payload normalisers (N1-N13, N15-N18) and the format registry (G1).

Every normaliser takes landed payloads ``(company, page, body, ...)`` and the
employer dimension ``(ind_name, careers_url, params)`` and returns postings. The
shape is always the same: join with the employer dimension, a typed reading of the
body with an explicit schema, ``posexplode`` (arrival order = (page, pos)), Column
projections and the keyword filters. Malformed bodies yield no rows (a failing source
never stops the others).

JSON bodies are read through a variant: the ``doc`` of payloads from a payload store
(parsed once, when they landed), else the body parsed here. A field of another type
than expected is null; the job it is in, and its neighbours, are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile
from ..functions import predicates as P
from ..functions.text import first_email, html_to_text, unescape
from ..functions.values import first_truthy, fmt_date, join_place, resolve_url, slug_to_title, truthy, with_country
from ..session import staged, staged_parts
from ..sources.payload_store import payload_format
from .dedup import dedup_coalesced_key, dedup_first_by_url, dedup_null_passthrough
from .merge import last_pages, payload_company_join

POSTING_COLS = ("company", "job_title", "location", "careers_url", "job_url", "visa_support",
                "relocation_support", "date_posted", "recruiter_email", "description", "notes")
ORDER_COLS = ("page", "pos")


def _s(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null(t: str = "string") -> Column:
    return F.lit(None).cast(t)


def posting(company="company", job_title=None, location=None, careers_url="careers_url", job_url=None,
            visa_support=None, relocation_support=None, date_posted=None, recruiter_email=None,
            description=None, notes=None, keep_order=True) -> list[Column]:
    vals = dict(company=company, job_title=job_title, location=location, careers_url=careers_url, job_url=job_url,
                visa_support=visa_support, relocation_support=relocation_support, date_posted=date_posted,
                recruiter_email=recruiter_email, description=description, notes=notes)
    out = []
    for name in POSTING_COLS:
        v = vals[name]
        t = "boolean" if name in ("visa_support", "relocation_support") else "string"
        out.append((_s(v) if v is not None else _null(t)).cast(t).alias(name))
    if keep_order:
        out += [F.col(c) for c in ORDER_COLS]
    return out


def with_company(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """J11 with the columns the normalisers read."""
    dims = companies.select("ind_name", "careers_url", "params", *[c for c in ("ord",) if c in companies.columns])
    return payload_company_join(payloads, dims).drop("ord")


def param(name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(default))


def _typed(payloads: DataFrame, schema: str) -> Column:
    """The body read with ``schema``."""
    doc = F.col("doc") if "doc" in payloads.columns else F.try_parse_json("body")
    return F.try_variant_get(doc, "$", schema)


def _jobs(payloads: DataFrame, companies: DataFrame, arr: Column, keep=("page",)) -> DataFrame:
    """One row (company, careers_url, params, ``keep``, pos, j) per element of ``arr``.
    The bodies are taken apart before the employer is joined: filters on the elements
    run below the join, and no body travels through it."""
    return with_company(payloads.select("company", *keep, F.posexplode(arr).alias("pos", "j")), companies)


def _fmt(template: str, **parts) -> Column:
    import re

    pieces = re.split(r"(\{[a-z]+\})", template)
    return F.concat(*[parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in pieces if p])


def _txt(c: Column) -> Column:
    """``.get(k, '')`` on a string field (absent → '')."""
    return F.coalesce(c, F.lit(""))


# ----------------------------------------------------------------- N1 greenhouse

GREENHOUSE = ("struct<jobs: array<struct<id: bigint, title: string, location: struct<name: string>, "
              "absolute_url: string, first_published: string, updated_at: string, "
              "departments: array<struct<name: string>>, content: string>>>")


def normalize_greenhouse(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Board JSON → postings (location AND role); description from the job's
    HTML content (the description ladder P13 handles short ones)."""
    d = _jobs(payloads, companies, _typed(payloads, GREENHOUSE)["jobs"])
    j = F.col("j")
    title, loc = _txt(j["title"]), _txt(j["location"]["name"])
    kept = d.filter(P.is_location(loc, profile) & P.is_target_role(title, profile))
    has_id = j["id"].isNotNull() & (j["id"] != 0)
    url = first_truthy(j["absolute_url"], _fmt(C.URL_FORMATS["greenhouse_job"], board=param("board"),
                                                id=j["id"].cast("string")))
    dept = F.coalesce(F.try_element_at(j["departments"], F.lit(1))["name"], F.lit(""))
    notes = F.when(dept != "", F.concat(F.lit("Dept: "), dept, F.lit(". " + C.NOTES["greenhouse"]))).otherwise(
        F.lit(C.NOTES["greenhouse"]))
    desc = F.when(has_id, html_to_text(j["content"]))
    email = F.when(has_id & (F.length(F.trim(desc)) >= C.PLACEHOLDER_DESCRIPTION_MIN), first_email(j["content"], profile))
    return kept.select(*posting(job_title=title, location=with_country(loc), job_url=url,
                                date_posted=fmt_date(first_truthy(j["first_published"], j["updated_at"])),
                                recruiter_email=email, description=desc, notes=F.lit(notes)),
                       j["content"].alias("content"), has_id.alias("has_id"), param("jd_base_url").alias("jd_base_url"))


# ----------------------------------------------------------------- N2 icims

ICIMS_FIELDS = ("req_id: string, id: string, slug: string, title: string, city: string, country: string, "
                "country_name: string, apply_url: string, absolute_url: string, url: string, "
                "posted_date: string, date_posted: string, description: string")
ICIMS = f"struct<jobs: array<struct<data: struct<{ICIMS_FIELDS}>, {ICIMS_FIELDS}>>>"


def normalize_icims(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Jobs (optionally wrapped in ``data``) deduplicated by id across all pages
    of an employer (rows without an id all kept), then location AND role. Pages
    restart per category, so a ``category`` column precedes the page in the order."""
    category = F.col("category") if "category" in payloads.columns else F.lit("")
    d = _jobs(payloads.withColumn("__category", category), companies, _typed(payloads, ICIMS)["jobs"],
              keep=("page", "__category"))
    j = F.col("j")
    jd = F.when(j["data"].isNotNull(), j["data"]).otherwise(F.struct(*[j[f.split(":")[0].strip()].alias(
        f.split(":")[0].strip()) for f in ICIMS_FIELDS.split(",")]))
    d = d.withColumn("jd", jd)
    uid = first_truthy(F.col("jd.req_id"), F.col("jd.id"), F.col("jd.slug"), default="")
    d = dedup_null_passthrough(d, uid, order=["__category", *ORDER_COLS], scope=["company"])
    jd = F.col("jd")
    title = _txt(jd["title"])
    loc = join_place(jd["city"], F.coalesce(jd["country"], jd["country_name"]))
    kept = d.filter(P.is_location(loc, profile) & P.is_target_role(title, profile))
    raw = first_truthy(jd["apply_url"], jd["absolute_url"], jd["url"], default="")
    job_id = F.regexp_extract(raw, C.NUMERIC_JOB_ID_PATTERN, 1)
    url = F.when(job_id != "", _fmt(C.URL_FORMATS["icims_job"], id=job_id)).otherwise(truthy(raw))
    desc = _txt(jd["description"])
    return kept.select(*posting(job_title=title, location=loc, job_url=url,
                                visa_support=P.visa_flag(desc), relocation_support=P.relocation_flag(desc),
                                date_posted=fmt_date(first_truthy(jd["posted_date"], jd["date_posted"])),
                                notes=F.lit(C.NOTES["icims"])), F.col("__category").alias("term"))


# ----------------------------------------------------------------- N3 lever

LEVER = ("array<struct<text: string, categories: struct<location: string, allLocations: array<string>>, "
         "workplaceType: string, hostedUrl: string, applyUrl: string, createdAt: string, description: string, "
         "descriptionPlain: string>>")


def normalize_lever(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE,
                    epoch_ms: bool = False) -> DataFrame:
    """Top-level array; location or any of allLocations matches, AND role."""
    d = _jobs(payloads, companies, _typed(payloads, LEVER))
    j = F.col("j")
    title = _txt(j["text"])
    loc = first_truthy(j["categories"]["location"], j["workplaceType"], default="")
    any_loc = F.exists(F.coalesce(j["categories"]["allLocations"], F.array().cast("array<string>")),
                       lambda x: P.is_location(x, profile))
    kept = d.filter((P.is_location(loc, profile) | any_loc) & P.is_target_role(title, profile))
    return kept.select(*posting(job_title=title, location=loc, job_url=first_truthy(j["hostedUrl"], j["applyUrl"]),
                                date_posted=fmt_date(F.coalesce(j["createdAt"], F.lit("")), epoch_ms=epoch_ms),
                                description=html_to_text(first_truthy(j["description"], j["descriptionPlain"],
                                                                      default="")),
                                notes=F.lit(C.NOTES["lever"])))


# ----------------------------------------------------------------- N4 smartrecruiters

SMARTRECRUITERS = ("struct<content: array<struct<name: string, location: struct<city: string, country: string>, "
                   "ref: string, releasedDate: string, updatedOn: string>>>")


def normalize_smartrecruiters(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Role filter only (the country is part of the request)."""
    d = _jobs(payloads, companies, _typed(payloads, SMARTRECRUITERS)["content"])
    j = F.col("j")
    title = _txt(j["name"])
    kept = d.filter(P.is_target_role(title, profile))
    loc = join_place(j["location"]["city"], F.coalesce(j["location"]["country"], F.lit(C.DEFAULT_COUNTRY)))
    return kept.select(*posting(job_title=title, location=loc, job_url=j["ref"],
                                date_posted=fmt_date(first_truthy(j["releasedDate"], j["updatedOn"])),
                                notes=F.lit(C.NOTES["smartrecruiters"])))


# ----------------------------------------------------------------- N5 ashby

ASHBY_ITEM = ("struct<title: string, location: string, locationName: string, address: struct<postalAddress: "
              "struct<addressLocality: string, addressCountry: string>>, jobUrl: string, applyUrl: string, "
              "publishedAt: string, createdAt: string, descriptionHtml: string, descriptionPlain: string, "
              "description: string>")
ASHBY = f"struct<jobs: array<{ASHBY_ITEM}>, jobPostings: array<{ASHBY_ITEM}>>"


def normalize_ashby(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """``jobs`` else ``jobPostings``; role AND (location text with the postal
    address matches, or the location is empty/remote/hybrid)."""
    body = _typed(payloads, ASHBY)
    arr = F.when(body["jobs"].isNotNull(), body["jobs"]).otherwise(body["jobPostings"])
    d = _jobs(payloads, companies, arr)
    j = F.col("j")
    title = _txt(j["title"])
    loc = first_truthy(j["location"], j["locationName"], default="")
    addr = j["address"]["postalAddress"]
    addr_str = F.trim(F.concat(_txt(addr["addressLocality"]), F.lit(" "), _txt(addr["addressCountry"])))
    full = F.trim(F.concat(loc, F.lit(" "), addr_str))
    ok = (full == "") | P.is_location(full, profile) | F.lower(loc).isin("remote", "hybrid", "")
    kept = d.filter(P.is_target_role(title, profile) & ok)
    return kept.select(*posting(job_title=title, location=first_truthy(loc, default=C.DEFAULT_COUNTRY),
                                job_url=first_truthy(j["jobUrl"], j["applyUrl"], default=""),
                                date_posted=fmt_date(first_truthy(j["publishedAt"], j["createdAt"])),
                                description=html_to_text(first_truthy(j["descriptionHtml"], j["descriptionPlain"],
                                                                      j["description"], default="")),
                                notes=F.lit(C.NOTES["ashby"])))


# ----------------------------------------------------------------- N6 recruitee

RECRUITEE = ("struct<offers: array<struct<title: string, city: string, country: string, careers_url: string, "
             "slug: string, published_at: string, created_at: string, description: string, "
             "description_html: string>>>")


def normalize_recruitee(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Role AND (empty location or a location match)."""
    d = _jobs(payloads, companies, _typed(payloads, RECRUITEE)["offers"])
    j = F.col("j")
    title = _txt(j["title"])
    loc = join_place(j["city"], j["country"])
    kept = d.filter(P.is_target_role(title, profile) & ((loc == "") | P.is_location(loc, profile)))
    url = first_truthy(j["careers_url"], _fmt(C.URL_FORMATS["recruitee_job"], board=param("board"),
                                               slug=_txt(j["slug"])))
    return kept.select(*posting(job_title=title, location=first_truthy(loc, default=C.DEFAULT_COUNTRY), job_url=url,
                                date_posted=fmt_date(first_truthy(j["published_at"], j["created_at"])),
                                description=html_to_text(first_truthy(j["description"], j["description_html"],
                                                                      default="")),
                                notes=F.lit(C.NOTES["recruitee"])))


# ----------------------------------------------------------------- N7 slug list in a page

SLUG_PATTERN = C.SLUG_LIST_PATTERN
TITLE_TAG = C.TITLE_TAG_PATTERN
LD_SCRIPT_LOOSE = C.LD_SCRIPT_ANY_PATTERN


def _jsonld_title(html: Column) -> Column:
    """Title of the last ld+json script whose first JobPosting item has a title
    (NULL when none): each such script overrides the title in turn."""
    scripts = F.regexp_extract_all(html, F.lit(LD_SCRIPT_LOOSE), 1)
    items = F.transform(scripts, lambda s: F.from_json(s, "array<struct<`@type`: string, title: string>>"))
    firsts = F.transform(items, lambda arr: F.try_element_at(F.filter(arr, lambda i: i["@type"] == "JobPosting"), F.lit(1)))
    titles = F.filter(F.transform(firsts, lambda x: x["title"]), lambda t: t.isNotNull())
    return F.try_element_at(titles, F.lit(-1))


def normalize_slug_page(listing: DataFrame, details: DataFrame, companies: DataFrame,
                        profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Ordered-distinct slugs from the listing page; title = slug title-cased,
    replaced by the detail page's <title> text (before '|', if longer than 3),
    replaced by a JSON-LD JobPosting title; role filter on the result."""
    slugs = F.array_distinct(F.regexp_extract_all("body", F.lit(SLUG_PATTERN), 1))
    s = _jobs(listing, companies, slugs).withColumnRenamed("j", "slug")
    head, tail = C.URL_FORMATS["picnic_job"].split("{slug}")
    s = s.withColumn("job_url", F.concat(F.lit(head), "slug", F.lit(tail)))
    det = last_pages(details).select(F.col("url").alias("job_url"), F.col("html").alias("__detail"))
    s = s.join(det, "job_url", "left")
    title = slug_to_title(F.col("slug"))
    tag = F.trim(F.regexp_extract(F.coalesce("__detail", F.lit("")), TITLE_TAG, 1))
    title = F.when(F.length(tag) > 3, tag).otherwise(title)
    title = F.coalesce(_jsonld_title(F.coalesce(F.col("__detail"), F.lit(""))), title)
    s = s.withColumn("__title", title)
    kept = s.filter(P.is_target_role(F.col("__title"), profile, compact=True))
    return kept.select(*posting(job_title="__title", location=F.lit(C.DEFAULT_CITY_LOCATION), job_url="job_url",
                                description=F.lit(""), notes=F.lit(C.NOTES["picnic"])))


# ----------------------------------------------------------------- N8 JSON in an HTML attribute

ATTR_PATTERNS = C.ATTRIBUTE_JSON_PATTERNS
ATTR_ITEM = ("array<struct<title: string, name: string, location: string, city: string, url: string, link: string, "
             "applyUrl: string, published_at: string, created_at: string, date: string, description: string, "
             "body: string>>")


def attribute_json(html: Column) -> Column:
    """First of the three attribute patterns that matches (its raw text)."""
    found = [F.when(F.regexp_extract(html, p, 0) != "", F.regexp_extract(html, p, 1)) for p in ATTR_PATTERNS]
    return F.coalesce(*found)


def normalize_attr_json(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE,
                        full_unescape: bool = False) -> DataFrame:
    """Entity-encoded JSON in a jobs attribute; a single object counts as a list."""
    raw = attribute_json(F.col("body"))
    d = _jobs(pages, companies, F.from_json(unescape(raw, full_unescape), ATTR_ITEM), keep=("page", "url"))
    j = F.col("j")
    title = first_truthy(j["title"], j["name"], default="")
    loc = first_truthy(j["location"], j["city"], default=C.DEFAULT_COUNTRY)
    ok = F.lower(loc).isin("remote", "hybrid", "") | P.is_location(loc, profile)
    kept = d.filter(P.is_target_role(title, profile) & ok)
    path = first_truthy(j["url"], j["link"], j["applyUrl"], default="")
    page_url = F.col("url")
    url = (F.when(path.startswith("/"), resolve_url(path, page_url))
           .when(path.startswith("http"), path).otherwise(page_url))
    return kept.select(*posting(job_title=title, location=loc, job_url=url,
                                date_posted=fmt_date(first_truthy(j["published_at"], j["created_at"], j["date"],
                                                                  default="")),
                                description=html_to_text(first_truthy(j["description"], j["body"], default="")),
                                notes=F.lit(C.NOTES["homerun"])))


# ----------------------------------------------------------------- N9 static search index

INDEX_ITEM = ("struct<title: string, name: string, vacancyTitle: string, location: string, city: string, "
              "url: string, link: string, path: string, date: string, published_at: string, body: string, "
              "description: string, content: string>")


def _nonempty_obj_list(v: Column) -> Column:
    """The value is a non-empty JSON array whose first element is an object."""
    elems = F.from_json(v, "array<string>")
    return F.coalesce(F.size(elems) > 0, F.lit(False)) & F.coalesce(
        F.ltrim(F.try_element_at(elems, F.lit(1))).startswith("{"), F.lit(False))


def normalize_search_index(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Docs under ``docs``/``documents``/``vacancies`` (first non-empty), else
    the first value that is a list of objects, else a top-level array. No
    location filter; relative paths resolved on the index host."""
    body = F.col("body")
    top = F.from_json(body, "map<string,string>")
    named = [F.when(F.coalesce(F.size(F.from_json(F.try_element_at(top, F.lit(k)), "array<string>")) > 0,
                               F.lit(False)), F.try_element_at(top, F.lit(k)))
             for k in ("docs", "documents", "vacancies")]
    entries = F.map_entries(top)
    first_list = F.try_element_at(F.filter(entries, lambda e: _nonempty_obj_list(e["value"])), F.lit(1))["value"]
    arr_text = F.when(F.ltrim(body).startswith("["), body).otherwise(F.coalesce(*named, first_list))
    d = _jobs(payloads, companies, F.from_json(arr_text, f"array<{INDEX_ITEM}>"))
    j = F.col("j")
    title = F.trim(first_truthy(j["title"], j["name"], j["vacancyTitle"], default=""))
    kept = d.filter(P.is_target_role(title, profile))
    path = first_truthy(j["url"], j["link"], j["path"], default="")
    url = F.when(path.startswith("/"), F.concat(F.lit(C.URL_FORMATS["kpmg_base"]), path)).otherwise(
        first_truthy(path, F.col("careers_url")))
    return kept.select(*posting(job_title=title, location=first_truthy(j["location"], j["city"],
                                                                       default=C.DEFAULT_COUNTRY),
                                job_url=url, date_posted=fmt_date(first_truthy(j["date"], j["published_at"],
                                                                               default="")),
                                description=html_to_text(first_truthy(j["body"], j["description"], j["content"],
                                                                      default="")),
                                notes=F.lit(C.NOTES["kpmg_lunr"])))


# ----------------------------------------------------------------- N10 workday

WORKDAY = ("struct<jobPostings: array<struct<title: string, externalPath: string, locationsText: string, "
           "postedOn: string>>, total: int>")


def normalize_workday(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Pages of all search terms deduplicated by externalPath (else title);
    role AND (empty location or a location match)."""
    term_rank = F.coalesce(F.col("term_rank"), F.lit(0)) if "term_rank" in payloads.columns else F.lit(0)
    d = _jobs(payloads.withColumn("__term", term_rank), companies, _typed(payloads, WORKDAY)["jobPostings"],
              keep=("__term", "page"))
    d = dedup_coalesced_key(d, [F.col("j.externalPath"), F.col("j.title")], order=["__term", "page", "pos"],
                            scope=["company"])
    j = F.col("j")
    title = _txt(j["title"])
    loc = _txt(j["locationsText"])
    kept = d.filter(P.is_target_role(title, profile) & ((loc == "") | P.is_location(loc, profile)))
    base = _fmt(C.URL_FORMATS["workday_base"], tenant=param("workday_tenant", ""), num=param("workday_num", "5"))
    ext = _txt(j["externalPath"])
    url = F.when(ext != "", F.concat(base, ext)).otherwise(F.col("careers_url"))
    return kept.select(*posting(job_title=title, location=first_truthy(loc, default=C.DEFAULT_COUNTRY),
                                job_url=url, date_posted=fmt_date(j["postedOn"]),
                                notes=F.lit(C.NOTES["workday"])),
                       F.lpad(F.col("__term").cast("string"), 10, "0").alias("term"))


# ----------------------------------------------------------------- N13 JSON array embedded in text

EMBEDDED = "array<struct<title: string, locationName: string, link: string, departmentName: string>>"


def normalize_embedded_array(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """The first ``"jobs":[...]`` up to the first ']' (non-greedy), parsed;
    nested arrays make the text invalid and the payload yields nothing."""
    text = F.regexp_extract("body", C.EMBEDDED_JOBS_PATTERN, 1)
    d = _jobs(payloads, companies, F.from_json(F.nullif(text, F.lit("")), EMBEDDED))
    j = F.col("j")
    title = _txt(j["title"])
    kept = d.filter(P.is_target_role(title, profile))
    loc = first_truthy(j["locationName"], default=C.DEFAULT_CITY_LOCATION)
    link = _txt(j["link"])
    url = F.when(link.startswith("/"), F.concat(F.lit(C.URL_FORMATS["bitvavo_base"]), link)).otherwise(link)
    notes = F.concat(F.lit("Dept: "), _txt(j["departmentName"]), F.lit(". " + C.NOTES["bitvavo"]))
    return kept.select(*posting(job_title=title, location=with_country(loc), job_url=url, notes=notes))


# ----------------------------------------------------------------- N15 JSON-LD

LD_SCRIPT = C.LD_SCRIPT_TYPED_PATTERN
LD_ITEM = ("struct<`@type`: string, title: string, url: string, datePosted: string, description: string, "
           "jobLocation: string>")
LD_ADDRESS = "struct<address: struct<addressLocality: string, addressCountry: string>>"


def _ld_items(html: Column) -> Column:
    """array<(script index, item index, item)> of JSON-LD blocks (object or array)."""
    scripts = F.regexp_extract_all(html, F.lit(LD_SCRIPT), 1)
    return F.flatten(F.transform(scripts, lambda s, si: F.transform(
        F.coalesce(F.from_json(s, f"array<{LD_ITEM}>"), F.array().cast(f"array<{LD_ITEM}>")),
        lambda it, ii: F.struct(si.alias("si"), ii.alias("ii"), it.alias("it")))))


def _ld_location(job_location: Column, sep: str) -> Column:
    first = F.when(F.ltrim(job_location).startswith("["),
                   F.try_element_at(F.from_json(job_location, f"array<{LD_ADDRESS}>"), F.lit(1))).otherwise(
        F.from_json(job_location, LD_ADDRESS))
    a = first["address"]
    return F.concat(_txt(a["addressLocality"]), F.lit(sep), _txt(a["addressCountry"]))


def jsonld_postings(pages: DataFrame, companies: DataFrame, lenient: bool = False,
                    profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """JobPosting items of ld+json scripts.

    strict (plain pages): location 'locality, country' must match, role filter,
    url falls back to the page, e-mail from the item's description;
    lenient (rendered pages): location joined with a space (empty accepted),
    description kept, and only the first script that yields rows is used."""
    items = pages.select("company", "page", F.col("url").alias("page_url"), F.explode(_ld_items(F.col("body"))).alias("x"))
    it = F.col("x.it")
    title = _txt(it["title"])
    typed = items.filter(it["@type"] == "JobPosting")
    if not lenient:
        loc = _ld_location(F.coalesce(it["jobLocation"], F.lit("{}")), ", ")
        # what a posting needs of its item is taken first: no description travels to the employers
        kept = typed.filter(P.is_location(loc, profile) & P.is_target_role(title, profile)).select(
            "company", "page", title.alias("__title"), loc.alias("__loc"), first_truthy(it["url"], "page_url").alias("__url"),
            fmt_date(it["datePosted"]).alias("__date"), first_email(_txt(it["description"]), profile).alias("__email"),
            (F.col("x.si") * 100000 + F.col("x.ii")).alias("pos"))
        return with_company(kept, companies).select(
            *posting(job_title="__title", location="__loc", job_url="__url", date_posted="__date", recruiter_email="__email",
                     notes=F.lit(C.NOTES["jsonld"])))
    typed = with_company(typed, companies)
    loc = F.trim(_ld_location(F.coalesce(it["jobLocation"], F.lit("{}")), " "))
    kept = typed.filter(P.is_target_role(title, profile) & ((loc == "") | P.is_location(loc, profile)))
    # of a page the rows of its first script that has any; only those are shuffled
    first = Window.partitionBy("company", "page").orderBy("x.si")
    kept = kept.withColumn("__rank", F.rank().over(first)).filter(F.col("__rank") == 1).drop("__rank")
    url = F.when(it["url"].isNotNull(), it["url"]).otherwise(F.col("page_url"))
    return kept.select(*posting(job_title=title, location=first_truthy(loc, default=C.DEFAULT_COUNTRY), job_url=url,
                                date_posted=fmt_date(_txt(it["datePosted"])),
                                description=html_to_text(_txt(it["description"])),
                                notes=F.lit(C.NOTES["jsonld_lenient"]), keep_order=False),
                       F.col("page"), (F.col("x.si") * 100000 + F.col("x.ii")).alias("pos"))


# ----------------------------------------------------------------- N16 page-state pairs

NEXT_DATA = r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
PAIR = C.STATE_PAIR_PATTERN


def nextdata_pairs(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Page-state JSON re-serialised, each "title" paired with the next
    url/href/link (pairs may cross objects); role filter; no dedup."""
    state = F.regexp_extract("body", NEXT_DATA, 1)
    # the pattern runs on the serialised state: valid JSON only, line breaks
    # (whitespace between tokens) flattened so a pair may span them
    valid = F.try_parse_json(F.nullif(state, F.lit(""))).isNotNull()
    text = F.when(valid, F.regexp_replace(state, r"[\r\n]+", " ")).otherwise(F.lit(""))
    matches = F.regexp_extract_all(text, F.lit(PAIR), 0)  # one pass over the page state
    pairs = F.transform(matches, lambda m: F.struct(F.regexp_extract(m, PAIR, 1).alias("t"),
                                                      F.regexp_extract(m, PAIR, 2).alias("u")))
    x = with_company(pages.select("company", "page", F.col("url").alias("page_url"),
                                  F.posexplode(pairs).alias("pos", "p")), companies)
    kept = x.filter(P.is_target_role(F.col("p.t"), profile))
    return kept.select(*posting(job_title=F.col("p.t"), location=F.lit(C.DEFAULT_COUNTRY), careers_url="page_url",
                                job_url=F.col("p.u"), notes=F.lit(C.NOTES["nextdata"])))


# ----------------------------------------------------------------- N17 anchors

ANCHOR = r"""(?is)<a\b([^>]*)>(.*?)</a>"""


def _attr(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def dom_link_postings(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE,
                      max_links: int | None = None) -> DataFrame:
    """Anchors whose href has a job-like path (with ``max_links`` only the
    first so many per page); title = aria-label else inner text (cut at 120)."""
    anchors = F.regexp_extract_all("body", F.lit(ANCHOR), 0)
    a = with_company(pages.select("company", "page", F.col("url").alias("page_url"),
                                  F.posexplode(anchors).alias("pos", "tag")), companies)
    attrs = F.regexp_extract("tag", r"(?is)<a\b([^>]*)>", 1)
    href = _attr(attrs, "href")
    a = a.withColumn("__href", href).filter(P.any_contains(F.col("__href"), C.JOB_LINK_MARKERS))
    if max_links is not None:
        a = a.withColumn("__k", F.row_number().over(Window.partitionBy("company", "page").orderBy("pos")))
        a = a.filter(F.col("__k") <= max_links)
    inner = F.trim(F.regexp_replace(F.regexp_extract("tag", r"(?is)<a\b[^>]*>(.*?)</a>", 1), r"<[^>]+>", ""))
    label = _attr(attrs, "aria-label")
    title = F.trim(first_truthy(label, inner, default=""))
    a = a.withColumn("__title", title).filter(
        (F.col("__title") != "") & P.is_target_role(F.col("__title"), profile, compact=True))
    url = resolve_url(F.col("__href"), F.col("page_url"))
    return a.select(*posting(job_title=F.substring("__title", 1, C.LINK_TITLE_MAX), location=F.lit(C.DEFAULT_COUNTRY),
                             job_url=url, description=F.lit(""), notes=F.lit(C.NOTES["dom"])))


# ----------------------------------------------------------------- N18 aggregator rows

def normalize_search_rows(rows: DataFrame, order="seq") -> DataFrame:
    """First row per URL (empty URL dropped), title pattern, projection.
    Missing text fields become NULL (the original printed 'nan'/'None')."""
    first = dedup_first_by_url(rows, url="job_url", order=order)
    kept = first.filter(P.title_regex(F.col("title")))
    return kept.select(
        "search_term", F.col(order).alias("seq"),
        *posting(company=F.col("company"), job_title=F.col("title"), location=F.col("location"),
                 careers_url=F.col("job_url"), job_url=F.col("job_url"),
                 date_posted=F.coalesce(F.col("date_posted"), F.lit("")),
                 description=F.coalesce(F.col("description"), F.lit("")), notes=F.lit(C.NOTES["search"]),
                 keep_order=False))


# ----------------------------------------------------------------- P16 / N11 / N12 ladders

def in_turn(inputs: DataFrame, strategies) -> DataFrame:
    """Strategies tried one after another per employer: the rows of each are made
    from the inputs of employers for whom none before yields a row. ``strategies`` is
    a list of (number, inputs → rows); the rows come with their ``strategy``. Which
    employers a strategy yields for is asked of all inputs, so the question is the same
    wherever it is asked and is answered once (a reused exchange of employer names).
    A third entry, true, marks a strategy whose rows are cheap and small beside their
    inputs: they are made of all inputs and meet the names themselves, so no page travels."""
    out, won = None, None
    for i, (number, strategy, *small) in enumerate(strategies):
        if won is None:
            rows = strategy(inputs)
        elif any(small):
            # a left join, since an anti join would be moved below what takes the pages apart
            rows = strategy(inputs).join(won.withColumn("__won", F.lit(True)), "company", "left")
            rows = rows.filter(F.col("__won").isNull()).drop("__won")
        else:
            rows = strategy(inputs.join(won, "company", "left_anti"))
        rows = rows.withColumn("strategy", F.lit(number))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if i + 1 < len(strategies):
            names = (rows if won is None else strategy(inputs)).select("company").distinct()
            won = names if won is None else won.unionByName(names)
    return out


def html_ladder(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Per employer, JSON-LD postings, else page-state pairs."""
    return in_turn(pages, [(1, lambda p: jsonld_postings(p, companies, profile=profile)),
                           (2, lambda p: nextdata_pairs(p, companies, profile), True)])


def json_documents(captures: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Postings of captured JSON documents: per employer those of the first document
    that yields any (responses in capture order, page-state variables in their fixed
    order)."""
    from .jsonsearch import json_job_search

    docs = captures.withColumn("doc_id", F.concat_ws(":", "company", F.col("strategy").cast("string"),
                                                     F.col("seq").cast("string")))
    found = json_job_search(docs.select("doc_id", "company", "body"), companies, note=F.lit(""), profile=profile)
    var = F.col("var") if "var" in captures.columns else F.lit(None).cast("string")
    note = F.when(var.isNull() | (F.col("strategy") == 1), F.lit(C.NOTES["xhr"])).otherwise(
        F.concat(F.lit("Via "), var, F.lit(" (Playwright).")))
    var_rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in C.PAGE_STATE_VARS]), var), F.lit(0))
    place = F.when(F.col("strategy") == 2, var_rank).otherwise(F.lit(0)).cast("long")
    meta = docs.select("doc_id", "seq", note.alias("__note"), place.alias("__ord"))
    first = Window.partitionBy("company").orderBy("__ord", "seq")
    found = found.join(meta, "doc_id").withColumn("__rank", F.rank().over(first)).filter(F.col("__rank") == 1)
    return found.withColumn("notes", F.col("__note")).select(
        *POSTING_COLS, F.col("seq").alias("page"), F.col("ipos").alias("pos"), "path")


def spa_ladder(captures: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """Rendered-page captures ``(company, strategy, seq, body)``:
    1 = JSON responses (the first response that yields), 2 = page-state
    variables in fixed order (the first that yields), 3 = JSON-LD (lenient),
    4 = job-like anchors. Per employer the first strategy that yields wins."""
    def json_of(k):
        return lambda c: json_documents(c.filter(F.col("strategy") == k), companies, profile)

    def pages_of(c, k):
        return c.filter(F.col("strategy") == k).select("company", F.col("seq").alias("page"), "body", "url")

    return in_turn(captures, [
        (1, json_of(1)), (2, json_of(2)),
        (3, lambda c: jsonld_postings(pages_of(c, 3), companies, lenient=True, profile=profile)),
        (4, lambda c: dom_link_postings(pages_of(c, 4), companies, profile))])


# ----------------------------------------------------------------- P13 description ladder

def page_facts(pages: DataFrame, urls: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """What the ladder reads of the pages at ``urls`` (column url): text, e-mail and
    the application-form flag, computed once a page (the last landing of a URL)."""
    wanted = last_pages(pages.join(urls.select("url").distinct(), "url", "left_semi"))
    return wanted.filter(F.col("html").isNotNull()).select(
        "url", F.struct(html_to_text(F.col("html"), C.PAGE_TEXT_MAX).alias("text"),
                        first_email(F.col("html"), profile).alias("email"),
                        P.is_apply_form(F.col("html"), profile).alias("form")).alias("fact"))


def description_ladder(postings: DataFrame, pages: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """A placeholder API description (< 100 characters) is replaced by the
    employer's slug page text (> 100 characters; its URL becomes the job URL,
    its e-mail is used), else by the job page text when that is longer and the
    page is not an application form (the job page's e-mail is used either way).
    A full description takes its e-mail from the content, else from the job page.

    Input postings carry ``content`` (API HTML), ``has_id`` and ``jd_base_url``.

    Both page needs of a posting are known before any page is read: a slug page that
    answers makes the job page needless, so the job URL asked for is always the given
    one. The distinct pairs of needed URLs are stacked, looked up together (the page
    table is exchanged once) and pivoted back to one row a pair."""
    # a one-row generator: description and e-mail are made once, not wherever they are asked for below
    once = F.explode(F.array(F.struct("description", "recruiter_email")))
    postings = postings.withColumn("__once", once).withColumns({c: F.col(f"__once.{c}") for c in (
        "description", "recruiter_email")}).drop("__once")
    desc0 = F.coalesce(F.col("description"), F.lit(""))
    short = F.col("has_id") & (F.length(F.trim(desc0)) < C.PLACEHOLDER_DESCRIPTION_MIN)
    slug = F.btrim(F.regexp_replace(F.lower("job_title"), C.SLUG_CHARS_PATTERN, "-"), F.lit("-"))
    slug_url = F.when(short & (F.coalesce(F.col("jd_base_url"), F.lit("")) != ""),
                      F.concat("jd_base_url", F.lit("/"), slug, F.lit("/")))
    job_url = F.when(F.col("has_id") & (short | F.col("recruiter_email").isNull()), truthy("job_url"))
    # '' stands for no need, so a pair is an ordinary join key
    d = postings.withColumn("__slug", F.coalesce(slug_url, F.lit(""))).withColumn(
        "__job", F.coalesce(job_url, F.lit(""))).withColumn("__short", short).withColumn("__desc0", desc0)
    pairs = d.select("__slug", "__job").filter((F.col("__slug") != "") | (F.col("__job") != "")).distinct()
    needs = pairs.select("__slug", "__job", F.explode(F.array("__slug", "__job")).alias("url")).filter(F.col("url") != "")
    found = needs.join(page_facts(pages, needs, profile), "url")
    facts = found.groupBy("__slug", "__job").agg(
        F.max(F.when(F.col("url") == F.col("__slug"), F.col("fact"))).alias("__slug_page"),
        F.max(F.when(F.col("url") == F.col("__job"), F.col("fact"))).alias("__job_page"))
    # postings without a need meet no pair: their key is salted so they spread
    from .merge import salt_missing

    none = (F.col("__slug") == "") & (F.col("__job") == "")
    d = d.withColumn("__slug", F.when(none, salt_missing(F.lit(""))).otherwise(F.col("__slug")))
    d = d.join(facts, ["__slug", "__job"], "left")
    slug_ok = F.col("__short") & (F.length("__slug_page.text") > C.PLACEHOLDER_DESCRIPTION_MIN)
    slug_ok = F.coalesce(slug_ok, F.lit(False))
    page = F.when(~slug_ok, F.col("__job_page"))
    has_page = page.isNotNull()
    # a slug text that is taken is long, so its posting never turns to the job page
    take_page = F.col("__short") & has_page & ~page["form"] & (F.length(page["text"]) > F.length("__desc0"))
    desc = (F.when(slug_ok, F.col("__slug_page.text")).when(take_page, page["text"]).otherwise(F.col("__desc0")))
    email = (F.when(slug_ok, F.col("__slug_page.email")).when(has_page, page["email"])
             .when(F.col("__short"), F.lit(None)).otherwise(F.col("recruiter_email")))
    return (d.withColumn("description", F.when(F.col("has_id"), desc).otherwise(F.col("description")))
            .withColumn("job_url", F.when(slug_ok, F.col("__slug")).otherwise(F.col("job_url")))
            .withColumn("recruiter_email", email)
            .drop("__desc0", "__short", "__slug", "__job", "__slug_page", "__job_page"))


# ----------------------------------------------------------------- G1 registry

def normalize_rendered(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """N12 over landed page bodies: a JSON body counts as a captured response, any
    other as a rendered page, tried for JSON-LD and then for job-like anchors."""
    is_json = F.coalesce(F.ltrim("body").rlike(r"^[\[{]"), F.lit(False))

    def responses(p):
        return json_documents(p.filter(is_json).select("company", F.lit(1).alias("strategy"),
                                                       F.col("page").cast("int").alias("seq"), "body"), companies, profile)

    return in_turn(pages, [
        (1, responses),
        (3, lambda p: jsonld_postings(p.filter(~is_json), companies, lenient=True, profile=profile)),
        (4, lambda p: dom_link_postings(p.filter(~is_json), companies, profile))])


def normalize_html(pages: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """N11 with its second chance: an employer whose pages give no posting is
    tried again with the page strategies of the rendered-page ladder (N12)."""
    return in_turn(pages, [
        (1, lambda p: jsonld_postings(p, companies, profile=profile)),
        (2, lambda p: nextdata_pairs(p, companies, profile), True),
        (3, lambda p: jsonld_postings(p, companies, lenient=True, profile=profile)),
        (4, lambda p: dom_link_postings(p, companies, profile))])


def normalize_slugs(listing: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    """N7 when no detail pages have landed: titles come from the slugs."""
    none = listing.sparkSession.createDataFrame([], "url string, html string")
    return normalize_slug_page(listing, none, companies, profile)


def registry() -> dict:
    """G1: source type → normaliser over landed payloads."""
    return {
        "greenhouse": normalize_greenhouse,
        "icims": normalize_icims,
        "lever": normalize_lever,
        "smartrecruiters": normalize_smartrecruiters,
        "ashby": normalize_ashby,
        "recruitee": normalize_recruitee,
        "picnic": normalize_slugs,
        "homerun": normalize_attr_json,
        "kpmg_lunr": normalize_search_index,
        "workday": normalize_workday,
        "bitvavo": normalize_embedded_array,
        "spa": normalize_rendered,
        "html": normalize_html,
    }


#: Formats whose payload is JSON as a whole (the others hold text or HTML).
JSON_TYPES = ("greenhouse", "icims", "lever", "smartrecruiters", "ashby", "recruitee", "kpmg_lunr", "workday")
#: Of these, the formats that are read from the parsed body alone; the search index
#: depends on the order of its keys, which the text keeps and a variant does not.
VARIANT_TYPES = tuple(t for t in JSON_TYPES if t != "kpmg_lunr")


def of_format(payloads: DataFrame, kind: str) -> DataFrame:
    """The payloads of one format: of a payload store its folder, else a filter on
    the source type."""
    if "format" in payloads.columns:
        return payloads.filter(F.col("format") == kind).drop("format")
    return payloads.filter(payload_format(F.col("source_type"), list(registry())) == kind)


def rejected_payloads(payloads: DataFrame, types=None) -> DataFrame:
    """Payloads no normaliser can read, with the reason: no body at all, or
    a body of a JSON format that is not valid JSON. ``types`` as in ``normalize_all``.
    A payload store has them already (``PayloadStore.rejected``)."""
    from ..sources.payload_store import tagged

    rows = tagged(payloads, list(registry()), JSON_TYPES)
    if types:
        rows = rows.filter(F.col("format").isin(*types))
    return rows.filter(~F.col("readable")).drop("format", "doc", "readable")


def by_format(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE, types=None,
              details: DataFrame | None = None, pages: DataFrame | None = None, written: bool = False) -> Iterator[DataFrame]:
    """The postings of ``normalize_all`` format by format, each made when it is asked for. With
    ``written`` those the description ladder completes are written before, by a job of their own."""
    reg = registry()
    for kind in list(types or reg):
        part = of_format(payloads, kind)
        if kind == "picnic" and details is not None:
            rows = normalize_slug_page(part, details, companies, profile)
        elif kind == "greenhouse" and pages is not None:
            rows = reg[kind](part, companies, profile=profile)
            rows = description_ladder(staged(rows, "described") if written else rows, pages, profile)
        else:
            rows = reg[kind](part, companies, profile=profile)
        term = F.col("term") if "term" in rows.columns else F.lit("").alias("term")
        yield rows.select(*POSTING_COLS, term, *ORDER_COLS).withColumn("source_type", F.lit(kind))


def normalize_all(payloads: DataFrame, companies: DataFrame, profile: Profile = DEFAULT_PROFILE, types=None,
                  details: DataFrame | None = None, pages: DataFrame | None = None, written: bool = False) -> DataFrame:
    """G1: every payload normalised by its format, the results stacked.

    A null or unknown type goes to the generic HTML ladder. Payloads from a payload
    store are read format by format, each from its own folder, already parsed.
    ``types`` restricts a run to some formats. ``details`` are the slug format's
    detail pages ``(url, html)`` and ``pages`` the pages of the description ladder
    (P13), where they have landed. ``term`` orders pages of different searches.
    One plan of all formats takes hundreds of MB in the driver; with ``written`` each
    format's postings are written under the shared folder by a job of their own."""
    parts = by_format(payloads, companies, profile, types, details, pages, written)
    if written:
        return staged_parts(payloads.sparkSession, parts, "normalized")
    return functools.reduce(DataFrame.unionByName, parts)
