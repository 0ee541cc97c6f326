"""Landed payloads: the raw bodies a fetcher would have stored, and their scans
(S6, S8, S9, F14).

Fetching itself is not part of the engine; a payload table holds what came back
``(company, source_type, term, page, url, status, fetched_at, body)``. Builders
here turn posting-shaped tables into such payloads in bounded pieces (pages of
at most ``page_size`` postings), the way a paging API delivers them.
"""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.values import quote_param, truthy


def page_of(seq: Column, page_size: int) -> Column:
    return F.floor(seq / F.lit(page_size)).cast("int")


def build_pages(rows: DataFrame, item: Column, wrap, page_size: int = 64, source_type: str = "",
                group=("company",), order: str = "seq", status: Column | None = None) -> DataFrame:
    """Group ``rows`` into pages of at most ``page_size`` items (in ``order``) and
    render each page body with ``wrap(array_column) -> Column``."""
    keyed = rows.withColumn("page", page_of(F.col(order), page_size))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), item.alias("__i"))))
    pages = keyed.groupBy(*group, "page").agg(items.alias("__items"))
    body = wrap(F.transform("__items", lambda x: x["__i"]))
    out = pages.select(*group, "page", F.lit(source_type).alias("source_type"), body.alias("body"))
    if status is not None:
        out = out.withColumn("status", status)
    else:
        out = out.withColumn("status", F.lit(200))
    return out


def raw_payload_scan(payloads: DataFrame, status: str = "status") -> DataFrame:
    """What a successful fetch returned: 2xx rows only, body present."""
    return payloads.filter(F.col(status).between(200, 299) & F.col("body").isNotNull())


def land_result_sets(rows: DataFrame, root: str, term: str = "search_term") -> str:
    """The result sets of a search run, a folder per term. ``term_text`` keeps the term as
    it is (null and empty ones included)."""
    tagged = rows.withColumnRenamed(term, "term_text").withColumn("term", F.md5(F.coalesce("term_text", F.lit(""))))
    tagged.write.partitionBy("term").parquet(root)
    return root


def search_results_union(spark: SparkSession, root: str, term: str = "search_term") -> DataFrame:
    """All result sets under ``root`` stacked, each row with its term."""
    return spark.read.parquet(root).drop("term").withColumnRenamed("term_text", term)


def paged_prefix(pages: DataFrame, term: str = "term", page: str = "page", n: str = "n_jobs",
                 status: str = "status", rule: str = "short_page", total: str = "total",
                 short_page: int = 10, limit: int = 20, cap: int | None = None) -> DataFrame:
    """The pages a paging loop would have read, per term.

    * every rule stops before the first failed (non-2xx) or empty page;
    * ``short_page``: stops after the first page with fewer than ``short_page`` items;
    * ``offset``: stops after page p when p*limit >= total_p (min(total_p, cap) with a
      ``cap``, which belongs to the fetch loop and drops pages that did land).
    The stop pages per term are found with one aggregate (map-side combined) and
    joined back on the term.
    """
    failed = ~F.col(status).between(200, 299) | (F.col(n) == 0)
    if rule == "short_page":
        last = F.col(n) < short_page
    elif rule == "offset":
        enough = F.col(total) if cap is None else F.least(F.col(total), F.lit(cap))
        last = F.col(page) * limit >= enough
    else:
        raise ValueError(rule)
    stops = pages.groupBy(term).agg(
        F.min(F.when(failed, F.col(page))).alias("__first_bad"),
        F.min(F.when(~failed & last, F.col(page))).alias("__last_ok"),
    )
    j = pages.join(stops, term)
    keep = ((F.col("__first_bad").isNull() | (F.col(page) < F.col("__first_bad")))
            & (F.col("__last_ok").isNull() | (F.col(page) <= F.col("__last_ok"))))
    return j.filter(keep).drop("__first_bad", "__last_ok")


def request_plan(companies: DataFrame, page: int = 1) -> DataFrame:
    """the request URLs each employer's format would fetch (a fetch plan): one
    row per employer, for icims one per category (``term``), at ``page``."""
    p = F.col("params")
    board = F.coalesce(F.try_element_at(p, F.lit("board")), F.lit(""))
    loc = F.try_element_at(p, F.lit("location_filter"))
    lever_base = F.coalesce(F.try_element_at(p, F.lit("lever_base")), F.lit(C.URL_FORMATS["lever_base"]))
    wd_num = F.coalesce(F.try_element_at(p, F.lit("workday_num")), F.lit("5"))
    tenant = F.coalesce(F.try_element_at(p, F.lit("workday_tenant")), board)
    wd_board = F.coalesce(F.try_element_at(p, F.lit("workday_board")), board)

    def fmt(template: str, **parts) -> Column:
        import re

        pieces = re.split(r"(\{[a-z]+\})", template)
        return F.concat(*[parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in pieces if x])

    lever = F.concat(lever_base, F.lit("/"), board, F.lit("?mode=json"),
                     F.when(truthy(loc).isNotNull(), F.concat(F.lit("&location="), quote_param(loc)))
                     .otherwise(F.lit("")))
    url = (F.when(F.col("source_type") == "greenhouse", fmt(C.URL_FORMATS["greenhouse_list"], board=board))
           .when(F.col("source_type") == "lever", lever)
           .when(F.col("source_type") == "smartrecruiters", fmt(C.URL_FORMATS["smartrecruiters_list"], board=board))
           .when(F.col("source_type") == "ashby", fmt(C.URL_FORMATS["ashby_list"], board=board))
           .when(F.col("source_type") == "recruitee", fmt(C.URL_FORMATS["recruitee_list"], board=board))
           .when(F.col("source_type") == "workday",
                 fmt(C.URL_FORMATS["workday_list"], tenant=tenant, num=wd_num, board=wd_board))
           .when(F.col("source_type") == "icims", F.concat(
               F.coalesce(F.try_element_at(p, F.lit("api_url")), F.lit("")),
               F.lit("?" + urlencode(C.ICIMS_PARAMS) + "&categories="), F.url_encode("term"), F.lit(f"&page={page}")))
           .when(F.col("source_type") == "kpmg_lunr", F.lit(C.URL_FORMATS["kpmg_list"]))
           .when(F.col("source_type") == "bitvavo", F.lit(C.URL_FORMATS["bitvavo_list"]))
           .otherwise(F.col("careers_url")))
    terms = F.when(F.col("source_type") == "icims", F.array(*[F.lit(c) for c in C.ICIMS_CATEGORIES])).otherwise(
        F.array(F.lit("")))
    return companies.withColumn("term", F.explode(terms)).withColumn("request_url", url)


def detail_requests(listed: DataFrame, board: str = "board", job_id: str = "job_id") -> DataFrame:
    """the URL of each listed greenhouse job's own record; jobs without an id have none."""
    before, between = C.URL_FORMATS["greenhouse_detail"].removesuffix("{id}").split("{board}")
    ident = truthy(F.col(job_id).cast("string"))
    url = F.concat(F.lit(before), F.coalesce(F.col(board), F.lit("")), F.lit(between), ident)
    return listed.filter(ident.isNotNull()).withColumn("request_url", url)


def company_dimension(rows: DataFrame, param_cols=("board", "location_filter")) -> DataFrame:
    """Employer dimension with per-format parameters in a map (empty values left out)."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in param_cols])
    params = F.map_from_entries(F.filter(entries, lambda e: truthy(e["value"]).isNotNull()))
    return rows.select("ord", "ind_name", "kvk", "source_type", "careers_url", params.alias("params"))
