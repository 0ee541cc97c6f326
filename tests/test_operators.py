"""Hand tables for the scalable operator shapes: bucketed range join, global
rank, paging prefix, W2 in one pass."""

import datetime as dt

from pyspark.sql import functions as F

from postwise.operators import dedup as W
from postwise.operators import ranking as O
from postwise.sources import payloads as PL
from postwise.streaming import ttl_cache as ST


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_ttl_range_join_day_boundaries(spark):
    stores = spark.createDataFrame([
        (1, ts("2024-01-01 23:30:00")),   # next-day lookup within 24 h: hit
        (2, ts("2024-01-01 00:00:00")),   # exactly 24 h before the lookup: miss (strict)
        (3, ts("2024-01-01 00:00:01")),   # 23:59:59 before: hit
        (4, ts("2024-01-02 12:00:00")),   # after the lookup: miss
        (5, ts("2024-01-01 10:00:00")), (5, ts("2024-01-02 09:00:00")),  # latest store counts
    ], "k long, ts timestamp")
    lookups = spark.createDataFrame([
        (1, 10, ts("2024-01-02 00:15:00")), (2, 20, ts("2024-01-02 00:00:00")),
        (3, 30, ts("2024-01-02 00:00:00")), (4, 40, ts("2024-01-02 11:00:00")),
        (5, 50, ts("2024-01-03 08:00:00")), (6, 60, ts("2024-01-02 00:00:00")),
    ], "k long, id long, ts timestamp")
    got = sorted(r.id for r in ST.ttl_hits_batch(lookups, stores, key="k").collect())
    assert got == [10, 30, 50]


def test_global_rank_is_a_total_order_over_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        (F.col("id") % 13).alias("score"), F.format_string("u%05d", "id").alias("job_url"), F.col("id").alias("seq"))
    ranked = O.rank_by_score(df)
    rows = ranked.select("rank", "score", "job_url").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001))
    by_rank = [(r["score"], r["job_url"]) for r in sorted(rows, key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank, key=lambda t: (-t[0], t[1]))


def test_paging_stop_rules(spark):
    pages = spark.createDataFrame([
        ("a", 1, 20, 200, 100), ("a", 2, 20, 200, 100), ("a", 3, 5, 200, 100), ("a", 4, 20, 200, 100),
        ("b", 1, 20, 200, 100), ("b", 2, 0, 200, 100), ("b", 3, 20, 200, 100),
        ("c", 1, 20, 200, 30), ("c", 2, 20, 200, 30), ("c", 3, 20, 200, 30),
        ("d", 1, 20, 500, 100), ("d", 2, 20, 200, 100),
    ], "term string, page int, n_jobs int, status int, total int")
    short = sorted((r.term, r.page) for r in PL.paged_prefix(pages, rule="short_page").collect())
    assert short == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2), ("c", 3)]
    offset = sorted((r.term, r.page) for r in PL.paged_prefix(pages, rule="offset").collect())
    # offset rule: stop after page p when p*20 >= min(total, 100); c: total 30 → after page 2
    assert offset == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("c", 1), ("c", 2)]


def test_dedup_null_passthrough_one_pass(spark):
    df = spark.createDataFrame([
        ("x", 1, "id1"), ("x", 2, "id1"), ("x", 3, ""), ("x", 4, None), ("x", 5, ""), ("y", 6, "id1"),
    ], "company string, seq long, uid string")
    got = sorted(r.seq for r in W.dedup_null_passthrough(df, "uid", order="seq", scope=["company"]).collect())
    assert got == [1, 3, 4, 5, 6]


def test_registry_survives_malformed_payloads(spark):
    """A malformed or unexpected payload yields no rows; the others are
    normalised; nothing raises."""
    import json

    from postwise.operators import normalize as N

    good_gh = json.dumps({"jobs": [{"id": 7, "title": "Senior Java Developer", "location": {"name": "Amsterdam"},
                                    "absolute_url": "https://g/7", "content": "<p>x</p>"}]})
    good_lever = json.dumps([{"text": "Platform Engineer", "categories": {"location": "Utrecht"},
                              "hostedUrl": "https://l/1"}])
    payloads = spark.createDataFrame([
        ("A", 0, "greenhouse", good_gh),
        ("A", 1, "greenhouse", good_gh[:40]),                      # cut short
        ("B", 0, "lever", good_lever),
        ("B", 1, "lever", json.dumps({"not": "a list"})),          # wrong shape
        ("C", 0, "workday", ""),                                   # empty body
        ("D", 0, "html", "<html><script type=\"application/ld+json\">{broken</script></html>"),
    ], "company string, page int, source_type string, body string").withColumn("url", F.lit("https://c/x"))
    dims = spark.createDataFrame([(c, "https://careers.example.org/" + c, {"board": "b"}) for c in "ABCD"],
                                 "ind_name string, careers_url string, params map<string,string>")
    out = N.normalize_all(payloads, dims, types=["greenhouse", "lever", "workday", "html"])
    got = sorted((r.company, r.job_url) for r in out.collect())
    assert got == [("A", "https://g/7"), ("B", "https://l/1")]


def _dims(spark):
    return spark.createDataFrame([("Co", "https://careers.example.org/x", {})],
                                 "ind_name string, careers_url string, params map<string,string>")


def test_page_state_pairs_cross_objects(spark):
    """A title without a link pairs with the next object's link."""
    from postwise.operators import normalize as N

    state = ('{"props": {"jobs": [{"title": "Senior Java Developer", "id": 1},'
             ' {"title": "Account Manager", "url": "https://j/2"}, {"title": "Platform Engineer", "href": "https://j/3"}]}}')
    html = f'<script id="__NEXT_DATA__" type="application/json">{state}</script>'
    pages = spark.createDataFrame([("Co", 0, html, "https://careers.example.org/x")],
                                  "company string, page int, body string, url string")
    got = sorted((r.job_title, r.job_url) for r in N.nextdata_pairs(pages, _dims(spark)).collect())
    # the first title reaches across to the second object's url; 'Account Manager' is then consumed
    assert got == [("Platform Engineer", "https://j/3"), ("Senior Java Developer", "https://j/2")]


def test_attribute_json_single_object_and_pattern_order(spark):
    """N8: ':jobs=' matches when 'v-bind:jobs=' is absent; a single object counts
    as a list of one; the entity-encoded JSON is decoded first."""
    from postwise.operators import normalize as N

    obj = '{&quot;title&quot;: &quot;Lead Backend Engineer&quot;, &quot;url&quot;: &quot;/v/9&quot;, &quot;location&quot;: &quot;Remote&quot;}'
    html = f'<div :jobs="{obj}" class="x"></div>'
    pages = spark.createDataFrame([("Co", 0, html, "https://careers.example.org/x")],
                                  "company string, page int, body string, url string")
    got = [(r.job_title, r.job_url, r.location) for r in N.normalize_attr_json(pages, _dims(spark)).collect()]
    assert got == [("Lead Backend Engineer", "https://careers.example.org/v/9", "Remote")]


def test_plugin_scorer_fallbacks(spark):
    """The user scorer runs on cache misses only; a failing batch or a missing
    answer falls back to the rule score; answers are clamped to 0..99."""
    from postwise.functions.scoring import rule_score
    from postwise.operators import scoring_ops as SO

    posts = spark.createDataFrame([
        ("https://j/1", "Senior Java Developer", "Co", None, None, None),
        ("https://j/2", "Data Analyst", "Co", None, None, None),
        ("https://j/3", "Platform Engineer", "Co", None, None, None),
    ], "job_url string, job_title string, company string, location string, description string, visa_support boolean")
    posts = posts.withColumn("relocation_support", F.lit(None).cast("boolean"))
    cache = spark.createDataFrame([("https://j/3", 42)], "job_url string, score int")
    rules = {r.job_url: r.s for r in posts.select("job_url", rule_score(notes=F.lit(None).cast("string")).alias("s")).collect()}

    def answers(pdf):
        import pandas as pd
        return pd.Series([150 if t.startswith("Senior") else None for t in pdf["job_title"]])

    def broken(pdf):
        raise RuntimeError("model unavailable")

    got = {r.job_url: (r.score, r.from_cache) for r in SO.score_with(posts, cache, answers).collect()}
    assert got == {"https://j/1": (99, False), "https://j/2": (rules["https://j/2"], False), "https://j/3": (42, True)}
    got = {r.job_url: r.score for r in SO.score_with(posts, cache, broken).collect()}
    assert got == {"https://j/1": rules["https://j/1"], "https://j/2": rules["https://j/2"], "https://j/3": 42}


def test_digest_header_plural_and_formats(spark):
    from postwise.operators import reports as R

    one = spark.createDataFrame([("u1",)], "job_url string")
    two = spark.createDataFrame([("u1",), ("u2",)], "job_url string")
    h1 = R.digest_header(one, "2024-03-05 07:08:00", "hourly").first()
    h2 = R.digest_header(two, "2024-03-05 07:08:00", "hourly").first()
    d = R.digest_header(one, "2024-03-05 07:08:00", "daily").first()
    assert (h1.heading, h1.subject) == ("1 new job found", "1 new NL jobs | Mar 05 07:08 UTC")
    assert h2.heading == "2 new jobs found"
    assert (d.heading, d.subject) == ("Daily Report: 1 jobs in the last 24 hours", "Daily job report | 1 jobs | Mar 05, 2024")


def test_all_formats_null_and_unknown_types(spark):
    """G1: every format has a normaliser, null and unknown types take the HTML
    ladder, an employer without a posting there is tried as a rendered page, and
    unreadable payloads are listed."""
    from postwise.operators import normalize as N

    ld = ('<script type="application/ld+json">{"@type": "JobPosting", "title": "Java Developer", "url": "https://%s/1",'
          ' "jobLocation": {"address": {"addressLocality": "Amsterdam", "addressCountry": "NL"}}}</script>')
    anchor = '<a href="/jobs/7">Senior Java Developer</a>'
    payloads = spark.createDataFrame([
        ("A", 0, None, ld % "a"), ("B", 0, "something new", ld % "b"), ("C", 0, "html", anchor), ("D", 0, "spa", anchor),
        ("E", 0, "picnic", "x engineering/senior-java-developer/amsterdam x"),
        ("F", 0, "lever", "{broken"), ("G", 0, "workday", ""),
    ], "company string, page int, source_type string, body string").withColumn("url", F.lit("https://c/x"))
    dims = spark.createDataFrame([(i, c, "https://careers.example.org/" + c, {}) for i, c in enumerate("ABCDEFGA")],
                                 "ord int, ind_name string, careers_url string, params map<string,string>")
    assert len(N.registry()) == 13
    got = sorted((r.company, r.source_type) for r in N.normalize_all(payloads, dims).collect())
    assert got == [("A", "html"), ("B", "html"), ("C", "html"), ("D", "spa"), ("E", "picnic")]
    bad = sorted((r.company, r.reason) for r in N.rejected_payloads(payloads).collect())
    assert bad == [("F", "malformed"), ("G", "empty")]


def test_icims_categories_restart_pages(spark):
    """Rows without an id are all kept, also when categories repeat page numbers."""
    import json

    from postwise.operators import normalize as N

    job = lambda t, **k: {"title": t, "city": "Amsterdam", "country": "NL", **k}
    body = lambda *j: json.dumps({"jobs": list(j)})
    payloads = spark.createDataFrame([
        ("Co", "b", 1, body(job("Java Developer"), job("Java Developer B", id="9"))),
        ("Co", "a", 1, body(job("Java Engineer"), job("Java Developer A", id="9")))],
        "company string, category string, page int, body string")
    got = sorted(r.job_title for r in N.normalize_icims(payloads, _dims(spark)).collect())
    assert got == ["Java Developer", "Java Developer A", "Java Engineer"]


def test_pages_landed_twice_and_employers_listed_twice(spark):
    """One row per payload and posting."""
    from postwise.operators import merge as J

    posts = spark.createDataFrame([(1, "u")], "seq int, job_url string")
    pages = spark.createDataFrame([("u", "old", "2024-01-01"), ("u", "new", "2024-01-02")],
                                  "url string, html string, fetched_at string")
    assert [r.page_html for r in J.posting_page_join(posts, pages, F.col("job_url")).collect()] == ["new"]
    dims = spark.createDataFrame([(2, "Co", "second"), (1, "Co", "first")], "ord int, ind_name string, careers_url string")
    joined = J.payload_company_join(spark.createDataFrame([("Co", 0)], "company string, page int"), dims)
    assert [r.careers_url for r in joined.collect()] == ["first"]
