"""N14 edge rules on hand-written documents: depth limits, promising keys,
list elements, duplicate URLs in visit order."""

import json

from postwise.operators.jsonsearch import json_job_search


def job(title, url, loc="Amsterdam"):
    return {"title": title, "url": url, "location": loc}


def nest(keys, leaf):
    for k in reversed(keys):
        leaf = {k: leaf}
    return leaf


def run(spark, docs):
    d = spark.createDataFrame([(str(i), "Co", json.dumps(b)) for i, b in enumerate(docs)], "doc_id string, company string, body string")
    c = spark.createDataFrame([("Co", "https://careers.example.org/x")], "ind_name string, careers_url string")
    out = json_job_search(d, c, "note")
    return sorted((r["doc_id"], r["job_url"]) for r in out.collect())


def test_depth_rules(spark):
    jobs = [job("Senior Java Developer", "https://j/1")]
    docs = [
        nest(["a", "b", "c"], jobs),            # list at depth 3 via plain keys: found
        nest(["a", "b", "c", "d"], jobs),       # depth 4: parent at depth 3 < 4: found
        nest(["a", "b", "c", "d", "e"], jobs),  # depth 5 by plain keys: refused
        nest(["data", "items", "jobs", "results", "hits", "nodes", "edges", "roles"], jobs),  # 8 promising: found
        nest(["data", "items", "jobs", "results", "hits", "nodes", "edges", "roles", "offers"], jobs),  # 9: ignored
        {"groups": [{"jobs": jobs}]},            # inside list elements: never searched
    ]
    assert run(spark, docs) == [("0", "https://j/1"), ("1", "https://j/1"), ("3", "https://j/1")]


def test_filters_and_dedup(spark):
    doc = {"jobs": [
        job("Senior Java Developer", "https://j/1"),
        job("Senior Java Developer", "https://j/1"),       # duplicate URL: dropped
        job("Account Manager", "https://j/2"),             # not a target role
        job("Platform Engineer", "https://j/3", "Berlin"),  # wrong location
        job("Platform Engineer", "/rel/4", "remote"),       # remote, relative URL resolved
        {"title": {"rendered": "Backend Engineer"}, "link": "https://j/5", "location": {"city": "Utrecht"}},
        {"name": "ML Engineer", "href": ""},               # '' URL, no location: careers URL is not a location
    ]}
    assert run(spark, [doc]) == [("0", "https://careers.example.org/rel/4"), ("0", "https://j/1"), ("0", "https://j/5")]


def test_candidate_needs_title_or_link_key(spark):
    doc = {"jobs": [{"label": "Senior Java Developer"}, job("Senior Java Developer", "https://j/9")]}
    assert run(spark, [doc]) == []


def test_spa_page_state_variables_in_fixed_order(spark):
    from postwise.operators import normalize as N

    caps = spark.createDataFrame([
        ("Co", 2, 0, json.dumps({"jobs": [job("Senior Java Developer", "https://j/nuxt")]}), "https://c/x", "__NUXT__"),
        ("Co", 2, 1, json.dumps({"jobs": [job("Platform Engineer", "https://j/next")]}), "https://c/x", "__NEXT_DATA__"),
        ("Co", 4, 0, '<a href="/jobs/1">Senior Java Developer</a>', "https://c/x", ""),
    ], "company string, strategy int, seq int, body string, url string, var string")
    dims = spark.createDataFrame([("Co", "https://careers.example.org/x", {})],
                                 "ind_name string, careers_url string, params map<string,string>")
    got = [(r.job_url, r.notes) for r in N.spa_ladder(caps, dims).collect()]
    assert got == [("https://j/next", "Via __NEXT_DATA__ (Playwright).")]


def test_html_ladder_sends_no_page_to_its_join(spark):
    """the second strategy's rows meet the names of the first; no page is exchanged."""
    from postwise.operators import normalize as N

    ld = ('<script type="application/ld+json">[{"@type": "JobPosting", "title": "Java Developer", "url": "u1", "jobLocation":'
          ' {"address": {"addressLocality": "Amsterdam", "addressCountry": "NL"}}}]</script>')
    state = '<script id="__NEXT_DATA__">{"jobs": [{"title": "Senior Python Engineer", "url": "https://u/2"}]}</script>'
    pages = spark.createDataFrame([("a", 1, ld, "p1"), ("a", 2, state, "p2"), ("b", 1, state, "p3"), ("c", 1, state, "p4"),
                                   (None, 1, state, "p5")], "company string, page int, body string, url string")
    dims = spark.createDataFrame([("a", 1, "c1"), ("b", 2, "c2"), ("b", 3, "c3")], "ind_name string, ord int, careers_url string") \
        .selectExpr("*", "map('board', 'x') AS params")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.html_ladder(pages, dims)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" not in plan and "LeftOuter" in plan
        got = sorted((r.company, r.strategy, r.job_url) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("a", 1, "u1"), ("b", 2, "https://u/2")]
