"""Payload store, result cache and description ladder: what they read, keep and order."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from postwise.operators import merge as J
from postwise.operators import normalize as N
from postwise.plans import flows as FL
from postwise.plans import q_flows as QF
from postwise.plans import q_normalize as QN
from postwise.session import remove_scratch, scratch_path, staged
from postwise.sources.payload_store import PayloadStore
from postwise.sources.result_cache import ResultCache

from .conftest import SMALL

PAYLOAD = "company string, source_type string, page int, url string, body string"
ROWS = [("A", "greenhouse", 0, "https://a/x", '{"jobs": [{"id": 1, "title": "Senior Java Developer", "location": {"name": "Amsterdam"}}]}'),
        ("B", "lever", 0, "https://b/x", "[{"), ("C", None, 0, "https://c/x", None), ("D", "odd", 0, "https://d/x", " "),
        ("E", "workday", 0, "https://e/x", "{"), ("F", "html", 0, "https://f/x", "<p>no JSON {"), ("G", "odd", 0, "https://g/x", "<p>x</p>")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_load_is_parsed_and_counted_once(spark):
    store = PayloadStore(scratch_path(spark, "t-payloads"))
    assert store.land(spark.createDataFrame(ROWS, PAYLOAD), 3) == {"landed": 7, "empty": 2, "malformed": 2}
    good = {r.company: (r.format, r.body, r.doc is not None) for r in store.read(spark, 3).collect()}
    assert good == {"A": ("greenhouse", None, True), "F": ("html", "<p>no JSON {", False), "G": ("html", "<p>x</p>", False)}
    bad = sorted((r.company, r.source_type, r.reason, r.body) for r in store.rejected(spark, 3).collect())
    assert bad == [("B", "lever", "malformed", "[{"), ("C", None, "empty", None), ("D", "odd", "empty", " "),
                   ("E", "workday", "malformed", "{")]
    # landing the same load again replaces it
    assert store.land(spark.createDataFrame(ROWS[:2], PAYLOAD), 3)["landed"] == 2
    assert store.read(spark, 3).count() == 1


def test_every_format_reads_its_own_folder(spark):
    payloads = QF.landed_store(spark, SMALL).read(spark, 1)
    for kind in N.registry():
        part = N.of_format(payloads, kind)
        wanted = plan(part).split("PartitionFilters:")[1].split("PushedFilters")[0]
        assert "readable#" in wanted and "format#" in wanted
        files = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
        assert files and all(f"/format={kind}/" in f and "/readable=true/" in f for f in files)
    gh = N.normalize_greenhouse(N.of_format(payloads, "greenhouse"), QN.dims(spark, SMALL))
    assert "parseJson" not in plan(gh) and "from_json" not in plan(gh)


def test_store_and_plain_payloads_give_the_same_rows(spark):
    raw, dims = QF.mixed_payloads(spark, SMALL), QN.dims(spark, SMALL)
    kinds = ["greenhouse", "icims", "ashby", "workday", "html"]
    a = N.normalize_all(QF.landed_store(spark, SMALL).read(spark, 1), dims, types=kinds)
    b = N.normalize_all(raw, dims, types=kinds)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_one_bad_field_costs_no_neighbour(spark):
    body = json.dumps({"jobs": [{"id": "x", "title": 5, "location": "y"}, 7, None,
                                {"id": 2, "title": "Senior Java Developer", "location": {"name": "Amsterdam"}}]})
    dims = spark.createDataFrame([("A", "https://a/x", {})], "ind_name string, careers_url string, params map<string,string>")
    got = N.normalize_greenhouse(spark.createDataFrame([("A", 0, body)], "company string, page int, body string"), dims)
    assert [r.job_title for r in got.collect()] == ["Senior Java Developer"]


def cache_rows(spark, rows):
    return spark.createDataFrame([(c, t) for c, t in rows], "company string, job_title string")


@pytest.fixture()
def cache(spark):
    c = ResultCache(scratch_path(spark, "t-cache"), cache_rows(spark, []).schema, buckets=8)
    c.write_back(cache_rows(spark, [(f"c{i}", f"old {i}") for i in range(40)] + [("c1", "second")]), 1, None, "2024-01-01 00:00:00")
    return c


def names(df):
    return sorted(r[0] for r in df.select("company").collect())


def test_cache_answers_young_entries_only(spark, cache):
    companies = spark.createDataFrame([("c1",), ("c2",), ("new",)], "ind_name string")
    got = cache.look_up(companies, 1, "2024-01-01 23:59:59")
    assert names(got.fresh) == ["c1", "c2"] and names(got.missing) == ["new"]
    assert sorted(r.job_title for r in got.rows.collect()) == ["old 1", "old 2", "second"]
    assert names(cache.look_up(companies, 1, "2024-01-02 00:00:00").fresh) == []  # 24 hours are too old
    forced = cache.look_up(companies, 1, "2024-01-01 10:00:00", force=spark.createDataFrame([("c1",)], "ind_name string"))
    assert names(forced.fresh) == ["c2"] and names(forced.missing) == ["c1", "new"]
    assert names(cache.look_up(companies, 1, "2024-01-01 10:00:00", force=True).fresh) == []
    assert names(cache.look_up(companies, None, "2024-01-01 10:00:00").missing) == ["c1", "c2", "new"]


def test_write_back_rewrites_touched_buckets_only(spark, cache):
    before = set(cache.read(spark, 1).inputFiles())
    touched = cache.write_back(cache_rows(spark, [("c1", "fetched"), ("new", "n")]), 2, 1, "2024-01-03 00:00:00",
                               answered=spark.createDataFrame([("c2",)], "company string"))
    assert 1 <= len(touched) <= 2
    held = cache.manifest(spark, 2)
    assert {b for b, v in held.items() if v == 2} == set(touched)
    after = set(cache.read(spark, 2).inputFiles())
    assert {f for f in before if not any(f"/bucket={b}/" in f for b in touched)} <= after
    rows = {(r.company, r.job_title) for r in cache.read(spark, 2).collect()}
    assert rows == {(f"c{i}", f"old {i}") for i in range(40) if i != 1} | {("c1", "fetched"), ("new", "n")}
    at = {r.company: str(r.cached_at) for r in cache.stamps(spark, 2).collect()}
    assert at["c1"] == at["new"] == at["c2"] == "2024-01-03 00:00:00" and at["c3"] == "2024-01-01 00:00:00"
    # the version before is whole
    assert cache.read(spark, 1).count() == 41 and ("c1", "second") in {tuple(r)[:2] for r in cache.read(spark, 1).collect()}


def test_an_empty_result_keeps_the_old_entry(spark, cache):
    assert cache.write_back(cache_rows(spark, []), 2, 1, "2024-01-03 00:00:00") == []
    assert cache.read(spark, 2).count() == 41


def test_ladder_reads_the_page_table_once(spark):
    gh = N.normalize_greenhouse(QN.greenhouse_pages(spark, SMALL), QN.dims(spark, SMALL)).filter("has_id")
    path = scratch_path(spark, "t-pages")
    QN.ladder_pages(spark, SMALL).write.parquet(path)
    out = N.description_ladder(gh, spark.read.parquet(path))
    out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and os.path.basename(path) in line]
    assert len(scans) == 1, scans


def test_place_orders_any_page_and_term(spark):
    new = spark.createDataFrame([(0, "", 16_384, 0, "first"), (1, "", 0, 0, "second")], "o long, t string, p long, i long, title string")
    prev = new.select(F.struct(F.col("o").alias("ord"), F.col("t").alias("term"), F.col("p").alias("page"), F.col("i").alias("pos"))
                      .alias("place"), F.lit("u").alias("job_url"), "title", F.lit("2024-01-01").alias("first_seen"),
                      F.lit("2024-01-01").alias("last_seen"))
    none = spark.createDataFrame([], "job_url string, title string")
    seen = spark.createDataFrame([], "job_url string, seen_at timestamp")
    got = J.stamp_and_retain(none, prev, seen, "2024-01-02", prev_order="place").collect()
    assert [r.title for r in got] == ["second"] and FL.PLACE == ("ord", "term", "page", "pos")


def test_no_query_leaves_a_cached_table(spark):
    from postwise.plans.catalog import load_all

    for name in ("norm_html_ladder", "norm_spa_ladder", "jsonld_postings_lenient", "description_ladder", "stamp_and_retain",
                 "rank_scored"):
        load_all()[name].run(spark, SMALL).collect()
        assert spark._jsparkSession.sharedState().cacheManager().isEmpty(), name
        assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty(), name


def test_scratch_is_removed(spark, monkeypatch):
    from postwise import session

    monkeypatch.setattr(session, "_SCRATCH", [])
    df = staged(spark.range(5), "t-staged")
    path = df.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert df.count() == 5 and os.path.exists(path)
    assert remove_scratch(spark) == 1 and not os.path.exists(path)


def jobs_of(spark, group, f):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    out = f()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_mixed_payloads_are_built_part_by_part(spark):
    """one plan of all parts took hundreds of MB in the driver."""
    parts = list(QF.mixed_payloads.__wrapped__(spark, SMALL))
    assert len(parts) == 16 and not any("Union" in p._jdf.queryExecution().analyzed().toString() for p in parts)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, QF.mixed_payloads(spark, SMALL).collect()))


def test_formats_written_one_by_one_give_the_same_rows(spark):
    """a job a format; what is left to plan is a scan."""
    payloads, dims = QF.landed_store(spark, SMALL).read(spark, 1), QN.dims(spark, SMALL)
    kinds = ["greenhouse", "lever", "workday"]
    whole = N.normalize_all(payloads, dims, types=kinds)
    parts, jobs = jobs_of(spark, "by-format", lambda: N.normalize_all(payloads, dims, types=kinds, written=True))
    assert jobs >= 3 and parts.columns == whole.columns
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    left = parts._jdf.queryExecution().optimizedPlan().toString()
    assert left.startswith("Relation") and len(left.splitlines()) == 1, left
    assert "Union" not in QF.normalize_all(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_with_a_cache_fetches_format_by_format(spark, monkeypatch):
    """of the fetched postings the driver plans one format at a time."""
    seen_plans, write = [], FL.staged_parts

    def spy(spark, parts, name):
        def noted():
            for p in parts:
                seen_plans.append(p._jdf.queryExecution().analyzed().toString())
                yield p
        return write(spark, noted(), name)

    monkeypatch.setattr(FL, "staged_parts", spy)
    run, _ = QF._full_run(spark, SMALL)
    assert len(seen_plans) == len(N.registry()) and all("place" in p for p in seen_plans)
    of = [set(re.findall(r"format#\d+ = (\w+)", p)) for p in seen_plans]  # greenhouse is read as written before its ladder
    assert of == [{kind} if kind != "greenhouse" else set() for kind in N.registry()]
    assert run.snapshot.count() > 0


def test_the_ladder_makes_descriptions_once(spark):
    """the expression of the description stood in the plan for each question asked about it."""
    gh = N.normalize_greenhouse(QN.greenhouse_pages(spark, SMALL), QN.dims(spark, SMALL))
    size = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (
        gh, N.description_ladder(gh, QN.ladder_pages(spark, SMALL)))]
    assert size[1] < 5 * size[0], size
