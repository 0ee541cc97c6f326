"""Property tests: the scalable operator shapes agree with brute force on random
small tables (random keys with heavy repetition, random partition counts)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postwise.operators import dedup as W
from postwise.operators import ranking as O

ROWS = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["", "a", "b", "c", "hot", "hot", "hot"])),
                min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows, parts):
    data = [(i, score, url) for i, (score, url) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, score int, job_url string").repartition(parts)


@SETTINGS
@given(rows=ROWS, parts=st.integers(1, 9))
def test_global_rank_matches_sorting(spark, rows, parts):
    df = frame(spark, rows, parts)
    got = {r.seq: r["rank"] for r in O.rank_by_score(df).collect()}
    want = sorted(((-s, u, i) for i, (s, u) in enumerate(rows)))
    assert got == {i: k + 1 for k, (_, _, i) in enumerate(want)}


@SETTINGS
@given(rows=ROWS, parts=st.integers(1, 9))
def test_first_per_url_matches_first_occurrence(spark, rows, parts):
    df = frame(spark, rows, parts)
    got = sorted(r.seq for r in W.dedup_first_by_url(df).collect())
    first = {}
    for i, (_, u) in enumerate(rows):
        if u and u not in first:
            first[u] = i
    assert got == sorted(first.values())


@SETTINGS
@given(rows=ROWS, parts=st.integers(1, 9))
def test_last_per_key_matches_last_occurrence(spark, rows, parts):
    df = frame(spark, rows, parts)
    got = sorted(r.seq for r in W.dedup_last_by_key(df, "job_url").collect())
    last = {}
    for i, (_, u) in enumerate(rows):
        if u:
            last[u] = i
    assert got == sorted(last.values())
