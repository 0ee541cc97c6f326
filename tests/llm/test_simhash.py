"""SimHash classes against brute force."""
import re

import numpy as np
import pytest
import xxhash

from postwise.llm import simhash
from postwise.llm.queries import QUERIES

from .conftest import SF


def brute_print(text, shingle=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, max_bits=4):
    """Fingerprint -> set of fingerprints reachable over links."""
    fps = sorted(set(prints))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = brute_classes([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)


def test_query_on_all_documents(spark, docs):
    got = sorted((tuple(r) for r in QUERIES["op1_simhash"](spark, SF).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(odd_docs)
    got = found.select("doc_id", simhash.hex_fingerprint(found.fp), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_row_of_each_component(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.select("doc_id", "text").collect()
    root = brute_classes([brute_print(r.text) for r in rows])
    got = kept.select("doc_id", "text").collect()
    assert sorted(root[brute_print(r.text)] for r in got) == sorted({root[brute_print(r.text)] for r in rows})
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert simhash.keep_one(no_docs).count() == 0


def test_segments_guarantee_one_bit():
    for bits in range(9):
        segs = simhash.segments(bits)
        assert sum(w for _, w in segs) == 64 and bits // len(segs) <= 1


@pytest.mark.parametrize("block", [4, 50, 16384])
def test_links_connect_like_all_pairs(spark, block):
    """A dense cluster, chains of links and random prints, also with buckets far
    beyond the block size."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    prints = {0, (1 << 64) - 1, base}
    for _ in range(150):  # copies around one print, up to nine bits away
        prints.add(base ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 10))}))
    step = int(rng.integers(1 << 62))
    for k in range(12):  # a chain: neighbours four bits apart
        prints.add(step)
        step ^= 0b1111 << (4 * k)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df, 4, block)).collect()}
    want = brute_classes(prints)
    groups, mine = {}, {}
    for p in prints:
        groups.setdefault(want[p], set()).add(p)
        mine.setdefault(roots.get(p, p - (1 << 64) if p >= 1 << 63 else p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert set(got.values()) == {0, 1000, 5000} and len(got) == 201 + 300 + 2
    assert simhash.components(df.limit(0)).count() == 0
