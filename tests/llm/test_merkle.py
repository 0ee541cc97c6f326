"""The Merkle manifest against a plain construction of the same trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postwise.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    """All levels of a ternary tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(tree, i):
    steps = []
    for nodes in tree[:-1]:
        run = nodes[i - i % 3:i - i % 3 + 3]
        steps.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        i //= 3
    return steps


def plain(rows):
    """{row: (subroot, root, path)} of rows (group, key, leaf)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        out += [(*r, trees[g][-1][0], top[-1][0], tuple(path_of(trees[g], i) + path_of(top, k)))
                for i, r in enumerate(groups[g])]
    return out


@pytest.mark.parametrize("block_levels, sizes", [(1, [1, 2, 3, 4, 28, 9]), (2, [82, 1, 27, 3]), (6, [90, 5])])
def test_manifest_equals_plain_trees(spark, block_levels, sizes):
    rng = random.Random(block_levels)
    names = [None, "é", "b", "", "a", "ab"]
    rows = [(names[g], rng.choice([None, 1, *range(n)]), H(str(rng.random()))) for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, leaf string")
    got = merkle.manifest(df, group="g", key="k", block_levels=block_levels)
    found = [(r.g, r.k, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def record(r):
    doc, text, lang, source, n = r
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text))


def check_documents(docs, got):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    changed = {}
    for r in rows:
        even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
        cut = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        changed[H(record(r))] = H(record((r[0], cut, *r[2:])))
    want = []
    for source, doc, leaf, subroot, root, path in plain([(r[3], r[0], H(record(r))) for r in rows]):
        folded = changed[leaf]
        for before, after in path:
            folded = H(before, folded, after)
        want.append((doc, leaf, subroot, root, H(*(b + a for b, a in path)), folded, folded == root))
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    return found


def test_odd_documents(spark, odd_docs):
    found = check_documents(odd_docs, merkle.verify_documents(odd_docs))
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_all_documents(spark, docs):
    check_documents(docs, merkle.verify_documents(docs))


def test_one_document_and_none(spark, odd_docs, no_docs):
    one = odd_docs.where("doc_id = 9")
    check_documents(one, merkle.verify_documents(one))
    assert merkle.verify_documents(no_docs).collect() == []


def test_a_changed_text_is_found(spark, docs):
    leaves = merkle.document_leaves(docs).withColumn("changed", F.when(F.col("doc_id") == 7, merkle.digest(F.lit("x")))
                                                     .otherwise(F.col("leaf")))
    got = merkle.manifest(leaves, group="source", key="doc_id", carry=["changed"])
    bad = got.where(merkle.fold(F.col("changed"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in bad.collect()] == [7]


def test_positions_are_those_of_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 10 ** 6)) for _ in range(3000)]
    got = merkle.positions(spark.createDataFrame(rows, "a long, b long").repartition(7), "a", "b")
    assert [(r.a, r.b) for r in got.orderBy("position").collect()] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.position for r in got.orderBy("position").collect()] == list(range(3000))
