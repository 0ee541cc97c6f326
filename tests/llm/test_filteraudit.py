"""The filter audit against running every order over the documents."""

import itertools
import re

import pytest

from postwise.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """The failed letters of every row (doc_id, text, source)."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append({a for a, bad in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search("[#$%&*|]", t) is not None),
            ("E", i is not None and i > smallest[t])) if bad})
    return out


def plain(rows, marks):
    """All orders run over the rows; ``marks`` is {doc_id: (good, toxic)}."""
    fails, out = failed(rows), []
    for part in {r[2] or "" for r in rows}:
        own = [(f, *marks.get(r[0], (0, 0))) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shapley[letter] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone),
                            sum(letter in x[0] for x in own) - len(gone), sum(x[0] == {letter} for x in own),
                            sum(x[1] for x in gone), sum(x[2] for x in gone)])
        for r in out:
            if r[0] == part:
                r.append(shapley[r[1][r[2] - 1]])
    return {tuple(r) for r in out}


def audited(docs, labels):
    return {tuple(r) for r in filteraudit.audit_documents(docs, labels).collect()}


def test_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (2, 1, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"),
                                    (6, None, 1, "x"), (7, 1, None, "x")], "doc_id long, quality int, toxic int, mask string")
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    marks = {1: (1, 1), 2: (1, 1), 6: (0, 1), 7: (1, 0)}
    want = plain(rows, marks)
    assert audited(odd_docs, labels) == want and len(want) == 600 * len({r[2] or "" for r in rows})


def test_copies_over_parts_and_a_hot_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "abc"[i % 3]) for i in range(300)] + [(7, text, "b"), (0, text, "c"), (None, text, "a")]
    rows += [(1000 + i, f"{text} {i} # {'X' * (i % 40)}", "a") for i in range(100)] + [(2000, None, None), (1999, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(1100)], "doc_id long, quality int, toxic boolean")
    labels = labels.selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    assert audited(docs, labels) == plain(rows, {i: (i % 2, int(i % 5 == 0)) for i in range(1100)})


def test_all_documents(spark, docs, labels):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    marks = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in labels.collect()}
    assert audited(docs, labels) == plain(rows, marks)


def test_no_documents(spark, no_docs, labels):
    assert audited(no_docs, labels) == set()
    assert audited(no_docs, labels.limit(0)) == set()


@pytest.mark.parametrize("letters", ["", "X", "ABCDEF"])
def test_prefixes(spark, letters):
    n = len(letters)
    got = filteraudit.prefixes(spark, letters).where("mask = 0") if letters else None
    if letters:
        want = {"".join(p) for k in range(1, n + 1) for p in itertools.permutations(letters, k)}
        rows = got.collect()
        assert len(rows) == len(want) and {r.prefix for r in rows} == want
        assert all(r.applied == r.before | r.bit == sum(1 << letters.index(a) for a in r.prefix) for r in rows)


def test_names_of_filters(spark):
    for bad in ("ABCDEFG", "AA", "A'"):
        with pytest.raises(ValueError):
            filteraudit.prefixes(spark, bad)
