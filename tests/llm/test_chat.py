"""Reply trees against a plain traversal, and the round trip of the markup."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm import chat

MESSAGE = "id string, parent string, role string, text string, score double"
TURN = "conv_id long, turn long, role string, text string, id string, up string, rank string, tree string"


def branches_of(messages):
    """{leaf: [ids from the root]} by walking up from every message without replies."""
    parent = {m[0]: m[1] if any(x[0] == m[1] for x in messages) else None for m in messages}
    found = {}
    for i in parent:
        path, at = [], i
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is not None:
            found[i] = [i]  # its parents never come to an end
        elif i not in parent.values():
            found[i] = path[::-1]
    return found


def random_tree(rng, n):
    rows = []
    for i in range(n):
        p = None if rng.random() < 0.1 else rng.choice(["missing", *(r[0] for r in rows)] or [None])
        rows.append((f"m{i}", p, rng.choice(["user", "assistant", "system", "tool", "", None]), f"text {i}", float(rng.randint(0, 3))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_branches_of_random_trees(spark, seed):
    rows = random_tree(random.Random(seed), 60)
    # a cycle of three with a reply that hangs from it, and a message that replies to itself
    rows += [("x", "z", "user", "x", 0.0), ("y", "x", "user", "y", 0.0), ("z", "y", "user", "z", 0.0),
             ("w", "x", "user", "w", 0.0), ("s", "s", "user", "s", 0.0)]
    links = spark.createDataFrame(rows, MESSAGE).select("id", "parent")
    got = {}
    for r in chat.branches(links).collect():
        got.setdefault(r.leaf, []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == branches_of(rows)


def test_ranks_and_texts_of_branches(spark):
    rows = random_tree(random.Random(5), 50)
    want, score = branches_of(rows), {r[0]: r[4] for r in rows}
    text = {r[0]: (r[2] or "", r[3]) for r in rows}
    trees = {}
    for leaf, path in want.items():
        trees.setdefault(path[0], []).append((-sum(score[i] for i in path), leaf))
    made = chat.format_trees(spark.createDataFrame(rows, MESSAGE), keep=2)
    got = made.withColumn("turns", chat.read_turns(chat.formatted(F.col("pieces")))).collect()
    assert {(r.tree, r["rank"], r.leaf, -r.score) for r in got} == {
        (t, k, leaf, s) for t, b in trees.items() for k, (s, leaf) in enumerate(sorted(b)[:2], 1)}
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [text[i] for i in want[r.leaf]]
        assert r.n_turns == len(want[r.leaf])


def test_a_long_chain_takes_few_rounds(spark):
    n = 1500
    rows = [(str(i), str(i - 1) if i else None, "assistant" if i % 2 else "user", f"t{i}", 1.0) for i in range(n)]
    got = chat.format_trees(spark.createDataFrame(rows, MESSAGE)).collect()
    assert len(got) == 1 and got[0].n_turns == n and got[0].score == n
    assert "".join(p.text for p in got[0].pieces if p.loss) == "".join(f"t{i}" for i in range(1, n, 2))


def test_repeated_and_missing_ids(spark):
    rows = [("a", None, "user", "first", None), ("a", None, "user", "second", None), ("b", "a", "assistant", "reply", 1.0),
            ("b", "a", "assistant", "reply", 1.0), (None, "a", "assistant", "no id", 2.0), (None, None, None, None, None)]
    got = chat.format_trees(spark.createDataFrame(rows, MESSAGE), keep=5)
    texts = {(r["rank"], chat_text(r)) for r in got.collect()}
    assert texts == {(1, "[INST] first [/INST]<s> no id </s>"), (2, "[INST] first [/INST]<s> reply </s>"),
                     (1, "[ROLE]  [AS]  [/ROLE]")}


def chat_text(row):
    return "".join(p.text for p in row.pieces)


def test_markup_gives_back_every_text(spark):
    rng = random.Random(3)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[AS]", "[/ROLE]", "<", "[", "\\", "<\\s>",
             "[\\\\/INST]", " ", "\n", "é", "😀", "$1", "s>", "INST]", "]", "x"]
    texts = ["", " ", "\\", *("".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(400))]
    roles = ["user", "assistant", "system", "", "tool", "[AS]", " [/ROLE]", "<s>"]
    rows = [(i // 4, i % 4, rng.choice(roles), t) for i, t in enumerate(texts)]
    made = chat.format_trees(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = made.select("tree", chat.formatted(F.col("pieces")).alias("w"), chat.loss_text(F.col("pieces")).alias("l"))
    got = {int(r.tree.split(":")[0]): r for r in got.withColumn("t", chat.read_turns(F.col("w"))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].t] == turns
        assert got[c].l == "".join(t for r, t in turns if r == "assistant")
    one = spark.createDataFrame([(t,) for t in texts], "t string")
    assert one.where(chat.unescape(chat.escape(F.col("t"))) != F.col("t")).count() == 0


ODD = [(1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 1, "assistant", "later"), (1, None, "system", "no turn"),
       (2, 5, None, "null role"), (2, 7, "assistant", "same"), (2, 7, "assistant", "same"), (3, 0, "", ""),
       (None, 1, "assistant", "no conversation"), (None, 0, "user", "first"), (4, 0, "assistant", "long " * 100_000)]


def test_conversations_with_odd_rows(spark):
    rows = [(*r, *["x"] * 4) for r in ODD]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, TURN)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None,
                         hashlib.sha256((t[3] or "").encode()).hexdigest())
        turns = [(t[2] or "", t[3] or "") for t in sorted((t for t in ODD if t[0] == c), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURN)).collect() == []


def test_main_path_has_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], T.StructType.fromDDL("conv_id long, turn long, role string, text string"))
    plan = chat.format_trees(chat.reply_chain(turns), unique_ids=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
