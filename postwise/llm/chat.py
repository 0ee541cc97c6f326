"""Reply trees as training conversations, JVM-side throughout.

A message names the message it replies to. Every path from a root to a leaf (a
message without replies) is a branch. Iterative self-joins of the narrow
(message, ancestor) table find the branches: in round k a message's ancestor
2^k steps up is joined to that ancestor's own one, so a tree of depth D takes
about log2 D rounds; the same tables, from the widest step to the narrowest, then
enumerate all ancestors of the leaves. Only ids move here; texts are joined to
the chosen branches once. Each round is written to the shared folder.

Branches are ranked by the sum of their messages' scores, and each chosen one is
formatted as a conversation: a list of pieces, each with its loss flag. Their
concatenation is the formatted text. A branch is one row, so its texts must fit
in one row (2 GB); nothing else is collected per key.

Markup. A turn is ``[INST] text [/INST]`` (user), ``[SYS] text [/SYS]`` (system),
``<s> text </s>`` (assistant) or ``[ROLE] role [AS] text [/ROLE]``. The control
strings inside a text get one backslash after their first character, those that
have n backslashes there one more, so a text never holds a control string and
``unescape`` gives it back exactly.

Defined results: null texts and roles are empty, null scores 0. A reply to a
message that doesn't exist is a root. Messages on or below a cycle of replies
have no root: each is a branch of its own. Of rows with the same id the first by
(parent, role, text, score) counts; a row without id gets one from its content.
An empty table gives no branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The control strings of the template (fixed values): <s> </s> [INST] [/INST] [SYS] [/SYS] [ROLE] [/ROLE] [AS]
_CONTROL = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])"
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<s> ", " </s>")}
_OTHER = ("[ROLE] ", " [AS] ", " [/ROLE]")
_TURN = (r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|<s> .*? </s>"
         r"|\[ROLE\] .*? \[AS\] .*? \[/ROLE\]")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def turn_pieces(role: Column, text: Column) -> Column:
    """The pieces of one turn: (text, loss); loss is true for assistant texts only."""
    def piece(t: Column, loss: bool) -> Column:
        return F.struct(t.alias("text"), F.lit(loss).alias("loss"))

    body = escape(text)
    whole = F.concat(F.lit(_OTHER[0]), escape(role), F.lit(_OTHER[1]), body, F.lit(_OTHER[2]))
    for name in ("user", "system"):
        whole = F.when(role == name, F.concat(F.lit(_MARKS[name][0]), body, F.lit(_MARKS[name][1]))).otherwise(whole)
    start, end = _MARKS["assistant"]
    return F.when(role == "assistant", F.array(piece(F.lit(start), False), piece(body, True), piece(F.lit(end), False))
                  ).otherwise(F.array(piece(whole, False)))


def _whole_rows(messages: DataFrame, unique_ids: bool) -> DataFrame:
    """(id, parent, role, text, score), one row an id, without nulls but in parent."""
    empty = F.lit("")
    rows = messages.select(
        F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
        F.coalesce(F.col("score").cast("decimal(28,9)"), F.lit(0)).alias("score"))
    if unique_ids:
        return rows
    content = F.sha2(F.concat_ws("\n", "parent", "role", "text", F.col("score").cast("string")), 256)
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("without id "), content)))
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return rows.groupBy("id").agg(first).select("id", "m.*")


def branches(links: DataFrame) -> DataFrame:
    """(leaf, node, up) for every branch and message of it; ``up`` counts the steps
    from the leaf to the message. ``links`` is (id, parent), one row an id."""
    links = written(links.select("id", "parent"), "chat-links")
    ids = links.select(F.col("id").alias("parent"))
    hop = written(links.join(ids, "parent", "left_semi").select("id", F.col("parent").alias("up")), "chat-hop")
    hops, left = [], hop.count()
    while left:
        hops.append(hop)
        twice = hop.alias("a").join(hop.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", "b.up")
        hop, before = written(twice, "chat-hop"), left
        left = hop.count()
        if left == before:  # all that is left never comes to an end
            break
    leaves = links.join(hops[0].select(F.col("up").alias("id")), "id", "left_anti") if hops else links
    endless = hop.select("id") if left else None
    walk = leaves.join(endless, "id", "left_anti") if left else leaves
    walk = walk.select(F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in range(len(hops) - 1, -1, -1):
        step = hops[k].select(F.col("id").alias("node"), F.col("up").alias("far"))
        here = F.struct("node", "up")
        there = F.struct(F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        both = F.when(F.col("far").isNull(), F.array(here)).otherwise(F.array(here, there))
        walk = walk.join(step, "node", "left").select("leaf", F.explode(both).alias("w")).select("leaf", "w.*")
    if left:
        alone = endless.select(F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("up"))
        walk = walk.unionByName(alone)
    return written(walk, "chat-branches")


def format_trees(messages: DataFrame, *, keep: int = 1, unique_ids: bool = False) -> DataFrame:
    """(tree, rank, leaf, score, n_turns, pieces): the ``keep`` best branches of every
    tree of ``messages`` (id, parent, role, text, score), each as one conversation.
    ``tree`` is the root's id; branches with equal scores are ordered by their leaf's id."""
    rows = _whole_rows(messages, unique_ids)
    walk = branches(rows.select("id", "parent"))
    scored = walk.join(rows.select(F.col("id").alias("node"), "score"), "node")
    sums = scored.groupBy("leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"),
                                      F.max_by("node", "up").alias("tree"))
    # a limit on row_number is applied before the shuffle as well, so a large tree sends few rows
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    turns = (walk.join(chosen.select("leaf"), "leaf", "left_semi")
             .join(rows.select(F.col("id").alias("node"), "role", "text"), "node")
             .select("leaf", "up", turn_pieces(F.col("role"), F.col("text")).alias("p")))
    texts = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("up", "p")), asc=False).alias("t"))
    texts = texts.select("leaf", F.flatten(F.transform("t", lambda x: x["p"])).alias("pieces"))
    return chosen.join(texts, "leaf").select("tree", "rank", "leaf", F.col("score").cast("double").alias("score"),
                                             "n_turns", "pieces")


def formatted(pieces: Column) -> Column:
    """The text of a conversation."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def read_turns(text: Column) -> Column:
    """The turns (role, text) read back from a formatted text."""
    def inner(t: Column, start: str, end: str) -> Column:
        return t.substr(F.lit(len(start) + 1), F.length(t) - (len(start) + len(end)))

    def turn(t: Column) -> Column:
        def struct(role: Column, body: Column) -> Column:
            return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

        parts = F.split(inner(t, _OTHER[0], _OTHER[2]), r" \[AS\] ", 2)
        found = struct(parts[0], parts[1])
        for name, (start, end) in _MARKS.items():
            found = F.when(t.startswith(start), struct(F.lit(name), inner(t, start, end))).otherwise(found)
        return found

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), turn)


def reply_chain(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): every turn
    replies to the one before. Equal turns are ordered by role and text, null
    first; rows without conv_id are one conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("hash"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("hash", F.sha2("text", 256))
    rows = rows.withColumn("at", F.row_number().over(order))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return rows.select(F.concat(conv, F.lit(":"), F.col("at")).alias("id"),
                       F.when(F.col("at") > 1, F.concat(conv, F.lit(":"), F.col("at") - 1)).alias("parent"),
                       "role", "text", F.lit(None).cast("double").alias("score"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Digests of all conversations, read back from the written conversations."""
    made = format_trees(reply_chain(turns), keep=1, unique_ids=True)
    back = written(made.select("tree", "pieces"), "chat-conversations")
    conv = F.expr("CAST(nullif(substring_index(tree, ':', 1), '') AS BIGINT)")
    back = back.select(conv.alias("conv_id"), formatted(F.col("pieces")).alias("whole"),
                       loss_text(F.col("pieces")).alias("loss"))
    back = back.withColumn("turns", read_turns(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("whole").cast("long").alias("formatted_chars"))
