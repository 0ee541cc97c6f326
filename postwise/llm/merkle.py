"""Merkle manifest of a dataset: a ternary tree per group, and one over the groups.

The leaves of a group ascend by key. While several nodes remain, every three
consecutive ones become the hash of their digests; what remains is the group's
subroot, and the subroots, in the order of their groups, give the root likewise.

The rank of a leaf is written in base 3. Its digits are columns, and the rollup
groups them away one after another, lowest digit first: each ``groupBy`` nests
the up to three children of a node in their parent's struct. This happens within
blocks of 3^BLOCK_LEVELS leaves, so a nested row is bounded; a block is one hash
partition key, and all groupings of a layer share one shuffle. The blocks' digests
are the leaves of the next layer. Proofs are emitted by ``transform`` from the
nested structs and one ``explode``, without joining leaves to siblings. Only a
block's own path, one row per block, is attached to its nested row by a join.

Ranks come from a range-partitioned sort of (group, key, digest), numbered within
its partitions and shifted by the partitions' counts, so a group of any size is
spread over many tasks and no window runs over a group.

Defined results: fields that are null count as ``-``, a null group is a group of
its own and the first; rows with equal or null keys (null first) stand in the
order of their digests, equal rows in any order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_text, written

FANOUT = 3
#: Levels nested in one row: blocks of 3^6 = 729 leaves.
BLOCK_LEVELS = 6
_PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def record_text(fields: Sequence[Column]) -> Column:
    """The fields in one text: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    values = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                      for v in values])


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position``: 0, 1, 2, ... in the order of the columns, nulls first.

    A range-partitioned sort is written once with the row's place in its partition;
    the partitions' counts (one row each) give the offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(sorted_.withColumn("place", F.monotonically_increasing_id()), "positions")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # one row per partition of the sort, whatever the number of rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return (placed.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("position", F.col("offset") + row).drop("offset", "place"))


def _levels(total: Column, most: int) -> Column:
    """Levels above ``total`` nodes: the least L with 3^L >= total, at most ``most``."""
    return sum((F.when(total > FANOUT ** i, 1).otherwise(0) for i in range(most)), F.lit(0))


def rollup(nodes: DataFrame, block_levels: int) -> DataFrame:
    """Blocks of a layer: (gid, block, total, levels, digest, kids) from nodes
    (gid, idx, total, digest, item). ``kids`` nests ``block_levels`` levels; levels a
    small group doesn't have hold a single child and pass its digest on."""
    b = block_levels
    rows = nodes.select(
        "gid", F.expr(f"idx div {FANOUT ** b}").alias("block"), "total",
        _levels(F.col("total"), b).alias("levels"),
        *[F.pmod(F.expr(f"idx div {FANOUT ** i}"), F.lit(FANOUT)).cast("int").alias(f"d{i}") for i in range(b)],
        "digest", F.col("item").alias("kids"))
    rows = rows.repartition("gid", "block")
    for i in range(b):
        above = [f"d{j}" for j in range(i + 1, b)]
        rows = rows.groupBy("gid", "block", "total", "levels", *above).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "digest", "kids"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        rows = rows.withColumn("digest", F.when(F.col("levels") > i, digest(joined))
                               .otherwise(F.col("kids")[0]["digest"]))
    return rows.select("gid", "block", "total", "levels", "digest", "kids")


def _emit(kids: Column, level: int, levels: Column, path: Column) -> Column:
    """The leaves below ``kids``, each with its path: one (before, after) pair of
    sibling digests a level, lowest level first."""
    def below(k: Column) -> Column:
        def side(keep) -> Column:
            return F.array_join(F.transform(F.filter(kids, keep), lambda x: x["digest"]), "")

        step = F.struct(side(lambda x: x["d"] < k["d"]).alias("before"), side(lambda x: x["d"] > k["d"]).alias("after"))
        own = F.when(levels > level, F.concat(F.array(step), path)).otherwise(path)
        if level == 0:
            return F.array(F.struct(k["digest"].alias("digest"), k["kids"].alias("item"), own.alias("path")))
        return _emit(k["kids"], level - 1, levels, own)

    return F.flatten(F.transform(kids, below))


def _paths(blocks: DataFrame, block_levels: int, above: Column) -> DataFrame:
    leaves = _emit(F.col("kids"), block_levels - 1, F.col("levels"), above)
    keep = [c for c in blocks.columns if c not in ("block", "total", "levels", "digest", "kids", "above")]
    return blocks.select(*keep, F.explode(leaves).alias("leaf")).select(*keep, "leaf.*")


def _tree(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """The layers of blocks over the nodes of every gid, lowest first."""
    layers = []
    while True:
        blocks = written(rollup(nodes, block_levels), "merkle-blocks")
        layers.append(blocks)
        largest = blocks.agg(F.max("total")).first()[0] or 0
        size = FANOUT ** block_levels
        if largest <= size:
            return layers
        nodes = blocks.select("gid", F.col("block").alias("idx"),
                              F.expr(f"(total + {size - 1}) div {size}").alias("total"), "digest",
                              F.col("block").alias("item"))


def manifest(leaves: DataFrame, *, group: str, key: str, carry: Sequence[str] = (),
             block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(group, key, carry..., leaf, subroot, root, path) of every row of ``leaves``
    (columns group, key, leaf, carry...). ``path`` holds a pair of sibling texts
    (before, after) a level, from the leaf to the root; see ``fold`` and ``proof``."""
    item = F.struct(F.col(group).alias("g"), F.col(key).alias("k"), F.struct(F.lit(0), *carry).alias("c"))
    placed = positions(leaves.select(F.col(group).alias("g"), F.col(key).alias("k"), "leaf", item.alias("item")),
                       "g", "k", "leaf")
    # a group stands in consecutive places: its first place and size, per partition of the sort
    runs = placed.groupBy("part", "g").agg(F.min("position").alias("lo"), F.count("*").alias("n"))
    groups = positions(runs.groupBy("g").agg(F.min("lo").alias("first"), F.sum("n").alias("total")), "first")
    groups = groups.select("g", "first", "total", F.col("position").alias("gid"))
    spans = (runs.alias("r").join(groups.alias("s"), F.expr("r.g <=> s.g"))
             .select("r.part", "r.g", "s.gid", "s.first", "s.total"))
    nodes = (placed.alias("p").join(spans.alias("s"), F.expr("p.part = s.part AND p.g <=> s.g"))
             .select("s.gid", (F.col("position") - F.col("first")).alias("idx"), "s.total",
                     F.col("leaf").alias("digest"), "item"))
    layers = _tree(nodes, block_levels)
    subroots = layers[-1].select("gid", F.col("digest").alias("subroot"))
    n_groups = groups.count()
    tops = _tree(subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"),
                                 F.lit(n_groups).cast("long").alias("total"), F.col("subroot").alias("digest"),
                                 F.col("gid").alias("item")), block_levels)
    # from the root down: every layer's blocks take the path of their own digest
    above = tops[-1].select("block", F.col("digest").alias("root"), F.lit(None).cast(_PATH).alias("path"))
    for blocks in reversed(tops):
        up = above.withColumnRenamed("path", "above")
        got = _paths(blocks.join(up, "block"), block_levels, F.coalesce("above", F.array().cast(_PATH)))
        above = got.select(F.col("item").alias("block"), "root", "path")
    above = (above.withColumnRenamed("block", "gid").join(subroots, "gid")
             .select("gid", F.lit(0).cast("long").alias("block"), "root", "subroot", "path"))
    for blocks in reversed(layers):
        up = above.select("gid", "block", "root", "subroot", F.col("path").alias("above"))
        got = _paths(blocks.join(up, ["gid", "block"]), block_levels, F.col("above"))
        above = got.withColumnRenamed("item", "block")
    return above.select(F.col("block.g").alias(group), F.col("block.k").alias(key),
                        *[F.col(f"block.c.{c}").alias(c) for c in carry],
                        F.col("digest").alias("leaf"), "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def proof(path: Column) -> Column:
    """All sibling digests of a path in one text, lowest level first."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): the leaf of every document, and that of its
    text without line breaks where 2 divides crc32(doc_id), else the same leaf."""
    fields = {c: F.col(c) for c in FIELDS}
    cut = fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    leaf, other = digest(record_text(list(fields.values()))), digest(record_text(list(cut.values())))
    changed = F.when(crc_text(F.col("doc_id")) % 2 == 0, other).otherwise(leaf)
    return docs.select("source", "doc_id", leaf.alias("leaf"), changed.alias("changed"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` per source, with every leaf folded again after
    tampering (see ``document_leaves``)."""
    leaves = written(document_leaves(docs), "merkle-leaves")
    got = manifest(leaves, group="source", key="doc_id", carry=["changed"])
    folded = got.withColumn("folded_root", fold(F.col("changed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
