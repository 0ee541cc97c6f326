"""Operator 1: near-duplicate detection by SimHash with deletion-variant signatures.

Fingerprints are 64 bits. To find all pairs that differ in at most ``max_bits``
bits, the fingerprint is cut into so few segments that some segment differs in
at most one bit: ``max_bits // 2 + 1`` (three for four bits). Each segment is
indexed once per bit with that bit wiped out (the wildcard). Two segments that
differ in at most one bit share at least one such variant, so an equality
grouping on (segment, wildcard, remaining bits) meets every pair; each meeting
is verified on the whole fingerprint.

Scale. Texts never move: only distinct fingerprints (one row for all exact
copies) are indexed. A bucket never emits its pairs: a search outwards from
already linked members yields at most one link per member, which keeps exactly
the connectivity of all verified pairs. Buckets are read in blocks of bounded
size from a sorted partition; the blocks of an over-full bucket are then compared
pairwise in tasks of their own, so no task holds a whole hot bucket. Components
come from large-star / small-star rounds of aggregates and joins, written to
the shared folder; nothing about all documents reaches the driver.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows share a fingerprint and thus a component; a component
whose ids are all null has a null component id, null ids are otherwise ignored
in the minimum; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, pa, text_bytes, written

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    """SimHash of the lower-cased words' shingles, repeats included (unsigned)."""
    words = text.lower().split()  # bytes: lowers A-Z, cuts at space and \t \n \v \f \r only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)  # one shingle: every set bit is in over half
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start, end = end[:n - shingle + 1] - size[:n - shingle + 1], end[shingle - 1:]
    total, votes = n - shingle + 1, np.zeros(64, np.int64)
    for i in range(0, total, _CHUNK):
        pairs = zip(start[i:i + _CHUNK].tolist(), end[i:i + _CHUNK].tolist())
        h = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprints(text: Column | str, shingle: int = 4) -> Column:
    """Fingerprint column (a signed long with the fingerprint's bits)."""

    @arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [fingerprint(t or b"", shingle) for t in texts.to_pylist()]
            yield pa.array(np.array(got, np.uint64).view(np.int64))

    return simhash(text_bytes(text))


# ---- candidate index -------------------------------------------------------

def segments(max_bits: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs in at most one bit."""
    m = max_bits // 2 + 1
    cut = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def variant_key(fp: np.ndarray, variant: np.ndarray, segs: list[tuple[int, int]]) -> np.ndarray:
    """Segment of each fingerprint with its wildcard bit wiped, tagged with the variant."""
    shift = np.concatenate([np.full(w, s) for s, w in segs]).astype(np.uint64)[variant]
    width = np.concatenate([np.full(w, w) for s, w in segs]).astype(np.uint64)[variant]
    bit = np.concatenate([np.arange(w) for s, w in segs]).astype(np.uint64)[variant]
    one = np.uint64(1)
    part = (fp >> shift) & ((one << width) - one) & ~(one << bit)
    return (part << np.uint64(6)) | variant.astype(np.uint64)


def _key_column(fp: Column, variant: Column, segs: list[tuple[int, int]]) -> Column:
    """``variant_key`` as a Spark expression (segments are under 58 bits wide)."""
    key, first = None, 0
    for s, w in segs:
        part = F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        bit = F.expr(f"shiftleft(1L, cast(variant - {first} as int))")
        here = part.bitwiseAND(F.bitwise_not(bit))
        key = F.when(variant < first + w, here) if key is None else key.when(variant < first + w, here)
        first += w
    return F.shiftleft(key, 6).bitwiseOR(variant.cast("long"))


def spanning_links(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (indices) that connect exactly what all pairs within ``max_bits``
    connect: a search from each linked member over the members not yet reached."""
    n, links = fp.size, []
    if n <= 64 and not (np.triu(np.bitwise_count(fp[:, None] ^ fp) <= max_bits, 1)).any():
        return links
    rest = np.arange(n)
    while rest.size > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= max_bits
            if near.any():
                hit = rest[near]
                links += [(at, int(j)) for j in hit]
                queue += hit.tolist()
                rest = rest[~near]
    return links


def _groups(batches: Iterator[pa.RecordBatch], key_of, block: int):
    """Fingerprints of equal keys from a sorted stream, at most ``block`` at a
    time: (key, number of the block, fingerprints)."""
    key, held, no = None, [], 0
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        keys = key_of(batch, fp)
        if not keys.size:
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [keys.size]))
        # keys that begin and end within the batch and occur once can hold no link
        alone = (ends - starts == 1)
        alone[0] = alone[-1] = False
        for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist()):
            k = keys[a]
            if key is None or k != key:
                if held:
                    yield key, no, np.concatenate(held)
                key, held, no = k, [], 0
            have = sum(x.size for x in held)
            while have + (b - a) > block:
                take = block - have
                held.append(fp[a:a + take])
                yield key, no, np.concatenate(held)
                a, held, have, no = a + take, [], 0, no + 1
            if b > a:
                held.append(fp[a:b].copy())
    if held:
        yield key, no, np.concatenate(held)


_OUT = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("no", pa.int32())])
_OUT_SQL = "kind tinyint, a bigint, b bigint, no int"


def _emit(rows: list[tuple[int, np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    if rows:
        cols = (np.concatenate([np.full(len(a), k, np.int8) for k, a, _, _ in rows]),
                np.concatenate([a for _, a, _, _ in rows]), np.concatenate([b for _, _, b, _ in rows]),
                np.concatenate([np.full(len(a), n, np.int32) for _, a, _, n in rows]))
        yield pa.record_batch([pa.array(c) for c in cols], schema=_OUT)


def _link_arrays(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    if fp.size == 2:  # by far the most frequent case
        if fp[0] != fp[1] and (int(fp[0]) ^ int(fp[1])).bit_count() <= max_bits:
            return fp[:1].view(np.int64), fp[1:].view(np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.array(spanning_links(fp, max_bits), np.int64).reshape(-1, 2)
    signed = fp.view(np.int64)
    return signed[at[:, 0]], signed[at[:, 1]]


def links(prints: DataFrame, max_bits: int = 4, block: int = 16384) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect
    all pairs within ``max_bits`` bits. ``block`` bounds what a task holds of a
    bucket; buckets beyond it are compared block by block."""
    segs = segments(max_bits)
    variants = F.explode(F.sequence(F.lit(0), F.lit(sum(w for _, w in segs) - 1))).alias("variant")
    key = _key_column(F.col("fp"), F.col("variant"), segs)  # evaluated by exchange and sort, not shipped
    index = prints.select("fp", variants).repartition(key).sortWithinPartitions(key)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of = lambda batch, fp: variant_key(fp, batch.column("variant").to_numpy(zero_copy_only=False), segs)
        rows, held = [], 0
        for k, no, fp in _groups(batches, key_of, block):
            a, b = _link_arrays(fp, max_bits)
            if a.size:
                rows.append((0, a, b, 0))
            if no or fp.size == block:  # perhaps one block of several: they meet later
                rows.append((1, np.full(fp.size, np.uint64(k).view(np.int64)), fp.view(np.int64), no))
            held += a.size + (fp.size if no or fp.size == block else 0)
            if held > 20_000:
                yield from _emit(rows)
                rows, held = [], 0
        yield from _emit(rows)

    found = written(index.mapInArrow(first_pass, _OUT_SQL), "simhash-links")
    here = found.filter("kind = 0").select("a", "b")
    blocks = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "no")
    counts = blocks.groupBy("key").agg((F.max("no") + 1).alias("n")).filter("n > 1")
    if counts.isEmpty():
        return here
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    pairs = (blocks.join(counts, "key").select("key", "fp", "no", others).filter("no != other")
             .select("fp", F.col("key"), F.least("no", "other").alias("i"), F.greatest("no", "other").alias("j"))
             .withColumn("pair", F.xxhash64("key", "i", "j"))
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("fp", "pair"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of = lambda batch, fp: batch.column("pair").to_numpy(zero_copy_only=False)
        for _, _, fp in _groups(batches, key_of, 2 * block):
            a, b = _link_arrays(fp, max_bits)
            if a.size:
                yield from _emit([(0, a, b, 0)])

    return here.unionAll(written(pairs.mapInArrow(second_pass, _OUT_SQL), "simhash-blocks").select("a", "b"))


# ---- components ------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge.

    Large-star and small-star rounds: every step is an aggregate per node
    (map-side combined, so a node with very many neighbours costs one row per
    map task) and a join with one row per node; repeats until no edge changes.
    Each round is written to the shared folder."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e = written(e, "components")
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low2.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = written(small, "components")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.countDistinct("u")).first()
        if now == before and now[0] == now[2]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, block: int = 16384) -> DataFrame:
    """(doc_id, fp, root, component_id): every row with its fingerprint, the
    representative fingerprint of its component and the component's smallest id."""
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")),
                     "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct, max_bits, block))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "simhash-roots")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every component, with all its columns: the one with the
    smallest id (a null id counts as larger than any); of rows that share that
    id, one is kept."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("first")), "simhash-ids")
    names = [f"`{c}`" for c in docs.columns]
    ident = F.col(f"d.`{id_col}`")
    # an id that names one row decides it; hashed by id on both sides at every
    # size: only the ids are built into a table, texts are not sorted
    once = ids.filter("n = 1 AND first AND doc_id IS NOT NULL").select("doc_id").hint("shuffle_hash")
    kept = docs.alias("d").join(once.alias("k"), ident == F.col("k.doc_id"), "left_semi").select(
        *[F.col(f"d.{c}") for c in names])
    again = ids.filter("first AND (n > 1 OR doc_id IS NULL)").select("doc_id")
    if again.isEmpty():
        return kept
    # rows without an id or with a repeated one: their fingerprint tells the component
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("d"),
                       fingerprints(F.col(f"`{text_col}`"), options.get("shingle", 4)).alias("fp"))
    rows = rows.join(again.alias("k"), ident.eqNullSafe(F.col("k.doc_id")), "left_semi")
    classes = found.select("fp", "root", "component_id").distinct()
    picked = rows.join(classes, "fp").filter(ident.eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return kept.unionAll(picked.select(*[F.col(f"d.{c}") for c in names]))
