"""Operator 7: exact top-k inner-product search in tiles.

Queries are cut into tiles and candidates into shards; each (tile, shard) cell is
one stream of a task: the tile's queries first, then the shard's candidates in
blocks. A block is a matrix product, of which only each query's best k scores
survive (partial selection); the lists of a query are then merged in a tree, a
few shards at a time, until one list is left.

Rows sent: candidates once per tile and queries once per shard; both counts are
chosen so that a tile and a block fit a bounded amount of memory, whatever the
number of rows. No pairs are emitted, only k rows per query and cell.

Scores are exact integers: products run in doubles while every partial sum is
below 2^53, else in Python integers. A score beyond 64 bits is held at the limit.

Defined results: vectors that are null or hold a null or non-finite component
take no part; vectors of different length are not compared; a null id takes no
part; rows that repeat a query's id are its own and not its candidates, and it is
searched once, with the smallest of its vectors; repeated candidates each count; ties go to the smaller id; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from .common import Column, DataFrame, F, pa

_EXACT = 1 << 53
_LIMIT = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a score matrix (queries x candidates): (query row, candidate id, score)
    of each query's k best, ties to the smaller id, its own id left out."""
    rows, got_ids, got = [], [], []
    mine = own[:, None] == ids[None, :]
    for i in range(len(scores)):
        s, keep = scores[i], ~mine[i]
        if keep.sum() > k:
            least = np.partition(s[keep], -k)[-k]  # the k-th best score
            keep &= s >= least
        at = np.flatnonzero(keep)
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        rows.append(np.full(at.size, i))
        got_ids.append(ids[at])
        got.append(s[at])
    return np.concatenate(rows), np.concatenate(got_ids), np.concatenate(got)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list column without nulls."""
    return np.diff(np.asarray(col.offsets)), np.asarray(col.flatten(), float)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, tile_queries: int = 4096, shard_rows: int = 32768, fan_in: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query."""
    vec = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", F.transform(F.col("v").cast("array<double>"),
                                             lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"), "q")
    n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    tiles, shards = max(1, math.ceil(n[1] / tile_queries)), max(1, math.ceil(n[0] / shard_rows))
    place = F.xxhash64("vec_id")
    tile_no = F.pmod(place, F.lit(tiles))
    # repeated rows of one id part by the file they come from
    shard_no = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(shards))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asked.select(tile_no.cast("int").alias("tile"), every(shards).alias("shard"),
                                      F.lit(0).alias("kind"), "vec_id", "v")
    cands = rows.select(every(tiles).alias("tile"), shard_no.cast("int").alias("shard"),
                        F.lit(1).alias("kind"), "vec_id", "v")
    cells = queries.unionByName(cands).repartition(tiles * shards, "tile", "shard").sortWithinPartitions(
        "tile", "shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tile, lists = None, {}, {}
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1).astype(np.int64)
            ids, (lengths, flat) = np.asarray(batch.column(3)).astype(np.int64), _matrix(batch.column(4))
            ends = np.cumsum(lengths)
            # runs of equal (tile, shard, kind, length)
            marks = np.column_stack((keys, lengths))
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1 if len(marks) > 1 else np.array([], int)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if a == b:
                    continue
                here, d = (int(keys[a, 0]), int(keys[a, 1])), int(lengths[a])
                if here != cell:
                    yield from _finish(cell, lists)
                    cell, tile, lists = here, {}, {}
                m = flat[ends[a] - d:ends[b - 1]].reshape(b - a, d)
                if keys[a, 2] == 0:
                    tile.setdefault(d, []).append((ids[a:b], m))
                    continue
                if d not in tile:
                    continue
                if isinstance(tile[d], list):
                    tile[d] = tuple(np.concatenate(x) for x in zip(*tile[d]))
                own, q = tile[d]
                for i in range(0, b - a, 2048):
                    for j in range(0, len(own), 1024):
                        c_ids = ids[a + i:min(a + i + 2048, b)]
                        r, got_ids, got = best(_products(q[j:j + 1024], m[i:i + 2048]), c_ids, own[j:j + 1024], k)
                        lists.setdefault((d, j), []).append((own[j:j + 1024][r], got_ids, got))
                        if len(lists[d, j]) >= 16:
                            lists[d, j] = [_merge(lists[d, j], k)]
        yield from _finish(cell, lists)

    def _finish(cell, lists) -> Iterator[pa.RecordBatch]:
        for part in lists.values():
            q, c, s = _merge(part, k)
            yield pa.record_batch([pa.array(np.full(len(q), cell[1], np.int32)), pa.array(q), pa.array(c), pa.array(s)],
                                  names=["shard", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(search, "shard int, query_id long, vec_id long, score long")
    return merge_lists(found, shards, k, fan_in)


def _merge(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each query in several lists."""
    q, c, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if q.size else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(q.size), 0)) if q.size else np.zeros(0, int)
    keep = np.arange(q.size) - start < k
    return q[keep], c[keep], s[keep]


def merge_lists(found: DataFrame, shards: int, k: int, fan_in: int) -> DataFrame:
    """Tree merge: ``fan_in`` shards at a time, so no group exceeds fan_in * k rows."""
    entry = F.struct((-F.col("score")).alias("neg"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    lists = found.groupBy("query_id", "shard").agg(F.collect_list(entry).alias("l"))
    lists = lists.select("query_id", "shard", F.slice(F.array_sort("l"), 1, k).alias("l"))
    while shards > 1:
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / fan_in).cast("int").alias("shard")).agg(
            F.collect_list("l").alias("l"))
        lists = lists.select("query_id", "shard", F.slice(F.array_sort(F.flatten("l")), 1, k).alias("l"))
        shards = math.ceil(shards / fan_in)
    each = lists.select("query_id", F.posexplode("l").alias("p", "e"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
                       F.col("e.score").alias("score"))
