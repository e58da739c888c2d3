"""Exact nearest vectors of many queries: blocks of queries meet blocks of vectors, each pair keeps what may be among the nearest, and these are merged once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries and vectors of a block, and vectors that are multiplied with all of a block's queries in one go.
QUERIES, VECTORS, CHUNK = 2048, 1 << 16, 2048
#: Decimals of a distance: order within them is by id, so that it doesn't depend on how sums were added up.
DECIMALS = 9


class _Best:
    """The nearest so far of one query: at most ``cap`` of a group and ``k`` in all, by distance, then id."""

    def __init__(self, k: int, cap: int | None):
        self.k, self.cap = k, cap
        self.distances, self.ids, self.groups = np.empty(0), None, None

    def add(self, distances: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> None:
        if len(self.distances) == self.k:
            # the list only gets nearer: what is further than its last can't enter
            near = distances <= self.distances[-1]
            distances, ids, groups = distances[near], ids[near], groups[near]
        if not len(distances):
            return
        if self.ids is not None:
            distances, ids, groups = np.concatenate([self.distances, distances]), np.concatenate([self.ids, ids]), np.concatenate([self.groups, groups])
        order = np.lexsort((ids, distances))
        if self.cap:
            # rank within the group: places of each group stand together in a stable sort
            by = np.argsort(groups[order], kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(groups[order][by]) != 0]))
            rank = np.empty(len(order), np.int64)
            rank[by] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            order = order[rank < self.cap]
        order = order[: self.k]
        self.distances, self.ids, self.groups = distances[order], ids[order], groups[order]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    rows = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pairs(k: int, cap: int | None):
    """(query, id, grp, distance) of each pair of blocks, whose queries (side 0) come before its vectors."""

    def found(queries: list, best: list[_Best], kinds) -> pa.RecordBatch:
        n = [len(b.distances) for b in best]
        held = [b for b in best if len(b.distances)]
        join = lambda what: np.concatenate([getattr(b, what) for b in held]).tolist() if held else []
        return pa.RecordBatch.from_arrays([pa.array([q for q, m in zip(queries, n) for _ in range(m)], kinds[0]), pa.array(join("ids"), kinds[1]), pa.array(join("groups"), pa.int64()), pa.array(join("distances"), pa.float64())], names=["query", "id", "grp", "distance"])

    def apply(batches):
        at, queries, matrix, best, kinds, parts = None, [], None, [], None, []
        for batch in batches:
            kinds = (batch.schema.field("query").type, batch.schema.field("id").type)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bq", "bv", "side"))))
            cuts = [0, *(j for j in range(1, len(keys)) if keys[j] != keys[j - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                some, pair, side = batch.slice(a, b - a), keys[a][:2], keys[a][2]
                if pair != at:
                    if best:
                        yield found(queries, best, kinds)
                    at, queries, matrix, best, parts = pair, [], None, [], []
                if side == 0:
                    queries += some.column("query").to_pylist()
                    parts.append(_matrix(some.column("vector")))
                    best += [_Best(k, cap) for _ in range(b - a)]
                    continue
                if not queries:
                    continue
                matrix = np.concatenate(parts) if matrix is None else matrix
                for c in range(0, b - a, CHUNK):
                    chunk = some.slice(c, CHUNK)
                    distances = np.round(1 - matrix @ _matrix(chunk.column("vector")).T, DECIMALS) + 0.0
                    ids, groups = np.array(chunk.column("id").to_pylist()), chunk.column("grp").to_numpy(zero_copy_only=False)
                    for one, row in zip(best, distances):
                        one.add(row, ids, groups)
        if best:
            yield found(queries, best, kinds)

    return apply


def nearest_of_each(queries: DataFrame, vectors: DataFrame, k: int, width: int, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding",
                    group: str | None = None, cap: int | None = None, queries_a_block: int = QUERIES, vectors_a_block: int = VECTORS) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``k`` vectors nearest to each query by cosine distance, at most ``cap`` of a group, ties by id.

    Vectors that are null, zero or not ``width`` wide have no distance and are left out on either side; null groups are one group. Vectors are sent once for
    every block of queries, and queries once for every block of vectors: a few thousand queries read the vectors once. A row is among the
    nearest of all only if it is so among its block, with the cap as well: what the cap puts in front of it there, or nearer rows of the same group, is
    in front of it everywhere."""
    fine = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()) & F.exists(vector, lambda x: x != 0)
    label = F.xxhash64(F.col(group)) if group else F.lit(0).cast("bigint")
    q = queries.where(fine).select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("vector"))
    v = vectors.where(fine).select(F.col(vec_id).alias("id"), label.alias("grp"), F.col(vector).cast("array<double>").alias("vector"))
    n_q, n_v = max(1, -(-q.count() // queries_a_block)), max(1, -(-v.count() // vectors_a_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    query_kind, id_kind = q.schema["query"].dataType, v.schema["id"].dataType
    left = q.select(block("query", n_q).alias("bq"), each(n_v).alias("bv"), F.lit(0).alias("side"), "query", F.lit(None).cast(id_kind).alias("id"), F.lit(None).cast("bigint").alias("grp"), "vector")
    right = v.select(each(n_q).alias("bq"), block("id", n_v).alias("bv"), F.lit(1).alias("side"), F.lit(None).cast(query_kind).alias("query"), "id", "grp", "vector")
    met = (left.unionByName(right).repartition("bq", "bv").sortWithinPartitions("bq", "bv", "side")
           .mapInArrow(_pairs(k, cap), f"query {query_kind.simpleString()}, id {id_kind.simpleString()}, grp bigint, distance double"))
    if cap:
        met = met.withColumn("__n", F.row_number().over(W.partitionBy("query", "grp").orderBy("distance", "id"))).where(F.col("__n") <= cap)
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(vec_id), "distance", "rank")
