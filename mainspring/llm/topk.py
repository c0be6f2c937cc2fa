"""Exact top-k search by inner product: tiled products, a selection per tile, tree merging.

Queries come in blocks of a fixed size. Every task multiplies a block with the tiles of its
shard, keeps each query's best of the tile and merges them with its best so far; two rounds
of windows then merge the lists of groups of tasks and of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

EXACT = float(1 << 53)


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while every partial sum is exact, else int64 or Python's."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    own = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(own, -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


class _Tiles:
    """The best candidates so far of queries of one length, over the tiles of a task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.score = [np.zeros(0, np.int64)] * len(query_ids)
        self.own = [np.zeros(0, np.int64)] * len(query_ids)

    def add(self, batch: pa.RecordBatch) -> None:
        k, score, own, width = self.k, self.score, self.own, self.queries.shape[1]
        vectors, ids = batch.column("v"), batch.column("vec_id").to_numpy()
        fit = (np.diff(vectors.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)) == width
        if not fit.any():
            return
        flat = vectors.filter(pa.array(fit)).flatten().to_numpy().reshape(int(fit.sum()), width)
        ids = ids[fit]
        for at in range(0, len(ids), 2048):
            tile, tile_ids = flat[at : at + 2048], ids[at : at + 2048]
            for first in range(0, len(self.query_ids), 1024):
                product = _products(self.queries[first : first + 1024], tile)
                for i, row in enumerate(product, first):
                    other = tile_ids
                    if len(score[i]) == k:
                        near = row >= score[i][-1]
                        if not near.any():
                            continue
                        row, other = row[near], other[near]
                    mine = other != self.query_ids[i]
                    row, other = np.concatenate((score[i], row[mine])), np.concatenate((own[i], other[mine]))
                    best = _best(row, other, k)
                    score[i], own[i] = row[best], other[best]

    def lists(self):
        sizes = [len(s) for s in self.score]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(self.query_ids, sizes), "vec_id": np.concatenate(self.own),
                "score": np.concatenate(self.score), "part": np.full(sum(sizes), TaskContext.get().partitionId(), np.int32),
            })


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1 << 16, block_bytes: int = 64 << 20, fan: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among `vectors`.

    Both tables have vec_id (a whole number) and embedding; components become floor(1024 * x).
    A query never gets its own vec_id. Ties go to the smaller vec_id; fewer than k candidates
    give them all. Vectors that are null, or hold null or non-finite components, take no part,
    nor do null ids; a query meets vectors of its own length only. A repeated query row gets one
    list, repeated candidate rows each count; an empty table gives no row. Products beyond 64
    bits are held at the limits of a long. Other columns are left out.

    Queries are broadcast in blocks of `block` rows and `block_bytes` of components; the driver holds one block
    at a time, and the lists of a block are written before the next one is fetched. Each block is
    a pass over the vectors, which stay where they are: shuffling blocks and shards to meet in a
    grid would move the vectors once for each block too, and the queries besides.
    """
    def ready(df):
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))

    spark = vectors.sparkSession
    shards, own = ready(vectors), ready(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = own.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("n")).first()
    blocks, every = max(1, -(-size["rows"] // block), -(-size["n"] * 8 // block_bytes)), None
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else own
        lists = _block_lists(shards, part.toArrow().combine_chunks(), k)
        if blocks > 1:
            lists = materialise(lists)
        every = lists if every is None else every.unionByName(lists)
    order = [F.desc("score"), F.asc("vec_id")]
    every = every.withColumn("part", F.floor(F.col("part") / fan))
    group = Window.partitionBy("query_id", "part").orderBy(*order)
    every = every.withColumn("n", F.row_number().over(group)).where(F.col("n") <= k)
    top = Window.partitionBy("query_id").orderBy(*order)
    return every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_lists(shards: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """The lists of each task for the queries (vec_id, v) of a block, one matrix for each length of vectors."""
    block = block.sort_by("vec_id")
    ids, sizes = block.column("vec_id").to_numpy(), pc.list_value_length(block.column("v")).to_numpy()
    matrices = []
    for width in np.unique(sizes).tolist():
        same = sizes == width
        flat = block.column("v").filter(pa.array(same)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrices.append((ids[same], flat.reshape(int(same.sum()), width)))
    held = shards.sparkSession.sparkContext.broadcast(matrices)

    def run(batches):
        own = [_Tiles(*m, k) for m in held.value]
        for batch in batches:
            for tiles in own:
                tiles.add(batch)
        for tiles in own:
            yield from tiles.lists()

    return shards.mapInArrow(run, "query_id long, vec_id long, score long, part int")
