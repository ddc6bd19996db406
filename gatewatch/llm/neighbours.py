"""Approximate nearest neighbours with a hash-prefix forest.

Index. Vectors are dealt into shards of about ``shard_rows`` at random. Every
shard holds ``trees`` sorted arrays; an array has the shard's vectors by a hash
string of 64 bits, the signs of 64 random projections of its tree. The
projections come from a fixed seed and nothing is fitted to the data, so every
vector is indexed the same way.

Search. A query descends the trees of a shard by bisection, to the longest
prefix that enough vectors share with it (one in several trees counts as many
times), and then ascends all trees together: the prefix length goes down
one by one, and at each length the vectors that share that prefix with the
query in any tree become candidates, until there are ``share`` of the shard
(and ``least`` at least). The last length is taken whole, so which candidates
are taken does not depend on their order. Candidates are compared by cosine in
double precision, and each shard's nearest are merged. ``least`` is a small
multiple of ``k``, so a table of a few hundred vectors is pruned as any other.

Queries meet shards in blocks of ``query_rows``; the memory of a task is
bounded by one shard and one block. Equal vectors are kept once with their
``k + 1`` smallest ids, which are all that can be among the nearest; they are
picked before the shuffle, so a group of copies is small wherever it goes.

On vectors without any structure the nearest ones are hardly nearer than the
rest, and a large share has to be looked at; ``share`` is what reaches a
recall of 0.9 there (measured in the tests and the README). Many trees with
longer prefixes find more in as many candidates than few trees with short ones.
Vectors in tight groups need far less.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates, nor do rows with
a null id. Vectors of different length are never compared. Rows with equal ids
and vectors count once. An empty table gives an empty table. Other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import worker_once, written

BITS = 64


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))

    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions(tree: int, size: int) -> np.ndarray:
    return np.random.default_rng([tree, size, 20]).standard_normal((size, BITS))


def hash_strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows): 64 sign bits as one number each, the first bit highest."""
    size = vectors.shape[1]
    out = np.empty((trees, len(vectors)), np.uint64)
    for t in range(trees):
        d = worker_once(f"directions-{t}-{size}", lambda: _directions(t, size))
        out[t] = np.packbits(vectors @ d > 0, axis=1).view(">u8")[:, 0]
    return out


#: Queries whose bounds in the trees are held at once.
TOGETHER = 128


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        hashes = hash_strings(vectors, trees)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def candidates(self, hashes: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query (a column of ``hashes``) the rows that the synchronous
        ascent meets."""
        for low in range(0, hashes.shape[1], TOGETHER):
            yield from self._candidates(hashes[:, low:low + TOGETHER], wanted)

    def _candidates(self, hashes: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        trees, n = self.sorted.shape
        lows, highs = {}, {}
        flat, begin = self.order.ravel(), np.arange(trees) * n

        def bounds(length: int) -> tuple[np.ndarray, np.ndarray]:
            """Where the vectors with the queries' prefix of a length stand."""
            if length not in lows:
                mask = np.uint64(0) if length == 0 else ~np.uint64((1 << (BITS - length)) - 1)
                low, high = hashes & mask, hashes | ~mask
                lows[length] = np.stack([np.searchsorted(self.sorted[t], low[t]) for t in range(trees)])
                highs[length] = np.stack([np.searchsorted(self.sorted[t], high[t], "right") for t in range(trees)])
            return lows[length], highs[length]

        for q in range(hashes.shape[1]):
            met = np.zeros(n, bool)
            # descend to the longest prefix for which the trees together have
            # enough matches; below it no union of theirs can be large enough
            length, step = 0, BITS
            while step:
                if length + step <= BITS:
                    low, high = bounds(length + step)
                    if (high[:, q] - low[:, q]).sum() >= wanted:
                        length += step
                step >>= 1
            while True:
                low, high = bounds(length)
                count = high[:, q] - low[:, q]
                if (total := count.sum()) >= wanted:
                    # the ranges of all trees in one go
                    met[:] = False
                    met[flat[np.repeat(begin + low[:, q] - count.cumsum() + count, count) + np.arange(total)]] = True
                    if length == 0 or met.sum() >= wanted:
                        break
                elif length == 0:
                    met[:] = True
                    break
                length -= 1
            yield np.flatnonzero(met)


def _leading(vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray, x: np.ndarray, wanted: int) -> np.ndarray:
    """Those of ``rows`` that can be among the ``wanted`` nearest: cosines by one
    matrix product, which may differ in the last places, with room for that."""
    rough = vectors[rows] @ x / norms[rows]
    if len(rows) <= wanted or not np.isfinite(rough).all():
        return rows
    return rows[rough >= np.partition(rough, -wanted)[-wanted] - 1e-9 * np.sqrt((x * x).sum())]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           trees: int = 256, share: float = 0.3, least: int = 40, shard_rows: int = 8192,
           query_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query``
    holds (a condition on the id, named ``id``) its ``k`` nearest found, ties
    to the smaller id; never the row itself."""
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    picked = picked.where(F.col("id").isNotNull() & usable(F.col("v")))
    # the smallest ids of each vector; the limit is applied before the shuffle too
    first = Window.partitionBy("v").orderBy("id")
    held = picked.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    held = written(held.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = written(picked.where(is_query).distinct(), "queries")
    shards = max(1, math.ceil(held.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    index = held.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, size)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        sizes = np.unique(pa.compute.list_value_length(right["v"]).to_numpy()) if right.num_rows else []
        for size in sizes:
            own, asks = (t.filter(pa.compute.equal(pa.compute.list_value_length(t["v"]), size)) for t in (left, right))
            if not own.num_rows:
                continue
            forest, queries = Forest(matrix(own["v"], size), trees), matrix(asks["v"], size)
            ids, names = own["ids"].to_pylist(), asks["id"].to_pylist()
            wanted = min(own.num_rows, max(least, math.ceil(share * own.num_rows)))
            for q, rows in enumerate(forest.candidates(hash_strings(queries, trees), wanted)):
                x = queries[q]
                rows = _leading(forest.vectors, forest.norms, rows, x, k + 1)
                score = (forest.vectors[rows] * x).sum(axis=1) / (forest.norms[rows] * np.sqrt((x * x).sum()))
                # rows that may hold one of the k nearest, the query's own row set aside
                cut = np.partition(score, -(k + 1))[-(k + 1)] if len(score) > k + 1 else -np.inf
                best = sorted((-s, i) for s, r in zip(score[score >= cut].tolist(), rows[score >= cut].tolist())
                              for i in ids[r] if i != names[q])[:k]
                out["query_id"] += [names[q]] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("id") % 50 == 0)
