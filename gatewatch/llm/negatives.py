"""Hard-negative mining with rotated one-bit codes.

Scores are inner products of integer vectors. Each vector is turned to unit
length and rotated by a fixed random rotation; its signs are a one-bit code, of
which the alignment with the vector (their inner product) is stored. What the
code leaves over is rotated and coded in the same way again, ``levels`` times:

    unit vector = sum of alignment * code  +  residual,

and the residual's length is stored too. An anchor takes the same rotations
and is rounded to bit planes (``PLANES`` bits a component); its inner product
with each code is counted with AND and popcount. By the Cauchy-Schwarz
inequality the true inner product lies within

    |residual|  +  sum of alignment * |rounding error of the anchor|

of that estimate (for unit vectors). This is an interval that always holds, not
a probable one. Rows whose interval cannot reach the result are left out, and
all others are scored in whole numbers. So the result is exact; only how many
rows are scored depends on the data.

First pass: of each anchor the best rows of its own label (positives). In a
shard a row survives if its upper end is not below the k-th largest lower end.
Second pass: for each anchor and positive the best rows of other labels whose
score lies between ``low`` and ``high`` percent of the positive's. The k-th
largest lower end is taken over rows that lie in that band for certain.

Rows are dealt to shards of about ``shard_rows`` by a hash of the id (copies
are spread), anchors to blocks of about ``anchor_rows``; a task holds one shard
and one block, and emits a few rows for each anchor. Every anchor meets every
row, so the work is anchors x rows. With blocks of this size a row is moved once
for 8,192 anchors and an anchor once for 16,384 rows.

Edge cases: rows with a null id, a null label, or a null vector, or one with
null or non-finite components, take no part; neither do rows whose squared
integer length is 2**62 or more, as their scores would not fit a long. Vectors
of different length never meet. Zero and empty vectors take part with score 0.
Equal rows (id, label and vector) count once. Of rows with equal ids and
different vectors each is an anchor and a candidate of its own, but a row never
meets its own id. An anchor without positives or negatives has no result. An
empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import worker_once, written

#: Slack for rounding of doubles, as part of the product of both lengths.
SLACK = 1e-9
LEVELS, PLANES = 6, 8
INDEX = "id long, label string, key long, v array<long>, codes array<long>, fit array<double>"


def _turned(x: np.ndarray, level: int) -> np.ndarray:
    """``x`` after the fixed rotation of a level."""
    size = x.shape[1]

    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng([size, level, 12]).standard_normal((size, size)))
        return q * np.sign(np.diag(r))

    return x @ worker_once(f"rotation-{size}-{level}", make) if size else x


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths of integer vectors."""
    x = vectors.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _packed(bits: np.ndarray) -> np.ndarray:
    """(rows, words) of 64 bits from (rows, components) of booleans."""
    whole = np.zeros((bits.shape[0], max(1, -(-bits.shape[1] // 64)) * 64), bool)
    whole[:, :bits.shape[1]] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, levels, words) and fits (rows, levels + 2): length of the
    vector, alignment of each code, length of the last residual."""
    rest, norm = _unit(vectors)
    size = max(1, rest.shape[1])
    codes, fit = [], [norm]
    for k in range(levels):
        rest = _turned(rest, k)
        up = rest >= 0
        aligned = np.abs(rest).sum(axis=1) / math.sqrt(size)
        rest = rest - np.where(up, 1, -1) * (aligned / math.sqrt(size))[:, None]
        codes.append(_packed(up))
        fit.append(aligned)
    fit.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(fit, axis=1)


class Shard:
    """The codes of one shard, in the order of labels."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, fit: np.ndarray):
        self.vectors, self.size = vectors, vectors.shape[1]
        self.norm, self.align, self.residual = fit[:, 0], fit[:, 1:-1].T, fit[:, -1]
        self.codes = np.ascontiguousarray(codes.transpose(1, 2, 0))  # levels, words, rows
        self.scale = self.align / math.sqrt(max(1, self.size))  # levels, rows
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)

    def bounds(self, anchors: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends (anchors, rows) of the scores with the rows
        ``low`` to ``high``."""
        high = len(self.norm) if high is None else high
        at = slice(low, high)
        q, norm = _unit(anchors)
        top = (1 << PLANES) - 1
        kind = np.uint16 if self.size * top < 1 << 16 else np.int64
        guess = np.zeros((len(anchors), high - low))
        wide = self.residual[at] + SLACK + guess
        for k, (level, ones, scale, align) in enumerate(zip(self.codes, self.ones, self.scale, self.align)):
            q = _turned(q, k)
            least = q.min(axis=1, initial=0)
            step = np.maximum(q.max(axis=1, initial=0) - least, 1e-300) / top
            steps = np.rint((q - least[:, None]) / step[:, None]).astype(np.int64).clip(0, top)
            near = least[:, None] + step[:, None] * steps  # the rounded anchors
            met = np.zeros(guess.shape, kind)
            for b in reversed(range(PLANES)):  # the highest bit first
                plane = _packed((steps >> b) & 1 == 1)
                met += met
                for w in range(level.shape[0]):
                    met += np.bitwise_count(plane[:, w, None] & level[w, at])
            # a code's components are 1 / sqrt(size) where a bit is set, else the same below zero
            guess += scale[at] * (2 * (least[:, None] * ones[at] + step[:, None] * met) - near.sum(axis=1)[:, None])
            wide += np.sqrt(((q - near) ** 2).sum(axis=1))[:, None] * align[at]
        both = norm[:, None] * self.norm[at]
        return (guess - wide) * both, (guess + wide) * both

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * anchor).sum(axis=1)


def _largest(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else -np.inf


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives_of(shard: Shard, ids: np.ndarray, anchor: np.ndarray, own: int, lower: np.ndarray, upper: np.ndarray,
                 first: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the best ``k`` among the rows from ``first`` on."""
    other = ids[first:first + len(lower)] != own
    cut = _largest(lower[other], k)
    rows = first + np.flatnonzero(other & (upper >= cut))
    score = shard.scores(anchor, rows)
    best = _best(score, ids[rows], k)
    return rows[best], score[best]


def negatives_of(shard: Shard, ids: np.ndarray, anchor: np.ndarray, other: np.ndarray, lower: np.ndarray,
                 upper: np.ndarray, bands: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band of scores, rows and scores of the best ``k`` within."""
    may = []
    for low, high in bands:
        inside = other & (upper >= low) & (lower <= high) if low <= high else np.zeros(len(lower), bool)
        rows = np.flatnonzero(inside)
        if len(rows):
            sure = rows[(lower[rows] >= low) & (upper[rows] <= high)]
            rows = rows[upper[rows] >= _largest(lower[sure], k)]
        may.append(rows)
    asked = np.unique(np.concatenate(may)) if may else np.zeros(0, np.int64)
    score = shard.scores(anchor, asked)
    out = []
    for (low, high), rows in zip(bands, may):
        own = score[np.searchsorted(asked, rows)]
        fits = (own >= low) & (own <= high)
        rows, own = rows[fits], own[fits]
        best = _best(own, ids[rows], k)
        out.append((rows[best], own[best]))
    return out


def _index(rows: DataFrame, levels: int) -> DataFrame:
    """Integer vectors with their codes, of rows (id, label, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch["v"])
            for size in np.unique(sizes.to_numpy()):
                part = batch.filter(pa.compute.equal(sizes, size))
                x = np.floor(256.0 * part["v"].flatten().to_numpy().reshape(part.num_rows, size))
                fine = (x * x).sum(axis=1) < 2.0 ** 62  # huge ones are infinite here
                part, v = part.filter(pa.array(fine)), x[fine].astype(np.int64)
                codes, fit = encode(v, levels)
                flat = codes.reshape(len(v), codes.shape[1] * codes.shape[2])
                yield pa.RecordBatch.from_arrays([
                    part["id"], part["label"], part["key"], _lists(v), _lists(flat.view(np.int64)), _lists(fit)],
                    names=["id", "label", "key", "v", "codes", "fit"])

    return rows.mapInArrow(run, INDEX)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    got = column.combine_chunks()
    got = got if isinstance(got, pa.Array) else got.chunk(0)
    flat = got.flatten().to_numpy()
    return flat.reshape(n, len(flat) // n)  # also of width 0


def _meetings(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """(shard, its ids, its labels, anchors, their labels, their vectors) for
    each vector size, the rows of the shard in the order of labels."""
    sizes = [pa.compute.list_value_length(t["v"]) for t in (left, right)]
    for size in np.unique(sizes[1].to_numpy()) if right.num_rows else []:
        own, asks = (t.filter(pa.compute.equal(s, size)) for t, s in zip((left, right), sizes))
        n = own.num_rows
        if n:
            fit = _matrix(own["fit"], n)
            codes = _matrix(own["codes"], n).view(np.uint64)
            codes = codes.reshape(n, levels := fit.shape[1] - 2, codes.shape[1] // levels)
            # numbers instead of labels, alike on both sides
            _, labels = np.unique([*own["label"].to_pylist(), *asks["label"].to_pylist()], return_inverse=True)
            order = np.argsort(labels[:n], kind="stable")
            yield (Shard(_matrix(own["v"], n)[order], codes[order], fit[order]), own["id"].to_numpy()[order],
                   labels[:n][order], asks, labels[n:], _matrix(asks["v"], asks.num_rows))


def _table(out: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int32() if k == "place" else pa.int64()) for k, v in out.items()})


#: Anchors that meet a shard at once; keeps the work in the processor's cache.
STEP = 16


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         levels: int = LEVELS, shard_rows: int = 16384, anchor_rows: int = 8192) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``; ``is_anchor`` is a condition on the id, named ``id``."""
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)))
    index = written(_index(rows.distinct().withColumn("key", F.xxhash64("id", "label", "v")), levels), "codes")
    asked = written(index.where(is_anchor).select("id", "label", "key", "v"), "anchors")
    shards = max(1, math.ceil(index.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / anchor_rows))
    placed = index.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).groupBy("shard", "block")

    def meeting(anchors: DataFrame):
        return placed.cogroup(anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).groupBy("shard", "block"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "key": [], "positive_id": [], "score": []}
        for shard, ids, labels, asks, of, queries in _meetings(left, right):
            names, keys = asks["id"].to_pylist(), asks["key"].to_pylist()
            for label in np.unique(of):
                first, last = int(np.searchsorted(labels, label)), int(np.searchsorted(labels, label, "right"))
                own = np.flatnonzero(of == label)
                for at in range(0, len(own) if last > first else 0, STEP):
                    part = own[at:at + STEP]
                    for a, lower, upper in zip(part, *shard.bounds(queries[part], first, last)):
                        found, score = positives_of(shard, ids, queries[a], names[a], lower, upper, first, positives)
                        out["id"] += [names[a]] * len(found)
                        out["key"] += [keys[a]] * len(found)
                        out["positive_id"] += ids[found].tolist()
                        out["score"] += score.tolist()
        return _table(out)

    best = Window.partitionBy("id", "key").orderBy(F.desc("score"), "positive_id")
    pairs = meeting(asked).applyInArrow(near, "id long, key long, positive_id long, score long")
    pairs = written(pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    placed_scores = F.sort_array(F.collect_list(F.struct("place", "score")))  # of at most ``positives`` rows
    wanted = asked.join(pairs.groupBy("id", "key").agg(
        F.transform(placed_scores, lambda x: x["score"]).alias("scores")), ["id", "key"])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "key": [], "place": [], "negative_id": [], "negative_score": []}
        for shard, ids, labels, asks, of, queries in _meetings(left, right):
            names, keys, scores = asks["id"].to_pylist(), asks["key"].to_pylist(), asks["scores"].to_pylist()
            for at in range(0, len(names), STEP):
                for a, lower, upper in zip(range(at, at + STEP), *shard.bounds(queries[at:at + STEP])):
                    bands = [(-(-low * p // 100), high * p // 100) for p in scores[a]]
                    other = (labels != of[a]) & (ids != names[a])
                    for place, (found, score) in enumerate(negatives_of(
                            shard, ids, queries[a], other, lower, upper, bands, negatives)):
                        out["id"] += [names[a]] * len(found)
                        out["key"] += [keys[a]] * len(found)
                        out["place"] += [place + 1] * len(found)
                        out["negative_id"] += ids[found].tolist()
                        out["negative_score"] += score.tolist()
        return _table(out)

    found = meeting(wanted).applyInArrow(hard, "id long, key long, place int, negative_id long, negative_score long")
    first = Window.partitionBy("id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return found.join(pairs, ["id", "key", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"),
        "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("id") % 50 == 0)
