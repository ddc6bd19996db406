import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5):
    """The rows as the docstring defines them, scored one by one."""
    fit = []
    for i, v, label in {(i, None if v is None else tuple(v), label) for i, v, label in rows}:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * y) for y in v]
        if sum(y * y for y in x) < 2**62:
            fit.append((i, label, x))
    out = []
    for i, label, a in fit:
        if i % every:
            continue
        met = [(-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in fit if j != i and len(a) == len(b)]
        for s, j, _ in sorted((s, j, o) for s, j, o in met if o == label)[:5]:
            fits = sorted((t, k) for t, k, o in met if o != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits[:3])]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("key", F.lit("own")).withColumn("v", F.lit(1))
    return sorted(tuple(r) for r in N.mine(df, F.col("id") % 5 == 0, **how).collect())


def vectors(n, size, rng, spread=1.0):
    middle = rng.standard_normal((4, size))
    return [(middle[rng.integers(4)] + spread * rng.standard_normal(size)).tolist() for _ in range(n)]


@pytest.mark.parametrize("size,spread", [(64, 1.0), (70, 0.3), (3, 1.0)])
def test_bounds_hold(size, spread):
    """Every score lies in its interval, and the interval is narrow."""
    rng = np.random.default_rng(size)
    v = np.floor(256 * np.array(vectors(400, size, rng, spread))).astype(np.int64)
    v[0] = 0
    shard = N.Shard(v, *N.encode(v))
    lower, upper = shard.bounds(v[:50])
    true = v[:50] @ v.T
    assert (lower <= true).all() and (true <= upper).all()
    both = np.outer(shard.norm[:50], shard.norm)
    assert (upper - lower <= 0.25 * both + 1e-9).all()


@pytest.mark.parametrize("shard_rows,anchor_rows", [(16384, 8192), (40, 9)])
def test_equals_brute_force(spark, shard_rows, anchor_rows):
    rng, py = np.random.default_rng(4), random.Random(4)
    rows = [(k, v, py.choice([0, 1, 2])) for k, v in enumerate(vectors(160, 8, rng))]
    rows += [(200 + k, rows[3][1], k % 2) for k in range(30)]  # copies, ties
    rows += [(300, v, 1) for v in vectors(2, 8, rng)] + [rows[5], rows[5]]  # equal ids, repeated rows
    rows += [(400, None, 1), (401, [1.0, None] * 4, 1), (402, [math.nan] * 8, 1), (403, [math.inf] * 8, 1), (None, rows[0][1], 1),
             (405, rows[0][1], None), (410, [0.0] * 8, 2), (415, [], 1), (416, [], 1), (417, [], 0), (420, [1e300] * 8, 1),
             (425, [1.0, 2.0], 1), (426, [1.0, 2.5], 1), (427, [1.0, 1.2], 0), (430, [2.0 ** 22] * 8, 0)]
    want = brute(rows)
    assert len(want) > 100 and got(spark, rows, shard_rows=shard_rows, anchor_rows=anchor_rows) == want


def test_filter_leaves_most_rows_out():
    """64 random components, the hardest case: few rows are scored."""
    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.standard_normal((4000, 64)) / 8).astype(np.int64)
    shard, ids, scored = N.Shard(v, *N.encode(v)), np.arange(4000), []
    whole = shard.scores
    shard.scores = lambda anchor, rows: (scored.append(len(rows)), whole(anchor, rows))[1]
    for a in range(20):
        (lower,), (upper,) = shard.bounds(v[a:a + 1])
        found, score = N.positives_of(shard, ids, v[a], a, lower, upper, 0, 5)
        true = np.sort(np.delete(v @ v[a], a))[::-1][:5]
        assert score.tolist() == true.tolist()
    assert sum(scored) < 0.1 * 20 * 4000


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0, 2.0], 1), (5, None, 2)]) == []
