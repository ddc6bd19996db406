import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatewatch.llm import lines as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_chars=10):
    """(id, lines, dropped, hash) of each row; None is behind all other ids."""
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(order(i), first.get(k, order(i)))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == order(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    found = L.keep_bitmaps(df).withColumn("sha", F.sha2(L.kept_text(F.col("text"), F.col("keep")), 256)).collect()
    for r in found:
        assert sum(r.keep) == r.n_lines and sum(r.keep[1::2]) == r.n_dropped and all(r.keep[1:-1])
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.sha) for r in found)


def table(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta Gamma Épée ZÜRICH straße".split()) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    rows = [(None, pool[0]), (None, pool[0] + "\nonly here is this line"), (5, None), (6, ""), (7, "\n\n"), (8, pool[1] + "\n" + pool[1])]
    for _ in range(n):
        lines = [rng.choice(WS) * rng.randint(0, 2) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "\r", " "])
                 for _ in range(rng.randint(0, 12))]
        rows.append((rng.randint(0, n), "\n".join([*lines, *[f"line {rng.random()}" for _ in range(rng.randint(0, 3))]])))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize("hot", [500, 3, 1])
def test_equals_brute_force(spark, hot, monkeypatch):
    """With hot hashes, without, and with nothing else."""
    monkeypatch.setattr(L, "HOT", hot)
    rows = table(hot, 150)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_hard_texts(docs, no_docs, texts):
    assert got(docs) == brute(texts)
    found = L.keep_bitmaps(docs.withColumn("n_lines", F.lit("own")).withColumn("_doc", F.lit(1)))
    assert sorted([*docs.columns, "_doc", *L.OWN]) == sorted(found.columns)
    assert dict(found.dtypes)["n_lines"] == "bigint" and L.keep_bitmaps(no_docs).count() == 0


def test_long_text(spark):
    line = "a line that is long enough"
    rows = [(1, line), (2, "\n".join([line, "x"] * 100_000)), (3, "\n".join([line] * 100_000)), (4, line * 50_000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_plan(spark, docs):
    """Lines are range-partitioned once and not dealt again for the window."""
    plan = L.repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(h1") == 1 and "hashpartitioning(h1" in plan  # of the hot ones' partial minimum
    assert plan.count("hashpartitioning(h1") == 1 and "Python" not in plan and "Arrow" not in plan
