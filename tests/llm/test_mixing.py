import collections
import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import mixing as M
from gatewatch.llm.oracles import ORACLES


def test_exponent():
    t = [1000.0, 100.0, 100.0, 10.0, 0.0]
    a = M.bisect_exponent(t, 0.95, math.inf, None)
    assert M.entropy(M.weights(t, a)) == pytest.approx(0.95 * math.log(4), rel=1e-9)
    a = M.bisect_exponent(t, 0.95, 2.0, None)
    w = M.weights(t, a)
    assert M.repeats(t, w, M.whole_budget(t, w)) == pytest.approx(2.0)
    assert M.bisect_exponent(t, 0.1, 2.0, None) == 1.0 and M.bisect_exponent([5.0], 0.9, 1.0, None) == 1.0
    assert M.weights([], 0.5) == [] and M.weights([0.0], 0.5) == [0.0]


def table(spark):
    rows = [(i, "big", "x " * (i % 7 + 1)) for i in range(400)] + [(1000 + i, "mid", "y y y") for i in range(60)]
    rows += [(2000 + i, None, "z z") for i in range(20)] + [(3000, "", None)] + [(7, "big", "x x")] * 5
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("own"))


@pytest.mark.parametrize("budget", [None, 900, 5000])
def test_budget(spark, budget):
    df = table(spark)
    held, given, times = collections.Counter(), collections.Counter(), collections.Counter()
    for r in df.collect():
        held[r.source] += len((r.text or "").split())
    out = M.mix(df, budget_tokens=budget, max_repeats=1.5, block_docs=30).collect()
    for r in out:
        given[r.source] += r.n_tokens
        times[(r.doc_id, r.epoch)] += 1
    sources = sorted(held, key=lambda s: (s is not None, str(s)))
    t = [float(held[s]) for s in sources]
    w = M.weights(t, M.bisect_exponent(t, 0.95, 1.5, budget))
    n = M.whole_budget(t, w) if budget is None else budget
    for s, x in zip(sources, w):
        assert math.floor(n * x + 1e-6) - 7 <= given[s] <= n * x + 1e-3
    repeated = {7}
    assert max(n for (i, _), n in times.items() if i not in repeated) == 1
    if budget is None:
        assert {r.doc_id for r in out} == {r.doc_id for r in df.collect()}


def test_last_epoch_is_a_run_of_blocks(spark):
    out = M.mix(table(spark), budget_tokens=900, max_repeats=9.0, block_docs=30).where("source = 'big' and epoch = 0")
    rows = out.groupBy("block").agg(F.min("position").alias("p"), F.count("*").alias("n")).orderBy("p").collect()
    every = {r.block: r["count"] for r in M.mix(table(spark), max_repeats=9.0, block_docs=30).where(
        "source = 'big' and epoch = 0").groupBy("block").count().collect()}
    assert all(r.n == every[r.block] for r in rows[:-1])  # only the last block may be cut


def test_edges(spark, docs, no_docs):
    assert M.mix(no_docs).count() == 0
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert M.mix(none).count() == docs.count()
    out = M.mix_stage(spark, docs, "")
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def brute_force(rows, budget, max_repeats, block_docs):
    """(doc_id, source, n_tokens, epoch, block, position) by the module's text, on a list."""
    def md5(*parts):
        return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()

    def number(digest):
        return int(digest[:13], 16)

    by = collections.defaultdict(list)
    for i, source, text in rows:
        by[source].append((md5(0, "" if i is None else i, md5(text or "")), len((text or "").split()), i))
    sources = list(by)
    t = [float(sum(n for _, n, _ in by[s])) for s in sources]
    w = M.weights(t, M.bisect_exponent(t, 0.95, max_repeats, budget))
    total = M.whole_budget(t, w) if budget is None else budget
    out = []
    for s, held, share in zip(sources, t, w):
        blocks = max(1, -(-len(by[s]) // block_docs))
        quota = math.floor(total * share * (1 + 1e-12) + 1e-6)
        quota = max(quota, int(held)) if budget is None else quota
        whole, rest = divmod(quota, int(held)) if held else (1, 0)
        for epoch in range(whole + 1):
            order = sorted((number(md5(0, epoch, number(at) % blocks)), number(at) % blocks, at, n, i) for at, n, i in by[s])
            used = 0
            for position, block, _, n, i in order:
                used += n
                if epoch < whole or (rest and used <= rest):
                    out.append((i, s, n, epoch, block, position))
    return out


@pytest.mark.parametrize("budget", [None, 900, 5000])
def test_rows_against_brute_force(spark, budget):
    df = table(spark).unionByName(spark.createDataFrame([(7, "big", "x x")] * 90 + [(None, "mid", "q q")] * 3,
                                  "doc_id long, source string, text string").withColumn("epoch", F.lit("own")))
    rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
    expected = collections.Counter(brute_force(rows, budget, 1.5, 30))
    for parts in (1, 7):  # whatever the layout
        out = M.mix(df.repartition(parts), budget_tokens=budget, max_repeats=1.5, block_docs=30).select(
            "doc_id", "source", "n_tokens", "epoch", "block", "position").collect()
        assert collections.Counter(tuple(r) for r in out) == expected


@pytest.mark.parametrize("copies", [1, 40, 100, 199])
def test_line_through_equal_rows(spark, copies):
    """One group of equal rows holds a source; as many as fit are given."""
    df = spark.createDataFrame([(1, "a", "x x x")] * 200, "doc_id long, source string, text string").repartition(5)
    assert M.mix(df, budget_tokens=3 * copies + 2, max_repeats=9.0).count() == copies


def test_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "hot", "w " * rng.randint(0, 30)) for i in range(3000)]
    rows += [(5000 + i, "mid", "v " * rng.randint(1, 30)) for i in range(250)]
    rows += [(7000 + i, None, "u " * rng.randint(1, 30)) for i in range(60)] + [(1, "hot", "w w")] * 40
    rows += [(None, "", "t t"), (9000, "none", None), (9001, "none", " ")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(
        str(tmp_path / "documents.parquet"))
    out = M.op8_mixture(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(ORACLES["op8_mixture"])
    assert [c[0] for c in found.description] == out.columns
    expected = collections.Counter(found.fetchall())
    assert max(r[3] for r in expected) > 0 and collections.Counter(tuple(r) for r in out.collect()) == expected
