import hashlib
import random

import pytest

from gatewatch.llm import substrings as U


def brute(rows, length=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1 if i is not None else 0):
            g = tuple(w[k:k + length])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, w in words:
        cut = [0] * len(w)
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k:k + length])] < i:
                cut[k:k + length] = [1] * length
        kept = b" ".join(x for x, c in zip(w, cut) if not c)
        out.append((str(i), len(w), sum(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **how):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in U.deduplicate(df, **how).collect())


def test_hard_texts(docs, no_docs, texts):
    assert got(docs) == brute(texts)
    assert U.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("crowd,step", [(16, 1 << 20), (1, 1 << 20), (1, 500)])
def test_shared_passages(spark, crowd, step, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 30)}" for _ in range(400)]
    rows = []
    for i in range(250):
        t = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 380)
            t += base[a:a + rng.randint(5, 60)] + [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 20))]
        rows.append((i, " ".join(t)))
    rows += [(400 + i, rows[7][1]) for i in range(50)] + [(401, "again " + rows[9][1])]
    monkeypatch.setattr(U, "STEP", step)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, crowd=crowd) == brute(rows)


def test_repeats_are_maximal(spark):
    a = [f"a{k}" for k in range(40)]
    b = ["x"] * 5 + a[3:30] + ["y"] * 5
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    found = {r.doc_id: r.repeats for r in U.deduplicate(df).collect()}
    assert found[1] == [] and [tuple(x) for x in found[2]] == [(5, 32)]


def test_collisions_of_the_first_hash_change_nothing(spark, monkeypatch):
    """Windows that agree in the first hash alone are different windows."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 30)}" for _ in range(200)]
    rows = []
    for i in range(60):
        a = rng.randint(0, 170)
        rows.append((i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(30)) + " " + " ".join(base[a:a + 30])))
    whole = U.Shape.window_hashes
    monkeypatch.setattr(U.Shape, "window_hashes", lambda self, codes: whole(self, codes) & U.np.uint64(7))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, crowd=1) == brute(rows)


def test_texts_are_shuffled_once(spark):
    """op10: both readers of the texts have the same exchange, whatever rows they take."""
    import re
    texts = [(k, f"{k} " + " ".join(f"w{j}" for j in range(k, k + 30))) for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = U.deduplicate(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    under = [re.sub(r"#\d+L?", "", "".join(plan.splitlines()[k + 1:k + 3])) for k, line in enumerate(plan.splitlines())
             if "REPARTITION_BY_COL" in line and "hashpartitioning(id" in line]
    assert len(under) == 2 and not any("isnotnull" in x for x in under)
    from gatewatch.llm.common import SHUFFLE_CLEANUP
    assert spark.conf.get(SHUFFLE_CLEANUP, None) != "true"
