import random

import pytest
from pyspark.sql import functions as F

SEED = random.Random(3)
VOCABULARY = [f"w{k}" for k in range(4000)]


def prose(n, rng=SEED):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and long texts, copies, shared passages, ties."""
    rng = random.Random(11)
    passage = prose(60, rng)
    out = [(None, passage), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two three")]
    out += [(10 + k, prose(80, rng)) for k in range(30)]
    out += [(50 + k, prose(20, rng) + " " + passage + " " + prose(20, rng)) for k in range(10)]
    copy = prose(100, rng)
    out += [(70 + k, copy) for k in range(10)]
    near = copy.split()
    near[50] = "other"
    out += [(90, " ".join(near)), (91, prose(30000, rng)), (91, prose(40, rng)), (92, copy), (92, copy)]
    out += [(95, "x" * 50000), (96, "Naïve café zwölf <|endoftext|> 字 " * 40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns whose names operators use themselves."""
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for name in ("n_words", "kept", "clean_text", "id", "fp", "component_id", "piece", "length", "sequence_id",
                 "offset", "spans", "row", "epoch", "block", "n_tokens", "entry", "info", "key"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.withColumn("source", F.when(F.col("doc_id") < 20, "small").when(F.col("doc_id") < 95, "hot")).withColumn(
        "lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
