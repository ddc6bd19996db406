import collections
import re

import pytest
from pyspark.sql import functions as F

from gatewatch.llm import quality as Q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(docs, texts):
    got = Q.judge(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[:5] == brute(r.text)


@pytest.mark.parametrize("text", [
    "a b c d e f g h a b c d e f g h", "a " * 40, "x\nx\nx\n\n y", "a b c d e f g h i a b c d e f g h j", "| a | b | c |"])
def test_repeats(spark, text):
    got = Q.judge(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute(text)


def test_line_rules(spark):
    plain = "The house on the hill stood empty for many long years before anyone came to see it again."
    other = "Nobody had kept a key, and so the men of the village broke the lock and walked in together."
    text = "\n".join([plain, "Home | News | Sport | Weather | About", "Read more", other, "Ab### cd*** ef$$$ gh%%% ij&&&"])
    got = Q.judge(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert got.clean_text.split("\n") == [plain, other]
    assert got.kept and got.lost_words == got.n_words - 37
    junk = "\n".join(["Ab### cd*** ef$$$ gh%%% ij&&&"] * 1 + [f"a{k}### b{k}*** c{k}$$$ d{k}%%% e{k}&&&" for k in range(10)])
    got = Q.judge(spark.createDataFrame([(1, junk)], "doc_id int, text string")).first()
    assert not got.base_failed and not got.kept


def test_lines_without_final_mark_stay(spark):
    text = "\n".join(f"heading{k} about{k} subject{k} number{k} and nothing{k} else{k}" for k in range(6))
    got = Q.judge(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert got.kept and got.lost_words == 0


def test_edges(docs, no_docs):
    got = Q.judge(docs)
    assert set(got.columns) >= {"source", "fp", "key"} and dict(got.dtypes)["kept"] == "boolean"
    assert got.where("n_words = 0 and kept").count() == 0
    assert Q.judge(no_docs).count() == 0
    kept = Q.keep_good(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0


def test_no_python(docs):
    plan = Q.judge(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1
