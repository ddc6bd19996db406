"""Classification by many key words in one pass."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from gatewatch.functions.classify import DEFAULT_RULES, category_of, keyword_pattern
from test_plans import SMOKE, plan_text

WORD = st.text(st.sampled_from("AB.*\\E]^-&[ ({É|$é"), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=6), st.text(st.sampled_from("AB.*\\E]^-&[ ({É|$é\n"), max_size=12))
def test_pattern_finds_what_any_keyword_finds(words, text):
    assert bool(re.search(keyword_pattern(words), text)) == any(w in text for w in words)


def test_category_equals_substring_search(spark):
    """On notes made of pieces of the key words themselves, in both cases."""
    rng = random.Random(3)
    rules = (*DEFAULT_RULES, ("odd", (r"a.b", "[x", "\\Q", "a&&b", "^", "$", "x y")), ("none", ()))
    words = [w for _, ws in rules for w in ws]
    notes = [None, "", "ß ǆ", "i̇"]
    for _ in range(3000):
        parts = [rng.choice(words)[rng.randint(0, 1):rng.randint(1, 9)] for _ in range(rng.randint(0, 4))]
        notes.append(rng.choice([str.lower, str.upper, str])(rng.choice(["", " ", "\n", "é"]).join(parts)))

    def expected(note, upper):
        return next((c for c, ws in rules if note is not None and any(w.upper() in upper for w in ws)), None)

    df = spark.createDataFrame([(n,) for n in notes], "notes string").select(
        "notes", F.upper("notes").alias("upper"), category_of("notes", rules).alias("category"))
    for r in df.collect():
        assert r.category == expected(r.notes, r.upper), r


def test_empty_keyword_matches_every_note(spark):
    df = spark.createDataFrame([("",), ("x",), (None,)], "notes string")
    assert [r[0] for r in df.select(category_of("notes", [("any", ("", "Y"))])).collect()] == ["any", "any", None]


def test_notes_are_upper_cased_once(spark):
    """One classification in the plan; the filter reads its column."""
    for name in ("notes_count_default", "notes_classify_rules", "notes_occurrence_detail"):
        text = plan_text(E.queries()[name](spark, SMOKE))
        physical = text[text.index("== Physical Plan =="):]
        final = physical.split("== Initial Plan ==")[0] if "== Initial Plan ==" in physical else physical
        nodes = [n for n in final.split("\n\n") if "upper(" in n]
        assert len(nodes) == 1 and nodes[0].count("upper(") == 1, name
        assert not any("RLIKE" in n.split("Condition")[-1] for n in final.split("\n\n") if ") Filter" in n), name
