"""Quality rules by line-first cleaning, in DataFrame functions only.

Every line of a text is judged by itself, failing lines are removed, and a
document is rejected if it loses too much of its text that way. Two rules on
the whole text come first: too few words, and too many words in repeated
8-word windows. All work is done inside the row: no shuffle, no Python.

Line rules (a line without a word never fails and counts for nothing):

* punctuation: ASCII punctuation makes up more than ``max_punctuation`` of the
  line's characters outside blanks, in a line of ``min_line_words`` or more;
* navigation: the line is a list of entries set apart by bars or arrows, one
  separator for at most ``nav_words`` words, three separators at least;
* boilerplate: the line is a notice that pages carry besides their text
  (``BOILERPLATE``), of at most ``boilerplate_words`` words.

Results in edge cases: a null or empty text has no words and is rejected. An
empty table gives an empty table. Repeated rows and equal ids are judged row
by row. Extra columns are passed on; the operator's own columns replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, words

#: Separators of navigation lines, as a class of single characters.
NAV_MARKS = r"[|»›→>]"

#: Notices, matched without case anywhere in a short line.
BOILERPLATE = (
    r"(?i)(\ball rights reserved\b|\bcookie (policy|settings|notice)\b|\bprivacy policy\b"
    r"|\bterms (of use|of service|and conditions)\b|\bsubscribe to our newsletter\b"
    r"|\benable javascript\b|\bskip to (main )?content\b|\bclick here\b|\bread more\b"
    r"|\blicensed under\b|\breleased under the .{1,40} licen[sc]e\b|^copyright\b|^©)"
)

WINDOW = 8


def _count(text: Column, but: str) -> Column:
    """How many characters are left without those in the runs of ``but``."""
    return F.length(F.regexp_replace(text, but, ""))


def _repeated(hashes: Column, width: int) -> Column:
    """How many positions lie in windows whose hash occurs twice or more.

    ``hashes`` has one value for each window, in order. Most texts repeat
    none, which a set shows at once; the others are sorted by hash, and the
    starts that have an equal neighbour are put in order again: a start adds
    as many positions as it lies behind the one before, ``width`` at most.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        last = F.size(p) - 1
        return F.filter(
            F.transform(p, lambda x, k: F.when(
                ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
                | ((k < last) & (F.get(p, k + 1)["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull())

    starts = F.sort_array(F.element_at(F.transform(F.array(pairs), twice), 1))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("at")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(width).cast("long"), i.cast("long") - acc["at"])).alias("n"),
            i.cast("long").alias("at")),
        lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def window_hashes(word_list: Column, width: int = WINDOW) -> Column:
    """A 64-bit hash of each window of ``width`` words, in order.

    Windows are told apart by hashes of word hashes. In one text of a million
    words the chance that any two different windows meet is below 10**-7.
    """
    def windows(codes: Column) -> Column:
        n = F.size(codes) - (width - 1)
        # fewer words than a window: no window
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(
            *[F.get(codes, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(F.transform(word_list, lambda w: F.xxhash64(w))), windows), 1)


def line_fails(line: Column, max_punctuation: float = 0.2, min_line_words: int = 5,
               nav_words: int = 3, boilerplate_words: int = 20) -> Column:
    """True if one of the line rules fails."""
    n = F.size(F.split(F.trim(F.regexp_replace(line, WORD_GAP, " ")), " "))
    solid = _count(line, WORD_GAP)
    punctuation = _count(line, r"[^!-/:-@\[-`{-~]+")
    marks = _count(line, r"[^|»›→>]+")
    return (
        ((n >= min_line_words) & (punctuation > solid * max_punctuation))
        | ((marks >= 3) & (n - marks <= marks * nav_words))
        | ((n <= boilerplate_words) & line.rlike(BOILERPLATE))
    )


def judge(docs: DataFrame, text_col: str = "text", max_lost: float = 0.4,
          min_words: int = 20, max_repeat_percent: int = 30, **line_rules) -> DataFrame:
    """``docs`` with what the rules find in ``text_col``.

    New columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``base_failed``, ``clean_text`` (the text
    without failing lines), ``lost_words`` (words in them), ``kept``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "clean_text", "lost_words", "kept"]
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    keep = [c for c in docs.columns if c.lower() not in own]

    # One expression for each step: a lambda binds its value once, and nothing
    # is worked out twice when Spark merges the projections.
    def facts(t: Column) -> Column:
        def with_words(w: Column) -> Column:
            def with_lines(lines: Column) -> Column:
                worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
                good = F.filter(lines, lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x, **line_rules)))
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                    _count(t, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
                    F.element_at(F.transform(F.array(worded), lambda x: (
                        F.size(x) - F.size(F.array_distinct(x))).cast("long")), 1).alias("n_dup_lines"),
                    F.element_at(F.transform(F.array(window_hashes(w)), lambda h: _repeated(h, WINDOW)), 1)
                    .alias("n_repeat_words"),
                    F.array_join(good, "\n").alias("clean_text"))
            return F.element_at(F.transform(F.array(F.split(t, "\n")), with_lines), 1)
        return F.element_at(F.transform(F.array(words(t)), with_words), 1)

    found = docs.select(*others, F.inline(F.transform(F.array(text), facts)))
    c = F.col
    found = found.withColumn("base_failed", (c("n_words") < min_words) | (
        c("n_repeat_words") * 100 > c("n_words") * max_repeat_percent))
    found = found.withColumn("lost_words", c("n_words") - F.size(words(c("clean_text"))))
    found = found.withColumn("kept", ~c("base_failed") & (c("lost_words") <= c("n_words") * max_lost))
    return found.select(*[f"`{k}`" for k in keep], *own)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lost_words")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: kept documents, with the text that is left of them.

    Other columns go along as they are, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judge(rows).where("kept").select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
