"""Line deduplication over documents, in DataFrame functions only.

A line's key is the line without white space at both ends, A-Z in lower case.
Of a key of ``min_chars`` or more that several documents hold, the smallest
document keeps its lines and the others lose theirs.

Lines become rows of hashes (128 bits of the key, document, position); no text
is moved with them. The rows are range-partitioned by hash, sorted within by
document and position, and each hash is streamed: the first occurrence names
the document that keeps the line, and rows of other documents are dropped. What
comes back is a bitmap for each document, compressed as run lengths (``keep``:
lines kept, dropped, kept, ... in turn, starting with kept ones).

A hash that holds a large part of all lines would end in one range. Such hashes
are found in a sample of lines (picked by hash; about ``SAMPLE`` for each
shuffle partition, where ``HOT`` of them make a hash hot, so there are at most
two hot hashes to a partition, and they may be broadcast). Their lines stay
where they are: the smallest document of each is a partial aggregate, joined
back as a broadcast table of that size. Which way a line goes changes nothing
in the result.

Edge cases: a null or empty text is one empty line, which is never dropped, as
its key is too short. Rows with equal ids are one document: lines that they
share stay in all of them. Rows with a null id are one document behind all
others. Repeated rows give repeated results. An empty table gives an empty
table. Other columns are passed on; the operator's own columns replace columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

BLANKS = " \t\n\x0b\x0c\r"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sampled lines for each shuffle partition, and how many of them make a hash hot.
SAMPLE, HOT = 1000, 500

OWN = ("n_lines", "n_dropped", "keep")


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, LARGE, SMALL))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _text_mark(text: Column) -> Column:
    """Tells apart rows with equal ids and different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``(doc, mark, pos, h1, h2)`` for each line whose key is long enough."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("doc", _text_mark(F.col("text")).alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def _hot(lines: DataFrame) -> DataFrame:
    """``(h1, h2)`` of hashes that hold half of what a partition should or more."""
    spark = lines.sparkSession
    wanted = SAMPLE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    one_in = max(1, lines.count() // wanted)
    picked = lines.where(F.pmod(F.xxhash64("h2", "mark", "pos"), F.lit(one_in)) == 0)
    return written(picked.groupBy("h1", "h2").count().where(F.col("count") >= HOT).select("h1", "h2"), "hot-lines")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``(doc, mark, dropped)``: for each document that loses lines, their
    positions in order. ``mark`` is a hash of the text."""
    lines = written(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    hot = F.broadcast(_hot(lines))  # at most two rows a shuffle partition, about
    # range-partitioned by hash; the window takes that partitioning and sorts
    # each range by hash, document and position
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_last(), "mark", "pos")
    rest = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1")
    rest = rest.withColumn("first", F.first("doc").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    least = lines.join(hot, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    of_hot = lines.join(F.broadcast(least), ["h1", "h2"])
    gone = rest.unionByName(of_hot).where(~F.col("doc").eqNullSafe(F.col("first")))
    return gone.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Run lengths of kept and dropped lines in turn."""
    def whole(d: Column) -> Column:
        starts = F.filter(F.transform(d, lambda x, i: F.when(
            (i == 0) | (F.get(d, i - 1) != x - 1), x)), lambda x: x.isNotNull())
        ends = F.filter(F.transform(d, lambda x, i: F.when(
            (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1), x + 1)), lambda x: x.isNotNull())

        def between(p: Column) -> Column:
            pairs = F.transform(p["s"], lambda s, i: F.array(
                s - F.coalesce(F.get(p["e"], i - 1), F.lit(0)), F.get(p["e"], i) - s))
            return F.concat(F.flatten(pairs), F.array(n_lines - F.element_at(p["e"], -1)))

        return _let(F.struct(starts.alias("s"), ends.alias("e")), between)

    return F.when(F.size(dropped) > 0, _let(dropped, whole)).otherwise(F.array(n_lines))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps."""
    text = F.coalesce(text, F.lit(""))
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.zip_with(F.split(text, "\n"), flags, lambda line, kept: F.when(kept, line))
    return F.when(F.size(keep) == 1, text).otherwise(F.array_join(lines, "\n"))  # nulls are left out


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` (long) and ``keep`` (array of
    run lengths). If the text is not used afterwards, it is not moved."""
    names = [c for c in docs.columns if c.lower() not in OWN]
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    found = repeated_lines(docs, id_col, text_col, min_chars)
    found = found.select(*[F.col(c).alias(free + c) for c in ("doc", "mark", "dropped")])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.withColumns({free + "text": _text_mark(text), free + "lines": breaks + 1})
    joined = rows.join(found, rows[f"`{id_col}`"].eqNullSafe(found[free + "doc"]) & (
        rows[free + "text"] == found[free + "mark"]), "left")
    dropped, n = F.col(free + "dropped"), F.col(free + "lines")
    return joined.select(
        *[F.col(f"`{c}`") for c in names], n.cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        _runs(F.coalesce(dropped, F.array().cast("array<int>")), n).alias("keep"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias(
        "kept_sha256"))
