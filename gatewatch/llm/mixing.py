"""Mixing sources to target weights by temperature.

Weights. A source with the token share p gets the weight p**a / sum(p**a).
The exponent a is bisected between 0 (all sources alike) and 1 (as they are):
the largest a whose weights reach ``target_entropy`` (as a part of the largest
possible, the log of the number of sources), or, if the sources would then have
to be repeated more than ``max_repeats`` times, the smallest a that keeps to
that limit. A step of the bisection needs two sums over the table of sources;
the sums of all the points that the next ``LEVELS`` halvings may ask for come
from one aggregation, so neither sources nor rows come to the driver.

Realisation. With a budget of n tokens a source gives n * weight tokens. Its
documents stand in blocks of about ``block_docs`` documents (by a hash, so a
block is a random part); an epoch goes through the blocks in an order that
depends on the epoch and the seed, and through each block in hash order. Whole
epochs are given whole. Of the last one as many blocks as fit the budget, and
of the block after them as many documents; the document that crosses the line
stays out. The budget is met from below to within a document for each source.

A row's place is the MD5 of the seed, its id and its text, so it does not depend
on the files or their splitting. Rows that are equal in all of these stand at
one place; if the line goes through them, as many of them as fit are taken.

The line of a source is looked for in three steps: among ``2**BUCKET_BITS`` sums
over stretches of the order of blocks, among the blocks of one stretch, and
among the documents of one block, of which equal ones are counted first. So a
source or a group of equal rows with a third of all rows is no hot spot. What
comes out is one line for each source; the documents are then taken or left
where they are, and texts are never shuffled as long as the table of sources is
small enough for the planner to broadcast it.

``budget_tokens=None`` takes the least budget by which every source is given
whole at least once, so no document is lost.

Edge cases: a null source is a source of its own, as is an empty one. Null and
empty texts have no tokens and are given along in every whole epoch and block.
Repeated rows and equal ids are documents of their own. A table without any
token is given once, as it is. An empty table gives an empty table. Other
columns are passed on; ``epoch``, ``block``, ``n_tokens`` and ``position``
replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, words, written

#: Halvings of the exponent's interval for each aggregation over the sources.
LEVELS = 10

#: Stretches of a source's order of blocks, as a power of two.
BUCKET_BITS = 12

#: Hashes are numbers of 13 hex digits, which a double holds as they are.
_PLACE_BITS = 52


class Sources(NamedTuple):
    """What the bisection needs to know of the sources that hold tokens."""
    n: int
    top: float     # tokens of the largest
    bottom: float  # tokens of the smallest


#: sum of r and of r * ln(t/top) over all sources, r = (t/top)**a, for each exponent a
Sums = Callable[[Sequence[float]], list[tuple[float, float]]]


def weights(tokens: list[float], a: float) -> list[float]:
    """Normalised weights of sources for an exponent; none for an empty source."""
    top = max(tokens, default=0.0)
    raised = [(t / top) ** a if t > 0 else 0.0 for t in tokens] if top > 0 else [0.0] * len(tokens)
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def repeats(tokens: list[float], shares: list[float], budget: float) -> float:
    """Most epochs of any source."""
    return max((budget * w / t for t, w in zip(tokens, shares) if t > 0), default=0.0)


def whole_budget(tokens: list[float], shares: list[float]) -> float:
    """The least budget by which every source is given whole."""
    return max((t / w for t, w in zip(tokens, shares) if w > 0), default=0.0)


def _halve(low: float, high: float, sums: Sums, up: Callable[[float, tuple[float, float]], bool],
           rounds: int = 6) -> tuple[float, float]:
    """The interval after ``rounds * LEVELS`` halvings; ``up`` says of a middle
    whether the upper half is next."""
    for _ in range(rounds):
        parts = 1 << LEVELS
        points = [low + (high - low) * k / parts for k in range(parts + 1)]
        found = sums(points[1:-1])
        first, last = 0, parts
        while last - first > 1:
            mid = (first + last) // 2
            first, last = (mid, last) if up(points[mid], found[mid - 1]) else (first, mid)
        low, high = points[first], points[last]
    return low, high


def bisect(of: Sources, sums: Sums, target_entropy: float, max_repeats: float, budget: float | None) -> float:
    """See the module's text. Entropy falls and repeats fall as a rises."""
    if of.n < 2:
        return 1.0

    def fits(a: float, found: tuple[float, float]) -> bool:
        # the largest source needs the largest budget, the smallest is repeated most often
        most = (of.top * found[0] if budget is None else budget) / found[0] * (of.bottom / of.top) ** a / of.bottom
        return most <= max_repeats * (1 + 1e-12)

    def flat(a: float, found: tuple[float, float]) -> bool:
        return math.log(found[0]) - a * found[1] / found[0] >= target_entropy * math.log(of.n)

    low = 1.0 if flat(1.0, sums([1.0])[0]) else _halve(0.0, 1.0, sums, flat)[0]
    if fits(low, sums([low])[0]):
        return low
    return _halve(low, 1.0, sums, lambda a, found: not fits(a, found))[1]


def bisect_exponent(tokens: list[float], target_entropy: float, max_repeats: float, budget: float | None) -> float:
    """The exponent for sources with these numbers of tokens."""
    held = [t for t in tokens if t > 0]
    top = max(held, default=0.0)

    def sums(points: Sequence[float]) -> list[tuple[float, float]]:
        raised = [[(t / top) ** a for t in held] for a in points]
        return [(sum(r), sum(x * math.log(t / top) for x, t in zip(r, held))) for r in raised]

    return bisect(Sources(len(held), top, min(held, default=0.0)), sums, target_entropy, max_repeats, budget)


def _sums_of(held: DataFrame, top: float) -> Sums:
    """The sums over a table of sources with ``tokens``, one aggregation a call."""
    part = F.col("tokens") / F.lit(top)

    def sums(points: Sequence[float]) -> list[tuple[float, float]]:
        exponents = F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>")
        each = held.select("tokens", F.posexplode(exponents).alias("k", "a"))
        raised = F.pow(part, F.col("a"))
        rows = each.groupBy("k").agg(F.sum(raised).alias("z"), F.sum(raised * F.log(part)).alias("y")).collect()
        return [(r.z, r.y) for r in sorted(rows, key=lambda r: r.k)]  # a row for each point

    return sums


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _PLACE_BITS // 4), 16, 10).cast("long")


def _around(group: list[str], order: list[str], size: str, room: str, before: Column | None = None) -> Callable:
    """Keeps the one row of each group that the line goes through: what comes
    before it, ``__before``, is at most ``room``, and with it is more."""
    start = F.lit(0) if before is None else before

    def keep(df: DataFrame) -> DataFrame:
        upto = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("__before", start + upto - F.col(size))
        return df.where((F.col("__before") <= F.col(room)) & (F.col("__before") + F.col(size) > F.col(room)))

    return keep


def mix(docs: DataFrame, source_col: str = "source", tokens: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", target_entropy: float = 0.95, max_repeats: float = 2.0,
        budget_tokens: int | None = None, block_docs: int = 1000, seed: int = 0,
        digest: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as the mixture gives them, with ``n_tokens``,
    ``epoch`` (from 0), ``block`` and ``position`` (of the block in its epoch).

    ``tokens`` counts a row's tokens; words between blanks by default.
    ``digest`` stands for a row's contents; the MD5 of its text by default. The
    order of a source's rows is epoch, position, then the hash of the row.
    """
    own = ["n_tokens", "epoch", "block", "position"]
    names = [c for c in docs.columns if c.lower() not in own]
    tokens = F.size(words(F.col(text_col))) if tokens is None else tokens
    digest = F.md5(F.coalesce(F.col(text_col), F.lit(""))) if digest is None else digest
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    # written once, so that every step below sees the same rows under __n
    rows = written(docs.select(*[F.col(f"`{c}`") for c in names], tokens.cast("long").alias("n_tokens"),
                               at.alias("__at"), F.monotonically_increasing_id().alias("__n")), "mixed-rows")
    sources = written(rows.groupBy(F.col(f"`{source_col}`").alias("__source")).agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mixed-sources")
    held = sources.where("tokens > 0")
    of = Sources(*held.select(F.count("*"), F.coalesce(F.max("tokens"), F.lit(0)).cast("double"),
                              F.coalesce(F.min("tokens"), F.lit(0)).cast("double")).first())
    sums = _sums_of(held, of.top)
    a = bisect(of, sums, target_entropy, max_repeats, budget_tokens)
    total = sums([a])[0][0] if of.n else 1.0
    budget = of.top * total if budget_tokens is None else budget_tokens

    # whole epochs, tokens of the last one, blocks
    quota = F.floor(F.pow(F.col("tokens") / F.lit(of.top), F.lit(a)) / F.lit(total) * F.lit(float(budget))
                    * (1 + 1e-12) + 1e-6)
    if budget_tokens is None:  # whatever the rounding, every source is given whole
        quota = F.greatest(quota, F.col("tokens"))
    some = F.col("tokens") > 0
    plans = sources.withColumn("__quota", F.when(some, quota)).select(
        "__source", F.when(some, F.expr("__quota div tokens")).otherwise(1).cast("int").alias("__whole"),
        F.when(some, F.expr("__quota % tokens")).otherwise(0).cast("long").alias("__rest"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long").alias("__blocks"))

    def placed(table: DataFrame, plan: DataFrame) -> DataFrame:
        """With the plan of each row's source (a row for each source) and the row's block."""
        return table.join(plan, F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))).withColumn(
            "block", F.pmod(_number(F.col("__at")), F.col("__blocks")))

    def position(epoch: Column) -> Column:
        return _number(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("block").cast("string"))))

    def of_line(df: DataFrame, line: DataFrame, *also: str) -> DataFrame:
        """Rows of a source's line, and of its block and so on, with the line's columns."""
        same = F.col("__source").eqNullSafe(F.col("s"))
        for name in also:
            same = same & (F.col(name) == F.col(f"line_{name}"))
        return df.join(line, same)

    def line_of(df: DataFrame, *columns) -> DataFrame:
        return df.select(F.col("__source").alias("s"), *columns)

    narrow = rows.select(F.col(f"`{source_col}`"), "n_tokens", "__at", "__n")
    light = placed(narrow, plans).where("__rest > 0")
    blocks = written(light.groupBy("__source", "__whole", "__rest", "block").agg(F.sum("n_tokens").alias("held"))
                     .withColumn("place", position(F.col("__whole")))
                     .withColumn("bucket", F.shiftright("place", _PLACE_BITS - BUCKET_BITS)), "mixed-blocks")
    line = line_of(_around(["__source"], ["bucket"], "held", "__rest")(
        blocks.groupBy("__source", "__rest", "bucket").agg(F.sum("held").alias("held"))),
        F.col("bucket").alias("line_bucket"), F.col("__before").alias("start"))
    line = line_of(_around(["__source"], ["place", "block"], "held", "__rest", F.col("start"))(
        of_line(blocks, line, "bucket")),
        F.col("place").alias("line_place"), F.col("block").alias("line_block"),
        (F.col("__rest") - F.col("__before")).alias("room"))
    line = written(line, "mixed-line")
    equal = of_line(light, line, "block").groupBy("__source", "__at", "n_tokens", "room").agg(
        F.sum("n_tokens").alias("held"))
    cut = line_of(_around(["__source"], ["__at", "n_tokens"], "held", "room")(equal),
                  F.col("__at").alias("line___at"), F.col("n_tokens").alias("line_n_tokens"),
                  F.expr("(room - __before) div n_tokens").alias("fit"))
    cut = written(cut, "mixed-cut")

    # of the equal rows at the line, the first ``fit`` by __n, whose upper bits name the task that wrote them
    crossing = of_line(light.withColumn("part", F.shiftright("__n", 33)), cut, "__at", "n_tokens").where("fit > 0")
    crossing = crossing.select("__source", "part", "__n", "fit", F.lit(1).alias("one"), (F.col("fit") - 1).alias("last"))
    part = line_of(_around(["__source"], ["part"], "n", "last")(
        crossing.groupBy("__source", "last", "part").agg(F.count("*").alias("n"))),
        F.col("part").alias("line_part"), F.col("__before").alias("start"))
    final = line_of(_around(["__source"], ["__n"], "one", "last", F.col("start"))(
        of_line(crossing, part, "part")), F.col("__n").alias("cut_n"))

    def beside(df: DataFrame, more: DataFrame, name: str) -> DataFrame:
        more = more.withColumnRenamed("s", name)
        return df.join(more, F.col("__source").eqNullSafe(F.col(name)), "left").drop(name)

    ends = beside(beside(beside(plans, line, "s1"), cut, "s2"), final, "s3").select(
        "__source", "__whole", "__blocks", "line_place", "line_block", "line___at", "line_n_tokens", "cut_n")
    ends = written(ends, "mixture")

    out = placed(rows, ends)
    place, spot = F.struct(position(F.col("__whole")), F.col("block")), F.struct("__at", "n_tokens")
    line_place, line_spot = F.struct("line_place", "line_block"), F.struct("line___at", "line_n_tokens")
    inside = (F.col("block") == F.col("line_block")) & (
        (spot < line_spot) | ((spot == line_spot) & F.coalesce(F.col("__n") <= F.col("cut_n"), F.lit(False))))
    last = F.col("line_place").isNotNull() & ((place < line_place) | inside)
    n = F.col("__whole") + F.when(last, 1).otherwise(0)
    out = out.withColumn("epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return out.withColumn("position", position(F.col("epoch"))).select(*[f"`{c}`" for c in names], *own)


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", F.size(words(F.col("text"))).alias("n_words"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    return mix(docs, tokens=F.col("n_words"), digest=F.col("digest")).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "position")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of all epochs; every document at least once,
    those of small sources again, up to 1.5 times on the whole."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                       F.size(words(F.col("text"))).alias("n_words"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    return mix(rows, tokens=F.col("n_words"), max_repeats=1.5, digest=F.col("digest")).select("row.*")
