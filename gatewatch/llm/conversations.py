"""Conversation structure repair by grammar-compressed dynamic programming.

Turns of a conversation are symbols (role initial and fault). The cheapest
edits that make the roles alternate are found with min-plus matrices over a
Re-Pair grammar (``grammar.py``): a rule's matrix is worked out once, bottom-up,
for all conversations of a batch that share it.

Rows are range-partitioned by conversation, turn, role and text, so a
conversation of any size is spread over tasks, and a task streams its sorted
rows. A conversation that lies within one task's rows and one part (``PART_ROWS``
rows, ``PART_CHARS`` characters) is solved right there. Others (at most two for
each task, and long ones) become parts:

* turns repeated in another part are found by a hash of role and text;
* each part gives the matrix of its symbols and its counts, some 40 numbers;
* these are chained for each conversation, which names the states where each
  part begins and ends;
* each part then has its own piece of the audit and of the repaired turns.

A part's texts are moved once more for that, and never gathered.

Faults, the first of which counts: *blank* (nothing but white space),
*duplicate* (role and text occurred before in the conversation), *truncated*
(the last character that is not white space is none of ``.!?``).

Edge cases: a null role or text is one blank. Null ids are one conversation.
Null turns come first; equal turns are in the order of role and text, and
repeated rows stand next to each other (all but the first are duplicates).
Roles of other initials than s, u, a can be renamed or deleted. A conversation
whose rows are all dropped has zeros, an empty audit and no turns. An empty
table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .grammar import START, Grammar, applied, chain, symbol

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: Bounds of a part, and of what is solved together.
PART_ROWS, PART_CHARS = 4096, 1 << 20
BATCH_ROWS, BATCH_CHARS = 16384, 1 << 22

NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("mark", pa.binary())])
SOLVED = ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired array<struct<role:string,text:string>>"
PART = f"part long, whole boolean, {SOLVED}, rows array<struct<turn:long,role:string,text:string,mark:binary>>"


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` of conversations that are damaged
    by a checksum of conversation and turn; dropped rows stay, marked ``gone``."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    what = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in ("role", "text"))
    found = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what"))
    return found.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        (F.col("what") == 0).alias("gone"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


# --- one conversation or part -------------------------------------------------

class Turns:
    """The rows of a conversation, or of a part of it, with their faults.

    ``marks`` has a hash of role and text for rows that may be repeated
    elsewhere, ``again`` the places of rows that are known to be."""

    def __init__(self, rows: list[tuple], again: set[int] = frozenset()):
        self.rows, self.marks = rows, []
        self.symbols, self.faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
        seen: set[bytes] = set()
        for k, (_, role, text) in enumerate(rows):
            bare, mark, fault = text.rstrip(BLANKS), None, None
            if not bare:
                fault = "blank"
            else:
                mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                repeated = mark in seen or k in again
                seen.add(mark)
                if repeated:
                    fault, mark = "duplicate", None
                elif bare[-1] not in ".!?":
                    fault = "truncated"
            if fault:
                self.faults[fault] += 1
            self.marks.append(mark)
            self.symbols.append(symbol(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.symbols = tuple(self.symbols)
        self.initials = [r[1][:1] for r in rows]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        self.turns = [r[0] for r in rows if r[0] is not None]

    def distinct_turns(self) -> int:
        return len(set(self.turns))

    def solved(self, grammar: Grammar) -> dict:
        cost, audit = grammar.solve(self.symbols)
        gaps = max(self.turns) - min(self.turns) + 1 - self.distinct_turns() if self.turns else 0
        return self.faults | {"gaps": gaps, "illegal": self.illegal, "cost": cost, "audit": audit,
                              "repaired": self.repaired(audit)}

    def repaired(self, audit: str, state: int = START) -> list[dict]:
        return [{"role": r, "text": t} for r, t in applied(audit, [x[1:] for x in self.rows], state)]


class _Cutter:
    """Streams the sorted rows of a task into conversations and parts."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.task = kind, TaskContext.get().partitionId()
        self.number, self.size, self.held, self.out = 0, [0, 0], [], []
        self.conv, self.rows, self.chars, self.open, self.begun = None, [], 0, True, False

    def rows_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch[k].to_pylist() for k in range(5))):
                if not self.begun or conv != self.conv:
                    if self.begun:
                        self._end()
                        self.open = False
                    self.conv, self.begun = conv, True
                if not gone:
                    if len(self.rows) >= PART_ROWS or self.rows and self.chars + len(text) > PART_CHARS:
                        self._part()
                    self.rows.append((turn, role, text))
                    self.chars += len(text)
                if self.size[0] >= BATCH_ROWS or self.size[1] >= BATCH_CHARS:
                    yield self._flush()
        if self.begun:
            self._part()
        if self.held:
            yield self._flush()

    def _hold(self, whole: bool) -> None:
        self.held.append((self.conv, (self.task << 32) | self.number, whole, self.rows))
        self.number += 1
        self.size[0] += len(self.rows) + 1
        self.size[1] += self.chars
        self.rows, self.chars = [], 0

    def _part(self) -> None:
        """A part of a conversation that goes on, or may."""
        self._hold(False)
        self.open = True

    def _end(self) -> None:
        self._hold(not self.open)

    def _flush(self) -> pa.RecordBatch:
        turns = [Turns(rows) for *_, rows in self.held]
        grammar = Grammar([t.symbols for t, h in zip(turns, self.held) if h[2]])
        solved = [t.solved(grammar) if h[2] else {} for t, h in zip(turns, self.held)]
        rows = [None if h[2] else [{"turn": a, "role": b, "text": c, "mark": m} for (a, b, c), m in zip(h[3], t.marks)]
                for t, h in zip(turns, self.held)]
        got = pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in self.held], self.kind), pa.array([h[1] for h in self.held], pa.int64()),
             pa.array([h[2] for h in self.held])] + _solved(solved) + [pa.array(rows, pa.list_(ROW))],
            names=["conv", "part", "whole", *NUMBERS, "audit", "repaired", "rows"])
        self.held, self.size = [], [0, 0]
        return got


def _solved(found: list[dict]) -> list[pa.Array]:
    return [pa.array([f.get(c) for f in found], pa.int64()) for c in NUMBERS] + [
        pa.array([f.get("audit") for f in found], pa.string()), pa.array([f.get("repaired") for f in found], pa.list_(TURN))]


# --- conversations in several parts -------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict, Turns]]]:
    """Parts with their turns, some at a time."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            x = batch.slice(k, 1).to_pylist()[0]
            rows = [(r["turn"], r["role"], r["text"]) for r in x.pop("rows")]
            held.append((x, Turns(rows, set(x.pop("again") or ()))))
            size += len(rows) + sum(len(r[2]) for r in rows) // 256
            if size >= BATCH_ROWS:
                yield held
                held, size = [], 0
    if held:
        yield held


FACTS = ["blank", "duplicate", "truncated", "illegal", "least", "most", "distinct", "n"]


def _measured(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            grammar, out = Grammar([t.symbols for _, t in held]), []
            for x, t in held:
                cost, rank = grammar.matrix(t.symbols)
                out.append(t.faults | {
                    "conv": x["conv"], "part": x["part"], "cost": cost, "rank": rank, "illegal": t.illegal,
                    "least": min(t.turns, default=None), "most": max(t.turns, default=None),
                    "distinct": t.distinct_turns(), "n": len(t.rows),
                    "ends": [t.initials[0], t.initials[-1]] if t.rows else []})
            yield pa.RecordBatch.from_arrays(
                [pa.array([o["conv"] for o in out], kind)] + [pa.array([o[c] for o in out], pa.int64()) for c in ("part", *FACTS)]
                + [pa.array([o[c] for o in out], pa.list_(pa.int64())) for c in ("cost", "rank")]
                + [pa.array([o["ends"] for o in out], pa.list_(pa.string()))],
                names=["conv", "part", *FACTS, "cost", "rank", "ends"])

    return run


def _chained(kind: pa.DataType):
    def solve(parts: list[dict]) -> list[dict]:
        cost, steps, tail = chain([(p["cost"], p["rank"]) for p in parts])
        total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")}
        ends = [p["ends"] for p in parts if p["n"]]
        total["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
        dated = [p for p in parts if p["least"] is not None]  # in the order of turns
        total["distinct"] -= sum(a["most"] == b["least"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["most"] - dated[0]["least"] + 1 - total["distinct"] if dated else 0
        last = len(parts) - 1
        return [{"conv": p["conv"], "part": p["part"], "start": i, "stop": j, "tail": tail if k == last else ""}
                | ({"cost": cost, "gaps": gaps} | total if k == last else {}) for k, (p, (i, j)) in enumerate(zip(parts, steps))]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r["conv"] for r in rows], kind)]
            + [pa.array([r.get(c) for r in rows], pa.int64()) for c in ("part", "start", "stop", *NUMBERS)]
            + [pa.array([r["tail"] for r in rows], pa.string())],
            names=["conv", "part", "start", "stop", *NUMBERS, "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if parts and parts[-1]["conv"] != x["conv"]:
                    yield batch_of(solve(parts))
                    parts = []
                parts.append(x)
        if parts:
            yield batch_of(solve(parts))

    return run


def _finished(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            grammar = Grammar([t.symbols for _, t in held])
            out = []
            for x, t in held:
                audit = grammar.audit(t.symbols, x["start"], x["stop"]) + x["tail"]
                out.append({c: x[c] for c in NUMBERS} | {"audit": audit, "repaired": t.repaired(audit, x["start"])})
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["conv"] for x, _ in held], kind), pa.array([x["part"] for x, _ in held], pa.int64())] + _solved(out),
                names=["conv", "part", *NUMBERS, "audit", "repaired"])

    return run


def _of_same_part(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"conv": "__conv", "part": "__part"})
    both = left["conv"].eqNullSafe(right["__conv"]) & (left["part"] == right["__part"])
    return left.join(right, both, "left").drop("__conv", "__part")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of ``rows`` (conv_id, turn, role, text, gone; the
    last marks rows that only name their conversation).

    One row for each part of a conversation, in the order of ``part``:
    ``(conv, part, whole, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired)``. The numbers stand in the last part alone; audit and
    repaired turns have to be put together. ``whole``: the only part."""
    own = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone",
        F.monotonically_increasing_id().alias("tie"))  # lets the ranges cut through repeated rows
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    field = rows.schema["conv_id"]
    name, kind = field.dataType.simpleString(), _arrow(field.dataType)
    sorted_rows = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    parts = written(sorted_rows.mapInArrow(lambda b: _Cutter(kind).rows_of(b), f"conv {name}, {PART}"), "parts")
    solved = parts.where("whole").drop("rows")
    loose = parts.where(~F.col("whole")).select("conv", "part", "rows")
    # turns that an earlier part has; each part names a turn once
    marks = loose.select("conv", "part", F.posexplode("rows").alias("at", "row")).select(
        "conv", "part", "at", F.col("row.mark").alias("mark")).where(F.col("mark").isNotNull())
    again = marks.withColumn("n", F.row_number().over(Window.partitionBy("conv", "mark").orderBy("part"))).where("n > 1")
    loose = written(_of_same_part(loose, again.groupBy("conv", "part").agg(F.collect_list("at").alias("again"))), "loose-parts")
    facts = ", ".join(f"{c} long" for c in ("part", *FACTS))
    matrices = written(loose.mapInArrow(
        _measured(kind), f"conv {name}, {facts}, cost array<long>, rank array<long>, ends array<string>"), "matrices")
    numbers = ", ".join(f"{c} long" for c in ("part", "start", "stop", *NUMBERS))
    ways = matrices.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(
        _chained(kind), f"conv {name}, {numbers}, tail string")
    done = _of_same_part(loose, ways).mapInArrow(_finished(kind), f"conv {name}, part long, {SOLVED}")
    return solved.unionByName(written(done, "repaired-parts").withColumn("whole", F.lit(False)))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def lines_of(repaired) -> object:
    """The repaired turns as ``role:text``, joined by newlines."""
    return F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digests(parts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(id, numbers, audit, repaired_sha256)`` for each conversation.

    A digest is made in the order of the text, so the parts of one conversation
    are streamed through one task, one part at a time."""
    columns = ["conv", *NUMBERS, "audit"]
    single = parts.where("whole").select(*columns, F.sha2(lines_of(F.col("repaired")), 256).alias("repaired_sha256"))
    name, kind = parts.schema["conv"].dataType.simpleString(), _arrow(parts.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, empty, audit = None, None, True, []

        def end(last: dict) -> pa.RecordBatch:
            values = [last["conv"], *(last[c] for c in NUMBERS), "".join(audit), sha.hexdigest()]
            kinds = [kind, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              names=[*columns, "repaired_sha256"])

        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                if now is None or x["conv"] != now["conv"]:
                    if now is not None:
                        yield end(now)
                    sha, empty, audit = hashlib.sha256(), True, []
                audit.append(x["audit"])
                if x["n"]:
                    sha.update(("" if empty else "\n").encode() + x["lines"].encode())
                    empty = False
                now = x
        if now is not None:
            yield end(now)

    several = parts.where(~F.col("whole")).select(*columns, "part", F.size("repaired").alias("n"), lines_of(
        F.col("repaired")).alias("lines")).repartition("conv").sortWithinPartitions("conv", "part")
    several = several.mapInArrow(run, f"conv {name}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string, repaired_sha256 string")
    return single.unionByName(several).withColumnRenamed("conv", id_col)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(repair(damage(rows)))
