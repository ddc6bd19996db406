"""Best-fit packing of token pieces into sequences, with a swap-based local
search.

Documents become ids (the tokenizer's, then the end id). One that is longer
than a sequence is cut into full pieces behind a shorter first one. Pieces go
to groups of about ``group_rows`` at random, and each group is packed by
itself: best fit, longest first, then a local search among underfull
sequences. It moves a piece, exchanges one for one or two for one between two
sequences whenever that raises the sum of squared fills, so the emptier ones
drain until they are gone. It ends at the least number of sequences that the
tokens allow or when nothing helps: a sequence finds its partner by the tokens
that the others can take, so no pair has to be left out.
Sequences that are still less than ``open_below`` full are opened again and
packed with those of other groups, level by level, while that helps.

Only lengths and checksums are shuffled, never ids.

Edge cases: a null or empty text is the end id alone. Repeated rows, equal and
null ids give pieces of their own. An empty table gives an empty table. Other
columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, slices, worker_memo, written
from .tokens import BLANKS, LATIN_END, byte_letters, is_byte_level, parts, tokenizer

#: Segments in one of the two generations of the memo; some 250 MB both
MEMO = 600_000


# --- ids ------------------------------------------------------------------

#: Characters by which the library's pattern is known to cut as ``PIECE`` does:
#: those of Latin blocks, of white space only what ASCII has.
PLAIN = {c for c in map(chr, range(ord(LATIN_END))) if not c.isspace()} | set(BLANKS)
#: What byte-level models write for each of them.
LETTERS = {c: "".join(map(byte_letters().__getitem__, c.encode())) for c in PLAIN}
_letters, _numbers = ("".join(re.escape(c) for c in sorted(PLAIN) if kind(c)) for kind in (str.isalpha, str.isnumeric))
#: The usual pattern of byte-level models.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_letters}]+| ?[{_numbers}]+| ?[^\s{_letters}{_numbers}]+|\s+(?!\S)|\s+")


def _segments(text: str) -> list[str]:
    """A text cut before blanks that follow a character other than white space.

    A byte-level pattern always starts a new word there, and nothing to the
    right changes what is to the left, so ids of segments, put together, are
    the ids of the text. The blank itself is left out (all but the first
    segment have one in front)."""
    out: list[str] = []
    for part in text.split(" "):
        if out and (not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Ids:
    """Ids of segments, as the library gives them, in the worker's memo.

    A segment of Latin characters is cut by the library's own pattern, and its
    model is asked for each piece that is new; so "word", "word," and
    "word.\nWord" cost two questions. Any other segment, and one that holds a
    special string, goes through the whole library. A file that is not of a
    byte-level model is used on whole texts.

    Texts are split, and their distinct segments found, by Arrow; Python sees a
    segment once for each batch of texts, however often it is there.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.by_words = is_byte_level(path)
        self.memo = worker_memo(f"ids-{path}", "segments", MEMO)  # with a blank in front
        self.heads = worker_memo(f"ids-{path}", "heads", MEMO // 4)  # without
        self.model = self.tok.model
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts(path)["added_tokens"]) or "(?!)")

    def _encoded(self, segments: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for low in range(0, len(segments), 4096)
                for e in self.tok.encode_batch_fast(segments[low:low + 4096], add_special_tokens=False)]

    def _model(self, piece: str) -> bytes:
        """Ids of a piece that the pattern does not cut."""
        return array("I", [t.id for t in self.model.tokenize("".join(map(LETTERS.__getitem__, piece)))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        memo, key = (self.memo, piece[1:]) if piece[0] == " " and len(piece) > 1 else (self.heads, piece)
        ids = memo.new.get(key)
        if ids is None:
            ids = memo.new[key] = memo.old.get(key) or self._model(piece)
        return ids

    def learn(self, memo: Memo, front: str, segments: Collection[str]) -> list[bytes]:
        """The ids of segments with ``front`` before them. The memo keeps words,
        and what has been through the whole library, but no words with marks:
        there are too many of them, and their pieces are known."""
        missing, new, piece, cut, rest = memo.missing(set(segments)), memo.new, self._piece, {}, []
        for s in missing:
            if s.isalpha() and max(s) < LATIN_END:
                new[s] = self._model(front + s)
            elif s[:-1].isalpha() and s[-1] in ".," and max(s) < LATIN_END:
                cut[s] = piece(front + s[:-1]) + piece(s[-1])
            elif PLAIN.issuperset(s) and not self.special.search(s):
                cut[s] = b"".join(map(piece, PIECE.findall(front + s)))
            else:
                rest.append(s)
        new.update(zip(rest, self._encoded([front + s for s in rest])))
        return [cut[s] if s in cut else new[s] for s in segments]

    def _of_segments(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which white space does not stand by itself."""
        split = [_segments(t) for t in texts]
        heads, inner = {s[0] for s in split}, set().union(*(s[1:] for s in split))
        head = dict(zip(heads, self.learn(self.heads, "", heads)))
        ids = dict(zip(inner, self.learn(self.memo, " ", inner)))
        return [head[s[0]] + b"".join(map(ids.__getitem__, s[1:])) for s in split]

    def of(self, texts: pa.Array) -> list[bytes]:
        if not self.by_words:
            return self._encoded(texts.to_pylist())
        split = pa.compute.split_pattern(texts, " ")
        edges = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        number, segments = np.array(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False)
        # a segment that is empty or ends in white space may go on behind the blank
        on = np.fromiter((not s or s[-1].isspace() for s in segments), bool, len(segments))
        apart = np.unique(np.searchsorted(edges, np.flatnonzero(on[number]), "right") - 1)
        # those at the front of a text have no blank before them and get numbers of their own
        heads, at = np.unique(number[edges[:-1]], return_inverse=True)
        number[edges[:-1]] = len(segments) + at
        used = np.flatnonzero(np.bincount(number, minlength=len(segments))[:len(segments)].astype(bool) & ~on)
        ids = [b""] * len(segments) + self.learn(self.heads, "", segments[heads].tolist())
        for k, got in zip(used.tolist(), self.learn(self.memo, " ", segments[used].tolist())):
            ids[k] = got
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = lists.take(pa.array(number))
        raw, ends = taken.flatten().to_numpy().tobytes(), (4 * taken.offsets.to_numpy().astype(np.int64))[edges].tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        whole = texts.take(pa.array(apart, pa.int64())).to_pylist()
        for k, got in zip(apart.tolist(), self._of_segments(whole)):
            out[k] = got
        return out


def ids_of(texts: list[str], path: str) -> list[bytes]:
    """The ids of whole texts as little-endian unsigned 32-bit numbers, as the
    library gives them."""
    return Ids(path).of(pa.array(texts, pa.string()))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the pieces of every row."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2048):
                tokens = Ids(path)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(tokens.of(part["text"])):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for j, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(k), piece.append(j), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a:4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# --- packing of one group -------------------------------------------------

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin
    that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    some = 0  # bit r: a bin has r left
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        if r > n:
            some |= 1 << (r - n)
    return bins


class _Partners:
    """Bins by what they can take: ``least[u]`` is the shortest piece that a
    bin gives back so that ``u`` tokens fit it (0 for a plain move), and
    ``bins[u][piece]`` are the bins for which that holds."""

    def __init__(self, capacity: int):
        self.none = 2 * capacity  # longer than any two pieces
        self.least = np.full(3 * capacity + 1, self.none, np.int64)
        self.bins: list[dict[int, set[int]]] = [{} for _ in range(2 * capacity + 1)]

    def add(self, b: int, room: int, pieces: dict[int, list[int]]) -> None:
        for m in (0, *pieces):
            self.bins[room + m].setdefault(m, set()).add(b)
            self.least[room + m] = min(m, self.least[room + m])

    def drop(self, b: int, room: int, pieces: dict[int, list[int]]) -> None:
        for m in (0, *pieces):
            at = self.bins[room + m]
            at[m].discard(b)
            if not at[m]:
                del at[m]
                if m == self.least[room + m]:
                    self.least[room + m] = min(at, default=self.none)

    def best(self, out: list[int], room: int) -> tuple[int, int, int] | None:
        """(place in ``out``, u, piece that comes back) of the largest net move
        from a bin with ``room`` left that may give ``out`` tokens.

        A net move of d from a to b raises the squares if d > fill[a] - fill[b].
        With s tokens going out, u - s is what b has left afterwards, which has
        to be less than a had before: u from s to s + room - 1."""
        low, width = self.least, 1
        while 2 * width <= room:  # least of each stretch of that width
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < room:
            low = np.minimum(low[:len(low) - (room - width)], low[room - width:])
        net = np.array(out) - low[out]
        k = int(net.argmax())
        if net[k] <= 0:
            return None
        u = out[k] + int(self.least[out[k]:out[k] + room].argmin())
        return k, u, out[k] - int(net[k])


def _may_leave(pieces: dict[int, list[int]]) -> dict[int, tuple[int, ...]]:
    """The lengths of one or two pieces of a bin, by their sum."""
    away: dict[int, tuple[int, ...]] = {n: (n,) for n in pieces}
    lengths = list(pieces)
    for x, n in enumerate(lengths):
        for m in lengths[:x]:
            away.setdefault(n + m, (n, m))
        if len(pieces[n]) > 1:
            away.setdefault(2 * n, (n, n))
    return away


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, effort: int | None = None) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared
    fills, emptiest bin first, until the bins are the fewest that the lengths
    allow or no bin can give anything to any other.

    ``effort`` bounds the number of looks for a partner; none by default."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least_bins = -(-sum(fill) // capacity)
    alive = sum(f > 0 for f in fill)
    if alive <= least_bins:
        return [b for b in bins if b]
    held: list[dict[int, list[int]]] = [{} for _ in bins]  # items by length
    partners = _Partners(capacity)
    for b, items in enumerate(bins):
        for i in items:
            held[b].setdefault(lengths[i], []).append(i)
        if 0 < fill[b] < capacity:
            partners.add(b, capacity - fill[b], held[b])

    def hand(a: int, b: int, n: int) -> None:
        """An item of length n goes from a to b."""
        held[b].setdefault(n, []).append(held[a][n].pop())
        if not held[a][n]:
            del held[a][n]
        fill[a] -= n
        fill[b] += n

    left = math.inf if effort is None else effort
    changed = True
    while changed and alive > least_bins and left > 0:
        changed = False  # a round in which nothing changes has met all pairs as they are
        for give in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b]):
            if alive <= least_bins or left <= 0:
                break
            if fill[give] == capacity:
                continue
            partners.drop(give, capacity - fill[give], held[give])
            while fill[give] and left > 0:
                left -= 1
                away = _may_leave(held[give])
                found = partners.best(list(away), capacity - fill[give])
                if found is None:
                    break
                k, u, back = found
                take = next(iter(partners.bins[u][back]))
                partners.drop(take, capacity - fill[take], held[take])
                for n in list(away.values())[k]:
                    hand(give, take, n)
                if back:
                    hand(take, give, back)
                if fill[take] < capacity:
                    partners.add(take, capacity - fill[take], held[take])
                changed = True
            if fill[give]:
                partners.add(give, capacity - fill[give], held[give])
            else:
                alive -= 1
    return [[i for items in b.values() for i in items] for b in held if b]


def pack_group(lengths: list[int], capacity: int, effort: int | None = None) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity, effort)


# --- packing of a table ---------------------------------------------------

def _packer(names: list[str], capacity: int, effort: int | None, level: int, open_below: float):
    """The function that packs one group of rows."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_pylist()
        order, ident, offset, still = [], [], [], []
        for k, b in enumerate(pack_group(lengths, capacity, effort)):
            at = 0
            for i in b:
                order.append(i), offset.append(at)
                at += lengths[i]
            ident += [(level << 56) | (key[0].as_py() << 16) | k] * len(b)
            still += [at < open_below] * len(b)
        got = table.take(pa.array(order, pa.int64())).select(names)
        for name, x, kind in (("sequence_id", ident, pa.int64()), ("offset", offset, pa.int64()),
                              ("still_open", still, pa.bool_())):
            got = got.append_column(name, pa.array(x, kind))
        return got

    return run


def pack(items: DataFrame, capacity: int = 2048, group_rows: int = 8192, open_below: float = 0.97,
         effort: int | None = None) -> DataFrame:
    """``items`` (a column ``length`` of 1 to ``capacity``) with ``sequence_id``
    and ``offset``; other columns are passed on."""
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = written(items.select(*[f"`{c}`" for c in names]), "pieces")
    n, level, out, held, opened = rows.count(), 0, [], None, 0
    own = "sequence_id long, offset long, still_open boolean"
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    while True:
        groups = max(1, math.ceil(n / group_rows))
        run = _packer(names, capacity, effort, level, open_below * capacity if groups > 1 else 0)
        # groups of equal size whatever the rows hold
        grouped = rows.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = written(grouped.groupBy("__group").applyInArrow(run, f"{types}, {own}"), "packed")
        # a sequence has one row at offset 0
        made, again, opens = packed.agg(*[F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (
            F.col("offset") == 0, F.col("still_open"), F.col("still_open") & (F.col("offset") == 0))]).first()
        if held is not None and made >= opened:  # this level saved nothing: the sequences it opened stay
            out.append(held)
            break
        if again == 0:
            out.append(packed)
            break
        out.append(packed.where("not still_open"))
        held, opened = packed.where("still_open"), opens
        rows, n, level = held.select(*[f"`{c}`" for c in names]), again, level + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("still_open")


def packed_documents(docs: DataFrame, path: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    found = pack(pieces(docs, path, capacity=capacity, end_id=end_id), capacity)
    return found.withColumnRenamed("id", "doc_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: sequences of all documents that are left."""
    return packed_documents(docs)
