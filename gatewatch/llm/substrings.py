"""Substring deduplication by seeds and extension.

Seeds. A match of ``length`` words is also a match of its rarest-looking
``shingle`` words: of the shingles in each window of ``length`` words the one
with the least hash is the window's anchor (winnowing), so equal windows have
equal anchors at the same place. A run of windows with one anchor is a block.

Join and extension. Blocks meet at their anchor. Equal blocks extend each
other over all their windows at once, and the one in the larger document is
repeated; next to each other such blocks make up the whole of a long match.
Where the blocks of an anchor differ, at the two ends of a match, the extension
goes on window by window: the windows of these blocks, and only these, are
compared by themselves. What the repeated windows cover are the maximal
repeats of ``length`` words or more against any smaller document.

Groups of copies and common phrases are thinned out before each shuffle: of
equal blocks (or windows) in a batch only those of its smallest document go to
the common key, as the others are known to be repeated; of an anchor with more
than ``crowd`` different blocks in a batch the rest go straight to the
comparison of windows, under a key of their own. The texts are shuffled once,
by id. No pair of documents is ever made, and nothing is left out.

Windows are compared by two independent 64-bit hashes of word hashes, blocks by
their anchor and a 64-bit hash of all their windows.

Edge cases: a null text has no words. A row with a null id keeps all its words
and takes none from others. Rows with equal ids do not take words from each
other; each has a result. An empty table gives an empty table. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices, worker_memo, written

#: Words that are worked on at once; bounds the memory of a task.
STEP = 1 << 20

FLAGGED, OPEN, SEED = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def _windows(codes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of each run of ``width`` codes, by its start."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, f in enumerate(_factors(width, salt)):
        out += codes[k:k + n] * f
    return _mix(out)


def _codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, through the worker's memo."""
    import xxhash

    memo = worker_memo("word-codes", "words", 500_000)
    for w in memo.missing(set(words)):
        memo.new[w] = xxhash.xxh64_intdigest(w, 7)
    return np.fromiter(map(memo.new.__getitem__, words), np.uint64, len(words))


def _covered(n: int, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` words are in a run of ``length`` words from ``first``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + length, -1)
    return step[:-1].cumsum() > 0


def _codes_where(words: list[bytes], asked: np.ndarray) -> np.ndarray:
    """The hashes of the words that are asked for; zero for the others."""
    out = np.zeros(len(words), np.uint64)
    out[asked] = _codes(list(compress(words, asked.tolist())))
    return out


class Shape:
    """The lengths that the method works with."""

    def __init__(self, length: int, shingle: int):
        self.length, self.shingle = length, shingle

    def window_hashes(self, codes: np.ndarray) -> np.ndarray:
        return _windows(codes, self.length, 1)

    def second_hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of windows that know nothing of the first ones."""
        return _windows(_mix(codes ^ np.uint64(0xA24BAED4963EE407)), self.length, 5)

    def blocks(self, codes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, block, first window, windows) of the runs of valid windows.

        ``valid``: per window, the number of its document, or -1."""
        wide = self.length - self.shingle + 1
        n = len(codes) - self.length + 1
        if n < 1 or not (valid >= 0).any():
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        small = _windows(codes, self.shingle, 2)
        view = np.lib.stride_tricks.sliding_window_view(small, wide)
        at = np.empty(n, np.int64)
        for low in range(0, n, 1 << 16):  # the last of equal ones
            part = view[low:low + (1 << 16), ::-1]
            at[low:low + len(part)] = wide - 1 - part.argmin(axis=1)
        at += np.arange(n)
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        block = self.block_hashes(self.second_hashes(codes), first, count)
        good = valid[first] >= 0
        return _mix(small[at[first]])[good], block[good], first[good], count[good]

    @staticmethod
    def block_hashes(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """One hash for the windows first, ..., first + count - 1 of each block."""
        at = np.repeat(first, count) + (place := np.arange(count.sum()) - np.repeat(count.cumsum() - count, count))
        terms = _mix(hashes[at] + _mix(place.astype(np.uint64) + np.uint64(11)))
        return np.add.reduceat(terms, np.cumsum(count) - count) if len(count) else np.zeros(0, np.uint64)


def _least_of(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row, the smallest document with its key in this batch."""
    _, inverse = np.unique(keys, return_inverse=True)
    least = np.full(inverse.max() + 1 if len(inverse) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs)
    return least[inverse]


def _rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many rows before it have its key; how many have it at all."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    rank, total = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - np.repeat(start, size)
    total[order] = np.repeat(size, size)
    return rank, total


def _lone(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys for rows that need not meet others."""
    return _mix(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + starts.astype(np.uint64) + np.uint64(3))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of many rows, STEP at a time: (codes, document number, id, place
    of the word in its document). A longer text comes in parts that overlap."""
    many: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for doc, text in zip(batch["id"].to_pylist(), batch["text"]):
        if doc is None:
            continue
        found = (text.as_py() or "").encode().split()
        for low in range(0, max(1, len(found)), STEP):
            part = _codes(found[low:low + STEP + 64])
            many.append((doc, low, part))
            held += len(part)
        if held >= STEP:
            yield _joined(many)
            many, held = [], 0
    if many:
        yield _joined(many)


def _joined(many: list) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for _, _, p in many], np.int64)
    row = np.repeat(np.arange(len(many)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([low for _, low, _ in many], sizes)
    return np.concatenate([p for _, _, p in many]), row, np.array([d for d, _, _ in many], np.int64), place


def _seeds(shape: Shape, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, row, ids, place in _batches(batch):
                n = len(codes) - shape.length + 1
                if n < 1:
                    continue
                # windows that do not run into the next text, nor into the overlap
                inside = (row[:n] == row[shape.length - 1:])
                inside &= place[:n] - place[np.searchsorted(row, row[:n])] < STEP
                anchor, block, first, count = shape.blocks(codes, np.where(inside, row[:n], -1))
                if not len(first):
                    continue
                doc, start = ids[row[first]], place[first]
                both = _mix(anchor ^ (block * np.uint64(5)))
                repeated = doc > _least_of(both, doc)
                # rows of an anchor that is left with many blocks
                rank, total = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
                rank[~repeated], total[~repeated] = _rank(anchor[~repeated])
                state = np.where(repeated, FLAGGED, np.where(rank >= crowd, OPEN, SEED))
                key = np.where(state == SEED, anchor, _lone(doc, start))
                info = (start << 24) | (count << 8) | (state << 1) | (total > crowd)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc), pa.array(info)],
                    names=["key", "block", "id", "info"])

    return run


def _open_windows(shape: Shape):
    """Windows of the blocks that are to be compared one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.fill_null(pa.compute.list_value_length(batch["open"]), 0), 0))
            for part in slices(batch, "text", 512):
                keys, seconds, docs, starts = [], [], [], []
                for doc, text, entries in zip(part["id"].to_pylist(), part["text"], part["open"]):
                    found = (text.as_py() or "").encode().split()
                    codes = _codes_where(found, _words_of(shape, entries, len(found)))
                    second = shape.second_hashes(codes)
                    first, count = _entries(entries, second)
                    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
                    if len(at):
                        keys.append(shape.window_hashes(codes)[at]), seconds.append(second[at])
                        docs.append(np.full(len(at), doc, np.int64)), starts.append(at)
                if not docs:
                    continue
                key, second, doc, start = map(np.concatenate, (keys, seconds, docs, starts))
                repeated = doc > _least_of(_mix(key) ^ second, doc)
                key = np.where(repeated, _lone(doc, start), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(second.view(np.int64)), pa.array(doc), pa.array(start),
                     pa.array(repeated)], names=["key", "second", "id", "start", "repeated"])

    return run


def _some(entries) -> bool:
    return entries is not None and entries.is_valid and len(entries.values) > 0


def _words_of(shape: Shape, entries, n: int) -> np.ndarray:
    """Which of a text's ``n`` words the windows of its entries hold."""
    if not _some(entries):
        return np.zeros(n, bool)
    info = entries.values.field("info").to_numpy()
    first, length = info >> 24, ((info >> 8) & 0xFFFF) + shape.length - 1
    fits = first + length <= n
    return _covered(n, first[fits], length[fits])


def _entries(entries, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and counts of a row's entries; those of another text with
    the same id do not fit its hashes and are left out."""
    if not _some(entries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    info = entries.values.field("info").to_numpy()
    check = entries.values.field("check").to_numpy()
    first, count = info >> 24, (info >> 8) & 0xFFFF
    fits = first + count <= len(hashes)
    first, count, check = first[fits], count[fits], check[fits]
    same = (Shape.block_hashes(hashes, first, count).view(np.int64) & 0x7FFFFFFF) == check
    return first[same], count[same]


def _result(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1024):
                total, gone, digest, spans = [], [], [], []
                for text, flagged, single in zip(part["text"], part["flagged"], part["starts"]):
                    found = (text.as_py() or "").encode().split()
                    step = np.zeros(len(found) + 1, np.int64)
                    if _some(flagged) or _some(single):
                        asked = _words_of(shape, flagged, len(found))
                        if _some(single):
                            at = single.values.field("start").to_numpy()
                            asked |= _covered(len(found), at[at + shape.length <= len(found)], shape.length)
                        own = shape.second_hashes(_codes_where(found, asked))
                        first, count = _entries(flagged, own)
                        np.add.at(step, first, 1)
                        np.add.at(step, first + count + shape.length - 1, -1)
                        if _some(single):
                            at = single.values.field("start").to_numpy()
                            at_hash = single.values.field("check").to_numpy()
                            fits = at < len(own)
                            at, at_hash = at[fits], at_hash[fits]
                            at = at[(own[at].view(np.int64) & 0x7FFFFFFF) == at_hash]
                            np.add.at(step, at, 1)
                            np.add.at(step, at + shape.length, -1)
                    cut = step[:-1].cumsum() > 0
                    total.append(len(found)), gone.append(int(cut.sum()))
                    kept = [w for w, c in zip(found, cut.tolist()) if not c] if gone[-1] else found
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0]))))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()),
                     pa.array(spans, kind)], names=["id", "n_words", "n_removed", "kept_sha256", "repeats"])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13,
                shingle: int = 5, crowd: int = 16) -> DataFrame:
    """Per row: ``(id, n_words, n_removed, kept_sha256, repeats)``; ``repeats``
    are the word ranges (end exclusive) that are in a smaller document too."""
    shape = Shape(length, shingle)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seeds = texts.mapInArrow(_seeds(shape, crowd), "key long, block long, id long, info long").repartition("key")
    state = F.shiftright("info", 1).bitwiseAND(3)
    same, meet = Window.partitionBy("key", "block"), Window.partitionBy("key")
    seeds = seeds.select(
        "id", "info", "block",
        F.min("id").over(same).alias("first"),
        (F.max(F.col("info").bitwiseAND(1)).over(meet) == 1).alias("crowded"),
        (F.min("id").over(meet) != F.max("id").over(meet)).alias("shared"),
        (F.min("block").over(meet) != F.max("block").over(meet)).alias("differ"))
    flagged = (state == FLAGGED) | (F.col("first") < F.col("id"))
    extend = (state == OPEN) | F.col("crowded") | (F.col("shared") & F.col("differ"))
    found = seeds.where(flagged | extend).select(
        "id", flagged.alias("flagged"), F.struct(
            "info", F.col("block").bitwiseAND(F.lit(0x7FFFFFFF)).alias("check")).alias("entry"))
    found = written(found.groupBy("id").agg(
        F.collect_list(F.when(F.col("flagged"), F.col("entry"))).alias("flagged"),
        F.collect_list(F.when(~F.col("flagged"), F.col("entry"))).alias("open")), "repeated-blocks", free=True)
    # Both readers of the texts take them from the same shuffle; a condition on
    # the rows would reach the texts below the shuffle and make another of it.
    texts = texts.repartition("id")
    joined = texts.join(found, "id", "left")
    # texts without open blocks are not sent to Python
    windows = joined.select("id", F.when(F.size("open") > 0, F.col("text")).alias("text"), "open").mapInArrow(
        _open_windows(shape), "key long, second long, id long, start long, repeated boolean").repartition("key")
    check = F.col("second").bitwiseAND(F.lit(0x7FFFFFFF)).alias("check")
    windows = windows.select("id", F.struct("start", check).alias("entry"), (
        F.col("repeated") | (F.min("id").over(Window.partitionBy("key", "second")) < F.col("id"))).alias("repeated"))
    single = windows.where("repeated").groupBy("id").agg(F.collect_list("entry").alias("starts"))
    return joined.drop("open").join(single, "id", "left").mapInArrow(
        _result(shape), "id long, n_words long, n_removed long, kept_sha256 string, "
        "repeats array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).drop("repeats")
