"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded as one chunk. A longer
one is cut into chunks that overlap; each is encoded by the library with its
offsets, and two neighbours are spliced at a boundary that both have in the
overlap. A boundary counts only if it is proven stable: both encodings start a
token there, the character before is an ASCII blank, and the tokens that both
have from there to the next such place are the same. The tokenizers meant here
(``blank_free``) drop blanks before they merge, and neither their normaliser
nor their patterns nor their special strings reach over a blank. So what
follows a blank does not depend on what is before it. Where an overlap has no
such boundary (a long run without blanks), it is doubled to the left; if it
would reach the chunk before, both are encoded as one, up to the next blank.

The same fact lets a text of one chunk be counted word by word: what the
library gives for a word between blanks is kept in a bounded memo of the
worker, and only words that it does not hold are encoded (``Counts``).

A worker looks at the tokenizer's file once (``is_blank_free``). If it is not
of the kind for which all this is proven, every text is encoded whole; so it is
with ``blank_free=False``.

Edge cases: a null text counts as empty (0 bytes, 0 tokens). Null ids, repeated
rows and equal ids give a row each. An empty table gives an empty table. Other
columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, worker_memo, worker_once

if TYPE_CHECKING:
    from tokenizers import Encoding

BLANKS = " \t\n\x0b\x0c\r"

#: Words in one of the two generations of the memo; about 130 MB both, and some 20 MB for pieces of words.
MEMO = 400_000


def tokenizer(path: str):
    """The library's tokenizer for a file; a bare name is one of the public
    files on the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def load():
        from tokenizers import Tokenizer

        if os.path.isabs(path):
            return Tokenizer.from_file(path)
        import public_tokenizers

        return Tokenizer.from_file(public_tokenizers.path(path))

    return worker_once(f"tokenizer-{path}", load)


def parts(path: str) -> dict:
    """What a tokenizer's file says of its parts, without the vocabulary."""
    def load() -> dict:
        said = json.loads(tokenizer(path).to_str())
        said["model"] = {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")}
        return said

    return worker_once(f"parts-{path}", load)


#: The normaliser and pre-tokenizer of which it is known that
#: blanks go before anything is merged and that no pattern reaches over one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _plain(said: dict) -> bool:
    """A merging model that always gives the same, special strings that are
    taken literally and hold no white space, and nothing around."""
    return (said["model"]["type"] == "BPE" and not said["model"]["dropout"] and not said["truncation"] and not said["padding"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])
                        for t in said["added_tokens"]))


def is_blank_free(path: str) -> bool:
    said = parts(path)
    before = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    return (_plain(said) and (said["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(before) == 2
            and before[0].get("pattern") == {"Regex": SPLIT} and before[0]["behavior"] == "Removed" and before[0]["invert"]
            and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"] and not before[1]["use_regex"])


def is_byte_level(path: str) -> bool:
    """Whether a file is that of a byte-level model with its usual pattern."""
    said = parts(path)
    before = said["pre_tokenizer"] or {}
    return (_plain(said) and said["normalizer"] is None and before.get("type") == "ByteLevel"
            and not before["add_prefix_space"] and before["use_regex"] and not said["model"].get("ignore_merges")
            and not said["model"].get("continuing_subword_prefix") and not said["model"].get("end_of_word_suffix"))


#: Text to the library's encoding, with offsets.
Encode = Callable[[str], "Encoding"]


def _encoder(path: str) -> Encode:
    tok = tokenizer(path)
    return lambda text: tok.encode(text, add_special_tokens=False)


def splice(text: str, encode: Encode, chunk_chars: int, overlap: int) -> int:
    """How many tokens a long text has, by chunks.

    An overlap without a blank is not encoded: nothing in it is stable. Where
    the whole chunk has no boundary, the next one is at least as long as what
    has been encoded in vain and goes on to the next blank, so all encodings
    together are a small multiple of the text, whatever it is made of."""
    counted, begin, end = 0, 0, min(chunk_chars, len(text))
    # tokens of ``left``, an encoding of ``text[base:end]``, count from number ``first`` on, which starts at ``begin``
    left, base, first = encode(text[begin:end]), begin, 0
    while end < len(text):
        wide, cut = overlap, None
        after = min(end + chunk_chars - overlap, len(text))
        while cut is None and end - wide > begin:
            at = end - wide
            wide *= 2
            if not any(c in BLANKS for c in text[at:end]):
                continue
            right = encode(text[at:after])
            cut = _common(text, _tail(left, base, at), _head(right, at, end), at, end)
        if cut is None:  # nothing stable in the whole chunk: encode it with the next one
            blank = min((k for c in BLANKS if (k := text.find(c, end)) >= 0), default=len(text))
            end = min(len(text), max(after, end + end - begin, blank + overlap))
            left, base, first = encode(text[begin:end]), begin, 0
        else:
            counted += len(left) - cut[1] - first
            left, base, first, begin, end = right, at, cut[2], cut[0], after
    return counted + len(left) - first


def _tail(found: Encoding, base: int, low: int) -> list[tuple[int, int]]:
    """(id, place) of the last tokens, those that start after ``low``. Only
    they are taken out of the library's encoding, not the whole chunk's."""
    ids, out = found.ids, []
    for k in range(len(ids) - 1, -1, -1):
        start = base + found.token_to_chars(k)[0]
        if start <= low:
            break
        out.append((ids[k], start))
    return out[::-1]


def _head(found: Encoding, base: int, high: int) -> list[tuple[int, int]]:
    """(id, place) of the first tokens, those that start before ``high``."""
    out = []
    for k, i in enumerate(found.ids):
        start = base + found.token_to_chars(k)[0]
        if start >= high:
            break
        out.append((i, start))
    return out


def _common(text: str, left: list, right: list, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable boundary in ``text[low:high]`` that both encodings have: its
    place, the tokens of the left one from there on and those of the right one
    before it."""
    # what stands between the last blank and the end of the left chunk may change
    last = max(text.rfind(c, low, high) for c in BLANKS)
    a, b = [x for x in left if x[1] < last], [x for x in right if x[1] < last]
    starts = {o: k for k, (_, o) in reversed([*enumerate(b)])}
    for k, (_, o) in enumerate(a):
        if o in starts and text[o - 1] in BLANKS and a[k:] == b[starts[o]:]:
            return o, len(left) - k, starts[o]
    return None


# --- words ----------------------------------------------------------------

#: Characters below are in Latin blocks, which every version of Unicode has alike.
LATIN_END = "\u0250"
#: Those that are one character in lower case, of the same blocks, and no space. No normal form changes them.
LATIN = {c for c in map(chr, range(ord(LATIN_END))) if not c.isspace() and len(c.lower()) == 1 and c.lower() < LATIN_END}
_letters, _numbers = ("".join(c for c in sorted(LATIN) if kind(c)) for kind in (str.isalpha, str.isnumeric))
#: ``SPLIT`` for lower-case words of such characters.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^{_letters}{_numbers}]+")


def byte_letters() -> dict[int, str]:
    """The character by which byte-level models write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Counts:
    """Token counts of words between blanks, as the library gives them, in the
    worker's memo.

    A word of Latin characters only is cut by the tokenizer's own pattern, and
    the library's model is asked for each piece that is new; so "Word", "word"
    and "word," cost one question. Any other word, and one that holds a special
    string, goes through the whole library.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.model = self.tok.model
        self.words = worker_memo(f"counts-{path}", "words", MEMO)
        self.pieces = worker_memo(f"counts-{path}", "pieces", MEMO // 2)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts(path)["added_tokens"]) or "(?!)")
        self.letters = byte_letters()

    def _piece(self, piece: str) -> int:
        n = self.pieces.new.get(piece)
        if n is None:
            n = self.pieces.old.get(piece)
            if n is None:
                plain = piece.isascii() and piece.isalpha()
                n = len(self.model.tokenize(piece if plain else "".join(map(self.letters.__getitem__, piece.encode()))))
            self.pieces.new[piece] = n
        return n

    def learn(self, words: set[bytes]) -> None:
        memo, rest = self.words.new, []
        for word in words:
            text = word.decode()
            if LATIN.issuperset(text) and not self.special.search(text):
                text = text.lower()
                if text.isalpha():
                    memo[word] = self._piece(text)
                elif text[:-1].isalpha():
                    memo[word] = self._piece(text[:-1]) + self._piece(text[-1])
                else:
                    memo[word] = sum(map(self._piece, PIECE.findall(text)))
            else:
                rest.append(word)
        for low in range(0, len(rest), 8192):
            part = rest[low:low + 8192]
            memo.update(zip(part, map(len, self.tok.encode_batch_fast(
                [w.decode() for w in part], add_special_tokens=False))))

    def of(self, texts: list[str]) -> list[int]:
        split = [t.encode().split() for t in texts]
        self.learn(self.words.missing(set().union(*split)))
        return [sum(map(self.words.new.__getitem__, s)) for s in split]


def word_counts(texts: list[str], path: str) -> list[int]:
    """Token counts of texts, word by word through the worker's memo; whole by
    whole if the tokenizer does not allow that."""
    if not is_blank_free(path):
        return [len(e) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return Counts(path).of(texts)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = 16384, overlap: int = 256, blank_free: bool = True) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for each row of ``docs``."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(texts: list[str]) -> list[int]:
        if not blank_free or not is_blank_free(path):
            return [len(tokenizer(path).encode(t, add_special_tokens=False)) for t in texts]
        out = [0] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= chunk_chars]
        for low in range(0, len(short), 256):
            part = short[low:low + 256]
            for k, n in zip(part, word_counts([texts[k] for k in part], path)):
                out[k] = n
        for k in set(range(len(texts))).difference(short):
            out[k] = splice(texts[k], _encoder(path), chunk_chars, overlap)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1024):
                n = count(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["n_bytes"], pa.array(np.array(n, np.int64))], names=["id", "n_bytes", "n_tokens"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir), "word_bpe_49k.json")
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)
