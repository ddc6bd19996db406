"""A deterministic sharded WARC writer, and a reader.

Write. Records are dealt into shards by ranges of (page id, payload digest) and
sorted by them; each shard goes to one task, which rolls to a new file when the
compressed size passes ``roll_bytes``. Every record is a gzip member of its
own; its headers are made anew: payload and block digests, lengths, an id and a
date that follow from the content. So the files depend on the records and the
parameters alone, byte for byte, however the input is partitioned.

Ranges. The cut points are quantiles of a sample of records picked by a hash
(about ``sample_rows``; equal ones count as one with their bytes), so they do
not depend on the partitioning either.

Copies. Of records with equal payloads of ``min_bytes`` or more the one with
the largest page id is written as response, the others as revisits of it
without the payload (their HTTP header still names the full length). The
largest id is found by a partial maximum per payload digest, so a payload that
a third of the pages share is no hot spot. Payloads count as equal if their
SHA-256 are.

Commit. A task writes under a temporary name of its own attempt. What it wrote
comes back as manifest rows, which Spark's writer commits for the winning
attempt only; then tasks over these rows rename the files into place, and the
manifest, a line for each file, is put beside them last, through a temporary
name too. The driver streams its lines and holds none. A reader goes by the
manifest, so it never sees what a lost or repeated task left behind, and the
renames can be repeated.

Edge cases: a null payload is empty, a null url is written as ``about:blank``;
rows with a null id are written with an empty id and read back as null. Rows
with equal ids and equal payloads, largest of their payload, are all responses.
An empty table gives a manifest without files. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

MANIFEST = "MANIFEST.json"
NAME_SPACE = uuid.UUID("b6f8a3a0-5d0e-4f38-9a53-0d8f4f0d2c11")


def _store(path: str):
    """The file system of a folder and the path within it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One record as it stands in a file, compressed."""
    revisit = refers_to is not None
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {n_bytes}\r\n\r\n").encode()
    block = http if revisit else http + payload
    key = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAME_SPACE, f'{key} {digest}')}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Page-ID: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAME_SPACE, f'{refers_to} {digest}')}>",
                  f"Refers-To-Page-ID: {refers_to}"]
    text = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(text, 6, mtime=0)


def _key(page_id: int | None, digest: bytes) -> bytes:
    """Bytes that sort like (page id, digest), a null id first."""
    return (b"\0" * 9 if page_id is None else b"\1" + int(page_id + (1 << 63)).to_bytes(8, "big")) + digest


class _Shard:
    """The open file of a shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll = folder, shard, roll_bytes
        self.part, self.out, self.rows = 0, None, []
        self.store, self.path = _store(folder)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"_tmp/{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size = self.n = self.crc = 0
        self.out.write(data)
        self.size, self.n, self.crc = self.size + len(data), self.n + 1, zlib.crc32(data, self.crc)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.size, self.n, self.crc))
            self.part, self.out = self.part + 1, None


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, (None, None, None)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = (row["shard"], row["page_id"], row["same"])
                if row["refers_to"] is not None:  # says that the pages of this key are revisits
                    of, refers_to = key, row["refers_to"]
                    continue
                if shard is None or row["shard"] != shard.shard:
                    if shard is not None:
                        shard.close()
                        done += shard.rows
                    shard = _Shard(folder, row["shard"], roll_bytes)
                payload = row["payload"].encode()
                digest = base32_sha1(payload)
                shard.add(record(row["page_id"], row["url"], payload, len(payload), digest,
                                 refers_to if key == of else None, date))
            done += shard.rows if shard else []
            if shard:
                shard.rows = []
            yield from _manifest_rows(done)
        if shard is not None:
            shard.close()
            yield from _manifest_rows(shard.rows)

    return run


def _manifest_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*rows)], names=["name", "temporary", "bytes", "records", "crc32"])


def _placer(cuts: list[bytes]):
    """Adds the shard of each record, by bisection of the cut points."""
    import bisect

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect.bisect_right(cuts, _key(i, bytes.fromhex(s))) for i, s in zip(
                batch["page_id"].to_pylist(), batch["sha1"].to_pylist())]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, sample_rows: int = 20_000,
          date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes ``pages`` to archives under ``folder`` and returns the manifest's path."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({
        "sha1": F.sha1(F.encode("payload", "UTF-8")), "same": F.unhex(F.sha2(F.encode("payload", "UTF-8"), 256)),
        "n_bytes": F.octet_length("payload").cast("long")})
    # digests alone: what the cut points and the copies need
    facts = written(rows.select("page_id", "sha1", "same", "n_bytes"), "page-digests")
    n, total = facts.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    shards = max(1, -(-int(total) // shard_bytes))
    share = min(1.0, sample_rows / max(1, n))
    picked = facts.where(F.pmod(F.xxhash64("page_id", "sha1"), F.lit(1 << 30)) < int(share * (1 << 30)))
    cuts: list[bytes] = []
    if shards > 1:
        sample = sorted((_key(r.page_id, bytes.fromhex(r.sha1)), r.n_bytes) for r in picked.groupBy(
            "page_id", "sha1").agg(F.sum("n_bytes").alias("n_bytes")).collect())
        at = np.cumsum([b for _, b in sample])
        if len(at):
            ends = np.searchsorted(at, at[-1] * np.arange(1, shards) / shards)
            cuts = sorted({sample[min(k, len(sample) - 1)][0] for k in ends.tolist()})
    # only payloads that occur more than once, with the largest page id of each
    copied = facts.where(F.col("n_bytes") >= min_bytes).groupBy("same").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("times")).where("times > 1 and largest is not null")
    # payloads are shuffled once, by shard; what each revisit refers to comes as
    # a row of its own, which sorts before the pages of its key
    refers = facts.join(copied.select("same", "largest"), "same").where(
        F.coalesce(F.col("page_id") < F.col("largest"), F.lit(True))).select(
        "page_id", "sha1", "same", F.col("largest").alias("refers_to")).distinct()
    whole = rows.drop("n_bytes").unionByName(refers, allowMissingColumns=True)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    placed = whole.mapInArrow(_placer(cuts), f"{types}, shard int")
    sorted_ = placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "page_id", "sha1", "same", F.col("refers_to").desc_nulls_last(), "url")
    store, path = _store(folder)
    store.create_dir(f"{path}/_tmp", recursive=True)
    done = written(sorted_.mapInArrow(
        _writer(folder, roll_bytes, date), "name string, temporary string, bytes long, records long, crc32 long"),
        "manifest-rows")
    return _commit(done, folder)


def _mover(folder: str):
    """Renames files into place; a task that runs again finds its work done."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for f in batch.to_pylist():
                there, new = f"{path}/{f['temporary']}", f"{path}/{f['name']}"
                if store.get_file_info(there).type == fs.FileType.File:
                    try:
                        store.move(there, new)
                    except OSError:
                        # another attempt of this task may have been first
                        if store.get_file_info(there).type == fs.FileType.File:
                            raise
                found = store.get_file_info(new)
                if found.type != fs.FileType.File or found.size != f["bytes"]:
                    raise FileNotFoundError(f"{f['name']}: neither the temporary file nor the final one is there")
            yield batch.drop_columns(["temporary"])

    return run


def _commit(done: DataFrame, folder: str) -> str:
    """Renames the files of the winning attempts, then puts the manifest down."""
    store, path = _store(folder)
    moved = written(done.mapInArrow(_mover(folder), "name string, bytes long, records long, crc32 long"), "moved")
    with store.open_output_stream(f"{path}/_tmp/{MANIFEST}") as out:
        before = "[\n"
        for f in moved.orderBy("name").toLocalIterator():
            out.write((before + json.dumps(f.asDict())).encode())
            before = ",\n"
        out.write(b"\n]" if before == ",\n" else b"[]")
    store.move(f"{path}/_tmp/{MANIFEST}", f"{path}/{MANIFEST}")
    return f"{folder}/{MANIFEST}"


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an open file, one member at a time."""
    rest = b""
    while True:
        inflate = zlib.decompressobj(31)
        parts = []
        while not inflate.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise EOFError("a record is cut off")
                return
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, block[:int(headers["Content-Length"])]


def _reader(folder: str, bodies: bool):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
    kinds = kinds if bodies else kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if base32_sha1(block) != h["WARC-Block-Digest"][5:]:
                            raise ValueError(f"{name}: a block does not fit its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = h["WARC-Payload-Digest"][5:]
                        full = h["WARC-Type"] == "response"
                        if full and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: a payload does not fit its digest")
                        rows.append({
                            "page_id": int(h["Page-ID"]) if h["Page-ID"] else None, "url": h["WARC-Target-URI"],
                            "payload_bytes": n, "payload_digest": digest, "record_type": h["WARC-Type"],
                            "refers_to": int(h["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in h else None,
                            "payload": payload.decode() if full else None})
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return run


def _listing(folder: str):
    """The names in the manifest, read line by line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, path = _store(folder)
            at, names = 0, []
            with io.TextIOWrapper(store.open_input_stream(f"{path}/{MANIFEST}", compression=None), "utf-8") as lines:
                for line in lines:
                    if line.startswith("{"):
                        names.append(json.loads(line.rstrip().rstrip(","))["name"])
                    if len(names) == 10_000:
                        yield _named(at, names)
                        at, names = at + len(names), []
            yield _named(at, names)

    return run


def _named(at: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(at, at + len(names)), pa.int32()), pa.array(names, pa.string())], names=["at", "name"])


def read(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    """The records of the files that the manifest names, a file a task."""
    names = written(spark.range(0, 1, 1, 1).mapInArrow(_listing(folder), "at int, name string"), "names")
    types = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
             + ", payload string" * bodies)
    return names.repartitionById(max(1, names.count()), F.col("at")).select("name").mapInArrow(
        _reader(folder, bodies), types)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_path(spark, "archives")
    write(pages, folder)
    return read(spark, folder, bodies=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
