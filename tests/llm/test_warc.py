import gzip
import json
import os

import pytest

from gatewatch.llm import common
from gatewatch.llm import warc as A


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "a" * 50), (2, "v", "a" * 50), (2, "v", "a" * 50), (None, "w", "a" * 50), (3, None, None), (4, "x", ""),
            (5, "a\nb", "é\r\n\r\nWARC/1.1\r\n"), (6, "long", "lorem " * 200_000)]
    rows += [(i, "z", f"q{i}" * 30) for i in range(10, 300)] + [(1000 + i, "hot", "same page") for i in range(150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS payload", "1 AS shard")


def files(folder):
    store, path = A._store(folder)
    with store.open_input_stream(f"{path}/{A.MANIFEST}") as s:
        return path, json.loads(s.read())


def test_round_trip_and_copies(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages, folder, shard_bytes=200_000, roll_bytes=2_000)
    rows = pages.collect()
    top = {}
    for r in rows:
        if r.page_id is not None:
            top[r.html or ""] = max(r.page_id, top.get(r.html or "", r.page_id))
    want = sorted((str(r.page_id), len((r.html or "").encode()), A.base32_sha1((r.html or "").encode()),
                   "response" if top.get(r.html or "", r.page_id) == r.page_id else "revisit",
                   str(None if top.get(r.html or "", r.page_id) == r.page_id else top[r.html or ""])) for r in rows)
    back = A.read(spark, folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in back) == want
    texts = {r.page_id: r.html for r in rows}
    assert all(r.payload == (texts[r.page_id] or "") for r in back if r.record_type == "response" and r.page_id is not None)


def test_same_files_however_the_input_is_cut(spark, pages):
    seen = []
    for n in (1, 7):
        folder = common.new_path(spark, "archives")
        A.write(pages.repartition(n), folder, shard_bytes=20_000, roll_bytes=1_500)
        path, names = files(folder)
        seen.append([(f["name"], open(f"{path}/{f['name']}", "rb").read()) for f in names])
        assert sorted(os.listdir(path)) == sorted([A.MANIFEST, "_tmp", *[f["name"] for f in names]])
    assert seen[0] == seen[1] and len(seen[0]) > 20
    assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\n") for _, data in seen[0])


def test_only_what_the_manifest_names_counts(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages, folder)
    path, names = files(folder)
    with open(f"{path}/pages-999999-0000.warc.gz", "wb") as f:  # what a lost task left behind
        f.write(A.record(1, "u", b"x", 1, A.base32_sha1(b"x"), None, "2024-01-01T00:00:00Z"))
    assert A.read(spark, folder, bodies=False).count() == pages.count()
    # a commit that is repeated finds its work done
    rows = spark.createDataFrame([(f["name"], "_tmp/gone", f["bytes"], f["records"], f["crc32"]) for f in names],
                                 "name string, temporary string, bytes long, records long, crc32 long")
    A._commit(rows, folder)
    assert files(folder)[1] == names


def test_damage_is_noticed(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages.where("page_id = 6"), folder)
    path, names = files(folder)
    name = f"{path}/{names[0]['name']}"
    data = gzip.decompress(open(name, "rb").read()).replace(b"lorem ", b"LOREM ", 1)
    with open(name, "wb") as f:
        f.write(gzip.compress(data))
    with pytest.raises(Exception, match="does not fit its digest"):
        A.read(spark, folder).collect()


def test_small_payloads_are_never_revisits(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages, folder, min_bytes=20)
    got = A.read(spark, folder)
    assert got.where("payload_bytes < 20 and record_type = 'revisit'").count() == 0
    assert got.where("payload_bytes >= 20 and record_type = 'revisit'").count() == 2


def test_empty(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages.limit(0), folder)
    assert A.read(spark, folder).count() == 0


def test_commit_goes_on_where_it_stopped(spark, pages):
    folder = common.new_path(spark, "archives")
    A.write(pages, folder, shard_bytes=200_000, roll_bytes=2_000)
    path, names = files(folder)
    assert len(names) > 3 and [f["name"] for f in names] == sorted(f["name"] for f in names)
    kind = "name string, temporary string, bytes long, records long, crc32 long"
    rows = [(f["name"], f"_tmp/{f['name']}.x", f["bytes"], f["records"], f["crc32"]) for f in names]
    # a driver that was lost between two renames, before the manifest
    for name, temporary, *_ in rows[2:]:
        os.rename(f"{path}/{name}", f"{path}/{temporary}")
    os.rename(f"{path}/{A.MANIFEST}", f"{path}/_tmp/old")
    A._commit(spark.createDataFrame(rows, kind).repartition(3), folder)
    assert files(folder)[1] == names and A.read(spark, folder).count() == pages.count()
    with pytest.raises(Exception, match="neither the temporary file nor the final one"):
        A._commit(spark.createDataFrame([("gone", "_tmp/gone", 1, 1, 1)], kind), folder)


def test_equal_rows_are_one_in_the_sample(spark):
    rows = [(7, "u", "x" * 100)] * 3000 + [(i, "u", f"{i}" * 40) for i in range(100, 400)]
    seen = []
    for n in (1, 5):
        folder = common.new_path(spark, "archives")
        A.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n), folder,
                shard_bytes=10_000, sample_rows=100_000)
        path, names = files(folder)
        seen.append([(f["name"], open(f"{path}/{f['name']}", "rb").read()) for f in names])
        assert A.read(spark, folder, bodies=False).count() == len(rows)
    assert seen[0] == seen[1] and len(seen[0]) > 3
