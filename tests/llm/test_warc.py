from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from arbelo.llm import warc
from arbelo.llm.common import new_folder


def brute(rows, min_bytes=0):
    first = {}
    for k, h in rows:
        b = (h or "").encode()
        if k is not None and len(b) >= min_bytes:
            first[b] = min(first.get(b, k), k)
    out, seen = [], set()
    for k, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        original = len(b) < min_bytes or f is None or (f == k and (k, b) not in seen)
        seen.add((k, b))
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if original else "revisit", None if original else f))
    return sorted(out, key=str)


ROWS = [(5, "<p>a</p>"), (2, "<p>a</p>"), (9, None), (7, ""), (8, "é🙂\r\n\r\n" * 300), (3, "x" * 200_000), (4, "<p>a</p>"), (4, "<p>a</p>"), (2, "<p>b</p>"), (None, "<p>b</p>"), (None, "only")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, f"http://h/{k}\nX-Evil: 1", h, "x", 1) for k, h in ROWS], "page_id long, url string, html string, shard string, digest int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 100, "roll_bytes": 200}, {"min_bytes": 9}])
def test_round_trip(pages, options):
    found = sorted((tuple(r) for r in warc.report(pages, **options).collect()), key=str)
    assert found == brute(ROWS, options.get("min_bytes", 0))


def test_same_bytes_whatever_the_partitions(spark, pages):
    def files(df):
        folder = new_folder(spark, "warc")
        names = [r.name for r in warc.write(df, folder, shard_bytes=5_000, roll_bytes=400).collect()]
        root = folder.removeprefix("file://")
        assert not os.path.exists(f"{root}/_temporary")
        return {n: open(f"{root}/{n}", "rb").read() for n in names}

    a, b = files(pages), files(pages.repartition(7))
    assert a == b and len(a) > 2
    plain = gzip.decompress(b"".join(a.values()))
    assert plain.count(b"WARC/1.1\r\n") == len(ROWS) + len(a) and b"\nX-Evil: 1" not in plain


def test_damage_is_found(spark, pages):
    folder = new_folder(spark, "warc")
    name = warc.write(pages, folder).first().name
    path = f"{folder.removeprefix('file://')}/{name}"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, folder).collect()


def test_no_pages(pages):
    assert warc.report(pages.filter("1 = 0")).count() == 0


def test_outlying_and_frequent_keys_are_cut_too(spark):
    rows = [(i, "u", f"<p>{i}</p>") for i in range(300)] + [(2**62, "u", "far"), (-(2**62), "u", "near"), (2**62, "u", "far")] + [(77, "u", f"<b>{i}</b>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = new_folder(spark, "warc")
    manifest = warc.write(df, folder, shard_bytes=400, roll_bytes=1 << 20).collect()
    assert len({r.shard for r in manifest}) > 10 and max(r.records for r in manifest) < 120
    found = warc.read(spark, folder).collect()
    assert len(found) == len(rows)
    got = sorted((tuple(r) for r in warc.report(df, shard_bytes=400).collect()), key=str)
    assert got == brute([(k, h) for k, _, h in rows])


def test_files_roll_inside_a_shard(spark):
    df = spark.createDataFrame([(i, "u", f"{i * 7919 % 10007} " * 40) for i in range(400)], "page_id long, url string, html string")
    manifest = warc.write(df, new_folder(spark, "warc"), roll_bytes=4_000).collect()
    assert len({r.shard for r in manifest}) == 1 and len(manifest) > 5 and sum(r.records for r in manifest) == 400


def test_shards_are_dealt_evenly_and_rolled(spark, monkeypatch):
    """Many shards over fewer tasks; each full shard rolls; the bytes do not depend on the number of tasks."""
    rows = [(i, "u", f"{i:05d}" + hashlib.sha256(str(i).encode()).hexdigest() * 12) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")

    def files():
        folder = new_folder(spark, "warc")
        made = warc.write(df, folder, shard_bytes=20_000, roll_bytes=2_000).collect()
        assert sorted((r.key, r.record_type) for r in warc.read(spark, folder).collect()) == sorted((str(i), "response") for i in range(400))
        return {r.name: r.sha256 for r in made}, {r.shard for r in made}

    names, shards = files()
    assert len(shards) >= 15 and shards == set(range(len(shards))) and len(names) > 2 * len(shards)
    monkeypatch.setattr(warc, "TASKS", 3)
    assert files() == (names, shards)
    monkeypatch.setattr(warc, "SHARDS", 4)
    assert len(files()[1]) <= 8
