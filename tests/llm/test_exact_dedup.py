from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from arbelo.llm import exact_dedup


def brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((k, t or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        wins = [(k, len(t)) == (keep[0], len(keep[1])) for k, t in own]  # of rows that repeat the winner one stays
        out += [(k, keep[0], len(own), i == wins.index(True), hashlib.sha256(norm.encode()).hexdigest()) for i, (k, _) in enumerate(own)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(odd, none):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(exact_dedup.assign(odd)) == want
    assert exact_dedup.assign(none).count() == 0
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, _, stays, _ in want if stays), key=str)
    assert exact_dedup.keep_one(none).count() == 0


def test_hash_collisions_are_told_apart_by_bytes(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "cd"), (4, "c d"), (5, "e"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_alike = lambda c: F.lit(b"0")
    assert found(exact_dedup.assign(df, hashed=all_alike)) == brute(rows)
    assert {r.doc_id for r in exact_dedup.keep_one(df, hashed=all_alike).collect()} == {k for k, *_, stays, _ in brute(rows) if stays}


def test_longest_original_text_stays_then_smallest_key(spark):
    df = spark.createDataFrame([(9, "a  b"), (3, "a b"), (4, "a\n\nb"), (5, "ab")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.assign(df).collect()} == {9: 4, 3: 4, 4: 4, 5: 4}


def test_of_repeated_rows_exactly_one_stays(spark):
    rows = [(1, "x y"), (1, "x y"), (1, "x  y"), (1, "xy "), (2, "x y"), (3, None), (3, None), (4, "other"), (None, "n"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.keep_one(df).collect()) == [(0, "n"), (1, "x  y"), (3, ""), (4, "other")]
    assert sorted(r.doc_id or 0 for r in exact_dedup.assign(df).filter("kept").collect()) == [0, 1, 3, 4]
    same = spark.createDataFrame([(7, "a b")] * 3, "doc_id long, text string")
    assert exact_dedup.keep_one(same).count() == 1 and exact_dedup.assign(same).filter("kept").count() == 1
