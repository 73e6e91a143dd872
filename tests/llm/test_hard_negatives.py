"""Hard negatives (op12) against brute force: bounds, bands, ties, odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbelo.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int"


def brute(rows):
    """The contract's rows over (vec_id, embedding, label), by comparing each anchor with every row."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    anchors = {}
    for r in kept:
        if r[0] % 50 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    out = []
    for a, label, v in anchors.values():
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, other, w in kept if b != a]
        good = sorted((-s, b) for s, b, other in scored if other == label)[:5]
        for s, p in good:
            band = sorted((-t, b) for t, b, other in scored if other != label and 50 * -s <= 100 * t <= 95 * -s)[:3]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(band)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hn.report(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def make(rng, n, labels, dim=24):
    centres = [rng.normal(size=dim) for _ in range(4)]
    return [(i, (centres[i % 4] + rng.normal(size=dim) * rng.choice([0.2, 1.5])).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_rows_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = make(rng, 700, 4)
    assert mined(frame(spark, rows)) == brute(rows) != []


def test_small_blocks_many_copies_and_one_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 32)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    rows = make(rng, 600, 3)
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v, 1 if i % 2 else k) for i, v, k in rows]  # a third are one vector, most have one label
    assert mined(frame(spark, rows).repartition(7)) == brute(rows) != []


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = make(rng, 160, 2, 5)
    rows += [(200, None, 1), (250, [1.0] * 5, None), (None, [1.0] * 5, 1), (300, [float("nan")] * 5, 1), (350, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1), (400, [None, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(450, [], 1), (500, [1.0], 0), (550, [0.5] * 40, 0), (50, [0.1] * 5, 9)]  # shorter and longer vectors, a label of one row, an id that repeats
    assert mined(frame(spark, rows)) == brute(rows) != []
    assert hn.report(frame(spark, rows).filter("1 = 0")).count() == 0
    assert hn.report(frame(spark, rows[1:50])).count() == 0  # no anchor


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    # smooth vectors, as of curves: segments say much about them
    base = np.cumsum(rng.normal(size=(900, 64)), axis=1) * 20
    vectors = base.astype(np.int64)
    sums = hn.summarise(vectors.astype(np.float64))
    exact, at = vectors @ vectors.T, 0
    for level in hn.LEVELS:
        m, d = sums[:, at : at + level], sums[:, at + level : at + 2 * level]
        assert (m @ m.T + d @ d.T + 1e-3 >= exact).all() and (m @ m.T - d @ d.T - 1e-3 <= exact).all()
        at += 2 * level
    a = object.__new__(hn._Block)
    a.ids, a.dim, a.top, a.vectors, a.summaries = np.arange(900), 64, float(np.sqrt((vectors**2).sum(axis=1).max())), vectors, sums
    low = np.partition(exact, -5, axis=1)[:, -5].astype(float)
    counts = [0, 0, 0]
    i, j, scores = hn.survivors(a, a, np.ones((900, 900), bool), low, np.full(900, np.inf), counts)
    want = {(x, y): exact[x, y] for x, y in zip(*np.nonzero(exact >= low[:, None]), strict=True)}
    got = {(i[x], j[y]): scores[x, y] for x, y in zip(*np.nonzero(scores > hn.NONE), strict=True)}
    assert want.items() <= got.items()
    assert counts[0] == 810_000 and 5 * len(want) >= counts[2] and counts[2] < counts[1] < counts[0] / 50


def test_great_components_stay_exact_or_fail():
    rng = random.Random(5)
    a = np.array([[rng.randrange(-(2**29), 2**29) for _ in range(8)] for _ in range(9)])
    assert (hn.inner(a, a, 2.0**62) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in a] for p in a])).all()
    with pytest.raises(OverflowError):
        hn.inner(a, a, 2.0**63)


def test_best_takes_first_of_equals():
    scores = np.array([[5, 7, 7, 5, 5, 7], [hn.NONE, hn.NONE, 1, hn.NONE, hn.NONE, 1], [hn.NONE] * 6])
    x, y = hn.best(scores, 4)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (0, 5), (1, 2), (1, 5)]


def test_rows_spread_over_blocks(spark):
    rows = hn.whole_vectors(frame(spark, make(np.random.default_rng(6), 500, 2)))
    blocks = hn.pack(rows, 64)
    assert blocks.agg(F.sum("n")).first()[0] == 500 and blocks.agg(F.max("n")).first()[0] <= 64
