"""Periodic runs (op13) against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from arbelo.llm import periodic


def brute(w, least=12):
    """Every run (start, length, smallest period) by comparing all distances."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_text(rng):
    n, k = rng.randint(0, 130), rng.choice([1, 2, 2, 2, 3, 5])
    kind, w = rng.random(), [rng.randrange(k) for _ in range(n)]
    if kind < 0.3:  # one period, with some words changed
        base = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        w = [base[i % len(base)] for i in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                w[rng.randrange(n)] = rng.randrange(k + 1)
    elif kind < 0.5:  # Fibonacci words hold very many runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    elif kind < 0.7:  # stretches of one period that touch, overlap or differ in phase
        u = [rng.randrange(2) for _ in range(rng.randint(1, 4))] * 40
        w = u[: rng.randint(0, 40)] + u[rng.randint(0, 3) :][: rng.randint(0, 50)] + u[: rng.randint(0, 40)]
    return [b"%d" % x for x in w]


def test_all_runs_of_many_texts():
    rng, n = random.Random(1), 0
    for _ in range(30):
        texts = [some_text(rng) for _ in range(50)]
        for w, got in zip(texts, periodic._solve(texts, 12), strict=True):
            want = brute(w)
            assert got == want, w
            n += len(want)
    assert n > 3000


def test_wavelet_tree_gives_the_least_value_from_x_on():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)[:200]
    tree = periodic.WaveletTree(values)
    left = rng.integers(0, 200, 500)
    right = np.minimum(200, left + rng.integers(0, 60, 500))
    x = rng.integers(0, 700, 500)
    for a, b, v, got in zip(left, right, x, tree.successor(left, right, x, 999), strict=True):
        assert got == min((y for y in values[a:b] if y >= v), default=999)


def test_factor_ranks_and_extensions():
    rng = np.random.default_rng(3)
    w = np.append(rng.integers(0, 2, 90), 2)
    f = periodic.Factors(w)
    assert f.suffixes.tolist() == sorted(range(91), key=lambda i: w[i:].tolist())
    i, j = np.triu_indices(91, 1)
    for a, b, ahead, behind in zip(i, j, f.ahead(i, j), f.behind(i, j), strict=True):
        assert ahead == next(k for k in range(92) if b + k >= 91 or w[a + k] != w[b + k])
        assert behind == next(k for k in range(92) if a - k - 1 < 0 or w[a - k - 1] != w[b - k - 1])


def told(doc_id, text):
    """The contract's row, by brute force."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in runs)]
    s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        len(runs), s, size, q, 1000 * size // q if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def test_report_by_brute_force(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        words = [rng.choice(["a", "bé", "x.", "Y"]) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 120))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", " ", "\n"])))
    rows += [(900 + i, " ".join(["ab", "c", "ab", "d"][: 1 + i] * 9)) for i in range(4)] + [(910, None), (911, ""), (912, " \n\t"), (913, "\xa0 a\x1cb a\x1cb"), (900, "same id " * 30), (900, "same id " * 30), (None, "t " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, *r[1:]) for r in periodic.report(docs).collect()), key=repr)
    assert got == sorted(((i, *told(i, t)) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_long_texts_extra_columns_and_odd_rows(spark, odd, none):
    found = periodic.find_runs(odd).collect()
    assert len(found) == odd.count() and found[0].asDict().keys() >= {"n_words", "runs", "collapsed", "kept", "h"}
    by = {r.doc_id: r for r in found if r.doc_id != 3}
    assert [tuple(x) for x in by[4].runs] == [(0, 30_000, 1)] and by[4].collapsed == "word" and by[0].runs == [] and by[0].n_words == 0
    assert periodic.report(odd).count() == odd.count() and periodic.report(none).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(odd, runs="kept")
    with pytest.raises(ValueError):
        periodic.find_runs(odd, least=4)
    long = [b"%d" % (i % 7 if i < 150_000 else i % 50_000) for i in range(300_000)]  # one text of more than a chunk
    assert periodic._solve([long, [], [b"0"] * 12], 12) == [[(0, 150_000, 7), (150_000, 150_000, 50_000)], [], [(0, 12, 1)]]
