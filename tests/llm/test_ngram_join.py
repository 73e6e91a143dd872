from __future__ import annotations

import random

import numpy as np
import pytest

from arbelo.llm import ngram_join


def brute(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split(" ")
        w = [x for x in w if x]
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((k, len(sets[k]), label[k]) for k in sets)


def texts(seed, n, common):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    passage = rng.choices(vocabulary, k=40)
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 20, 60, 200]))
        if common and rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("block", [2000, 3])
def test_as_brute_force(spark, block):
    rows = texts(block, 160, True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(tuple(r) for r in ngram_join.link_components(df, block=block).collect())
    assert found == brute(rows)


def test_common_shingles_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 2)
    rows = texts(9, 120, True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in ngram_join.link_components(df).collect()) == brute(rows)


def test_the_tree_loses_no_pair_that_can_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 60, rng.integers(3, 300)).astype(np.uint64)
        for _ in range(4):
            own = base.copy()
            own[rng.random(len(own)) < 0.05] += np.uint64(1)
            sets.append(np.unique(own))
    points = np.array([np.bincount((s % np.uint64(16)).astype(int), minlength=16) for s in sets])
    tree = ngram_join.CountTree(points, np.array([len(s) for s in sets]), 85, 100)
    for i, a in enumerate(sets):
        near = set(tree.search(points[i], len(a)).tolist())
        assert {j for j, b in enumerate(sets) if ngram_join.links(a, b)} <= near


def test_prefixes_are_long_enough():
    for n in range(1, 300):
        assert ngram_join.prefix_length(n) == n - -(-85 * n // 100) + 1


def test_odd_rows(odd, none):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(odd).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (7, 3, 7), (8, 3, 7)} <= found
    assert (None, 1, None) in found
    assert ngram_join.link_components(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, 4, 5, 6, 7, None]


def test_of_repeated_rows_exactly_one_stays(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "short"), (3, "a longer one of five"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(df).collect()) == [(1, "a b c d e"), (3, "a longer one of five"), (4, "")]
