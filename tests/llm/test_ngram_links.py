from __future__ import annotations

import pytest
from test_ngram_join import brute, texts

from arbelo.llm import ngram_join


def brute_links(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and x and y and 100 * len(x & y) >= 85 * len(x | y)}, sets


@pytest.mark.parametrize("part", [100, 2])
def test_every_link_is_counted(spark, part):
    rows = texts(part, 160, True)
    rows += [(1000 + i, " ".join(["near"] * i + [f"v{j}" for j in range(200)])) for i in range(8)] + [(2000, None), (2001, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    linked, sets = brute_links(rows)
    found = sorted(tuple(r) for r in ngram_join.link_counts(df, part=part).collect())
    assert found == [(*r, sum(a == r[0] for a, _ in linked)) for r in brute(rows)]
    least = {}
    for k in sorted(sets):
        least.setdefault(sets[k], k)
    pairs = {(a, b) for a, b in linked if a < b and least[sets[a]] == a and least[sets[b]] == b}
    got = [tuple(r) for r in ngram_join.link_pairs(df, part=part).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r.n_links, r.doc_id or 0) for r in ngram_join.link_counts(df).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert ngram_join.link_counts(df.limit(0)).collect() == [] and ngram_join.link_pairs(df.limit(0)).collect() == []
