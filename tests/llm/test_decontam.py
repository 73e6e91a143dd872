from __future__ import annotations

import hashlib
import random
import re

import pytest

from arbelo.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    out = []
    for k, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            p = words(text)
            n = min(window, len(p))
            for i in range(len(p) - n + 1) if n else []:
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item))
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_as_brute_force(spark, block_words):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "d1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 10, 12])))) for i in range(10)] + [(3, "a b c a b"), (11, None)]
    docs = [(i, "-".join(rng.choices(vocabulary + ["zz"], k=rng.randint(0, 60)))) for i in range(60)] + [(70, None), (71, "")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = sorted((tuple(r) for r in decontam.report(df, it, block_words=block_words).collect()), key=str)
    assert found == brute(docs, items)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "same text of some words here"), (None, "ÀÉ中"), (2, "")], "item_id int, text string")
    found = {r.doc_id: r for r in decontam.report(odd, items).collect()}
    assert found[7].contaminated and found[7].n_hit == 6 and not found[0].contaminated and found[4].n_words == 30_000
    assert found[6].contaminated is False or found[6].n_items == 0
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and not {7, 8} & {r.doc_id for r in kept.collect()}
    assert decontam.report(none, items).count() == 0
    assert decontam.report(odd, items.filter("1 = 0")).filter("contaminated").count() == 0
