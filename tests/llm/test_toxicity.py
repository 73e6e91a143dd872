from __future__ import annotations

import random

import numpy as np

from arbelo.llm import toxicity


def brute_segments(scores):
    """All maximal-scoring segments by their recursive definition."""

    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (top is None or s > top[2] + 1e-9 or (abs(s - top[2]) < 1e-9 and j + 1 - i < top[1] - top[0])):
                    top = (i, j + 1, s)
        return top

    def split(a, b):
        top = best(a, b)
        return [] if top is None else split(a, top[0]) + [top] + split(top[1], b)

    return split(0, len(scores))


def test_segments_are_the_maximal_scoring_ones():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-5, -2, -1.5, -0.25, 1, 2.25, 3.5, 4.75]) + rng.random() / 1000 for _ in range(rng.randint(0, 25))]
        found = toxicity.segments(np.array(scores)) if scores else []
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want])


def corpus(spark, n=600):
    rng = random.Random(2)
    plain, bad = [f"w{i}" for i in range(300)], ["slur1", "slur2", "slur3"]
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        w = rng.choices(plain, k=rng.randint(5, 80))
        for _ in range(rng.randint(1, 4) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    return docs, labels, {i: t for i, _, t in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.report(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_odd_rows(spark, odd, none):
    docs, labels, _ = corpus(spark, 60)
    both = docs.unionByName(odd.select("doc_id", "text"))
    more = labels.unionByName(spark.createDataFrame([(3, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.report(both, more).count() == both.count()
    no_labels = labels.filter("1 = 0")
    assert toxicity.report(odd, no_labels).filter("predicted = 1").count() == 0
    assert toxicity.report(none, no_labels).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    one_kind = labels.filter("toxic = 0")
    assert toxicity.report(odd, one_kind).count() == odd.count()


def test_log_odds_are_signed_and_shrunken():
    odds = toxicity.log_odds(np.array([0, 1, 5, 50, 0, 10]), np.array([0, 0, 0, 0, 50, 90]), 100, 900)
    assert abs(odds[0]) < 1e-9 and 0 < odds[1] < odds[2] < odds[3] and odds[4] < -1 and abs(odds[5]) < 0.1


def test_chance_excess_of_clean_texts_is_calibrated(spark):
    """Clean texts that the fit has not seen rarely have a significant passage, whatever their own words."""
    docs, labels, truth = corpus(spark, 900)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).filter("held").collect()
    clean = [r for r in rows if not truth[r.doc_id]]
    assert sum(bool(r.passages) for r in clean) <= 0.4 * len(clean) and all(r.score < toxicity.THRESHOLD for r in clean)
    assert sum(bool(r.passages) for r in rows if truth[r.doc_id]) >= 0.95 * (len(rows) - len(clean))


def test_repeated_documents_count_once(spark):
    docs, labels, truth = corpus(spark)
    many = docs.unionByName(docs).unionByName(docs)
    rows = [r for r in toxicity.report(many, labels).collect() if r.held_out]
    assert len(rows) > 300 and sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
