"""Quality (op4) and language (op10): held-out accuracy, and odd rows."""

from __future__ import annotations

import itertools
import random

import numpy as np

from arbelo.llm import langid, quality


def test_bradley_terry_ranks_the_better_row_higher():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) > 0).astype(int)
    rank = x @ quality.bradley_terry(x, y)
    assert rank[y == 1].mean() > rank[y == 0].mean() and np.mean((rank > 0) == (y == 1)) > 0.95


def test_quality_on_held_out_rows(spark, odd, none):
    rng, rows = random.Random(3), []
    for i in range(500):
        good = i % 4 != 0
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(words) if good else "!! ".join(words[:5] * 12).upper(), int(good)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    found = quality.report(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert quality.report(odd, labels).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in quality.report(odd, labels).collect())
    assert quality.report(odd, labels.filter("1 = 0")).filter("predicted = 1").count() == odd.count()
    assert quality.report(none, labels).count() == 0


def brute_viterbi(scores, switch):
    best, at = None, None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        s = sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if best is None or s > best + 1e-9:
            best, at = s, path
    return best, at


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    langs = ["a", "b", "c"]
    words = [f"w{i}" for i in range(9)]
    labeller = langid.Labeller({"langs": langs, "grams": {}, "unseen": np.zeros(3), "scripts": {}}, 1.5)
    labeller.scores = rng.normal(size=(len(words), 3))
    labeller.known = {w: i for i, w in enumerate(words)}
    texts = [list(rng.choice(words, size=n)) for n in (0, 1, 2, 5, 6, 6, 3)]
    for text, path in zip(texts, labeller.label(texts), strict=True):
        if not text:
            assert not len(path)
            continue
        scores = np.array([labeller.scores[labeller.known[w]] for w in text])
        own = sum(scores[i, p] for i, p in enumerate(path)) - 1.5 * np.count_nonzero(np.diff(path))
        assert abs(own - brute_viterbi(scores, 1.5)[0]) < 1e-9


def path_score(scores, path, switch):
    return sum(scores[i, p] for i, p in enumerate(path)) - switch * np.count_nonzero(np.diff(path))


def test_settled_texts_have_the_best_path_too():
    rng = np.random.default_rng(8)
    words, settled = [f"w{i}" for i in range(12)], 0
    for _ in range(40):
        labeller = langid.Labeller({"langs": ["a", "b", "c"], "grams": {}, "unseen": np.zeros(3), "scripts": {}}, 4.0)
        labeller.scores = rng.normal(size=(len(words), 3)) + np.array([rng.uniform(0, 3), 0, 0])
        labeller.known = {w: i for i, w in enumerate(words)}
        texts = [list(rng.choice(words, size=rng.integers(1, 8))) for _ in range(12)]
        rows = [np.array([labeller.known[w] for w in t]) for t in texts]
        settled += np.count_nonzero(labeller._settled(np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1]) >= 0)
        for text, path in zip(texts, labeller.label(texts), strict=True):
            scores = np.array([labeller.scores[labeller.known[w]] for w in text])
            assert abs(path_score(scores, path, 4.0) - brute_viterbi(scores, 4.0)[0]) < 1e-9
    assert 100 < settled < 480


def test_letterless_texts_have_no_language(spark):
    docs = spark.createDataFrame([(i, "plain words of one kind", "en") for i in range(40)] + [(100, "½ ²", "en"), (101, "Ⅷ ① 12", None), (102, "_ 7", None), (103, "ab½cd", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.report(docs).collect()}
    assert [found[k] for k in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert langid.words("ab½Cd Ⅷ é1") == ["ab", "cd", "é"]


def test_language_on_held_out_rows_and_mixed_spans(spark, odd, none):
    rng, rows = random.Random(4), []
    sounds = {"aa": ["ba", "ko", "ri"], "bb": ["thu", "sch", "ent"], "ru": ["да", "ни", "то"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(n))

    for i in range(300):
        lang = list(sounds)[i % 3]
        rows.append((i, text(lang, rng.randint(2, 40)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.report(docs).collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang_pred == list(sounds)[r.doc_id % 3] for r in held) >= 0.98 * len(held)
    model = langid.fit(docs)
    mixed = spark.createDataFrame([(1, text("aa", 20) + " " + text("ru", 30))], "doc_id long, text string")
    spans = langid.label(mixed, model).first().lang_spans
    assert [(s.start, s.end, s.lang) for s in spans] == [(0, 20, "aa"), (20, 50, "ru")]
    more = langid.label(odd.drop("score"), model).collect()
    assert {r.lang_pred for r in more if not r.text or not r.text.strip()} == {"und"}
    assert langid.report(odd).count() == odd.count()
    assert langid.report(none).count() == 0
    assert {r.lang_pred for r in langid.report(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("doc_id < 3")).collect()} == {"und"}
