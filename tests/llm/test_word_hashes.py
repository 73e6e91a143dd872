"""Hashes of words (op6): words that a polynomial modulo a power of two cannot tell apart stay apart."""

from __future__ import annotations

import random

import numpy as np

from arbelo.llm import ngram_join
from arbelo.llm.shingles import shingle_set, word_hashes


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))


def hashes(text):
    return word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0]))[0].tolist()


def test_structured_words_stay_apart(spark):
    for bits in range(3, 14):
        word = thue_morse(bits)
        assert hashes(word) != hashes(word.translate(str.maketrans("ab", "ba")))
    a = thue_morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, f"{a} x y z w"), (5, f"{b} x y z w")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_words_by_their_bytes_wherever_they_stand():
    rng = random.Random(1)
    words = list({"".join(rng.choices("abABé0", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 600]))) for _ in range(3000)} | {"a", "aa", "a\0", "a\0\0"})
    rng.shuffle(words)
    found = hashes(" ".join(words))
    assert len(found) == len(words)
    low = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
    own = dict(zip(low, found, strict=True))
    assert len(set(own.values())) == len(own) and all(own[w] == h for w, h in zip(low, found, strict=True))
    assert all(hashes(f" {w}\n") == [own[w]] for w in low[:300])
    assert shingle_set("a b c d", 4).tolist() == shingle_set("  A  b\tC\nd ", 4).tolist() != shingle_set("a b d c", 4).tolist()
