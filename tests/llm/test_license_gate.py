"""The keyword gate of the license rules refuses no text that their patterns match; sentences of license texts have their label."""

from __future__ import annotations

import itertools
import random
import re
from re import _parser

from pyspark.sql import functions as F

from arbelo.llm import licenses


def language(items, most):
    """All texts of a pattern; repeats as often as least and, if most, as often as most; a negated class as one letter."""
    parts = []
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            parts.append([chr(x) for _, x in arg])
        elif op == "NOT_LITERAL":
            parts.append(["q"])
        elif op == "SUBPATTERN":
            parts.append(language(arg[3], most))
        elif op == "BRANCH":
            parts.append([x for one in arg[1] for x in language(one, most)])
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            times = sorted({int(low), min(int(high), 24)}) if most else [int(low)]
            parts.append([x * n for n in times for x in (language(inner, most) if n else [""])])
        else:
            assert op.startswith("ASSERT"), op
    return ["".join(x) for x in itertools.product(*parts)]


def test_no_rule_is_gated_off_a_text_it_matches():
    by_pattern = {}
    for r in licenses.rules():
        by_pattern.setdefault(r.pattern, []).append((r.keyword, r.needs))
    refused = {}
    for pattern, pairs in by_pattern.items():
        texts = language(_parser.parse(pattern), most=False)
        if len(texts) <= 60:
            texts += language(_parser.parse(pattern), most=True)[:2_000]
        assert re.search(pattern, f" {texts[0]} ")
        for t in texts:
            words = set(t.split(" "))
            if not any(k in words and n in words for k, n in pairs):
                refused[pattern] = t
    assert not refused


TEXTS = {
    "licensed under the Open Font License 1.1": "ofl",
    "General Public License version 2": "gpl-2",
    "Lesser General Public License version 2.1": "lgpl-2.1",
    "Library General Public License 2": "lgpl-2",
    "Free Documentation License 1.2": "gfdl",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
}


def test_names_without_optional_words_and_bodies(spark):
    docs = spark.createDataFrame([(t, t) for t in TEXTS], "doc_id string, text string")
    assert {r.doc_id: r.labels for r in licenses.report(docs).collect()} == TEXTS


def test_every_rule_finds_its_words_and_not_them_reversed():
    patterns = {r.pattern for r in licenses.rules() if not r.base}
    assert len(patterns) > 500
    for pattern in patterns:
        words = language(_parser.parse(pattern), most=False)[0].split(" ")
        assert re.search(pattern, f" {' '.join(words)} ")
        if len(words) > 1:
            assert not re.search(pattern, f" {' '.join(words[:-1])}x {words[-1]}x ")


def test_each_signature_has_words_that_tell_it():
    seen = {}
    for label, words in licenses.SIGNATURES:
        assert words == " ".join(words.split()) and len(words.split()) >= 2 and seen.setdefault(words, label) == label
    assert len(seen) == len(licenses.SIGNATURES)


def brute_kept(found):
    inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1]
    return sorted(d for d in found if not any(inside(d, o) and (o[3] > d[3] or (o[3] == d[3] and o[1] - o[0] > d[1] - d[0])) for o in found))


def test_suppression_as_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [(a := rng.randrange(12), a + rng.randint(1, 6), rng.choice("xyz"), rng.randint(1, 4), False) for _ in range(rng.randint(0, 14))]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, found array<struct<start:int,end:int,label:string,priority:int,base:boolean>>")
    for r in df.withColumn("kept", licenses._unsuppressed(F.col("found"), 4)).collect():
        assert sorted(tuple(d) for d in r.kept) == brute_kept([tuple(d) for d in r.found])


def test_labels_as_brute_force(spark):
    texts = ["the MIT License and SPDX-License-Identifier: MIT, a copy of the Apache License Version 2.0 at", "See the BSD 3-Clause license. " * 3 + "CC BY-SA 4.0", "released under the GNU General Public License v3, all rights reserved"]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        plain = f" {' '.join(re.findall('[a-z0-9]+', texts[r.doc_id].lower()))} "
        found = set()
        for rule in licenses.rules():
            for m in re.finditer(rule.pattern, plain):
                found.add((plain[: m.start()].count(" ") - 1, plain[: m.end()].count(" "), rule.label, rule.priority, rule.base))
        # two forms of one license may give the same detection
        assert {tuple(d) for d in r.found} == found and {tuple(d) for d in r.kept} == set(brute_kept(found))


def test_kelvin_signs_are_no_letters_of_keywords(spark):
    docs = spark.createDataFrame([(1, "Mozilla Public Licen\u017fe MIT \u212a mit license"), (2, "m\u0130t license mit l\u0130cense")], "doc_id int, text string")
    assert {r.doc_id: r.n_base for r in licenses.report(docs).collect()} == {1: 1, 2: 0}


def test_many_places_in_one_text(spark):
    docs = spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id int, text string")
    r = licenses.report(docs).first()
    assert (r.n_base, r.first_word, r.last_word) == (100_000, 0, 199_998)
