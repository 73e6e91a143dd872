"""Names that meet on several shared parts, groups of few names, and mentions whose names settle early, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import alike, mentions, search
from arbelo.operators.resolve import Params


def brute(left, right, least):
    every = left.withColumnRenamed("name", "a").join(right.withColumnRenamed("name", "b"), "k")
    return {(r.k, r.a, r.b): r.s for r in every.select("k", "a", "b", X.name_similarity(F.col("a"), F.col("b")).alias("s")).filter(F.col("s") >= least).collect()}


@pytest.mark.parametrize("few", [0, 900])
def test_three_shared_parts_lose_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(alike, "ALL_PAIRS", 0)
    monkeypatch.setattr(alike, "DEEP", 0)
    monkeypatch.setattr(alike, "FEW", few)
    rng = random.Random(5)
    names = sorted({"LOJA " + "".join(rng.choices("0123AB", k=rng.randint(1, 9))) for _ in range(120)} | {"A", "B A", "LOJA"})
    left, right = (spark.createDataFrame([(g, n) for g, share in ((1, 0.8), (2, 0.1)) for n in names if rng.random() < share], "k int, name string") for _ in "ab")
    want = brute(left, right, 0.5)
    got = [(r.k, r.a, r.b, r.s) for r in alike.scored(left, right, 0.5, ["k"]).collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want != {}


def test_a_settled_name_meets_no_unlike_ones(spark):
    rows = [(f"e{i}", i, n) for i, n in enumerate(["LOJA AAAA", "LOJA BBBB", "LOJA CCCC", "MERCADO AZUL", "MERCADO AZUIS"])]
    owners = spark.createDataFrame(rows, "id string, ordem int, nome string")
    asked = spark.createDataFrame([(n, n) for n in ("LOJA AAAA", "MERCADO AZUL", "LOJA AAAB")], "q string, query string")
    got = sorted((r.q, r.id) for r in mentions._nearest(asked, owners, Params()).collect())
    assert [i for q, i in got if q == "LOJA AAAA"] == ["e0"]  # before, every shop was its candidate
    least = [(q, i) for q in ("LOJA AAAB",) for i, _, n in rows if spark.range(1).select(X.name_similarity(F.lit(q), F.lit(n))).first()[0] >= 0.5]
    assert {i for q, i in got if q == "LOJA AAAB"} == {i for _, i in least}
    assert [i for q, i in got if q == "MERCADO AZUL"] == ["e3"]  # the next one is too far behind to matter


def test_names_that_hold_a_query_meet_on_its_rarest_word(spark):
    asked = spark.createDataFrame([("q1", "LOJA RARA"), ("q2", "LOJA"), ("q3", "LOJA NADA"), ("q4", "RARA RARA")], "q string, query string")
    names = spark.createDataFrame([("LOJA RARA",), ("RARA LOJA SUL",), ("LOJA NORTE",), ("",)], "nome string")
    got = sorted((r.q, r.nome) for r in search.contained(asked, names).collect())
    assert got == [("q1", "LOJA RARA"), ("q1", "RARA LOJA SUL"), ("q2", "LOJA NORTE"), ("q2", "LOJA RARA"), ("q2", "RARA LOJA SUL"), ("q4", "LOJA RARA"), ("q4", "RARA LOJA SUL")]
