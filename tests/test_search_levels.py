"""The best names of a query, level by level; postings of names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import alike, ranking, search


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    name = lambda: "LOJA " + "".join(r.choices("ABCD12", k=5))
    known = [(f"E{i:03}", name(), w) for i in range(150) for w in (1.0, 0.95)]
    asked = [(i, known[i * 2][1] if i % 2 else name()) for i in range(30)] + [(90, "ZZZZZ"), (91, "CONTATO K1")]
    others = [(1, "E007", 0.95), (1, "E001", 1.0), (2, "E009", 0.9), (90, "E003", 1.0)]
    return spark.createDataFrame(asked, "q long, query string"), spark.createDataFrame(known, "id string, nome string, w double"), spark.createDataFrame(others, "q long, id string, s double")


@pytest.mark.parametrize("n", [1, 5, 40])
def test_levels_lose_none_of_the_best(spark, tables, monkeypatch, n):
    asked, names, others = tables
    best = lambda by_name: sorted(map(tuple, ranking.top_k(others.unionByName(by_name.join(others, ["q", "id"], "left_anti")).withColumn("s", X.round_half_up(F.col("s"), 2)).filter("s >= 0.4"), ["q"], n, F.col("s").desc(), F.col("id")).collect()))
    whole = best(search.candidates(asked, names.select("nome"), "max", 0.39).join(names, "nome").groupBy("q", "id").agg(F.max(F.col("s") * F.col("w")).alias("s")))
    monkeypatch.setattr(search, "ALL_PAIRS", 0)
    assert best(search.nearest(asked, names, others, n, "max", 0.39)) == whole and len(whole) > 30


def test_postings_are_never_sent_through_the_driver(spark, tables, monkeypatch):
    asked, names, _ = tables
    monkeypatch.setattr(alike, "ALL_PAIRS", 0)
    found = alike.scored(asked.select(F.col("query").alias("name")), names.select(F.col("nome").alias("name")), 0.39)
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()
