"""Names met on prefixes of their rarest parts: no pair that reaches the threshold is lost."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators.alike import alike


@pytest.mark.parametrize("least", [0.3, 0.5, 0.72, 0.86])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least * 100))
    words = ["MERCADO", "BOM", "PRECO", "CENTRAL", "AAAA", "AA", "NOVO", "RIO", "R2"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)} | {"A", "AB", ""})
    rows = [(g, n) for g in (1, 2) for n in names if n and rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k int, name string")
    every = df.withColumnRenamed("name", "a").join(df.withColumnRenamed("name", "b"), "k")
    want = {tuple(r) for r in every.filter(X.name_similarity(F.col("a"), F.col("b")) >= least).select("k", "a", "b").collect()}
    met = [tuple(r) for r in alike(df, df, least, ["k"]).collect()]
    assert len(met) == len(set(met)) and want <= set(met)
