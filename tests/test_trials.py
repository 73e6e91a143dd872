"""Models against Spark ML and plain least squares, noise, comparators and leaks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbelo.functions import noise
from arbelo.functions import text as X
from arbelo.operators import access, benchmark, evaluate, experiments, models


@pytest.fixture(scope="module")
def runs(spark):
    r = random.Random(3)
    rows = []
    for k in range(600):
        a, b, m = r.choice("xyz"), r.choice("pq"), r.randint(5, 20)
        rate = 0.2 * (1.5 if a == "y" else 1.0) * (0.7 if b == "q" else 1.0)
        rows.append((a, b, m, sum(r.random() < rate for _ in range(m)), r.gauss(3.0 + (a == "z"), 1.0)))
    return spark.createDataFrame([*rows, (None, "p", 5, 1, 1.0), ("x", "p", 0, 0, None)], "a string, b string, m int, y int, v double")


def test_poisson_equals_spark_ml(runs):
    fit = models.fit(models.cells(runs, ["a", "b"], "y", "m"), ["a", "b"])
    kept = runs.filter("a is not null and m > 0")
    ml = experiments.poisson_rates(kept, ["a", "b"], "y", "m")
    assert fit.deviance == pytest.approx(ml.summary.deviance, rel=1e-8)
    assert fit.df == ml.summary.residualDegreeOfFreedom
    pearson = sum(r[0] ** 2 for r in ml.summary.residuals("pearson").collect())
    assert fit.phi == pytest.approx(pearson / fit.df, rel=1e-6)
    without = experiments.poisson_rates(kept, ["b"], "y", "m")
    rows = {r["termo"]: r for r in models.term_tests(models.cells(runs, ["a", "b"], "y", "m"), ["a", "b"]).collect()}
    assert rows["a"]["diferenca"] == pytest.approx(without.summary.deviance - ml.summary.deviance, rel=1e-6)
    assert rows["a"]["gl"] == 2 and rows["a"]["p"] < 1e-4 and rows["a"]["p_holm"] >= rows["a"]["p"]


def test_least_squares(runs):
    data = [r for r in runs.filter("a is not null and v is not null").collect()]
    x = np.array([[1, r.a == "y", r.a == "z", r.b == "q"] for r in data], dtype=float)
    v = np.array([r.v for r in data])
    rss = lambda x: float(((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum())
    rows = {r["termo"]: r for r in models.term_tests(models.cells(runs, ["a", "b"], "v"), ["a", "b"], poisson=False).collect()}
    assert rows["a"]["diferenca"] == pytest.approx(rss(x[:, [0, 3]]) - rss(x), rel=1e-8)
    assert rows["a"]["f"] == pytest.approx((rss(x[:, [0, 3]]) - rss(x)) / 2 / (rss(x) / (len(v) - 4)), rel=1e-8)
    both = models.interaction_tests(models.cells(runs, ["a", "b"], "v"), ["a", "b"], [("a", "b")], poisson=False).first()
    wide = np.column_stack([x, x[:, 1] * x[:, 3], x[:, 2] * x[:, 3]])
    assert both["gl"] == 2 and both["diferenca"] == pytest.approx(rss(x) - rss(wide), rel=1e-6)


def test_contrasts_turn_round(runs):
    design = models.cells(runs, ["a", "b"], "y", "m")
    ab, ba = models.contrasts(design, ["a", "b"], [("a", "x", "y"), ("a", "y", "x")]).collect()
    assert ab["razao"] * ba["razao"] == pytest.approx(1.0) and ab["ic_inf"] < ab["razao"] < ab["ic_sup"]
    assert ab["p"] == pytest.approx(ba["p"])


def test_tails():
    # with two and two degrees the tail is 1 / (1 + f); with 1 and many it is that of a squared normal
    assert models.f_tail(3.0, 2, 2) == pytest.approx(0.25, rel=1e-12)
    assert models.f_tail(1.96**2, 1, 10**6) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-4)
    assert models.f_tail(0.0, 3, 9) == 1.0


def test_designs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST", 10)
    with pytest.raises(ValueError):
        models.fit(models.cells(spark.range(50).withColumn("y", F.lit(1)), ["id"], "y"), ["id"])
    with pytest.raises(ValueError):
        models.fit(models.cells(spark.range(0).withColumn("y", F.lit(1)), ["id"], "y"), ["id"])


def test_bootstrap_interval(spark):
    r = random.Random(1)
    d = [r.gauss(1.0, 2.0) for _ in range(400)]
    pairs = spark.createDataFrame([*enumerate(d), (999, None)], "k long, a double").withColumn("b", F.lit(0.0)).repartition(5)
    one = experiments.paired_bootstrap(pairs, "k", "a", "b").first()
    se = np.std(d) / math.sqrt(len(d))
    assert one.replicas == 10_000 and one.media == pytest.approx(np.mean(d), abs=0.01)
    assert one.ic_sup - one.ic_inf == pytest.approx(2 * 1.96 * se, rel=0.05)
    assert experiments.paired_bootstrap(pairs.filter("k < 0"), "k", "a", "b").first().media is None


def test_noise_keeps_what_it_must(spark):
    k = F.col("id")
    tax = F.concat(F.lpad(k.cast("string"), 8, "1"), F.lit("0001"))
    whole = F.concat(tax, X.check_digits(tax))
    bad = noise.wrong_digit(whole, k, k)
    rows = spark.range(200).select(whole.alias("t"), bad.alias("bad"), (X.check_digits(F.substring(bad, 1, 12)) == F.substring(bad, 13, 2)).alias("fits"), noise.tax_id(whole).alias("f"), *[X.address(noise.address(F.lit(s), F.lit("Avenida Brasil"), k + 1, F.lit("Centro"), F.lit("Colombo")))["chave"].alias(f"a{s}") for s in range(4)]).collect()
    for i, r in enumerate(rows):
        assert len(r.bad) == 14 and r.bad != r.t and not r.fits
        assert "".join(ch for ch in r.f if ch.isdigit()) == r.t
        assert {r.a0, r.a1, r.a2, r.a3} == {f"AVENIDA BRASIL, {i + 1}"}


def test_answers(spark):
    rows = [("numero", "10,50", "10.5", True), ("numero", "10.52", "10.5", False), ("numero", "x", "1", False), ("booleano", "True", "true", True), ("booleano", None, "true", False), ("endereco", "R. XV 3, Colombo", "RUA XV, 3", True), ("outro", "a", "a", False)]
    got = spark.createDataFrame(rows, "t string, g string, o string, want boolean").select("want", benchmark.is_right(F.col("t"), F.col("g"), F.col("o")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_errors_and_exact(spark):
    both = spark.createDataFrame([("p", "a", "m"), ("p", "a", "m"), ("p", "b", "m"), ("p", "c", "n"), ("q", "d", "n"), (None, "e", "n")], "p string, t string, m string")
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "t string, grupo int")
    assert sorted(tuple(r) for r in evaluate.error_kinds(both, "p", "t", "m", groups).collect()) == [("m", 1, 1), ("n", 1, 0)]
    assert tuple(evaluate.exact_truths(both, "p", "t").first()) == (5, 1)


def test_parts_of_permitted_values_are_no_leak(spark):
    rows = spark.createDataFrame([("a", "bar litoral ltda"), ("b", "litoral"), ("b", "secreto"), ("b", "curto"), ("b", None)], "s string, w string")
    assert [r.w for r in access.exclusive_inside(rows, F.col("s") == "a", "w").collect()] == ["secreto"]


def test_traps(spark):
    names = spark.createDataFrame([("g", "BAR SOL NORTE", 1), ("g", "BAR SOL SUL", 2), ("h", "SO UM", 1), ("i", "UM", 1), ("i", "DOIS", 2)], "grupo string, nome string, ordem int")
    got = sorted(r.consulta for r in benchmark.traps(spark, names).filter("tipo = 'varias unidades'").collect())
    assert got == ["bar sol"]
