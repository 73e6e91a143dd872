from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from arbelo.operators import benchmark, evaluate, experiments, ranking, resolve
from arbelo.streaming import events


def test_numbers_and_medians_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(-50, 50) / 2) for _ in range(301)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = ranking.numbered(df, ["g"], "v", 7.0).collect()
    for g in "ab":
        own = sorted(v for k, v in rows if k == g)
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == own
        assert {r.g: r.mediana for r in ranking.upper_median(df, ["g"], "v", 3.0).collect()}[g] == own[len(own) // 2]


def sequential_merge(nodes, edges):
    root, ids = {n: n for n, _ in nodes}, {n: i for n, i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    merged, refused = [], []
    for a, b in edges:
        x, y = find(a), find(b)
        if x == y:
            continue
        if ids[x] and ids[y] and ids[x] != ids[y]:
            refused.append((a, b))
            continue
        root[y], ids[x] = x, ids[x] or ids[y]
        merged.append((a, b))
    return {n: find(n) for n, _ in nodes}, merged, refused


def test_constrained_merge_equals_the_sequential_pass(spark):
    rng = random.Random(7)
    nodes = [(f"n{i}", rng.choice([None, None, "x", "y", "z"])) for i in range(40)]
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    df = spark.createDataFrame([(1, 0, i, 0, a, b, "", 1.0) for i, (a, b) in enumerate(edges)], "phase int, block long, pos_b long, pos_a long, a string, b string, motivo string, forca double")
    labels, merges, refused = resolve.constrained_merge(spark.createDataFrame(nodes, "ref string, id string"), df)
    want, merged, no = sequential_merge(nodes, edges)
    group = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert group({r.ref: r.root for r in labels.collect()}) == group(want)
    assert sorted((r.a, r.b) for r in merges.collect()) == sorted(merged)
    assert sorted((r.a, r.b) for r in refused.collect()) == sorted(no)


def test_pair_scores_without_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "q", None]), rng.choice("xyz")) for _ in range(50)]
    s = evaluate.pair_scores(spark.createDataFrame(rows, "pred string, truth string"), "pred", "truth").first()
    same = lambda f: sum(f(rows[i], rows[j]) for i in range(50) for j in range(i))
    vp, pp, pv = same(lambda a, b: a[0] is not None and a == b), same(lambda a, b: a[0] is not None and a[0] == b[0]), same(lambda a, b: a[1] == b[1])
    assert (s.vp, s.pp, s.pv) == (vp, pp, pv) and abs(s.f1 - 2 * (vp / pp) * (vp / pv) / (vp / pp + vp / pv)) < 1e-12


def test_designs_and_tests(spark):
    oa = experiments.orthogonal_array(spark, 3, 3).collect()
    assert len(oa) == 27 and len(oa[0]) == 14
    for i in range(1, 14):
        for j in range(i + 1, 14):
            assert len({(r[i], r[j]) for r in oa}) == 9
    assert experiments.holm({"a": 0.01, "b": 0.04, "c": 0.03}) == {"a": 0.03, "c": 0.06, "b": 0.06}
    rng = random.Random(3)
    pairs = spark.createDataFrame([(i, rng.gauss(1, 1), rng.gauss(0, 1)) for i in range(300)], "k long, a double, b double")
    boot = experiments.paired_bootstrap(pairs, "k", "a", "b", 400).first()
    mean = experiments.paired_summary(pairs, "a", "b").first().media
    assert boot.ic_inf < mean < boot.ic_sup and boot.ic_inf > 0.5 and boot.replicas == 400
    assert experiments.wilcoxon(pairs, "a", "b", 0.5).first().z > 5
    jobs = experiments.crossed_jobs(spark.range(3).withColumnRenamed("id", "c"), spark.range(4).withColumnRenamed("id", "n"))
    assert jobs.count() == 12
    runs = spark.createDataFrame([("base", 10.0, 5.0, 0.99), ("x", 4.0, 5.2, 0.99), ("y", 1.0, 9.0, 0.99)], "cfg string, y double, p double, f double")
    assert experiments.choose(runs, "cfg", "y", "p", "f", "base").first().cfg == "x"
    level = experiments.level_means(runs, "cfg", "y").filter("cfg = 'base'").first()
    assert level.media == 10 and math.isclose(level.sn, -20)


def test_poisson_rates(spark):
    rows = [(g, float(n), 100.0) for g, n in [("a", 10), ("a", 12), ("a", 8), ("b", 30), ("b", 33), ("b", 27)]]
    model = experiments.poisson_rates(spark.createDataFrame(rows, "g string, y double, e double"), ["g"], "y", "e")
    assert math.isclose(abs(model.coefficients[0]), math.log(3), rel_tol=1e-3)


def test_benchmark_rates(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, ref string")
    got = spark.createDataFrame([(1, "a"), (2, "c"), (2, "z")], "q int, ref string")
    found = {r.q: (r.ouro, r.achadas, r.completa) for r in benchmark.evidence(gold, got).collect()}
    assert found == {1: (2, 1, False), 2: (1, 1, True)}
    questions = spark.createDataFrame([(1, "BOM"), (2, "BOM PRECO")], "q int, query string")
    names = spark.createDataFrame([("BOM PRECO", "x"), ("BOM DIA", "y")], "nome string, dono string")
    assert {r.q: r.ambigua for r in benchmark.split_by_ambiguity(questions, names).collect()} == {1: True, 2: False}
    score = {r.adaptador: r.evidencia for r in benchmark.measure({"floor": lambda q: got.filter("1 = 0"), "half": lambda q: got}, questions, gold).collect()}
    assert score == {"floor": 0.0, "half": 50.0}


def test_windows_are_the_same_in_a_stream(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4)
    table.write.parquet(f"file://{tmp_path}/in")
    stream = events.windows(events.read(spark, f"file://{tmp_path}/in", 2), late="40 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows_found").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    told = lambda df: sorted(str(r) for r in df.select("inicio", "event_type", "n", F.col("total").cast("string")).collect())
    assert told(spark.table("windows_found")) == told(events.windows(table))
    assert events.first_arrivals(table.unionByName(table)).count() == table.count()
