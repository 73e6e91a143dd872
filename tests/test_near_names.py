"""Similar names by counted parts, and near-identical names without all pairs, against brute force and the pass in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import alike, resolve, search
from test_merge_rounds import in_order

WORDS = ["MERCADO", "BOM", "PRECO", "CENTRAL", "AAAA", "AA", "NOVO", "RIO", "R2", "ÁÉ"]


@pytest.mark.parametrize("all_pairs", [0, 4_000_000])
@pytest.mark.parametrize("least", [0.0, 0.35, 0.72])
def test_every_pair_once_with_its_score(spark, monkeypatch, all_pairs, least):
    monkeypatch.setattr(alike, "ALL_PAIRS", all_pairs)
    rng = random.Random(int(least * 100))
    names = sorted({" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(70)} | {"A", "AB", "", "B A"})
    left, right = (spark.createDataFrame([(g, n) for g in (1, 2) for n in names if rng.random() < 0.7], "k int, name string") for _ in "ab")
    every = left.withColumnRenamed("name", "a").join(right.withColumnRenamed("name", "b"), "k")
    want = {(r.k, r.a, r.b): r.s for r in every.select("k", "a", "b", X.name_similarity(F.col("a"), F.col("b")).alias("s")).filter(F.col("s") >= max(least, 1e-9)).collect()}
    got = [(r.k, r.a, r.b, r.s) for r in alike.scored(left, right, least, ["k"]).collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want != {}
    pairs = alike.scored(left, left, least, ["k"], order=True).collect()
    assert pairs and all(r.a < r.b for r in pairs)


def test_a_threshold_of_its_own_for_each_group(spark, monkeypatch):
    monkeypatch.setattr(alike, "ALL_PAIRS", 0)
    df = spark.createDataFrame([(g, n) for g in (1, 2) for n in ("BOM PRECO", "BOM PRECOS", "BOM RIO", "NOVO RIO")], "k int, name string")
    guard = F.when(F.col("k") == 1, 0.8).otherwise(0.3)
    got = {(r.k, r.a, r.b) for r in alike.scored(df, df, guard, ["k"]).collect()}
    assert (1, "BOM PRECO", "BOM PRECOS") in got and (1, "BOM RIO", "NOVO RIO") not in got and (2, "BOM RIO", "NOVO RIO") in got


def test_queries_meet_names_once(spark):
    names = spark.createDataFrame([("BOM PRECO",), ("BOM RIO",), ("",)], "nome string")
    asked = spark.createDataFrame([("q1", "BOM PRECO"), ("q2", "BOM PRECO"), ("q3", ""), ("q4", "XYZ")], "q string, query string")
    got = sorted((r.q, r.nome) for r in search.candidates(asked, names, least=0.3).collect())
    assert got == [("q1", "BOM PRECO"), ("q1", "BOM RIO"), ("q2", "BOM PRECO"), ("q2", "BOM RIO")]


RECORDS = "pos long, ref string, nome string, cidade string, cnpj string, cnpjOk boolean, email string, fone string, end struct<chave:string,cidade:string>"


def records(rng, n, names, cities, ids):
    return [(i, f"r{i:06d}", rng.choice(names), rng.choice(cities), c := rng.choice(ids), c is not None, "", "", None) for i in range(n)]


def all_attempts(spark, rows, params):
    """Every attempt of the rules over ids and near names, in order, by comparing all records."""
    names = sorted({r[2] for r in rows})
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    near = {(r.a, r.b) for r in pairs.filter(X.name_similarity(F.col("a"), F.col("b")) >= params.quaseIdentico).collect()}
    out, first, block = [], {}, {}
    for pos, ref, nome, city, cnpj, *_ in rows:
        if cnpj and first.setdefault(cnpj, (pos, ref))[0] < pos:
            out.append((1, 0, pos, *first[cnpj], ref))
        block.setdefault(city or "?", pos)
    for i, b in enumerate(rows):
        out += [(7, block[b[3] or "?"], b[0], a[0], a[1], b[1]) for a in rows[:i] if (a[3] or "?") == (b[3] or "?") and (a[2], b[2]) in near]
    return [(p, k, y, x, a, b, "", 0.0) for p, k, y, x, a, b in out]


def test_first_of_each_class_gives_the_same_merges_and_refusals(spark):
    params = resolve.Params()
    for seed in range(4):
        rng = random.Random(seed)
        names = ["BOM PRECO", "BOM PRECOS", "BOM PRECO RIO", "PRECO BOM", "NOVO RIO", "NOVO RIOS", "NOVOS RIOS", ""]
        rows = records(rng, 90, names, ["A", "B", ""], [None, None, None, "11111111111111", "22222222222222", "33333333333333"])
        cad = spark.createDataFrame(rows, RECORDS)
        none = spark.createDataFrame([], "ref string, pos long, de string, para string, a string, pos_a long")
        tried = resolve.candidate_edges(cad, params, none)
        labels, merges, refused = resolve.constrained_merge(cad.select("ref", F.col("cnpj").alias("id")), tried.edges)
        clusters, want, no = in_order([(r[1], r[4]) for r in rows], all_attempts(spark, rows, params))
        got = {}
        for r in labels.collect():
            got.setdefault(r.root, set()).add(r.ref)
        assert sorted(map(sorted, got.values())) == clusters
        assert sorted(tuple(r)[:6] for r in merges.collect()) == want
        assert sorted(tuple(r)[:6] for r in tried.refused(refused, labels).collect()) == no != []
        assert tried.refused_count(refused, labels) == len(no)


def test_equal_names_of_one_city_give_edges_in_line_with_their_number(spark):
    n = 100_000
    tax = F.when(F.col("id") == 0, "11111111111111").when(F.col("id") == 40_000, "22222222222222")
    cad = spark.range(n).select(F.col("id").alias("pos"), F.format_string("r%06d", "id").alias("ref"), F.lit("BOM PRECO").alias("nome"), F.lit("A").alias("cidade"), tax.alias("cnpj"), tax.isNotNull().alias("cnpjOk"), F.lit("").alias("email"), F.lit("").alias("fone"), F.lit(None).cast("struct<chave:string,cidade:string>").alias("end"))
    none = spark.createDataFrame([], "ref string, pos long, de string, para string, a string, pos_a long")
    tried = resolve.candidate_edges(cad, resolve.Params(), none)
    assert tried.edges.count() == n - 1
    labels, merges, refused = resolve.constrained_merge(cad.select("ref", F.col("cnpj").alias("id")), tried.edges)
    assert merges.count() == n - 2 and labels.select("root").distinct().count() == 2
    assert tried.refused_count(refused, labels) == n - 1  # the other id is refused with all others
    sample = tried.refused(refused, labels)
    assert sample.count() == n - 1 and sample.filter("a <> 'r040000' and b <> 'r040000'").isEmpty()


def test_numbers_of_earlier_near_names(spark):
    rng = random.Random(9)
    rows = records(rng, 300, ["BOM PRECO", "BOM PRECOS", "NOVO RIO", ""], ["A", "B"], [None])
    keyed = resolve.keyed_rows(spark.createDataFrame(rows, RECORDS), [resolve.Rule(7, F.col("cidade"), 0.8)])
    near = resolve.near_names(keyed, ["rule", "cell"], 0.8)
    same = {(r.cell, r.nome_a, r.nome_b) for r in near.collect()}
    want = {}
    for i, b in enumerate(rows):
        earlier = [a[0] for a in rows[:i] if a[3] == b[3] and (a[3], a[2], b[2]) in same]
        if earlier:
            want[b[1]] = (len(earlier), earlier[0])
    assert {r.ref: (r.n, r.first) for r in resolve.earlier_near(keyed, near, width=17).collect()} == want
