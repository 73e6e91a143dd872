"""The constrained merge against a pass in order, and its rounds on stars and chains."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from arbelo.operators import resolve

SCHEMA = "phase int, block long, pos_b long, pos_a long, a string, b string, motivo string, forca double"


def in_order(nodes, edges):
    root, own, merges, refused = {r: r for r, _ in nodes}, dict(nodes), [], []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in sorted(edges, key=lambda e: e[:6]):
        x, y = find(e[4]), find(e[5])
        if x == y:
            continue
        if own[x] and own[y] and own[x] != own[y]:
            refused.append(e[:6])
            continue
        root[y] = x
        own[x] = own[x] or own[y]
        merges.append(e[:6])
    clusters = {}
    for r, _ in nodes:
        clusters.setdefault(find(r), set()).add(r)
    return sorted(map(sorted, clusters.values())), sorted(merges), sorted(refused)


def merged(spark, nodes, edges):
    labels, merges, refused = resolve.constrained_merge(spark.createDataFrame(nodes, "ref string, id string"), spark.createDataFrame(edges, SCHEMA))
    clusters = {}
    for r in labels.collect():
        clusters.setdefault(r.root, set()).add(r.ref)
    return sorted(map(sorted, clusters.values())), sorted(tuple(r)[:6] for r in merges.collect()), sorted(tuple(r)[:6] for r in refused.collect())


def test_as_in_order(spark):
    for seed in range(3):
        rng = random.Random(seed)
        nodes = [(f"r{i}", rng.choice([None, None, "x", "y", "z"])) for i in range(80)]
        edges = [(rng.randint(1, 3), rng.randint(0, 2), rng.randint(0, 99), rng.randint(0, 99), f"r{rng.randrange(80)}", f"r{rng.randrange(80)}", "m", 1.0) for _ in range(150)]
        assert merged(spark, nodes, edges) == in_order(nodes, edges)


def rounds(spark, monkeypatch, nodes, edges):
    told = []
    write = resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, name: told.append(name) or write(df, name))
    out = merged(spark, nodes, edges)
    return out, told.count("picks"), told.count("pointers")


def test_a_star_takes_few_rounds(spark, monkeypatch):
    nodes = [(f"r{i:05d}", "x" if i % 3 == 0 else None) for i in range(10_000)]
    edges = [(1, 0, i, 0, "r00000", f"r{i:05d}", "m", 1.0) for i in range(1, 10_000)]
    (clusters, merges, _), n, jumps = rounds(spark, monkeypatch, nodes, edges)
    assert len(clusters) == 1 and len(merges) == 9_999 and n <= 3 and n + jumps < 20


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    nodes = [(f"r{i:05d}", None) for i in range(10_000)]
    edges = [(1, 0, i, 0, f"r{i - 1:05d}", f"r{i:05d}", "m", 1.0) for i in range(1, 10_000)]
    (clusters, merges, _), n, jumps = rounds(spark, monkeypatch, nodes, edges)
    assert len(clusters) == 1 and len(merges) == 9_999 and n <= 2 and n + jumps < 20


def test_a_hub_of_many_ids_refuses_at_once(spark, monkeypatch):
    nodes = [(f"r{i:04d}", str(i % 7)) for i in range(2_000)]
    edges = [(1, 0, i, 0, "r0000", f"r{i:04d}", "m", 1.0) for i in range(1, 2_000)]
    out, n, _ = rounds(spark, monkeypatch, nodes, edges)
    assert n <= 2 and out == in_order(nodes, edges)


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a", None)], "ref string, id string")
    labels, merges, refused = resolve.constrained_merge(nodes, spark.createDataFrame([], SCHEMA))
    assert [tuple(r) for r in labels.select("ref", F.col("root")).collect()] == [("a", "a")] and merges.count() == refused.count() == 0
