"""How many tables the plans of search, adapters and roles name: what the driver holds grows with it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbelo import adapters, layer
from arbelo.operators import tables
from arbelo.plans import layer_queries

SMALLEST = "/root/testdata/sf0.001"


def tables_named(df) -> int:
    return df._jdf.queryExecution().analyzed().toString().count("Relation [")


@pytest.fixture
def written(monkeypatch):
    """The tables named by each plan that the layer or an adapter writes, with the name of what is written."""
    sizes = []

    def materialize(df, name):
        sizes.append((tables_named(df), name))
        return tables.materialize(df, name)

    parts = lambda spark, made, name, **how: tables.materialize_parts(spark, [lambda p=p: [p(), sizes.append((tables_named(p()), name))][0] for p in made], name, **how)
    for module in (adapters, layer, layer_queries):
        monkeypatch.setattr(module, "materialize", materialize, raising=False)
    for module in (adapters, layer):
        monkeypatch.setattr(module, "materialize_parts", parts, raising=False)
    return sizes


@pytest.fixture(scope="module")
def own(spark):
    return layer_queries.layer(spark, SMALLEST)


def test_search_names_few_tables(spark, own, written):
    found = own.search(layer_queries._asked(spark, SMALLEST))
    assert tables_named(found) <= 4 and max(written)[0] <= 40


def test_an_answer_of_the_layer_names_few_tables(spark, own, written):
    asked = adapters.questions(spark.range(1, 4).select(F.col("id").alias("entidade"), layer_queries._name(F.col("id")).alias("consulta"), F.lit("chamados").alias("tipo"), F.lit("1").alias("resposta")))
    got = adapters.layered(own)(asked)
    assert max(map(tables_named, (got.contexts, got.returned, got.answers))) <= 8 and max(written)[0] <= 40
    assert got.answers.count() == 3


def test_roles_searched_are_one_table_each(spark, own, written):
    assert tables_named(layer_queries.layer_roles_search(spark, SMALLEST)) == 6


def test_roles_read_records_with_their_entities_as_one_table(own):
    ready = own.prepared()
    assert "Join" not in ready.rows_of("financeiro")._jdf.queryExecution().analyzed().toString() and ready.prepared() is ready
    for role in (None, "financeiro", "nobody"):
        assert sorted(map(tuple, ready.rows_of(role).select("ref", "id", "kind").collect())) == sorted(map(tuple, own.rows_of(role).select("ref", "id", "kind").collect()))
