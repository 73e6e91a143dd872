"""What the layer's build does once, in small plans, on all cores."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import alike, records, tables


def logical(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_folding_is_a_small_expression(spark):
    plan = logical(spark.createDataFrame([("a",)], "a string").select(X.fold(F.col("a")).alias("x")))
    assert plan.count(",") < 200  # a map of 199 characters as literals had 400


def test_check_digits_are_computed_once(spark):
    plan = logical(spark.createDataFrame([("a",)], "a string").select(X.check_digits(F.col("a")).alias("x")))
    assert plan.count("aggregate(") == 2 and plan.count("split(") == 1


def test_rows_of_one_file_are_parsed_on_all_cores(spark):
    one = spark.range(50).coalesce(1).select(F.col("id").alias("_linha"), F.col("id").cast("string").alias("id"), F.lit("x@y.z").alias("de"), F.lit("2024-01-01").alias("data"), F.lit("oi").alias("assunto"), F.lit("Bom dia\nLoja Azul").alias("corpo"))
    assert records.emails(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_names_are_cut_on_all_cores(spark):
    made = alike.cut(spark.range(400).select(F.concat(F.lit("LOJA "), "id").alias("name")), [])
    assert made.count() == 400 and len(made.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_records_start_no_python_worker(spark):
    made = records.union(spark.range(3).select(F.col("id").alias("pos"), F.lit("nf").alias("fonte")))
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 3 and [f.simpleString() for f in made.schema] == [f.simpleString() for f in records.union(made).schema]


def test_steps_run_side_by_side_and_keep_their_order(spark):
    met = threading.Barrier(2, timeout=60)

    def step(n):
        met.wait()  # passed only if the other step is under way
        return spark.range(n).count()

    assert tables.together(spark, lambda: step(3), lambda: step(5)) == [3, 5]


def test_parts_are_written_apart_and_read_as_one_table(spark):
    made = tables.materialize_parts(spark, [lambda: spark.range(3), lambda: spark.range(3, 5), lambda: spark.range(0)], "parts")
    assert sorted(r.id for r in made.collect()) == [0, 1, 2, 3, 4]
    assert "Union" not in logical(made)


def test_names_in_order_lie_on_all_cores(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(alike, "materialize", lambda df, name: kept.append((name, tables.materialize(df, name))) or kept[-1][1])
    monkeypatch.setattr(alike, "ALL_PAIRS", 0)
    names = spark.range(200).select(F.concat(F.lit("LOJA "), F.md5(F.col("id").cast("string"))).alias("name"))
    assert alike.scored(names, names, 0.9, order=True).count() == 0
    ordered = next(df for name, df in kept if name == "parts-in-order")
    assert len(ordered.inputFiles()) >= spark.sparkContext.defaultParallelism
