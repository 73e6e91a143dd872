"""When two fields say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbelo.operators import profiling
from arbelo.plans import study_queries


def test_a_text_in_either_case_says_the_same(spark):
    # the capital sharp s and the Greek iota below are other characters, or none, in one case only
    rows = spark.createDataFrame([("Straẞe 1",), ("aͅb",), ("Straße",), ("İstanbul",)], "t string").select(F.lower("t").alias("a"), F.upper("t").alias("b"))
    assert rows.select(profiling.equal_as("texto", F.col("a"), F.col("b")).alias("x")).filter("not x").count() == 0


def test_lines_that_tie_give_one_result(spark, tmp_path):
    lines = [(1, 7, 3, "F"), (1, 7, 3, "O")]
    for name, order in (("a", lines), ("b", lines[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        spark.createDataFrame([(1, "O")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        spark.createDataFrame([(1, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/{name}/customer.parquet")
        spark.createDataFrame([(1, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        spark.createDataFrame([("x",)], "text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = [sorted(map(tuple, study_queries.copy_detection(spark, f"{tmp_path}/{name}").collect())) for name in ("a", "b")]
    assert found[0] == found[1]
