"""Row numbers, medians, margins and top-k without bringing a large group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], key: str, width: float, tie: str | None = None, into: str = "n") -> DataFrame:
    """rows with their 1-based number within `by` in the order of (key, tie).

    Only counts per range of `width` key values are summed up over a whole
    group; rows are sorted within their range.
    """
    marked = rows.withColumn("_range", F.floor(F.col(key) / width))
    counts = marked.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(whole), F.lit(0))).drop("_c")
    order = [key] + ([tie] if tie else [])
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return marked.join(before, [*by, "_range"]).withColumn(into, (F.col("_before") + inside).cast("long")).drop("_range", "_before")


def running(rows: DataFrame, by: list[str], key: str, width: float, value: str, into: str) -> DataFrame:
    """rows with the sum of `value` over all rows of `by` up to their key, those of one key together.

    Sums per range of `width` key values are added up over a whole group; rows
    are sorted within their range only.
    """
    marked = rows.withColumn("_range", F.floor(F.col(key) / width))
    whole = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy(*by, "_range").agg(F.sum(value).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(whole), F.lit(0))).drop("_c")
    inside = F.sum(value).over(Window.partitionBy(*by, "_range").orderBy(key))
    return marked.join(before, [*by, "_range"]).withColumn(into, (F.col("_before") + inside).cast("long")).drop("_range", "_before")


def upper_median(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Element floor(n / 2), from 0, of each group in order: only the range of values that holds it is sorted."""
    marked = rows.filter(F.col(value).isNotNull()).withColumn("_range", F.floor(F.col(value) / width))
    counts = marked.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    summed = counts.withColumns({"_total": F.sum("_c").over(group), "_upto": F.sum("_c").over(group.orderBy("_range"))})
    at = F.floor(F.col("_total") / 2)
    holds = summed.filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*by, "_range", (at - F.col("_upto") + F.col("_c") + 1).alias("_at"))
    inside = marked.join(holds, [*by, "_range"]).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value)))
    return inside.filter("_n = _at").select(*by, F.col(value).alias("mediana"))


def top_k(rows: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    """The first k rows per `by`, numbered; the limit goes below the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def two_best(scored: DataFrame, by: list[str], score: str, item: str, tie: str) -> DataFrame:
    """Per `by`: the best item, its score and the runner-up's (0 without one)."""
    best = top_k(scored, by, 2, F.col(score).desc(), F.col(tie))
    return best.groupBy(*by).agg(F.max_by(item, -F.col("rank")).alias(item), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("s1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0)).alias("s2"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with their place `n` in an order that looks random but depends on key and seed alone."""
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return numbered(rows.withColumn("_spot", spot), [], "_spot", float(1 << 20), tie=key).drop("_spot")
