"""Evaluation of a clustering against a truth by counts of the contingency table; no pair is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(n):
    return F.sum(n * (n - 1) / 2)


def pair_scores(both: DataFrame, pred: str, truth: str) -> DataFrame:
    """precision, recall and F1 over pairs of rows (pred null: in no cluster)."""
    cells = both.groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))
    hit = cells.filter(F.col(pred).isNotNull()).agg(_pairs(F.col("n")).alias("vp"))
    pp = cells.filter(F.col(pred).isNotNull()).groupBy(pred).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("pp"))
    pv = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("pv"))
    one = hit.withColumn("k", F.lit(1)).join(pp.withColumn("k", F.lit(1)), "k").join(pv.withColumn("k", F.lit(1)), "k")
    prec, rec = F.try_divide("vp", "pp"), F.try_divide("vp", "pv")
    return one.select("vp", "pp", "pv", prec.alias("precisao"), rec.alias("revocacao"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"))


def owners(both: DataFrame, pred: str, truth: str) -> DataFrame:
    """(pred, dono): the truth that most rows of a cluster have; ties to the smallest."""
    cells = both.filter(F.col(pred).isNotNull()).groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(pred).agg(F.min_by(truth, F.struct((-F.col("n")).alias("n"), F.col(truth).alias("t"))).alias("dono"))


def outcomes(both: DataFrame, pred: str, truth: str) -> DataFrame:
    """Rows right, wrong and loose, by the owner of their cluster."""
    placed = both.join(owners(both, pred, truth), pred, "left")
    return placed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("dono") == F.col(truth)).alias("certas"), F.count_if(F.col(pred).isNotNull() & (F.col("dono") != F.col(truth))).alias("erradas"), F.count_if(F.col(pred).isNull()).alias("soltas"))


def splits(both: DataFrame, pred: str, truth: str) -> DataFrame:
    """Clusters with more than one truth and truths with more than one cluster."""
    cells = both.select(F.col(pred).cast("string").alias("p"), F.col(truth).cast("string").alias("t")).distinct()
    merged = cells.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("merged").alias("kind"), F.col("p").alias("id"), "n")
    split = cells.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("split").alias("kind"), F.col("t").alias("id"), "n")
    return merged.unionByName(split)


def exact_truths(both: DataFrame, pred: str, truth: str) -> DataFrame:
    """Truths, and those whose rows all stand in one cluster that holds nothing else; a truth with a loose row is not exact."""
    cells = both.select(F.col(pred).alias("p"), F.col(truth).alias("t")).distinct()
    pure = cells.filter("p is not null").groupBy("p").agg((F.count(F.lit(1)) == 1).alias("pura"))
    spread = cells.join(pure, "p", "left").groupBy("t").agg((F.count(F.lit(1)) == 1).alias("junta"), F.every(F.coalesce(F.col("pura"), F.lit(False))).alias("pura"))
    return spread.agg(F.count(F.lit(1)).alias("entidades"), F.count_if(F.col("junta") & F.col("pura")).alias("exatas"))


def error_kinds(both: DataFrame, pred: str, truth: str, motive: str, groups: DataFrame) -> DataFrame:
    """Wrong rows per motive, and those whose cluster's owner is of the row's own group; groups (truth, grupo), null: in none."""
    wrong = both.join(owners(both, pred, truth), pred).filter(F.col("dono") != F.col(truth))
    mine = groups.select(F.col(truth), F.col("grupo").alias("_a"))
    theirs = groups.select(F.col(truth).alias("dono"), F.col("grupo").alias("_b"))
    # rows are counted per motive and pair of truths before groups join
    counts = wrong.groupBy(motive, truth, "dono").agg(F.count(F.lit(1)).alias("n"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return counts.join(mine, truth, "left").join(theirs, "dono", "left").groupBy(motive).agg(F.sum("n").alias("erros"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("mesmo_grupo"))
