"""Whole runs over seeds: sources are made, the layer is built and held against the truth; one row a run."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.layer import EntityLayer
from arbelo.operators import evaluate
from arbelo.operators.resolve import Params
from arbelo.operators.tables import materialize
from arbelo.sources import synthetic


def score(layer: EntityLayer, truth: DataFrame) -> DataFrame:
    """One row: pair scores over all records, mentions linked wrongly or not at all, registrations in the wrong entity, exact entities."""
    mention, own = F.col("ref").rlike("^(em|ch):"), F.col("ref").rlike("^(crm|erp|ct):") & ~F.contains("ref", F.lit("#"))
    both = materialize(truth.join(layer.entity_of(), "ref", "left"), "scored")
    placed = both.join(evaluate.owners(both, "id", "entidade"), "id", "left")
    right = F.col("dono") == F.col("entidade")
    counts = placed.agg(
        F.count_if(mention).alias("mencoes"), F.count_if(mention & F.col("id").isNull()).alias("pendentes"), F.count_if(mention & ~right).alias("mencoes_erradas"), F.count_if(own & ~right).alias("cadastros_errados"),
    )
    parts = [evaluate.pair_scores(both, "id", "entidade").select("precisao", "revocacao", "f1"), counts, evaluate.exact_truths(both.filter(own), "id", "entidade")]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def runs(spark: SparkSession, seeds: Iterable[int], entities: int, noise: str | None = "mild", params: Params = Params()) -> DataFrame:
    """A row for each seed, with the multipliers of noise that it draws (None: plain noise)."""
    out = []
    for seed in seeds:
        made = synthetic.generate(spark, entities, seed, 1.0 if noise is None else synthetic.noise_of(seed, noise))
        made = {name: materialize(df, f"made-{name}") for name, df in made.items()}
        row = score(EntityLayer.build({k: v for k, v in made.items() if k != "gabarito"}, params), made["gabarito"])
        out.append(materialize(row.select(F.lit(seed).cast("long").alias("semente"), "*"), "run"))
    return reduce(DataFrame.unionByName, out)


def accepted(rows: DataFrame, least_f1: float = 0.95, most_wrong: float = 0.02) -> DataFrame:
    """One row: how many runs there are, their mean and least F1, the share of mentions linked wrongly, and whether all criteria hold."""
    told = rows.agg(F.count(F.lit(1)).alias("sementes"), F.avg("f1").alias("f1_media"), F.min("f1").alias("f1_minimo"), F.try_divide(F.sum("mencoes_erradas"), F.sum("mencoes")).alias("erro"), F.try_divide(F.sum("exatas"), F.sum("entidades")).alias("exatas"))
    return told.withColumn("aceito", (F.col("f1_minimo") >= least_f1) & (F.coalesce("erro", F.lit(0.0)) <= most_wrong))


def write_sources(made: dict[str, DataFrame], folder: str) -> None:
    """The tables of generate() as Parquet, one folder each."""
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
