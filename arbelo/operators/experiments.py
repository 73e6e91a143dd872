"""Designed experiments: paired comparison, bootstrap, rank tests, designs, Poisson rates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbelo.operators import ranking


def paired_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count(F.lit(1)).alias("n"), (F.sum(d).cast("double") / F.count(F.lit(1))).alias("media"), F.count_if(d > 0).alias("vitorias"), F.count_if(d == 0).alias("empates"), F.count_if(d < 0).alias("derrotas"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from any, by shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return x ^ (x >> np.uint64(31))


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, replicates: int = 10_000, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean difference: each row counts Poisson(1) times in each replicate, by a hash of key and replicate.

    Every task sums all replicates over its rows in blocks, so rows never move
    and a task sends one sum per replicate, whatever its number of rows. Pairs
    without both values are left out.
    """
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    block = max(1, 1_000_000 // replicates)

    def sums(batches):
        marks = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total, weight = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            h, d = batch["h"].to_numpy().astype(np.int64).view(np.uint64), batch["d"].to_numpy(dtype=float)
            for at in range(0, len(h), block):
                u = (_mixed(h[at : at + block, None] ^ marks[None, :]) >> np.uint64(11)) * 2.0**-53
                w = np.searchsorted(edges, u, side="right")
                total += d[at : at + block] @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"r": np.arange(replicates), "s": total, "w": weight})

    rows = pairs.select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), (F.col(a) - F.col(b)).cast("double").alias("d")).filter("d is not null")
    means = rows.mapInPandas(sums, "r long, s double, w double").groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return means.agg(F.count("m").alias("replicas"), F.avg("m").alias("media"), F.percentile("m", F.lit(0.025)).alias("ic_inf"), F.percentile("m", F.lit(0.975)).alias("ic_sup"))


def least_effect(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The least mean difference that the pairs could show (80 % power at 5 %, two-sided): 2.8 standard errors."""
    d = (F.col(a) - F.col(b)).cast("double")
    return pairs.agg(F.count(d).alias("n"), (2.8 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("mde"))


def finalists(runs: DataFrame, search: str, score: str, params: list[str]) -> DataFrame:
    """The best run of each search (least score, then parameters), equal parameters once, under the first search that found them."""
    best = runs.groupBy(search).agg(F.min(F.struct(score, *params)).alias("x")).select(search, "x.*")
    kept = F.min(F.struct(F.col(search), F.col(score))).alias("x")
    return best.groupBy(*params).agg(kept).select(*params, f"x.{search}", f"x.{score}")


def wilcoxon(pairs: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Signed-rank statistic of paired differences and its normal approximation; ties get their mean rank."""
    diffs = pairs.select((F.col(a) - F.col(b)).cast("double").alias("d")).filter("d is not null and d <> 0").select("d", F.abs("d").alias("x"), F.lit(1).alias("g"))
    sizes = diffs.groupBy("g", "x").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    # ranks of distinct values: numbers of smaller rows come from counts per range
    placed = ranking.numbered(diffs.drop("d"), ["g"], "x", width).groupBy("g", "x").agg(F.min("n").alias("first"))
    ranked = sizes.join(placed, ["g", "x"]).withColumn("k", F.col("first") + (F.col("t") - 1) / 2)
    sums = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("k") * F.col("up")).alias("w"))
    n = F.col("n")
    return sums.select("n", "w", F.round((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6).alias("z"))


def holm(p_values: dict[str, float]) -> dict[str, float]:
    """Adjusted p-values, in steps down from the smallest."""
    out, worst = {}, 0.0
    for i, (name, p) in enumerate(sorted(p_values.items(), key=lambda kv: kv[1])):
        worst = max(worst, min(1.0, p * (len(p_values) - i)))
        out[name] = worst
    return out


def orthogonal_array(spark, p: int, m: int) -> DataFrame:
    """The p**m runs of an array over GF(p): columns are all combinations of m base factors whose first weight is 1."""
    weights = [w for k in range(1, p**m) if (w := [k // p**i % p for i in range(m)])[next(i for i in range(m) if w[i])] == 1]
    base = [F.floor(F.col("id") / p**i) % p for i in range(m)]
    return spark.range(p**m).select("id", *[(sum((w * x for w, x in zip(ws, base, strict=True)), F.lit(0)) % p).cast("int").alias(f"f{j + 1}") for j, ws in enumerate(weights)])


def crossed_jobs(controls: DataFrame, noise: DataFrame) -> DataFrame:
    """Every control run under every noise run: both are designs of fixed size."""
    return controls.withColumn("_k", F.lit(1)).join(F.broadcast(noise.withColumn("_k", F.lit(1))), "_k").drop("_k")


def level_means(runs: DataFrame, factor: str, y: str) -> DataFrame:
    """Mean, standard error and signal-to-noise ratio of a response per level."""
    return runs.groupBy(factor).agg(F.count(y).alias("n"), F.avg(y).alias("media"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("erro"), (-10 * F.log10(F.avg(F.col(y) * F.col(y)))).alias("sn"), F.log(F.var_samp(y)).alias("ln_var"))


def poisson_rates(runs: DataFrame, factors: list[str], y: str, exposure: str):
    """A Poisson regression of counts with a log exposure, by Spark ML."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = runs.withColumn("_offset", F.log(F.col(exposure)))
    shaped = RFormula(formula=f"{y} ~ {' + '.join(factors)}", featuresCol="_x", labelCol="_y").fit(rows).transform(rows)
    return GeneralizedLinearRegression(family="poisson", link="log", offsetCol="_offset", featuresCol="_x", labelCol="_y").fit(shaped)


def choose(runs: DataFrame, by: str, y: str, pending: str, f1: str, base: str, more_pending: float = 1.10, less_f1: float = 0.002) -> DataFrame:
    """The configuration with the fewest errors among those that keep pending and F1 near the base's."""
    means = runs.groupBy(by).agg(F.avg(y).alias("y"), F.avg(pending).alias("p"), F.avg(f1).alias("f"))
    own = means.filter(F.col(by) == base).select(F.col("p").alias("bp"), F.col("f").alias("bf"), F.lit(1).alias("_k"))
    ok = means.withColumn("_k", F.lit(1)).join(F.broadcast(own), "_k").filter((F.col("p") <= F.col("bp") * more_pending) & (F.col("f") >= F.col("bf") - less_f1))
    return ok.agg(F.min_by(by, F.struct("y", by)).alias(by), F.min("y").alias("y"))
