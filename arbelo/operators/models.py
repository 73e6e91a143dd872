"""Linear models of designed experiments: quasi-Poisson rates and least squares, tests of terms, interactions, contrasts.

Spark sums all runs into the cells of the design (combinations of factor
levels); deviance, Pearson statistic and residual squares follow exactly from
these sums. Only cells reach the driver: a design bounds their number, whatever
the number of runs, and more than MOST raise an error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbelo.operators.experiments import holm

#: Greatest number of cells of a design.
MOST = 20_000


class Fit(NamedTuple):
    names: list[tuple[str, ...]]
    beta: np.ndarray
    cov: np.ndarray
    deviance: float
    phi: float
    df: int


def cells(runs: DataFrame, factors: list[str], y: str, exposure: str | None = None) -> DataFrame:
    """Sums per combination of levels; runs with a null factor, response or exposure, or an exposure of 0 or less, are left out."""
    v, m = F.col(y).cast("double"), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    rows = runs.select(*[F.col(f).cast("string").alias(f) for f in factors], v.alias("_v"), m.alias("_m")).na.drop().filter("_m > 0")
    log = F.when(F.col("_v") > 0, F.col("_v") * F.log(F.col("_v") / F.col("_m"))).otherwise(0.0)
    sums = {"_n": F.count("_v"), "_y": F.sum("_v"), "_exposure": F.sum("_m"), "_squares": F.sum(F.col("_v") * F.col("_v") / F.col("_m")), "_logs": F.sum(log), "_within": F.var_pop("_v") * F.count("_v")}
    return rows.groupBy(*factors).agg(*[c.alias(k) for k, c in sums.items()])


def _take(design: DataFrame):
    rows = design.limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} combinations of levels: not a design")
    if rows.empty:
        raise ValueError("no runs")
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def _matrix(rows, terms: list[str]) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """Indicators of levels but the first of each factor; a term `a:b` has their products."""
    columns, names = [np.ones(len(rows))], [("",)]
    for term in terms:
        made = [(np.ones(len(rows)), (term,))]
        for f in term.split(":"):
            levels = sorted(rows[f].unique())[1:]
            made = [(x * (rows[f] == level).to_numpy(), (*name, level)) for x, name in made for level in levels]
        columns += [x for x, _ in made]
        names += [name for _, name in made]
    return np.column_stack(columns), names


def _solve(x: np.ndarray, weights: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.linalg.pinv((x.T * weights) @ x, hermitian=True)
    return inverse @ (x.T @ (weights * z)), inverse


def _fit(rows, terms: list[str], poisson: bool) -> Fit:
    x, names = _matrix(rows, terms)
    n, y, m = (rows[c].to_numpy(dtype=float) for c in ("_n", "_y", "_exposure"))
    df = int(n.sum()) - int(np.linalg.matrix_rank(x))
    if not poisson:
        beta, inverse = _solve(x, n, y / n)
        rest = float(rows["_within"].sum() + (n * (y / n - x @ beta) ** 2).sum())
        phi = rest / df if df > 0 else math.nan
        return Fit(names, beta, inverse * phi, rest, phi, df)
    eta, last = np.full(len(rows), math.log(max(y.sum(), 1e-9) / m.sum())), math.inf
    for _ in range(200):
        mu = m * np.exp(eta)
        beta, inverse = _solve(x, mu, eta + (y - mu) / mu)
        # cells without any count drive their rate to 0: it stays at a least value
        eta = np.maximum(x @ beta, -30.0)
        mu = m * np.exp(eta)
        deviance = float(2 * (rows["_logs"].sum() - (y * eta).sum() - y.sum() + mu.sum()))
        if abs(last - deviance) <= 1e-12 * (abs(deviance) + 1):
            break
        last = deviance
    pearson = float((rows["_squares"].to_numpy() * np.exp(-eta)).sum() - 2 * y.sum() + mu.sum())
    phi = pearson / df if df > 0 else math.nan
    return Fit(names, beta, inverse * phi, deviance, phi, df)


def fit(design: DataFrame, terms: list[str], poisson: bool = True) -> Fit:
    """A log-linear model of rates (dispersion from the Pearson statistic) or, without `poisson`, least squares."""
    return _fit(_take(design), terms, poisson)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for k in range(1, 10_000):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(front) * total / a


def f_tail(f: float, d1: int, d2: int) -> float:
    """The chance of an F statistic above f."""
    return beta_share(d2 / (d2 + d1 * max(f, 0.0)), d2 / 2, d1 / 2) if d1 > 0 and d2 > 0 and not math.isnan(f) else math.nan


def _tests(rows, changes: dict[str, tuple[list[str], list[str]]], poisson: bool) -> list[tuple]:
    """(name, degrees, difference, F, p, dispersion) of each change from few terms to more."""
    out = []
    for name, (few, more) in changes.items():
        small, big = _fit(rows, few, poisson), _fit(rows, more, poisson)
        gl, gain = small.df - big.df, small.deviance - big.deviance
        f = gain / gl / big.phi if gl and big.phi else math.nan
        out.append((name, gl, gain, f, f_tail(f, gl, big.df), big.phi))
    return out


_SCHEMA = "termo string, gl long, diferenca double, f double, p double, p_holm double, contribuicao double, dispersao double"


def term_tests(design: DataFrame, factors: list[str], poisson: bool = True) -> DataFrame:
    """Each factor against the model without it: F test, Holm's p and its share of what all factors explain in percent.

    With Poisson the share leaves out what chance alone would explain.
    """
    rows = _take(design)
    found = _tests(rows, {f: ([g for g in factors if g != f], factors) for f in factors}, poisson)
    total = sum(t[2] for t in found) or math.nan
    adjusted = holm({t[0]: t[4] for t in found})
    shares = [100 * (max(gain - gl * phi, 0.0) if poisson else gain) / total for _, gl, gain, _, _, phi in found]
    return design.sparkSession.createDataFrame([(*t[:5], adjusted[t[0]], share, t[5]) for t, share in zip(found, shares, strict=True)], _SCHEMA)


def interaction_tests(design: DataFrame, factors: list[str], pairs: list[tuple[str, str]], poisson: bool = True) -> DataFrame:
    """Each pair's products against the model of all factors alone."""
    found = _tests(_take(design), {f"{a}:{b}": (factors, [*factors, f"{a}:{b}"]) for a, b in pairs}, poisson)
    adjusted = holm({t[0]: t[4] for t in found})
    return design.sparkSession.createDataFrame([(*t[:5], adjusted[t[0]], None, t[5]) for t in found], _SCHEMA)


def contrasts(design: DataFrame, factors: list[str], asked: list[tuple[str, str, str]]) -> DataFrame:
    """Ratio of rates b to a of a factor's levels (factor, a, b), with a 95 % interval and a normal p-value."""
    model = _fit(_take(design), factors, True)
    at = {name: i for i, name in enumerate(model.names)}
    out = []
    for factor, a, b in asked:
        way = np.zeros(len(model.beta))
        for level, sign in ((a, -1.0), (b, 1.0)):
            if (factor, level) in at:
                way[at[factor, level]] += sign
        d, se = float(way @ model.beta), math.sqrt(max(float(way @ model.cov @ way), 0.0))
        p = math.erfc(abs(d / se) / math.sqrt(2)) if se else math.nan
        out.append((factor, a, b, math.exp(d), math.exp(d - 1.96 * se), math.exp(d + 1.96 * se), p))
    return design.sparkSession.createDataFrame(out, "fator string, de string, para string, razao double, ic_inf double, ic_sup double, p double")
