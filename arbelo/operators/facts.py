"""Facts of entities: latest independent declaration, finance, divergences, gaps, timelines, as groupings and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.functions import text as X


def latest_wins(declared: DataFrame, by: str, value: str, date: str, pos: str, copied: Column) -> DataFrame:
    """Per `by`: the latest value (independent ones first), the number of distinct values, the naive majority and whether it errs.

    Ties: the same date, the smaller pos; the same count, the value that comes
    first when sorted by date (latest first), then pos.  Partial aggregates only.
    """
    dated = declared.filter(F.col(value).isNotNull()).withColumns({"_copy": copied, "_when": F.coalesce(F.col(date).cast("string"), F.lit(""))})
    # the latest date first: its characters are ordered by max, so the order is by (date desc, pos asc)
    newest = lambda flag: F.max(F.when(flag, F.struct("_when", (-F.col(pos)).alias("p"), F.col(value).alias("v"))))
    own = dated.groupBy(by).agg(newest(~F.col("_copy")).alias("own"), newest(F.lit(True)).alias("any"), F.countDistinct(value).alias("valores_distintos"))
    counts = dated.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_when", (-F.col(pos)).alias("p"))).alias("seen"))
    major = counts.groupBy(by).agg(F.max_by(value, F.struct("n", "seen")).alias("maioria_ingenua"))
    now = F.coalesce("own", "any")
    return own.join(major, by).select(by, now["v"].alias("atual"), "valores_distintos", "maioria_ingenua", (F.col("maioria_ingenua") != now["v"]).alias("maioria_erraria"))


def finance(invoices: DataFrame, by: str, amount: str, late: Column, contract: DataFrame, contract_value: str) -> DataFrame:
    """Per `by`: invoices, late total, mean, and the mean's deviation from the contract in percent."""
    sums = invoices.groupBy(by).agg(F.count(F.lit(1)).alias("notas"), F.sum(F.when(late, F.col(amount)).otherwise(0)).alias("atrasado"), (F.sum(amount).cast("double") / F.count(F.lit(1))).alias("media"))
    both = sums.join(contract.select(by, F.col(contract_value).cast("double").alias("contrato")), by, "left")
    off = F.when((F.col("contrato") != 0) & (F.col("media") != 0), (F.col("media").cast("double") - F.col("contrato")) / F.col("contrato"))
    return both.select(by, "notas", X.round_half_up(F.col("atrasado"), 2).alias("total_atrasado"), X.round_half_up(F.col("media"), 2).alias("media_faturada"), "contrato", (F.floor(off * 1000 + 0.5) / 10).alias("desvio_contrato"))


def diverges(deviation: Column, limit: float = 4.0) -> Column:
    """A rounded deviation beyond the limit, strictly."""
    return F.coalesce(F.abs(deviation) > limit, F.lit(False))


def timeline(parts: list[DataFrame], date: str = "data") -> DataFrame:
    """All dated events under one schema; order by (date, pos) where it is shown."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col(date).isNotNull())


def mode(rows: DataFrame, by: str, value: str, tie: Column) -> DataFrame:
    """The commonest value per `by`; of equal ones that with the smallest tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(tie).alias("t"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "t")).alias(value))
