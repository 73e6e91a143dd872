"""Permissions: a role sees the rows of its sources; everything else is computed from those rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources that each role sees.
ROLES = {
    "comercial": ["crm", "email", "chamado"],
    "financeiro": ["erp", "nf"],
    "juridico": ["contrato", "aditivo"],
    "suporte": ["chamado", "email"],
    "auditoria": ["crm", "erp", "nf", "contrato", "aditivo", "email", "chamado"],
}
ALL = "auditoria"


def allowed(role: str | None, source: str = "fonte", roles: dict[str, list[str]] = ROLES) -> Column:
    """No role and the audit role see all; an unknown role sees nothing."""
    if role is None or (role == ALL and roles is ROLES):
        return F.lit(True)
    return F.col(source).isin(roles.get(role, [])) if roles.get(role) else F.lit(False)


def visible(rows: DataFrame, role: str | None, source: str = "fonte", roles: dict[str, list[str]] = ROLES) -> DataFrame:
    return rows.filter(allowed(role, source, roles))


def hidden(rows: DataFrame, role: str | None, by: str, source: str = "fonte", roles: dict[str, list[str]] = ROLES) -> DataFrame:
    """Per `by`: rows that the role sees and rows that it does not."""
    return rows.groupBy(by).agg(F.count_if(allowed(role, source, roles)).alias("visiveis"), F.count_if(~allowed(role, source, roles)).alias("ocultos"))


def exclusive(values: DataFrame, permitted: Column, value: str) -> DataFrame:
    """Rows whose value no permitted row holds."""
    return values.filter(~permitted).join(values.filter(permitted).select(value).distinct(), value, "left_anti")


#: Shorter values show too easily inside others to prove a leak.
LEAST = 6


def exclusive_inside(values: DataFrame, permitted: Column, value: str) -> DataFrame:
    """Rows of at least LEAST letters whose value stands in no permitted value, not even as a part of it.

    A value meets permitted ones at the one of its pieces of LEAST letters that
    the fewest of them hold: whoever holds the value holds that piece.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v") - LEAST + 1), lambda i: F.substring("v", i, F.lit(LEAST))))
    of = lambda rows: rows.select(F.col(value).alias("v")).filter(F.length("v") >= LEAST).distinct().select("v", F.explode(pieces).alias("piece"))
    shown, asked = of(values.filter(permitted)), of(values.filter(~permitted))
    counts = shown.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "piece", "left").groupBy("v").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    found = rarest.join(shown.withColumnRenamed("v", "whole"), "piece").filter(F.contains("whole", "v")).select(F.col("v").alias(value)).distinct()
    return values.filter(~permitted & (F.length(value) >= LEAST)).join(found, value, "left_anti")
