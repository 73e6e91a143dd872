"""Health report of a folder of exports whose schema nobody knows: types, keys, links, copies, documents, risks.

Loops run over sources and columns, whose numbers are small; rows stay in Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import profiling
from arbelo.operators.tables import materialize
from arbelo.sources import readers

CONFIRMED = "cópia confirmada pela marca de importação: concordar entre si não confirma nada"
LIKELY = "provável cópia: confirmar com quem administra o sistema antes de contar como duas fontes"
PARTLY = "parcialmente igual: pode ser importação antiga com atualizações depois; cada concordância precisa de origem"


@dataclass(frozen=True)
class Report:
    columns: DataFrame
    links: DataFrame
    foreign_keys: DataFrame
    copies: DataFrame
    documents: DataFrame
    risks: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return {"colunas": self.columns, "ligacoes": self.links, "chaves_estrangeiras": self.foreign_keys, "copias": self.copies, "documentos": self.documents, "riscos": self.risks}

    def write(self, folder: str) -> None:
        """One JSON table per part; every part has a row per column, pair of columns or source."""
        for name, df in self.parts().items():
            readers.write_json(df, f"{folder}/{name}")

    def markdown(self) -> str:
        out = ["# Laudo de saúde dos dados", "", "| gravidade | onde | problema | n |", "|-|-|-|-|"]
        out += [f"| {r.gravidade} | {r.onde} | {r.regra} | {r.n} |" for r in self.risks.orderBy("ordem", "onde", "regra").collect()]
        out += ["", "## Ligações", "", *[f"- {r.a} = {r.b} ({r.chave}): {r.em_comum} valores, {r.cobertura_a}% e {r.cobertura_b}%" for r in self.links.orderBy(F.desc("em_comum"), "a", "b").limit(12).collect()]]
        out += ["", "## Colunas", "", *[f"- {r.source}::{r.col}: {r.tipo}, {r.preenchida}% preenchida, {r.distintos} distintos" for r in self.columns.orderBy("source", "col").collect()]]
        return "\n".join(out) + "\n"


def profile(spark: SparkSession, folder: str) -> Report:
    sources = readers.read_folder(spark, folder)
    return profile_tables(spark, {n: d for n, (kind, d) in sources.items() if kind == "tabela"}, {n: d for n, (kind, d) in sources.items() if kind == "documentos"})


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame], documents: dict[str, DataFrame]) -> Report:
    tables = {n: d.drop("_file") for n, d in tables.items()}
    values = materialize(profiling.column_values(tables), "values") if tables else spark.createDataFrame([], "source string, col string, value string, n long")
    stats = materialize(profiling.column_stats(values), "stats")
    sets = materialize(profiling.comparable(values, stats), "sets")
    links, fks = profiling.links(sets), materialize(profiling.foreign_keys(sets, stats), "keys")
    extras = materialize(profiling.column_extras(tables, values, stats), "extras")
    marked = {r.source for r in extras.filter("marca > 0").select("source").distinct().collect()}
    copies = _copies(spark, tables, stats, fks, marked)
    docs = _documents(spark, documents, sets)
    risks = profiling.column_risks(stats, extras)
    risk = lambda df, grade, where, rule, n: df.select(grade.alias("gravidade"), where.alias("onde"), rule.alias("regra"), n.cast("long").alias("n"))
    more = [
        risk(copies, F.when(F.col("identicos") >= 90, "alta").otherwise("media"), F.col("campo"), F.concat(F.lit("copy of "), F.col("igual_a")), F.col("pares")),
        risk(fks.filter("orfaos > 0"), F.lit("media"), F.col("coluna"), F.concat(F.lit("orphans of "), F.col("aponta_para")), F.col("orfaos")),
        risk(docs.filter("por_nome > 0"), F.lit("media"), F.col("fonte"), F.lit("documents linked by name only"), F.col("por_nome")),
        risk(docs.filter("sem_ligacao > 0"), F.lit("media"), F.col("fonte"), F.lit("documents without any link"), F.col("sem_ligacao")),
    ]
    order = F.element_at(F.create_map(*[F.lit(x) for kv in profiling.SEVERITY.items() for x in kv]), F.col("gravidade")).alias("ordem")
    risks = reduce(DataFrame.unionByName, [risks, *[m.select(order, "gravidade", "onde", "regra", "n") for m in more]])
    return Report(stats.drop("n_cnpj"), links, fks, copies, docs, risks)


def _copies(spark: SparkSession, tables: dict[str, DataFrame], stats: DataFrame, fks: DataFrame, marked: set[str]) -> DataFrame:
    """Same-typed fields of sources joined by a foreign key or a tax id that agree in 70 % of 10 pairs or more."""
    kinds: dict[str, dict[str, list[str]]] = {}
    order = {n: {c: i for i, c in enumerate(d.columns)} for n, d in tables.items()}
    for r in stats.select("source", "col", "tipo").collect():
        kinds.setdefault(r.source, {}).setdefault(r.tipo, []).append(r.col)
    for own in kinds.values():
        for cols in own.values():
            cols.sort()
    joins = []
    for r in fks.collect():
        (a, ka), (b, kb) = r.coluna.split("::", 1), r.aponta_para.split("::", 1)
        joins.append((a, ka, b, kb, ("endereco", "nome", "email", "telefone"), False))
    names = list(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ca, cb = (sorted(kinds.get(x, {}).get("cnpj", []), key=lambda c, x=x: order[x][c]) for x in (a, b))
            if ca and cb:
                joins.append((a, ca[0], b, cb[0], ("endereco", "telefone", "email"), True))
    parts = []
    for a, ka, b, kb, types, tax in joins:
        fields = [(t, x, y) for t in types for x in kinds.get(a, {}).get(t, []) for y in kinds.get(b, {}).get(t, [])]
        if not fields:
            continue
        form = X.digits if tax else X.text_of
        left = tables[a].select(form(F.col(f"`{ka}`")).alias("k"), F.col("_linha").alias("la"), *[F.col(f"`{c}`").alias(f"a_{i}") for i, (_, c, _) in enumerate(fields)]).filter("k <> ''")
        right = tables[b].select(form(F.col(f"`{kb}`")).alias("k"), F.col("_linha").alias("lb"), *[F.col(f"`{c}`").alias(f"b_{i}") for i, (_, _, c) in enumerate(fields)]).filter("k <> ''")
        if tax:
            left = profiling.last_per_key(left, "k", "la")
        pairs = left.join(profiling.last_per_key(right, "k", "lb"), "k")
        for i, (t, x, y) in enumerate(fields):
            reading = F.lit(CONFIRMED) if {a, b} & marked else F.when(F.col("identicos") >= 90, LIKELY).otherwise(PARTLY)
            parts.append(profiling.agreement(pairs, f"a_{i}", f"b_{i}", t).filter("copia").select(F.lit(f"{a}::{x}").alias("campo"), F.lit(f"{b}::{y}").alias("igual_a"), "pares", "identicos", reading.alias("leitura")))
    if not parts:
        return spark.createDataFrame([], "campo string, igual_a string, pares long, identicos double, leitura string")
    return materialize(reduce(DataFrame.unionByName, parts).groupBy("campo", "igual_a").agg(F.max_by("pares", "pares").alias("pares"), F.max_by("identicos", "pares").alias("identicos"), F.max_by("leitura", "pares").alias("leitura")), "copies")


def _documents(spark: SparkSession, documents: dict[str, DataFrame], sets: DataFrame) -> DataFrame:
    keys = sets.filter("tipo in ('cnpj', 'email', 'telefone')").select("tipo", "v")
    names = sets.filter("tipo = 'nome'").select(F.col("v").alias("nome"))
    parts = []
    for name, d in documents.items():
        rows = d.select(F.col("arquivo").alias("doc"), F.col("texto").alias("text"))
        linked = profiling.document_links(rows, keys, names)
        size = rows.agg(F.sum(F.length("text")).alias("caracteres"))
        counts = linked.agg(F.count(F.lit(1)).alias("documentos"), F.count_if("by_key").alias("por_chave"), F.count_if("by_name").alias("por_nome"))
        parts.append(counts.withColumn("j", F.lit(1)).join(size.withColumn("j", F.lit(1)), "j").select(F.lit(name).alias("fonte"), "documentos", "caracteres", "por_chave", "por_nome", (F.col("documentos") - F.col("por_chave") - F.col("por_nome")).alias("sem_ligacao")))
    if not parts:
        return spark.createDataFrame([], "fonte string, documentos long, caracteres long, por_chave long, por_nome long, sem_ligacao long")
    return reduce(DataFrame.unionByName, parts)


def as_json(report: Report) -> str:
    return json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in report.parts().items()}, ensure_ascii=False)
