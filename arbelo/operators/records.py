"""Business sources to one stream of records: registry (cadastro), facts (fato), mentions (mencao)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arbelo.functions import text as X
from arbelo.operators.tables import spread

SCHEMA = (
    "pos long, ref string, fonte string, origem string, papel string, nomeOrig string, nome string, cnpjBruto string, cnpj string, cnpjOk boolean, "
    "email string, fone string, contato string, pessoa string, `end` struct<chave:string,cidade:string,texto:string>, dataEnd string, cidade string, data string, "
    "copiaDe string, lote string, cod string, valor double, situacao string, valorMensal double, num string, pai string, assunto string, texto string"
)
SOURCES = {"crm": 0, "erp": 1, "nf": 2, "contrato": 3, "email": 4, "chamado": 5}  # the order of records
_SLOT = 1 << 40  # positions of a source


def _line(source: str) -> Column:
    return (F.lit(SOURCES[source] * _SLOT) + F.col("_linha") * 2).alias("pos")


def _origin(file: str) -> Column:
    return F.concat(F.lit(f"{file} linha "), F.col("_linha").cast("string")).alias("origem")


def _parsed(rows: DataFrame, tax: str, address: str) -> DataFrame:
    """rows with _tax and _end, which _registry() names more than once."""
    return spread(rows).withColumns({"_tax": X.digits(F.col(tax)), "_end": X.address(F.col(address))})


def _registry(name: str, tax: str, remove_noise: bool) -> list[Column]:
    """The columns of a registry record, from rows of _parsed()."""
    c = F.col
    return [F.lit("cadastro").alias("papel"), c(name).alias("nomeOrig"), X.normalise_name(c(name), remove_noise).alias("nome"), c(tax).alias("cnpjBruto"), c("_tax").alias("cnpj"), X.valid_tax_id(c("_tax")).alias("cnpjOk"), c("_end").alias("end"), c("_end.cidade").alias("cidade")]


def crm(rows: DataFrame, remove_noise: bool = True) -> DataFrame:
    c = F.col
    return _parsed(rows, "cnpj", "endereco").select(_line("crm"), F.concat(F.lit("crm:"), "id_crm").alias("ref"), F.lit("crm").alias("fonte"), _origin("crm.csv"), *_registry("empresa", "cnpj", remove_noise), F.lower("email").alias("email"), X.phone_key(c("telefone")).alias("fone"), "contato", c("endereco_atualizado_em").alias("dataEnd"), c("endereco_atualizado_em").alias("data"))


def erp(rows: DataFrame, remove_noise: bool = True) -> DataFrame:
    c = F.col
    return _parsed(rows, "cnpj", "endereco_cobranca").select(_line("erp"), F.concat(F.lit("erp:"), "cod_erp").alias("ref"), F.lit("erp").alias("fonte"), _origin("erp_clientes.csv"), *_registry("razao_social", "cnpj", remove_noise), c("data_cadastro").alias("dataEnd"), c("data_cadastro").alias("data"), F.when(c("lote_importacao").startswith("IMP-CRM"), "crm").alias("copiaDe"), c("lote_importacao").alias("lote"), c("cod_erp").alias("cod"))


def invoices(rows: DataFrame) -> DataFrame:
    return rows.select(_line("nf"), F.concat(F.lit("nf:"), "nf").alias("ref"), F.lit("nf").alias("fonte"), _origin("erp_notas.csv"), F.lit("fato").alias("papel"), F.col("cod_erp").alias("cod"), F.col("emissao").alias("data"), F.col("valor").cast("double").alias("valor"), "situacao")


# How contracts and addenda are written: number, party with tax id and address, date, monthly amount; date and text of an addendum.
CONTRACT_NUMBER = r"CONTRATO DE FORNECIMENTO (\S+)"
CONTRACT_PARTY = r"CONTRATANTE:\s*(.+?), inscrita no CNPJ ([\d./-]+), com sede em (.+?)\.\n"
CONTRACT_DATE = r"Curitiba, (\d{4}-\d{2}-\d{2})"
CONTRACT_AMOUNT = r"R\$\s*([\d.]+,\d{2})"
ADDENDUM = r"TERMO ADITIVO \((\d{4}-\d{2}-\d{2})\) ---\n(.+)"


def contracts(texts: DataFrame, remove_noise: bool = True) -> DataFrame:
    """A registry record per contract and a fact per addendum, in order of file names."""
    t = F.col("texto")
    digits = X.digits(F.col("arquivo"))
    place = F.when(digits != "", F.substring(digits, -11, 11).cast("long")).otherwise(F.conv(F.substring(F.md5("arquivo"), 1, 9), 16, 10).cast("long"))
    pos = F.lit(SOURCES["contrato"] * _SLOT) + place * 2
    number = F.regexp_extract(t, CONTRACT_NUMBER, 1)
    signed = F.regexp_extract(t, CONTRACT_DATE, 1)
    amount = F.regexp_extract(t, CONTRACT_AMOUNT, 1)
    base = spread(texts).select(pos.alias("pos"), "arquivo", "texto", F.when(number != "", number).otherwise(F.col("arquivo")).alias("num"), signed.alias("data"), F.when(amount != "", X.money(amount)).otherwise(0.0).alias("valorMensal"), *[F.regexp_extract(t, CONTRACT_PARTY, k).alias(n) for k, n in ((1, "_nome"), (2, "_cnpj"), (3, "_end"))])
    registry = base.withColumns({"_tax": X.digits(F.col("_cnpj")), "_end": X.address(F.col("_end"))}).select("pos", F.concat(F.lit("ct:"), "num").alias("ref"), F.lit("contrato").alias("fonte"), F.concat(F.lit("contratos/"), "arquivo").alias("origem"), *_registry("_nome", "_cnpj", remove_noise), F.col("data").alias("dataEnd"), "data", "valorMensal", "num")
    date = F.regexp_extract(t, ADDENDUM, 1)
    facts = base.filter(t.rlike(ADDENDUM)).select((F.col("pos") + 1).alias("pos"), F.concat(F.lit("ct:"), "num", F.lit("#ad1")).alias("ref"), F.lit("aditivo").alias("fonte"), F.concat(F.lit("contratos/"), "arquivo", F.lit(" (aditivo)")).alias("origem"), F.lit("fato").alias("papel"), F.concat(F.lit("ct:"), "num").alias("pai"), date.alias("data"), X.address(X.address_in_text(F.regexp_extract(t, ADDENDUM, 2))).alias("end"), date.alias("dataEnd"))
    return registry.unionByName(facts, allowMissingColumns=True)


def emails(rows: DataFrame, remove_noise: bool = True) -> DataFrame:
    """The signature's first line that looks like a phone; the company stands before it, or last."""
    lines = F.filter(F.transform(F.split("corpo", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    phone = F.get(F.filter("_l", lambda x: x.rlike("^[+0-9( ][0-9() +-]{7,}\\z")), F.lit(0))
    at = F.when(phone.isNotNull(), F.array_position("_l", phone) - 1).otherwise(F.size("_l"))
    company = F.when(at > 0, F.coalesce(F.get("_l", (at - 1).cast("int")), F.lit(""))).otherwise("")
    base = spread(rows).withColumn("_l", lines).withColumns({"_phone": phone, "_name": company, "_found": X.address_in_text(F.col("corpo"))})
    return base.select(_line("email"), F.concat(F.lit("em:"), "id").alias("ref"), F.lit("email").alias("fonte"), _origin("emails.jsonl"), F.lit("mencao").alias("papel"), F.lower("de").alias("email"), F.col("_name").alias("nomeOrig"), X.normalise_name(F.col("_name"), remove_noise).alias("nome"), X.phone_key(F.col("_phone")).alias("fone"), "data", "assunto", F.col("corpo").alias("texto"), X.address(F.col("_found")).alias("end"), F.col("data").alias("dataEnd"))


def tickets(rows: DataFrame, remove_noise: bool = True) -> DataFrame:
    who = F.col("solicitante")
    mail = F.when(F.contains(who, F.lit("@")), F.lower(who)).otherwise("")
    return spread(rows).withColumn("_found", X.address_in_text(F.col("descricao"))).select(_line("chamado"), F.concat(F.lit("ch:"), F.col("id").cast("string")).alias("ref"), F.lit("chamado").alias("fonte"), _origin("chamados.jsonl"), F.lit("mencao").alias("papel"), mail.alias("email"), F.when(mail == "", who).otherwise("").alias("pessoa"), F.col("empresa_digitada").alias("nomeOrig"), X.normalise_name(F.col("empresa_digitada"), remove_noise).alias("nome"), F.col("aberto_em").alias("data"), "assunto", F.col("descricao").alias("texto"), X.address(F.col("_found")).alias("end"), F.col("aberto_em").alias("dataEnd"))


def union(*parts: DataFrame) -> DataFrame:
    """All records under one schema; columns that a source lacks are null."""
    # no row, made without Python workers
    none = lambda field: F.lit(None).cast(field.dataType).alias(field.name)
    out = parts[0].sparkSession.range(0, 0, 1, 1).select(*map(none, StructType.fromDDL(SCHEMA)))
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
