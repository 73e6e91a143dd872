"""Seeded synthetic sources with their ground truth, made row by row from hashes: any number of entities, in parallel."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import noise as N
from arbelo.functions import text as X

KINDS = ["Mercado", "Padaria", "Farmácia", "Restaurante", "Empório", "Drogaria", "Lanchonete", "Açougue"]
FIRST = ["Bom", "Novo", "Santa", "Ponto", "Porto", "Monte", "Vale", "Estrela", "Campo", "Rio"]
SECOND = ["Preço", "Horizonte", "Clara", "Certo", "Alegre", "Verde", "Dourado", "Azul", "Largo", "Bonito", "Central", "Feliz", "Real"]
CITIES = ["Curitiba", "São José", "Colombo", "Pinhais", "Londrina"]
DISTRICTS = ["Centro", "Vila Nova", "Jardim América", "Boa Vista", "Santo Antônio"]
STREETS = ["Rua das Flores", "Rua XV de Novembro", "Avenida Brasil", "Rua Sete de Setembro", "Alameda dos Pinheiros"]


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


#: What scales the share of each kind of noise.
SCALED_BY = {"sem_crm": "id", "errado": "id", "muda": "address", "free": "generic", "estranho": "generic", "twice": "double", "curto": "typo", "torto": "typo", "homonimo": "homonym"}
# The ranges from which a seed draws its multipliers, mild and under stress.
RANGES = {"mild": {"typo": (0.5, 1.5), "double": (0.5, 1.5), "generic": (0.5, 1.5), "homonym": (0.5, 1.5)}, "stress": {"typo": (2.0, 3.0), "double": (2.0, 3.0), "generic": (2.0, 3.0), "homonym": (2.0, 3.0)}}


def noise_of(seed: int, of: str = "mild") -> dict[str, float]:
    """The multipliers of a seed, always the same ones."""
    draw = random.Random(f"{of} {seed}")
    return {kind: draw.uniform(*ends) for kind, ends in RANGES[of].items()}


def generate(spark: SparkSession, entities: int, seed: int = 1, noise: float | dict[str, float] = 1.0) -> dict[str, DataFrame]:
    """crm, erp_clientes, erp_notas, contratos, emails, chamados and gabarito (ref, entidade).

    noise scales the shares of missing and wrong tax ids (id), moved addresses
    (address), free and unknown senders (generic), registrations made twice
    (double), incomplete and mistyped names (typo) and customers that bear the
    name of another one (homonym): one number for all, or one for each.
    """
    h = lambda *x: F.xxhash64(F.lit(seed), *[F.lit(v) if isinstance(v, str) else v for v in x])
    k = F.col("k")
    scale = lambda name: noise.get(SCALED_BY.get(name), 1.0) if isinstance(noise, dict) else noise
    chance = lambda name, p: F.pmod(h(name, k), F.lit(10_000)) < int(min(1.0, p * scale(name)) * 10_000)
    # every eighth entity is a branch of the one before it: same name and root of the tax id, another city
    branch = k % 8 == 7
    parent = F.when(branch, k - 1).otherwise(k)
    base = F.concat(F.lpad((parent * 7 + 10_000_000).cast("string"), 8, "0"), F.when(branch, "0002").otherwise("0001"))
    # and some have the name of the one before them, but a tax id, a domain and a city of their own
    homonym = (k % 8 == 5) & chance("homonimo", 0.3)
    namesake = F.when(homonym, k - 1).otherwise(parent)
    kind, core = _pick(KINDS, h("kind", namesake)), F.concat_ws(" ", _pick(FIRST, h("first", namesake)), _pick(SECOND, h("second", namesake)))
    name = F.concat_ws(" ", kind, core)
    city = _pick(CITIES, F.when(branch | homonym, h("city", k - 1) + 1).otherwise(h("city", k)))
    street, number = _pick(STREETS, h("street", k)), (F.pmod(h("number", k), F.lit(900)) + 10).cast("string")
    slug = F.concat(F.regexp_replace(F.lower(X.fold(name)), "[^a-z]", ""), parent.cast("string"))
    e = spark.range(entities).withColumnRenamed("id", "k").select(
        "k", name.alias("nome"), city.alias("cidade"), F.concat(base, X.check_digits(base)).alias("cnpj"), *[N.address(style, street, number, _pick(DISTRICTS, h("district", k)), city).alias(n) for n, style in (("velho", F.lit(0)), ("velho_crm", h("written", k)), ("velho_erp", h("billed", k)))],
        N.address(F.lit(0), _pick(STREETS, h("street2", k)), F.pmod(h("number2", k), F.lit(900)) + 1000, _pick(DISTRICTS, h("district2", k)), city).alias("novo"),
        N.variant(h("variant", k), name, core, F.upper(F.substring(kind, 1, 4)), F.concat(name, F.lit(" Ltda")), h("slip", k)).alias("outro"), N.typo(name, h("slip2", k), h("slip3", k)).alias("nome_torto"),
        F.when(chance("free", 0.2), F.concat(slug, F.lit("@gmail.com"))).otherwise(F.concat(F.lit("contato@"), slug, F.lit(".com.br"))).alias("email"),
        F.concat(F.lit("(41) 9"), F.lpad(F.pmod(h("tel", k), F.lit(10_000_000)).cast("string"), 7, "3")).alias("tel"),
        *[chance(n, p).alias(n) for n, p in (("sem_crm", 0.08), ("errado", 0.05), ("importado", 0.4), ("muda", 0.15), ("contrato", 0.9), ("estranho", 0.15), ("curto", 0.1), ("torto", 0.1), ("twice", 0.1))],
    )
    c = F.col
    wrong = N.wrong_digit(c("cnpj"), h("place", k), h("step", k))
    marked = lambda tax: F.when(F.pmod(h("marks", k), F.lit(2)) == 0, N.tax_id(tax)).otherwise(tax)
    dialled = N.phone(h("dialled", k), X.digits(c("tel")))
    id_of = lambda p: F.concat(F.lit(p), F.lpad(k.cast("string"), 5, "0"))
    line = (k + 2).alias("_linha")
    crm = e.select(id_of("C").alias("id_crm"), c("nome").alias("empresa"), F.when(c("sem_crm"), "").otherwise(marked(F.when(c("errado"), wrong).otherwise(c("cnpj")))).alias("cnpj"), "email", dialled.alias("telefone"), F.concat(F.lit("Ana "), _pick(SECOND, h("contact", k))).alias("contato"), c("velho_crm").alias("endereco"), F.lit("2023-01-10").alias("endereco_atualizado_em"), F.lit("v").alias("vendedor"), line)
    more = e.filter("twice").select(id_of("D").alias("id_crm"), c("outro").alias("empresa"), F.lit("").alias("cnpj"), "email", F.lit("").alias("telefone"), F.lit("").alias("contato"), c("velho_erp").alias("endereco"), F.lit("2022-05-01").alias("endereco_atualizado_em"), F.lit("v").alias("vendedor"), (k + entities + 2).alias("_linha"))
    erp = e.select(id_of("1").alias("cod_erp"), F.upper(F.concat(X.fold(c("nome")), F.lit(" LTDA"))).alias("razao_social"), c("cnpj"), c("velho_erp").alias("endereco_cobranca"), F.lit("2023-02-01").alias("data_cadastro"), F.when(c("importado"), "IMP-CRM-2023-02").otherwise("").alias("lote_importacao"), line)
    months = e.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("m"))
    notas = months.select(F.lpad((k * 3 + c("m")).cast("string"), 7, "0").alias("nf"), id_of("1").alias("cod_erp"), F.concat(F.lit("2024-0"), c("m").cast("string"), F.lit("-05")).alias("emissao"), F.lit("").alias("vencimento"), F.format_string("%.2f", 1000.0 + F.pmod(h("v", k, c("m")), F.lit(200))).alias("valor"), F.when(F.pmod(h("s", k, c("m")), F.lit(5)) == 0, "ATRASADA").otherwise("PAGA").alias("situacao"), (k * 3 + c("m") + 1).alias("_linha"))
    text = F.concat(F.lit("CONTRATO DE FORNECIMENTO CT-"), F.lpad(k.cast("string"), 5, "0"), F.lit("\nCONTRATANTE: "), c("nome"), F.lit(" Ltda, inscrita no CNPJ "), c("cnpj"), F.lit(", com sede em "), c("velho"), F.lit(".\nValor mensal: R$ 1.050,00\nCuritiba, 2023-03-01\n"), F.when(c("muda"), F.concat(F.lit("--- PRIMEIRO TERMO ADITIVO (2024-02-01) ---\nFica alterado o endereço da CONTRATANTE para "), c("novo"), F.lit(", mantidas as demais.\n"))).otherwise(""))
    contratos = e.filter("contrato").select(F.concat(F.lit("CT-"), F.lpad(k.cast("string"), 5, "0"), F.lit(".txt")).alias("arquivo"), text.alias("texto"))
    sender = F.when(c("estranho"), F.concat(F.lit("pessoal"), k.cast("string"), F.lit("@hotmail.com"))).otherwise(c("email"))
    typed = F.when(c("curto"), F.element_at(F.split("nome", " "), 2)).when(c("torto"), c("nome_torto")).otherwise(c("nome"))
    talk = e.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("m"))
    mid = lambda p: F.concat(F.lit(p), F.lpad((k * 2 + c("m")).cast("string"), 6, "0"))
    body = F.concat(F.lit("Bom dia.\n"), F.when(c("muda") & (c("m") == 2), F.concat(F.lit("Endereço novo: "), c("novo"), F.lit(".\n"))).otherwise(""), F.lit("\nAna\n"), typed, F.when((c("m") == 2) & ~c("curto"), F.concat(F.lit("\n"), c("tel"))).otherwise(""))
    emails = talk.select(mid("M").alias("id"), sender.alias("de"), F.concat(F.lit("2024-03-0"), c("m").cast("string")).alias("data"), F.lit("Pedido").alias("assunto"), body.alias("corpo"), (k * 2 + c("m")).alias("_linha"))
    chamados = talk.select(mid("").alias("id"), F.concat(F.lit("2024-04-0"), c("m").cast("string")).alias("aberto_em"), F.lit("web").alias("canal"), F.when(c("m") == 1, sender).otherwise(F.concat(F.lit("Ana "), _pick(SECOND, h("contact", k)))).alias("solicitante"), typed.alias("empresa_digitada"), F.lit("Entrega").alias("assunto"), F.lit("Atraso na entrega.").alias("descricao"), (k * 2 + c("m")).alias("_linha"))
    truth = [crm.select(F.concat(F.lit("crm:"), "id_crm").alias("ref"), (c("_linha") - 2).alias("entidade")), more.select(F.concat(F.lit("crm:"), "id_crm").alias("ref"), (c("_linha") - 2 - entities).alias("entidade")), erp.select(F.concat(F.lit("erp:"), "cod_erp").alias("ref"), (c("_linha") - 2).alias("entidade")), notas.select(F.concat(F.lit("nf:"), "nf").alias("ref"), F.floor((c("nf").cast("long") - 1) / 3).alias("entidade"))]
    truth += [contratos.select(F.concat(F.lit("ct:"), F.regexp_replace("arquivo", "\\.txt$", "")).alias("ref"), F.substring("arquivo", 4, 5).cast("long").alias("entidade"))]
    truth += [d.select(F.concat(F.lit(p), c("id")).alias("ref"), F.floor((c("_linha") - 1) / 2).alias("entidade")) for d, p in ((emails, "em:"), (chamados, "ch:"))]
    gold = truth[0]
    for t in truth[1:]:
        gold = gold.unionByName(t)
    return {"crm": crm.unionByName(more), "erp_clientes": erp, "erp_notas": notas, "contratos": contratos, "emails": emails, "chamados": chamados, "gabarito": gold}
