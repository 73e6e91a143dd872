"""The entity layer over the given tables: customers, suppliers, orders and events as its six sources.

Customers are CRM records and, every seventh one, parties of a contract;
suppliers are the ERP's records of the customers with their keys, some of them
imported, some with a wrong digit in the tax id, some with another address;
orders are invoices; events are e-mails and tickets, some from unknown senders.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.layer import EntityLayer
from arbelo.operators import access
from arbelo.operators.tables import materialize, shared_folder
from arbelo.plans.tables import table
from arbelo.streaming import mentions

_layers: dict[tuple[str, str], EntityLayer] = {}


def _name(k: Column) -> Column:
    return F.concat(F.lit("Loja "), F.upper(F.substring(F.md5(k.cast("string")), 1, 10)))


def _tax(k: Column) -> Column:
    base = F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("0001"))
    return F.concat(base, X.check_digits(base))


def _wrong(tax: Column) -> Column:
    return F.concat(F.substring(tax, 1, 13), ((F.substring(tax, 14, 1).cast("int") + 1) % 10).cast("string"))


def _mail(k: Column) -> Column:
    return F.concat(F.lit("contato@k"), k.cast("string"), F.lit(".com.br"))


def _phone(k: Column) -> Column:
    # a five in the third place: the end of no tax id, of which phone and id searches would meet
    return F.concat(F.lit("(41) 9"), F.pmod(F.floor(k / 100_000), F.lit(10)).cast("string"), F.lit("5"), F.lpad((k % 100_000).cast("string"), 5, "0"))


def _address(street: str, k: Column, city: Column) -> Column:
    return F.concat(F.lit(f"{street}, "), k.cast("string"), F.lit(" - "), city)


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = F.broadcast(table(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city")))  # 25 rows
    k, city, empty = F.col("k"), F.col("city"), F.lit("")
    people = table(spark, sf_dir, "customer", F.col("c_custkey").alias("k"), "c_nationkey").join(nation, "c_nationkey").select("k", "city")
    line = k.alias("_linha")
    home = _address("Rua das Flores", k, city)
    crm = people.select(F.concat(F.lit("C"), k.cast("string")).alias("id_crm"), _name(k).alias("empresa"), _tax(k).alias("cnpj"), _mail(k).alias("email"), _phone(k).alias("telefone"), empty.alias("contato"), home.alias("endereco"), F.lit("2023-01-10").alias("endereco_atualizado_em"), empty.alias("vendedor"), line)
    known = table(spark, sf_dir, "supplier", F.col("s_suppkey").alias("k")).join(people, "k")
    erp = known.select(
        k.cast("string").alias("cod_erp"), F.concat(F.upper(_name(k)), F.lit(" LTDA")).alias("razao_social"), F.when(k % 5 == 0, _wrong(_tax(k))).otherwise(_tax(k)).alias("cnpj"),
        F.when(k % 3 == 0, _address("Avenida Brasil", k, city)).otherwise(home).alias("endereco_cobranca"), F.lit("2023-02-01").alias("data_cadastro"), F.when(k % 2 == 0, "IMP-CRM-2023-02").otherwise("").alias("lote_importacao"), line,
    )
    orders = table(spark, sf_dir, "orders")
    notas = orders.select(F.col("o_orderkey").cast("string").alias("nf"), F.col("o_custkey").cast("string").alias("cod_erp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("emissao"), empty.alias("vencimento"), F.format_string("%.2f", "o_totalprice").alias("valor"), F.when(F.col("o_orderstatus") == "O", "ATRASADA").otherwise("PAGA").alias("situacao"), F.col("o_orderkey").alias("_linha"))
    new = _address("Alameda Azul", k, city)
    text = F.concat(
        F.lit("CONTRATO DE FORNECIMENTO CT-"), k.cast("string"), F.lit("\nCONTRATANTE: "), _name(k), F.lit(", inscrita no CNPJ "), _tax(k), F.lit(", com sede em "), home, F.lit(".\nValor mensal: R$ 150.000,00\nCuritiba, 2023-03-01\n"),
        F.when(k % 14 == 0, F.concat(F.lit("--- PRIMEIRO TERMO ADITIVO (2024-02-01) ---\nFica alterado o endereço da CONTRATANTE para "), new, F.lit(", mantidas as demais.\n"))).otherwise(""),
    )
    contracts = people.filter(k % 7 == 0).select(F.concat(F.lit("CT-"), k.cast("string"), F.lit(".txt")).alias("arquivo"), text.alias("texto"))
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    user, event = F.col("user_id"), F.col("event_id")
    sender = F.when(event % 4 == 0, F.concat(F.lit("x"), event.cast("string"), F.lit("@gmail.com"))).otherwise(_mail(user))
    emails = events.filter("event_type <> 'error'").select(F.concat(F.lit("M"), event.cast("string")).alias("id"), sender.alias("de"), F.col("day").alias("data"), F.col("event_type").alias("assunto"), F.concat(F.lit("Bom dia.\n\nAna\n"), _name(user)).alias("corpo"), event.alias("_linha"))
    tickets = events.filter("event_type = 'error'").select(event.cast("string").alias("id"), F.col("day").alias("aberto_em"), F.lit("web").alias("canal"), F.when(event % 2 == 0, _mail(user)).otherwise("Ana Lima").alias("solicitante"), _name(user).alias("empresa_digitada"), F.lit("error").alias("assunto"), F.lit("Atraso na entrega.").alias("descricao"), event.alias("_linha"))
    return {"crm": crm, "erp_clientes": erp, "erp_notas": notas, "contratos": contracts, "emails": emails, "chamados": tickets}


def layer(spark: SparkSession, sf_dir: str) -> EntityLayer:
    """The layer of a folder's tables, built once per application: it is a few tables in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _layers:
        _layers[at] = EntityLayer.build(sources(spark, sf_dir))
    return _layers[at]


_BASE = """
    k AS (SELECT c_custkey AS k, n_name AS city, 'ENT-' || CASE WHEN r < 10000 THEN lpad(r::VARCHAR, 4, '0') ELSE r::VARCHAR END AS id
          FROM (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN nation ON n_nationkey = c_nationkey),
    erp AS (SELECT k.* FROM supplier JOIN k ON k = s_suppkey),
    ct AS (SELECT * FROM k WHERE k % 7 = 0),
    nf AS (SELECT erp.k, id, o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders JOIN erp ON erp.k = o_custkey),
    ev AS (SELECT event_id, id, user_id, event_type, ts, CASE WHEN event_type = 'error' THEN 'ch:' || event_id ELSE 'em:M' || event_id END AS ref,
                  CASE WHEN event_type = 'error' THEN event_id % 2 = 0 ELSE event_id % 4 <> 0 END AS known FROM events LEFT JOIN k ON k = user_id),
    refs AS (SELECT id, 'crm:C' || k AS ref, 'crm' AS fonte, k, '2023-01-10' AS data FROM k UNION ALL SELECT id, 'erp:' || k, 'erp', k, '2023-02-01' FROM erp UNION ALL SELECT id, 'nf:' || o_orderkey, 'nf', k, strftime(o_orderdate, '%Y-%m-%d') FROM nf
             UNION ALL SELECT id, 'ct:CT-' || k, 'contrato', k, '2023-03-01' FROM ct UNION ALL SELECT id, 'ct:CT-' || k || '#ad1', 'aditivo', k, '2024-02-01' FROM ct WHERE k % 14 = 0
             UNION ALL SELECT id, ref, CASE WHEN event_type = 'error' THEN 'chamado' ELSE 'email' END, user_id, strftime(ts, '%Y-%m-%d') FROM ev WHERE id IS NOT NULL),
    fin AS (SELECT k.id, k.k, count(o_orderkey) AS notas, floor(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END), 0)::DOUBLE * 100 + 0.5) / 100 AS atrasado, avg(o_totalprice) AS media FROM k LEFT JOIN nf USING (id) GROUP BY 1, 2),
    ends AS (SELECT id, k, 1 + (k % 3 = 0 AND k IN (SELECT k FROM erp))::INT + (k % 14 = 0)::INT AS versoes FROM k)"""


def layer_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and the entity that it belongs to."""
    return layer(spark, sf_dir).membership.select("ref", "id")


LAYER_MEMBERSHIP = f"WITH {_BASE} SELECT ref, id FROM refs"


def layer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention: its entity and why, or why it is pending."""
    own = layer(spark, sf_dir)
    rows = own.records.filter("papel = 'mencao'").select("ref", "motivoLigacao")
    return rows.join(own.membership.select("ref", "id"), "ref", "left").join(own.pending.select("ref", "porque"), "ref", "left").select("ref", "id", F.coalesce("motivoLigacao", "porque").alias("motivo"))


LAYER_MENTIONS = f"""
    WITH {_BASE} SELECT ref, id, CASE WHEN id IS NULL THEN 'nome digitado não se parece o bastante com nenhum cliente' WHEN known THEN 'e-mail do remetente já conhecido' ELSE 'nome parecido (1.00)' END AS motivo FROM ev"""


def layer_mentions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As layer_mentions, with the mentions arriving as a stream of files."""
    own = layer(spark, sf_dir)
    folder = f"{shared_folder(spark)}/arbelo/mention-stream-{uuid.uuid4().hex}"
    own.records.filter("papel = 'mencao'").select(*mentions.COLUMNS).repartitionByRange(6, "pos").write.parquet(f"{folder}/in")
    mentions.link_stream(mentions.read(spark, f"{folder}/in", 2), f"{folder}/out", *own.registry(), own.params).awaitTermination()
    return mentions.current(spark, f"{folder}/out").select("ref", "id", F.coalesce("motivo", "porque").alias("motivo"))


LAYER_MENTIONS_STREAM = LAYER_MENTIONS


def layer_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of registry records with their rule, and corrections of tax ids."""
    own = layer(spark, sf_dir)
    merges = own.merge_log().select("id", "de", "para", F.split_part("motivo", F.lit(" corrigido"), F.lit(1)).alias("motivo"))
    plain = merges.select("id", "de", "para", F.when(F.col("motivo").startswith("CNPJ"), "CNPJ com 1 dígito errado").otherwise(F.col("motivo")).alias("motivo"))
    return plain.join(own.corrections.select(F.col("ref").alias("para"), F.lit(True).alias("c")), "para", "left").withColumn("corrigido", F.coalesce("c", F.lit(False))).drop("c")


LAYER_MERGES = f"""
    WITH {_BASE} SELECT id, 'crm:C' || k AS de, 'erp:' || k AS para, CASE WHEN k % 5 = 0 THEN 'CNPJ com 1 dígito errado' ELSE 'mesmo CNPJ válido' END AS motivo, k % 5 = 0 AS corrigido FROM erp
    UNION ALL SELECT id, 'crm:C' || k, 'ct:CT-' || k, 'mesmo CNPJ válido', false FROM ct"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five queries for each supplier: tax id, one with a wrong digit, e-mail, phone, name."""
    k = F.col("s_suppkey")
    tax = _tax(k)
    shown = F.concat(F.substring(tax, 1, 2), F.lit("."), F.substring(tax, 3, 3), F.lit("."), F.substring(tax, 6, 3), F.lit("/"), F.substring(tax, 9, 4), F.lit("-"), F.substring(tax, 13, 2))
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.posexplode(F.array(shown, _wrong(tax), F.upper(_mail(k)), _phone(k), F.upper(_name(k)))).alias("p", "consulta")).select((k * 10 + F.col("p")).alias("q"), "consulta")


def layer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer that a query of one of five kinds means: the score with which it is found, and why."""
    own = layer(spark, sf_dir)
    wanted = own.membership.filter("ref like 'crm:C%'").select(F.substring("ref", 6, 20).cast("long").alias("k"), "id")
    return own.search(_asked(spark, sf_dir)).withColumn("k", F.floor(F.col("q") / 10)).join(wanted, ["k", "id"]).select("q", "id", "score", "motivo")


LAYER_SEARCH = f"""
    WITH {_BASE} SELECT erp.k * 10 + p AS q, id, score, motivo
    FROM erp, (VALUES (0, 1.0::DOUBLE, 'CNPJ'), (1, 0.9, 'CNPJ com 1 dígito diferente'), (2, 1.0, 'e-mail'), (3, 0.95, 'telefone'), (4, 1.0, 'nome')) t(p, score, motivo)"""


def layer_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dossier of every entity: identity, address, finance, gaps, merges."""
    d = layer(spark, sf_dir).dossier()
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select(
        "id", "nome", "razao_social", "cidade", "registros", F.array_join("cnpj", ",").alias("cnpj"), F.array_join("emails", ",").alias("emails"), F.col("endereco.atual.endereco").alias("atual"), F.col("endereco.atual.fonte").alias("fonte"),
        F.col("endereco.valores_distintos").cast("long").alias("versoes"), F.col("financeiro.notas").alias("notas"), F.col("financeiro.total_atrasado").alias("atrasado"), size("chamados").alias("chamados"), size("divergencias").alias("divergencias"), F.array_join("lacunas", "; ").alias("lacunas"), size("como_foi_ligado").alias("ligados"),
    )


_NAME = "'Loja ' || upper(substr(md5(k::VARCHAR), 1, 10))"
_GAP = "CASE WHEN k % 7 <> 0 THEN 'nenhum contrato encontrado para esta entidade' WHEN k % 14 = 0 THEN 'endereço mais recente só aparece em aditivo de contrato; CRM e ERP ainda não foram atualizados' ELSE '' END"
_TAX = """
    tb AS (SELECT k, [substr(lpad(k::VARCHAR, 8, '0') || '0001', i::INT, 1)::INT FOR i IN range(1, 13)] AS x FROM k),
    t1 AS (SELECT k, x, list_sum(list_transform(list_zip(x, [5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r FROM tb),
    t2 AS (SELECT k, list_append(x, CASE WHEN r < 2 THEN 0 ELSE 11 - r END) AS x FROM t1),
    t3 AS (SELECT k, x, list_sum(list_transform(list_zip(x, [6,5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r FROM t2),
    tax AS (SELECT k, array_to_string(x, '') || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS cnpj FROM t3)"""
LAYER_DOSSIER = f"""
    WITH {_BASE}, {_TAX}, n AS (SELECT id, count(*) AS registros, count(*) FILTER (fonte = 'chamado') AS chamados FROM refs GROUP BY 1), e AS (SELECT k, TRUE AS erp FROM erp),
    dv AS (SELECT id, (versoes > 1)::INT + coalesce(erp AND k % 5 = 0, false)::INT + coalesce(erp AND k % 2 = 0, false)::INT + coalesce(k % 7 = 0 AND abs((media - 150000) / 150000 * 100) > 4, false)::INT AS d FROM ends LEFT JOIN e USING (k) JOIN fin USING (id, k))
    SELECT id, {_NAME} AS nome, CASE WHEN k % 7 = 0 THEN {_NAME} WHEN erp THEN upper({_NAME}) || ' LTDA' ELSE {_NAME} END AS razao_social, upper(city) AS cidade, registros, cnpj, 'contato@k' || k || '.com.br' AS emails,
           CASE WHEN k % 14 = 0 THEN 'ALAMEDA AZUL' WHEN k % 7 <> 0 AND erp AND k % 2 = 1 AND k % 3 = 0 THEN 'AVENIDA BRASIL' ELSE 'RUA DAS FLORES' END || ', ' || k AS atual,
           CASE WHEN k % 14 = 0 THEN 'aditivo' WHEN k % 7 = 0 THEN 'contrato' WHEN erp AND k % 2 = 1 THEN 'erp' ELSE 'crm' END AS fonte, versoes::BIGINT AS versoes, notas, atrasado, chamados, d::BIGINT AS divergencias, {_GAP} AS lacunas,
           coalesce(erp, false)::BIGINT + (k % 7 = 0)::BIGINT AS ligados
    FROM k JOIN n USING (id) JOIN fin USING (id, k) JOIN ends USING (id, k) JOIN dv USING (id) JOIN tax USING (k) LEFT JOIN e USING (k)"""


def layer_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir).divergences().select("id", "campo")


LAYER_DIVERGENCES = f"""
    WITH {_BASE} SELECT id, 'endereço' AS campo FROM ends WHERE versoes > 1 UNION ALL SELECT id, 'CNPJ' FROM erp WHERE k % 5 = 0 UNION ALL SELECT id, 'independência das fontes' FROM erp WHERE k % 2 = 0
    UNION ALL SELECT id, 'valor faturado × contrato' FROM fin WHERE k % 7 = 0 AND abs((media - 150000) / 150000 * 100) > 4"""


def layer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir).gaps().select("id", F.array_join("lacunas", "; ").alias("lacunas"))


LAYER_GAPS = f"WITH {_BASE} SELECT id, {_GAP} AS lacunas FROM k"


def layer_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir).timeline().select("id", "data", "ref")


LAYER_TIMELINE = f"WITH {_BASE} SELECT id, data, ref FROM refs"


def layer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every entity, by source."""
    return layer(spark, sf_dir).references().groupBy("id", "fonte").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("primeira"))


LAYER_REFERENCES = f"WITH {_BASE} SELECT id, fonte, count(*) AS n, min(ref) AS primeira FROM refs GROUP BY 1, 2"


def layer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role sees, and an attack on it: secrets of records that it may not see (references, e-mails, tax ids) looked for in all that it is told.

    Criteria: records told of that are not allowed (proibidos), secrets that no
    allowed record holds but an answer does (vazados), and entities whose number
    of hidden records is told wrongly (contagem).  A tax id that an allowed
    record was corrected to is no secret.
    """
    own = layer(spark, sf_dir).prepared()
    marks = F.array_distinct(F.filter(F.array("ref", "email", F.when(F.length("cnpj") == 14, F.col("cnpj")), "cnpjCorrigido"), lambda x: F.coalesce(x, F.lit("")) != ""))
    secrets = materialize(own.records.select("fonte", F.explode(marks).alias("w")).distinct(), "secrets")
    everything = own.rows_of()
    out = []
    for role in [*access.ROLES, "visitante"]:
        dossier = materialize(own.dossier(role).select("id", "registros_ocultos", F.to_json(F.struct("*")).alias("t")), "dossiers")
        told = [own.references(role=role).select(F.concat_ws(" ", "ref", "citacao").alias("t")), dossier.select("t"), own.divergences(role).select(F.col("detalhe").alias("t")), own.timeline(role).select(F.concat_ws(" ", "ref", "evento").alias("t"))]
        words = reduce(DataFrame.unionByName, told).select(F.explode(F.split("t", '[\\s"\\\\,;()\\[\\]{}]+')).alias("w")).distinct()
        leaked = access.exclusive(secrets, access.allowed(role), "w").select("w").distinct().join(words, "w", "left_semi").agg(F.count(F.lit(1)).alias("vazados"))
        hidden = everything.groupBy("id").agg(F.count_if(~access.allowed(role)).alias("h")).join(dossier, "id").agg(F.count_if(F.col("h") != F.col("registros_ocultos")).alias("contagem"))
        counts = own.rows_of(role).agg(F.count(F.lit(1)).alias("registros"), F.count_distinct("id").alias("entidades"), F.array_join(F.array_sort(F.collect_set("fonte")), ",").alias("fontes"), F.count_if(~access.allowed(role)).alias("proibidos"))
        out.append(counts.crossJoin(leaked).crossJoin(hidden).select(F.lit(role).alias("perfil"), "registros", "entidades", "fontes", "proibidos", "vazados", "contagem"))  # one row each
    return reduce(DataFrame.unionByName, out)


LAYER_ROLES = f"""
    WITH {_BASE}, roles AS (SELECT role, unnest(fs) AS fonte FROM (VALUES {", ".join(f"('{r}', {fs})" for r, fs in access.ROLES.items())}) t(role, fs)),
    seen AS (SELECT * FROM roles JOIN refs USING (fonte))
    SELECT role AS perfil, count(*) AS registros, count(DISTINCT id) AS entidades, string_agg(DISTINCT fonte, ',' ORDER BY fonte) AS fontes, 0::BIGINT AS proibidos, 0::BIGINT AS vazados, 0::BIGINT AS contagem FROM seen GROUP BY 1
    UNION ALL SELECT 'visitante', 0, 0, '', 0, 0, 0"""


def layer_roles_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attack on every role by search: tax ids, e-mails and phones that only records hidden from it hold are asked for.

    perguntas: identifiers asked; revelados: those that find an entity by that
    very kind of identifier; sem_registro: entities found of which the role sees
    no record; vazados: secret identifiers in the texts of answers.
    """
    own = layer(spark, sf_dir)
    c = F.col
    held = F.array(
        F.struct(F.lit("CNPJ").alias("kind"), F.when(c("cnpjOk"), c("cnpj")).otherwise(c("cnpjCorrigido")).alias("consulta")),
        F.struct(F.lit("e-mail").alias("kind"), c("email").alias("consulta")), F.struct(F.lit("telefone").alias("kind"), c("fone").alias("consulta")),
    )
    rows = own.records.join(own.membership.select("ref"), "ref", "left_semi").select("fonte", F.explode(held).alias("h")).select("fonte", "h.*").filter("coalesce(consulta, '') <> ''").distinct()
    rows = materialize(rows, "identifiers")
    out = []
    for role in [*access.ROLES, "visitante"]:
        shown = rows.filter(access.allowed(role)).select("kind", "consulta").distinct()
        asked = rows.filter(~access.allowed(role)).select("kind", "consulta").distinct().join(shown, ["kind", "consulta"], "left_anti").withColumn("q", F.concat_ws(" ", "kind", "consulta"))
        asked = materialize(asked, "secret-identifiers")
        hits = materialize(own.search(asked.select("q", "consulta"), role=role).join(asked.select("q", "kind"), "q"), "found-by-secrets")
        words = hits.select(F.explode(F.split(F.concat_ws(" ", "nome", "cidade", "aviso"), "\\s+")).alias("consulta")).distinct()
        sums = [
            asked.agg(F.count(F.lit(1)).alias("perguntas")), hits.filter(c("motivo") == c("kind")).agg(F.countDistinct("q").alias("revelados")),
            hits.join(own.rows_of(role).select("id").distinct(), "id", "left_anti").agg(F.countDistinct("id").alias("sem_registro")), asked.join(words, "consulta", "left_semi").agg(F.count(F.lit(1)).alias("vazados")),
        ]
        out.append(materialize(reduce(DataFrame.crossJoin, sums).withColumn("perfil", F.lit(role)), "role-searched"))  # one row each
    return reduce(DataFrame.unionByName, out)


LAYER_ROLES_SEARCH = f"""
    WITH {_BASE}, {_TAX}, held AS (
        SELECT 'crm' AS fonte, 'CNPJ' AS kind, cnpj AS v FROM tax UNION SELECT 'erp', 'CNPJ', cnpj FROM erp JOIN tax USING (k) UNION SELECT 'contrato', 'CNPJ', cnpj FROM ct JOIN tax USING (k)
        UNION SELECT 'crm', 'e-mail', 'contato@k' || k || '.com.br' FROM k UNION SELECT 'crm', 'telefone', k::VARCHAR FROM k
        UNION SELECT 'email', 'e-mail', CASE WHEN event_id % 4 = 0 THEN 'x' || event_id || '@gmail.com' ELSE 'contato@k' || user_id || '.com.br' END FROM ev WHERE id IS NOT NULL AND event_type <> 'error'
        UNION SELECT 'chamado', 'e-mail', 'contato@k' || user_id || '.com.br' FROM ev WHERE id IS NOT NULL AND event_type = 'error' AND event_id % 2 = 0),
    roles AS (SELECT role, fs FROM (VALUES {", ".join(f"('{r}', {fs})" for r, fs in access.ROLES.items())}, ('visitante', []::VARCHAR[])) t(role, fs)),
    secret AS (SELECT role, kind, v FROM roles, held GROUP BY ALL HAVING NOT bool_or(list_contains(fs, fonte)))
    SELECT role AS perfil, count(v) AS perguntas, 0::BIGINT AS revelados, 0::BIGINT AS sem_registro, 0::BIGINT AS vazados FROM roles LEFT JOIN secret USING (role) GROUP BY 1"""


def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source, and of mentions those linked."""
    own = layer(spark, sf_dir)
    linked = own.records.join(own.membership.select("ref", F.lit(1).alias("l")).distinct(), "ref", "left")
    return linked.groupBy("fonte").agg(F.count(F.lit(1)).alias("registros"), F.count("l").alias("ligados"))


LAYER_STATISTICS = f"""
    WITH {_BASE}, n AS (SELECT fonte, count(*) AS ligados FROM refs GROUP BY 1),
    t AS (SELECT 'nf' AS fonte, count(*) AS n FROM orders UNION ALL SELECT CASE WHEN event_type = 'error' THEN 'chamado' ELSE 'email' END, count(*) FROM events GROUP BY 1)
    SELECT fonte, coalesce(t.n, ligados) AS registros, ligados FROM n LEFT JOIN t USING (fonte)"""

QUERIES = {f.__name__: f for f in (layer_membership, layer_mentions, layer_mentions_stream, layer_merges, layer_search, layer_dossier, layer_divergences, layer_gaps, layer_timeline, layer_references, layer_roles, layer_roles_search, layer_statistics)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
