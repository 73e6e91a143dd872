"""The entity layer: sources in, resolved entities and answers with their origins out. Every answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import access, mentions, ranking, records, resolve, search
from arbelo.operators.resolve import Params
from arbelo.operators.tables import materialize, materialize_parts, together
from arbelo.sources import readers

EMAIL_SCHEMA = "id string, de string, data string, assunto string, corpo string"
TICKET_SCHEMA = "id string, aberto_em string, canal string, solicitante string, empresa_digitada string, assunto string, descricao string"


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six sources of a folder."""
    return {
        "crm": readers.read_csv(spark, f"{folder}/crm.csv"), "erp_clientes": readers.read_csv(spark, f"{folder}/erp_clientes.csv"), "erp_notas": readers.read_csv(spark, f"{folder}/erp_notas.csv"),
        "contratos": readers.read_texts(spark, f"{folder}/contratos"), "emails": readers.read_jsonl(spark, f"{folder}/emails.jsonl", EMAIL_SCHEMA), "chamados": readers.read_jsonl(spark, f"{folder}/chamados.jsonl", TICKET_SCHEMA),
    }


@dataclass(frozen=True)
class EntityLayer:
    params: Params
    records: DataFrame  # all records, with the corrected tax id of a registry record and the reason of a mention's link
    membership: DataFrame  # ref, id, kind (0 registry, 1 fact, 2 mention), pos
    entities: DataFrame
    groups: DataFrame
    merges: DataFrame
    refused: DataFrame
    n_refused: int
    corrections: DataFrame
    pending: DataFrame
    resolved: DataFrame  # entities as the registry alone gives them, before mentions teach them e-mails
    placed: DataFrame | None = None  # records with their membership, if they were written together

    @classmethod
    def build(cls, sources: dict[str, DataFrame], params: Params = Params()) -> EntityLayer:
        noise = params.removeRuido
        parts = {"crm": lambda d: records.crm(d, noise), "erp_clientes": lambda d: records.erp(d, noise), "erp_notas": records.invoices, "contratos": lambda d: records.contracts(d, noise), "emails": lambda d: records.emails(d, noise), "chamados": lambda d: records.tickets(d, noise)}
        spark = next(iter(sources.values())).sparkSession
        rows = materialize_parts(spark, [lambda d=sources[name], make=make: records.union(make(d)) for name, make in parts.items() if name in sources], "records")
        registered, mentioned = rows.filter("papel = 'cadastro'"), rows.filter("papel = 'mencao'")
        (cad, fixed, tried, labels, merges, refused, member, ents, groups), alike = together(spark, lambda: cls._resolved(registered, params), lambda: mentions.alike_names(mentioned, registered, params))
        resolved = ents
        invoices = rows.filter("fonte = 'nf'").select("ref", "cod", "pos").join(cad.filter("fonte = 'erp'").select("cod", F.col("ref").alias("r")), "cod").join(member.select(F.col("ref").alias("r"), "id"), "r")
        addenda = rows.filter("fonte = 'aditivo'").select("ref", "pos", F.col("pai").alias("r")).join(member.select(F.col("ref").alias("r"), "id"), "r")
        links, pending = mentions.link(mentioned, cad, member, ents, groups, params, alike)
        order = lambda kind: (F.lit(kind).alias("kind"),)
        placed = member.select("ref", "id", *order(0), F.col("pos").alias("ordem_no_grupo")).unionByName(invoices.select("ref", "id", *order(1), F.col("pos").alias("ordem_no_grupo"))).unionByName(addenda.select("ref", "id", *order(1), (F.col("pos") + (1 << 50)).alias("ordem_no_grupo")))
        placed = placed.unionByName(links.select("ref", "id", *order(2), (F.col("passada").cast("long") * (1 << 50) + F.col("pos")).alias("ordem_no_grupo")))
        rows = rows.join(fixed.select("ref", F.col("para").alias("cnpjCorrigido")), "ref", "left").join(links.select("ref", F.col("motivo").alias("motivoLigacao")), "ref", "left")
        if params.aprendeEmail:
            strong = links.filter(~F.col("motivo").rlike("nome parecido|contato conhecido")).join(rows.select("ref", "email"), "ref").filter("email <> ''").groupBy("id").agg(F.collect_set("email").alias("learned"))
            ents = ents.join(strong, "id", "left").withColumn("emails", F.array_union("emails", F.coalesce("learned", F.array().cast("array<string>")))).drop("learned")
        written = together(
            spark,
            lambda: materialize(rows, "records"), lambda: materialize(placed, "membership"), lambda: materialize(ents, "entities"),
            lambda: tried.refused_count(refused, labels),
        )
        return cls(params, *written[:3], groups, merges, tried.refused(refused, labels), written[3], fixed, pending, resolved)

    @staticmethod
    def _resolved(cad: DataFrame, params: Params) -> tuple:
        """Registry records with corrected tax ids, the corrections, what was tried, labels, merges and refusals, membership, entities and their groups."""
        fixed, found = together(cad.sparkSession, lambda: materialize(resolve.corrections(cad, params), "corrections"), lambda: resolve.near_records(cad, params))
        tried = resolve.candidate_edges(cad, params, fixed, found)
        nodes = cad.select("ref", F.when(F.col("cnpjOk"), F.col("cnpj")).alias("id"))
        # a correction joins by its target's id, but the corrected record itself brings none into the merge
        labels, merges, refused = resolve.constrained_merge(nodes, tried.edges)
        cad = cad.join(fixed.select("ref", F.col("para").alias("cnpjCorrigido")), "ref", "left")
        member, ents = resolve.entities(cad, labels)
        member, ents = together(cad.sparkSession, lambda: materialize(member, "membership"), lambda: materialize(ents, "entities"))
        return cad, fixed, tried, labels, merges, refused, member, ents, materialize(resolve.economic_groups(ents), "groups")

    def registry(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """What mentions are linked against: registry records, their entities, the entities, their groups."""
        return self.records.filter("papel = 'cadastro'"), self.membership.filter("kind = 0").select("ref", "id"), self.resolved, self.groups

    # -- what a role sees ---------------------------------------------------

    def rows_of(self, role: str | None = None) -> DataFrame:
        """Records with their entity, kind and order, as far as the role may see them."""
        see = lambda rows: rows if role is None or role == access.ALL else access.visible(rows, role)
        return see(self.records).join(self.membership, "ref") if self.placed is None else see(self.placed)

    def prepared(self) -> EntityLayer:
        """The layer with records and membership written as one table, for answers that need them many times over."""
        return self if self.placed is not None else replace(self, placed=materialize(self.rows_of(), "placed"))

    def view(self, role: str | None = None) -> DataFrame:
        """Entities with the identity that the visible records give, and how many records are hidden."""
        if role is None or role == access.ALL:
            return self.entities.join(self.groups, "id", "left").withColumns({"grupo": F.coalesce("grupo", F.array().cast("array<string>")), "ocultos": F.lit(0).cast("long")})
        seen = self.rows_of(role)
        who = resolve.identity(seen.filter("kind = 0"))
        counts = access.hidden(self.rows_of(), role, "id")
        first_mention = seen.filter("kind = 2").groupBy("id").agg(F.min_by("nomeOrig", "ordem_no_grupo").alias("mencionado"))
        base = self.entities.select("id", "cidade", "ordem").join(self.groups, "id", "left").join(counts, "id").join(who, "id", "left").join(first_mention, "id", "left")
        empty = F.array().cast("array<string>")
        lists = {c: F.coalesce(c, empty) for c in ("nomesNorm", "emails", "dominios", "fones", "cnpjs", "grupo")}
        return base.withColumns(lists | {"nome": F.coalesce("nome", "mencionado", F.lit("")), "razao": F.coalesce("razao", F.lit(""))}).drop("mencionado")

    # -- facts ---------------------------------------------------------------

    def declarations(self, role: str | None = None) -> DataFrame:
        rows = self.rows_of(role).filter("`end`.chave is not null")
        return rows.select("id", "ref", "fonte", F.col("end.chave").alias("endereco"), F.col("end.texto").alias("texto"), F.col("end.cidade").alias("cidade"), F.coalesce("dataEnd", "data", F.lit("")).alias("data"), F.col("copiaDe").alias("copia_de"), F.struct("kind", "ordem_no_grupo").alias("o"))

    def addresses(self, role: str | None = None) -> DataFrame:
        """Per entity the current address (latest independent declaration), distinct values, the naive majority and all declarations."""
        d = self.declarations(role).withColumn("e", F.struct("data", "endereco", "texto", "cidade", "ref", "fonte", "copia_de"))
        # latest first; of one date, the first in order: negated orders make both a maximum
        key = F.struct("data", (-F.col("o.kind")).alias("k"), (-F.col("o.ordem_no_grupo")).alias("p"))
        d = d.withColumn("key", key)
        now = d.groupBy("id").agg(F.max_by("e", F.when(F.col("copia_de").isNull(), F.col("key"))).alias("own"), F.max_by("e", "key").alias("any"), F.countDistinct("endereco").alias("valores_distintos"), F.transform(F.sort_array(F.collect_list(F.struct("key", "e")), asc=False), lambda x: x["e"]).alias("declaracoes"))
        counts = d.groupBy("id", "endereco").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key")).groupBy("id").agg(F.max_by("endereco", F.struct("n", "key")).alias("maioria_ingenua"))
        return now.join(counts, "id").select("id", F.coalesce("own", "any").alias("atual"), "declaracoes", "valores_distintos", "maioria_ingenua")

    def finance(self, role: str | None = None) -> DataFrame:
        """Per entity: invoices, overdue ones and their total, the first contract, the mean and its deviation."""
        rows = self.rows_of(role)
        nf = rows.filter("fonte = 'nf'")
        late = F.col("situacao") == "ATRASADA"
        sums = nf.groupBy("id").agg(
            F.count(F.lit(1)).alias("notas"), F.array_sort(F.collect_set("cod")).alias("codigos_erp"),
            F.array_sort(F.collect_list(F.when(late, F.struct("data", "ref", "valor")))).alias("atrasadas"), F.sum(F.when(late, F.col("valor")).otherwise(0.0)).alias("atrasado"), F.avg("valor").alias("media"),
        )
        ct = rows.filter("fonte = 'contrato' and kind = 0").groupBy("id").agg(F.min_by(F.struct("ref", F.col("valorMensal").alias("valor_mensal")), "pos").alias("contrato"))
        both = self.entities.select("id").join(sums, "id", "left").join(ct, "id", "left")
        agreed = F.col("contrato.valor_mensal")
        off = F.when((agreed != 0) & (F.col("media") != 0), (F.col("media") - agreed) / agreed)
        return both.select("id", F.coalesce("notas", F.lit(0)).alias("notas"), "codigos_erp", "atrasadas", X.round_half_up(F.coalesce("atrasado", F.lit(0.0)), 2).alias("total_atrasado"), "contrato", X.round_half_up(F.coalesce("media", F.lit(0.0)), 2).alias("media_faturada"), (F.floor(off * 1000 + 0.5) / 10).alias("desvio_contrato"))

    def divergences(self, role: str | None = None) -> DataFrame:
        """(id, campo, detalhe): address versions, invoiced against contract, broken tax ids, copies that confirm nothing."""
        rows, ad, fin = self.rows_of(role), self.addresses(role), self.finance(role)
        stale = rows.filter("kind = 0 and fonte in ('crm', 'erp') and `end` is not null").join(ad.select("id", F.col("atual.endereco").alias("now")), "id").filter(~F.col("end.chave").eqNullSafe(F.col("now"))).groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("cadastros_desatualizados"))
        a = ad.filter("valores_distintos > 1").join(stale, "id", "left").select("id", F.lit("endereço").alias("campo"), F.to_json(F.struct(F.col("atual").alias("mais_recente"), F.col("declaracoes").alias("versoes"), "maioria_ingenua", (F.col("maioria_ingenua") != F.col("atual.endereco")).alias("maioria_erraria"), "cadastros_desatualizados")).alias("detalhe"))
        b = fin.filter("abs(desvio_contrato) > 4").select("id", F.lit("valor faturado × contrato").alias("campo"), F.to_json(F.struct("contrato", "media_faturada", F.col("desvio_contrato").alias("desvio_pct"))).alias("detalhe"))
        wrong = rows.filter("coalesce(cnpjBruto, '') <> '' and not cnpjOk").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref", F.col("cnpjBruto").alias("cnpj"), F.col("cnpjCorrigido").alias("corrigido_para")))).alias("registros_com_dv_invalido"))
        c = wrong.select("id", F.lit("CNPJ").alias("campo"), F.to_json(F.struct("registros_com_dv_invalido")).alias("detalhe"))
        copies = rows.filter("kind = 0 and copiaDe = 'crm'").groupBy("id").agg(F.array_sort(F.collect_list(F.concat("ref", F.lit(" ← lote "), "lote"))).alias("refs"))
        d = copies.select("id", F.lit("independência das fontes").alias("campo"), F.to_json(F.struct("refs")).alias("detalhe"))
        return a.unionByName(b).unionByName(c).unionByName(d)

    def gaps(self, role: str | None = None) -> DataFrame:
        """(id, lacunas): what no visible source knows."""
        rows, fin, ad = self.rows_of(role), self.finance(role), self.addresses(role)
        registered = rows.filter("kind = 0 and fonte in ('crm', 'erp')").select("id", F.col("end.chave").alias("endereco")).distinct().withColumn("registered", F.lit(True))
        now = ad.select("id", F.col("atual.endereco").alias("endereco"), F.col("atual.fonte").alias("fonte")).join(registered, ["id", "endereco"], "left").filter("registered is null")
        where = F.create_map(*[F.lit(x) for kv in {"email": "e-mail", "chamado": "chamado", "aditivo": "aditivo de contrato", "contrato": "contrato"}.items() for x in kv])
        late = now.select("id", F.concat(F.lit("endereço mais recente só aparece em "), F.coalesce(where[F.col("fonte")], F.col("fonte")), F.lit("; CRM e ERP ainda não foram atualizados")).alias("l3"))
        all_ = self.view(role).select("id", "cnpjs").join(fin.select("id", "contrato"), "id").join(late, "id", "left")
        found = F.array(F.when(F.col("contrato").isNull(), "nenhum contrato encontrado para esta entidade"), F.when(F.size("cnpjs") == 0, "nenhuma fonte traz CNPJ válido"), F.col("l3"))
        return all_.select("id", F.filter(found, lambda x: x.isNotNull()).alias("lacunas"))

    def timeline(self, role: str | None = None) -> DataFrame:
        """(id, data, evento, ref, o): dated records; order by (data, o) where they are shown."""
        c = F.col
        event = (
            F.when(c("fonte") == "nf", F.concat(F.lit("nota "), F.substring("ref", 4, 100), F.lit(" R$ "), F.format_string("%.2f", c("valor")), F.lit(" "), c("situacao")))
            .when(c("fonte") == "crm", "CRM: endereço registrado/atualizado").when((c("fonte") == "erp") & c("copiaDe").isNotNull(), F.concat(F.lit("ERP: cadastro importado do CRM ("), c("lote"), F.lit(")"))).when(c("fonte") == "erp", "ERP: cadastro manual")
            .when(c("fonte") == "contrato", F.concat(F.lit("contrato "), c("num"), F.lit(" assinado (R$ "), F.format_string("%.2f", c("valorMensal")), F.lit("/mês)"))).when(c("fonte") == "aditivo", "aditivo: novo endereço").otherwise(F.concat(c("fonte"), F.lit(": "), c("assunto")))
        )
        return self.rows_of(role).filter("coalesce(data, '') <> ''").select("id", "data", event.alias("evento"), "ref", F.struct("kind", "ordem_no_grupo").alias("o"))

    # -- answers ---------------------------------------------------------------

    @staticmethod
    def citation() -> Column:
        """A record as a citation; null fields are left out of its JSON."""
        c = F.col
        some = lambda x: F.when(x != "", x)
        tax = F.when(c("cnpjOk"), c("cnpjBruto")).when(c("cnpjCorrigido").isNotNull(), F.concat(c("cnpjBruto"), F.lit(" (DV inválido, corrigido)"))).otherwise(F.concat(c("cnpjBruto"), F.lit(" (DV inválido)")))
        return F.struct(
            "ref", "origem", some(c("nomeOrig")).alias("nome"), F.when(c("cnpjBruto") != "", tax).alias("cnpj"), some(c("email")).alias("email"), c("end.texto").alias("endereco"), some(c("data")).alias("data"), some(c("assunto")).alias("assunto"),
            c("valor"), c("situacao"), c("cod").alias("cod_erp"), F.when(c("valorMensal") != 0, c("valorMensal")).alias("valor_mensal"), F.when(c("copiaDe").isNotNull(), F.concat("copiaDe", F.lit(" (lote "), "lote", F.lit(")"))).alias("copia_de"), c("motivoLigacao").alias("ligado_por"),
        )

    def possible(self, role: str | None = None) -> DataFrame:
        """Pending mentions by the entity that they may mean."""
        rows = self.records if role is None else access.visible(self.records, role)
        p = self.pending.select("ref", "porque", "candidatos", F.explode("candidatos").alias("id"))
        return p.join(rows, "ref").select("id", "ref", "fonte", F.to_json(self.citation()).alias("citacao"), F.col("porque").alias("pendente"), F.array_remove("candidatos", F.col("id")).alias("outros_candidatos"))

    def references(self, source: str | None = None, role: str | None = None) -> DataFrame:
        """(id, ref, fonte, citacao, pendente): all citations of every entity, pending ones marked."""
        linked = self.rows_of(role).select("id", "ref", "fonte", F.to_json(self.citation()).alias("citacao"), F.lit(None).cast("string").alias("pendente"))
        out = linked.unionByName(self.possible(role).select("id", "ref", "fonte", "citacao", "pendente"))
        return out.filter(F.col("fonte") == source) if source else out

    def merge_log(self, role: str | None = None) -> DataFrame:
        """(id, de, para, motivo) of merges both of whose records the role sees."""
        seen = self.rows_of(role).filter("kind = 0").select("ref", "id")
        logged = self.merges.join(seen.select(F.col("ref").alias("a")), "a", "left_semi").join(seen.select(F.col("ref").alias("b"), "id"), "b")
        return logged.select("id", F.col("a").alias("de"), F.col("b").alias("para"), "motivo")

    def dossier(self, role: str | None = None) -> DataFrame:
        """One row per entity that the role can see, with everything consolidated; parts of it as JSON."""
        rows = self.rows_of(role)
        counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("registros"))
        listed = lambda df, *order: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
        tickets = listed(rows.filter("fonte = 'chamado'").select("id", "ordem_no_grupo", F.to_json(self.citation()).alias("c")), "ordem_no_grupo", "c").select("id", F.col("x.c").alias("chamados"))
        pend = listed(self.possible(role), "ref", "citacao", "pendente").select("id", F.col("x.citacao").alias("mencoes_pendentes"))
        div = listed(self.divergences(role), "campo", "detalhe").select("id", F.col("x").alias("divergencias"))
        how = listed(self.merge_log(role), "de", "para", "motivo").select("id", F.col("x").alias("como_foi_ligado"))
        out = self.view(role).join(counts, "id")
        for part in (self.addresses(role).select("id", F.struct("atual", "declaracoes", "valores_distintos", "maioria_ingenua").alias("endereco")), self.finance(role).select("id", F.struct("notas", "codigos_erp", "atrasadas", "total_atrasado", "contrato", "media_faturada", "desvio_contrato").alias("financeiro")), tickets, pend, div, self.gaps(role), how):
            out = out.join(part, "id", "left")
        return out.select("id", F.lit(role or access.ALL).alias("perfil"), F.col("ocultos").alias("registros_ocultos"), "nome", F.col("razao").alias("razao_social"), "cidade", F.col("cnpjs").alias("cnpj"), "emails", F.col("grupo").alias("grupo_economico"), "endereco", "financeiro", "chamados", "mencoes_pendentes", "divergencias", "lacunas", "registros", "como_foi_ligado")

    def search(self, queries: DataFrame, n: int = 5, role: str | None = None) -> DataFrame:
        """The n best entities for each query (q, consulta): by tax id, one wrong digit, e-mail, phone, or name; ties and incomplete names are flagged."""
        p = self.params
        # each part below names these tables several times: they are written once, so that no plan holds them over and over
        rows = self.rows_of(role)
        seen = self.view(role).join(rows.select("id").distinct(), "id", "left_semi")
        ents = materialize(seen.select("id", "nome", "cidade", "ordem", "nomesNorm", "emails", "fones", "cnpjs"), "entities-searched")
        own = ents.select("id", F.explode("nomesNorm").alias("nome"), F.lit(1.0).alias("w"))
        said = rows.filter("kind = 2 and nome <> ''").select("id", "nome", F.lit(0.95).alias("w")).distinct()
        names = materialize(own.unionByName(said), "names-searched")
        asked = queries.select("q", F.trim("consulta").alias("c")).filter("c <> ''").select("q", F.col("c"), X.digits(F.col("c")).alias("d"), F.lower("c").alias("l"), X.normalise_name(F.col("c"), p.removeRuido).alias("query"))
        asked = materialize(asked, "asked")
        tax = ents.select("id", F.explode("cnpjs").alias("t"))
        found = [
            asked.filter("length(d) >= 8").withColumn("t8", F.substring("d", 1, 8)).join(tax.withColumn("t8", F.substring("t", 1, 8)), "t8").filter(F.col("t").startswith(F.col("d"))).select("q", "id", F.lit(1.0).alias("s"), F.lit(1).alias("o"), F.lit("CNPJ").alias("motivo")),
            asked.filter("length(d) = 14").select("q", F.explode(X.one_digit_neighbours(F.col("d"))).alias("t")).hint("merge").join(tax, "t").select("q", "id", F.lit(0.9).alias("s"), F.lit(2).alias("o"), F.lit("CNPJ com 1 dígito diferente").alias("motivo")),
            asked.filter("l like '%@%'").join(ents.select("id", F.explode("emails").alias("l")), "l").select("q", "id", F.lit(1.0).alias("s"), F.lit(3).alias("o"), F.lit("e-mail").alias("motivo")),
            asked.filter("length(d) >= 8").withColumn("f", F.substring("d", -8, 8)).join(ents.select("id", F.explode("fones").alias("f")), "f").select("q", "id", F.lit(0.95).alias("s"), F.lit(4).alias("o"), F.lit("telefone").alias("motivo")),
        ]
        best_of = lambda df: df.groupBy("q", "id").agg(F.min_by(F.struct("s", "motivo", "o"), "o").alias("b")).select("q", "id", "b.*")
        by_key = materialize(best_of(reduce(DataFrame.unionByName, found)), "found-by-key")
        by_name = search.nearest(asked.filter("query <> ''").select("q", "query"), names, by_key, n, p.sim, p.scoreMinBusca - search.ROUNDING)
        one = best_of(by_key.unionByName(by_name.select("q", "id", "s", F.lit("nome").alias("motivo"), F.lit(5).alias("o")).select(by_key.columns)))
        scored = one.withColumn("score", X.round_half_up(F.col("s"), 2)).filter(F.col("score") >= p.scoreMinBusca).join(ents.select("id", "nome", "cidade", "ordem"), "id")
        best = materialize(ranking.top_k(scored, ["q"], n, F.col("score").desc(), F.col("ordem")), "best-entities")
        firsts = best.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2")).select("q", F.coalesce(F.col("s1") - F.col("s2") < p.margemBusca, F.lit(False)).alias("tie"))
        fits = search.contained(asked.filter("query <> '' and d = ''").select("q", "query"), own.select("nome")).join(own, "nome").select("q", "id", "nome").join(asked.select("q", "query"), "q")
        fit = fits.groupBy("q").agg(F.countDistinct("id").alias("cabem"), F.max(F.col("nome") == F.col("query")).alias("exato"), F.collect_set("id").alias("ids")).filter("cabem > 1 and not exato")
        if not p.regraIncompleto:
            fit = fit.limit(0)
        fit = materialize(fit, "names-that-fit")
        out = best.join(firsts, "q").join(fit, "q", "left").withColumn("empate", F.col("tie") | F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
        note = F.when((F.col("rank") == 1) & F.col("empate") & F.col("cabem").isNotNull(), F.concat(F.lit("nome incompleto: serve para "), F.col("cabem").cast("string"), F.lit(" clientes; pergunte qual")))
        return out.select("q", "rank", "id", "nome", "cidade", "score", "motivo", "empate", note.alias("aviso"))

    def statistics(self) -> dict:
        """Counts over the layer."""
        rows, ad = self.records, self.addresses()
        mention = rows.filter("papel = 'mencao'")
        return {
            "registros": rows.count(), "fontes": {r.fonte: r["count"] for r in rows.groupBy("fonte").count().collect()}, "entidades": self.entities.count(), "ambiguos": self.pending.count(),
            "correcoes_cnpj": self.corrections.count(), "bloqueios_cnpj": self.n_refused, "entidades_com_copia_crm_erp": self.rows_of().filter("kind = 0 and copiaDe = 'crm'").select("id").distinct().count(),
            "maioria_ingenua_erraria_endereco": ad.filter("maioria_ingenua <> atual.endereco").count(), "mencoes": mention.count(), "mencoes_ligadas": mention.join(self.membership, "ref", "left_semi").count(),
        }

    def entity_of(self) -> DataFrame:
        return self.membership.select("ref", "id")
