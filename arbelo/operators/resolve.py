"""Resolution of registry records into entities: ordered candidate edges, a constrained merge, identities, groups.

Candidate edges depend on record fields only; all rules that join records by a
key run as one self-join on (rule, key).  The merge gives what a pass over them in one order gives under the rule
that two different valid ids never meet, in rounds of joins whose number grows
with the logarithm of the largest component.  No group of records is gathered
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import ranking
from arbelo.operators.alike import scored
from arbelo.operators.tables import materialize, together


@dataclass(frozen=True)
class Params:
    """Thresholds of one layer; instances do not share state."""

    sim: str = "max"
    removeRuido: bool = True
    regraIncompleto: bool = True
    aprendeEmail: bool = True
    guardaFone: float = 0.35
    guardaDominio: float = 0.55
    guardaEnd: float = 0.50
    quaseIdentico: float = 0.86
    simCorrecaoCnpj: float = 0.50
    limiarMencaoNome: float = 0.72
    limiarContato: float = 0.60
    margem: float = 0.08
    grupo: str = "atual"
    margemBusca: float = 0.05
    scoreMinBusca: float = 0.40

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


@dataclass(frozen=True)
class Rule:
    """Records with the same key are one entity if their names reach the guard (0: whatever they are called) and, if asked, their city is the same."""

    phase: int
    key: Column
    guard: float
    same_city: bool = False


#: The rule that tries all earlier records of a city.
NEAR = 7
# What the rules say of a merge, and how strong they are.
REASONS = {
    1: ("mesmo CNPJ válido", 1.0), 3: ("mesmo e-mail", 0.95), 4: ("mesmo telefone e nome parecido", 0.85), 5: ("mesmo domínio corporativo e nome parecido", 0.8),
    6: ("mesmo endereço e nome parecido", 0.8), 7: ("nome quase idêntico na mesma cidade", 0.7),
}
EDGE = ["phase", "block", "pos_b", "pos_a", "a", "b", "motivo", "forca"]


def first_in_block(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """rows with first, the smallest pos under the same key (partial minima, then a join: no hot group)."""
    first = rows.groupBy(key).agg(F.min(pos).alias("first"))
    return rows.join(first, key)


def near_names(rows: DataFrame, by: list[str], guard: Column | float, kind: str = "max") -> DataFrame:
    """(by..., nome_a, nome_b): similar enough pairs, both ways and with itself, of the names of rows (by..., nome) that agree in `by`.

    The numbers of Dice and Jaccard come from counted shared parts; the other
    measures compare all names of a group.
    """
    names = rows.filter("nome <> ''").select(*by, "nome").distinct()
    if kind == "max":
        own = names.withColumnRenamed("nome", "name")
        return scored(own, own, guard, by).select(*by, F.col("a").alias("nome_a"), F.col("b").alias("nome_b"))
    pairs = names.withColumnRenamed("nome", "nome_a").join(names.withColumnRenamed("nome", "nome_b"), by)
    return pairs.filter(X.name_similarity(F.col("nome_a"), F.col("nome_b"), kind) >= guard)


def keyed_rows(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, cell, pos, ref, nome, block): a row for each rule under which a record has a key; block: the first pos of the key.

    A cell is the key, for rules that ask for one city together with it; where a
    rule compares no names they are empty.  Records that cannot be an end (without
    a name or city that a rule asks for) count for the block alone.
    """
    city, name = F.coalesce("cidade", F.lit("")), F.coalesce("nome", F.lit(""))

    def under(r: Rule) -> Column:
        cell = F.when(city != "", F.concat(r.key, F.lit("\u0001"), city)) if r.same_city else r.key
        own = F.struct(F.lit(r.phase).alias("rule"), r.key.alias("key"), (F.when(name != "", cell) if r.guard > 0 else cell).alias("cell"), (name if r.guard > 0 else F.lit("")).alias("nome"))
        return F.when(F.coalesce(r.key, F.lit("")) != "", own)

    held = F.filter(F.array(*map(under, rules)), lambda x: x.isNotNull())
    each = rows.select("pos", "ref", F.explode(held).alias("x")).select("x.*", "pos", "ref")
    first = each.groupBy("rule", "key").agg(F.min("pos").alias("block"))
    return each.join(first, ["rule", "key"]).filter("cell is not null").select("rule", "cell", "pos", "ref", "nome", "block")


def rule_edges(keyed: DataFrame, near: DataFrame, every: Sequence[int] = ()) -> DataFrame:
    """(rule, a, b, pos_a, pos_b, block): each record to the first earlier one of its cell whose name is near enough.

    The rows of one name and cell are a class, and only its first can be such an
    end, so the edges are as many as the records.  For rules in `every`, which
    try all earlier records, there is an edge to the first of each near class:
    records of a class already lie in one entity or in entities of different ids
    when a later record comes, so whatever its attempts with the others merge, an
    attempt with the first has merged; all that is left of the others is refusals
    (refused_pairs).
    """
    firsts = keyed.groupBy("rule", "cell", F.col("nome").alias("nome_a")).agg(F.min(F.struct("pos", "ref", "block")).alias("first"))
    # where names are not compared, the cell is one class
    plain = firsts.filter("nome_a = ''").select("rule", "cell", "nome_a", F.col("nome_a").alias("nome_b"))
    ends = near.select("rule", "cell", "nome_a", "nome_b").unionByName(plain).join(firsts, ["rule", "cell", "nome_a"])
    tries_all = F.col("rule").isin(list(every)) if every else F.lit(False)
    ends = ends.groupBy("rule", "cell", F.col("nome_b").alias("nome"), F.when(tries_all, F.col("nome_a")).otherwise("").alias("class")).agg(F.min("first").alias("first"))
    found = keyed.drop("block").join(ends.select("rule", "cell", "nome", "first"), ["rule", "cell", "nome"]).filter("pos > first.pos")
    return found.select("rule", F.col("first.ref").alias("a"), F.col("ref").alias("b"), F.col("first.pos").alias("pos_a"), F.col("pos").alias("pos_b"), F.col("first.block").alias("block"))


def guarded_edges(rows: DataFrame, key: str, guard: float, kind: str = "max", same_city: bool = False) -> DataFrame:
    """(a, b, pos_a, pos_b, block) from rows (pos, ref, nome, cidade, key): b to the first earlier row of its key that is similar enough.

    A guard of 0 compares nothing.
    """
    keyed = materialize(keyed_rows(rows, [Rule(0, F.col(key).cast("string"), guard, same_city)]), "keyed")
    return rule_edges(keyed, near_names(keyed, ["rule", "cell"], guard, kind)).drop("rule")


def earlier_near(keyed: DataFrame, near: DataFrame, width: int = 50_000) -> DataFrame:
    """(rule, cell, ref, pos, n, first): of each record the number of earlier ones with a near name in its cell, and the first of them.

    Positions of a class are counted per range of `width`, then inside each range:
    no class has to fit one task, and no pair is made.
    """
    asks = keyed.join(near.withColumnRenamed("nome_b", "nome"), ["rule", "cell", "nome"]).select("rule", "cell", F.col("nome_a").alias("class"), "pos", "ref", F.lit(0).alias("one"))
    marked = keyed.filter("nome <> ''").select("rule", "cell", F.col("nome").alias("class"), "pos", F.lit(None).cast("string").alias("ref"), F.lit(1).alias("one")).unionByName(asks)
    counted = ranking.running(marked, ["rule", "cell", "class"], "pos", width, "one", "upto").filter("ref is not null")
    firsts = keyed.groupBy("rule", "cell", F.col("nome").alias("class")).agg(F.min("pos").alias("first"))
    # the running count holds a record itself in its own class, the others of its pos or before
    own = keyed.select("rule", "cell", "ref", F.col("nome").alias("own"))
    each = counted.join(own, ["rule", "cell", "ref"]).withColumn("n", F.col("upto") - (F.col("class") == F.col("own")).cast("int")).filter("n > 0").join(firsts, ["rule", "cell", "class"])
    return each.groupBy("rule", "cell", "ref", "pos").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _refusing_classes(keyed: DataFrame, near: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with class and root, and the pairs of near classes of different roots with their sizes."""
    placed = keyed.join(labels, "ref")
    sizes = placed.groupBy("rule", "cell", "nome", "root").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: sizes.select("rule", "cell", *[F.col(c).alias(f"{c}_{s}") for c in ("nome", "root", "n")])
    pairs = near.join(side("a"), ["rule", "cell", "nome_a"]).join(side("b"), ["rule", "cell", "nome_b"]).filter("root_a <> root_b")
    return placed, pairs


def refused_pairs(keyed: DataFrame, near: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, a, b, pos_a, pos_b, block): the attempts of rules that try all earlier records that were refused.

    An attempt between two clusters is refused only if both have ids and these
    differ, for good; any other leaves them in one entity.  So the refused ones
    are those whose ends lie in two entities.  Only those are made.
    """
    placed, pairs = _refusing_classes(keyed, near, labels)
    end = lambda s: placed.select("rule", "cell", *[F.col(c).alias(f"{c}_{s}") for c in ("nome", "root", "pos", "ref")], *(["block"] if s == "a" else []))
    made = pairs.drop("n_a", "n_b").join(end("a"), ["rule", "cell", "nome_a", "root_a"]).join(end("b"), ["rule", "cell", "nome_b", "root_b"]).filter("pos_a < pos_b")
    return made.select("rule", F.col("ref_a").alias("a"), F.col("ref_b").alias("b"), "pos_a", "pos_b", "block")


def refused_count(keyed: DataFrame, near: DataFrame, labels: DataFrame) -> int:
    """How many rows refused_pairs() has, from the sizes of classes alone."""
    _, pairs = _refusing_classes(keyed, near, labels)
    return int((pairs.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0) // 2)  # each pair comes both ways


def corrections(cad: DataFrame, params: Params) -> DataFrame:
    """(ref, pos, de, para, a, pos_a): invalid ids with exactly one valid id one digit away that name or phone confirms."""
    valid = cad.filter("cnpjOk").groupBy("cnpj").agg(F.min_by("ref", "pos").alias("a"), F.min_by("nome", "pos").alias("nome_a"), F.min("pos").alias("pos_a"))
    wrong = cad.filter("length(cnpj) = 14 and not cnpjOk").select("ref", "pos", "cnpjBruto", "nome", "fone", F.explode(X.one_digit_neighbours(F.col("cnpj"))).alias("cnpj"))
    phones = cad.filter("coalesce(fone, '') <> ''").select("cnpj", "fone").distinct().withColumn("confirmed", F.lit(True))
    near = wrong.join(valid, "cnpj").join(phones, ["cnpj", "fone"], "left")
    ok = near.filter((X.name_similarity(F.col("nome_a"), F.col("nome"), params.sim) >= params.simCorrecaoCnpj) | F.coalesce("confirmed", F.lit(False)))
    one = ok.groupBy("ref", "pos").agg(F.count(F.lit(1)).alias("n"), F.first("cnpjBruto").alias("de"), F.first("cnpj").alias("para"), F.first("a").alias("a"), F.first("pos_a").alias("pos_a"))
    return one.filter("n = 1").drop("n")


def rules(params: Params) -> list[Rule]:
    """The rules that join registry records by a key, in their order."""
    group = params.grupo != "atual"
    out = [
        Rule(1, F.when(F.col("cnpjOk"), F.col("cnpj")), 0.0),
        Rule(3, F.col("email"), 0.0, group),
        Rule(4, F.when(F.length("fone") == 8, F.col("fone")), params.guardaFone),
        Rule(5, X.company_domain(F.col("email")), params.guardaDominio, group),
        Rule(6, F.when(F.col("end.chave").isNotNull(), F.concat("end.chave", F.lit("|"), "end.cidade")), params.guardaEnd),
        Rule(NEAR, F.when(F.coalesce("cidade", F.lit("")) == "", F.lit("?")).otherwise(F.col("cidade")), params.quaseIdentico),
    ]
    return [r for r in out if r.phase != 5 or params.grupo != "pendente"]


@dataclass(frozen=True)
class Attempts:
    """What was tried to merge: ordered edges, and for the rule of near-identical names its classes."""

    edges: DataFrame
    keyed: DataFrame
    near: DataFrame

    def refused(self, refused: DataFrame, labels: DataFrame) -> DataFrame:
        """All refused attempts: those of the merge, and of near-identical names every pair."""
        pairs = refused_pairs(self.keyed.filter(F.col("rule") == NEAR), self.near.filter(F.col("rule") == NEAR), labels)
        return refused.filter(F.col("phase") != NEAR).unionByName(_told(pairs).select(*EDGE))

    def refused_count(self, refused: DataFrame, labels: DataFrame) -> int:
        return refused.filter(F.col("phase") != NEAR).count() + refused_count(self.keyed.filter(F.col("rule") == NEAR), self.near.filter(F.col("rule") == NEAR), labels)


def _told(found: DataFrame) -> DataFrame:
    """Found edges (rule, a, b, pos_a, pos_b, block) as attempts in their order."""
    pick = lambda k: reduce(lambda c, kv: c.when(F.col("rule") == kv[0], kv[1][k]), REASONS.items(), F.when(F.lit(False), REASONS[1][k]))
    # one id is one block, whatever its first record
    block = F.when(F.col("rule") == 1, 0).otherwise(F.col("block"))
    return found.select(F.col("rule").alias("phase"), block.cast("long").alias("block"), F.col("pos_b").cast("long").alias("pos_b"), F.col("pos_a").cast("long").alias("pos_a"), "a", "b", pick(0).alias("motivo"), pick(1).alias("forca"))


def near_records(cad: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Registry records by rule and cell, and the near names of each cell: what candidate_edges() needs of them."""
    asked = rules(params)
    keyed = materialize(keyed_rows(cad, asked), "keyed")
    guard = reduce(lambda c, r: c.when(F.col("rule") == r.phase, F.lit(r.guard)), asked, F.when(F.lit(False), F.lit(0.0)))
    return keyed, materialize(near_names(keyed, ["rule", "cell"], guard, params.sim), "near-names")


def candidate_edges(cad: DataFrame, params: Params, fixed: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> Attempts:
    """The ordered merge attempts between registry records, of all rules in one pass; found: what near_records() gave."""
    keyed, near = found or near_records(cad, params)
    corrected = fixed.select(
        F.lit(2).alias("phase"), F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("pos_b"), F.col("pos_a").cast("long").alias("pos_a"), "a", F.col("ref").alias("b"),
        F.concat(F.lit("CNPJ "), "de", F.lit(" com 1 dígito errado (DV inválido); corrigido para "), "para").alias("motivo"), F.lit(0.9).alias("forca"),
    )
    return Attempts(_told(rule_edges(keyed, near, [NEAR])).unionByName(corrected), keyed, near)


def _contracted(picks: DataFrame) -> DataFrame:
    """(c, root) of clusters that point at another one; pointers form trees but for pairs that point at each other."""
    back = picks.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
    at = materialize(picks.join(back, ["c", "to"], "left").filter(F.col("mutual").isNull() | (F.col("c") > F.col("to"))).select("c", F.col("to").alias("root")), "pointers")
    while True:
        ahead = at.select(F.col("c").alias("root"), F.col("root").alias("next"))
        jumped = at.join(ahead, "root", "left").select("c", "root", "next")
        if jumped.filter("next is not null").isEmpty():
            return at
        at = materialize(jumped.select("c", F.coalesce("next", "root").alias("root")), "pointers")


def constrained_merge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (ref, valid id or null), ordered edges -> labels (ref, root), effective merges, refused edges.

    Roots are refs; edges between clusters with two different ids are refused,
    as in one pass over the edges in their order.  A cluster's id never changes
    once it has one, so edges between different ids can be refused at once.  The
    first edge of a cluster without an id always merges it, whatever becomes of
    the other end; the first edge of a cluster with an id does if the other end
    has the same.  All such edges are taken in one round.  Clusters without an
    id at least halve in number, then those of each id: rounds grow with the
    logarithm of a component's size, also for stars and chains.
    """
    order = F.struct("phase", "block", "pos_b", "pos_a", "a", "b")
    # the same pair can come under several rules; its order tells them apart
    open_ = materialize(edges.filter("a <> b").select(*EDGE).dropDuplicates(["phase", "block", "pos_b", "pos_a", "a", "b"]).withColumn("ord", order).withColumns({"ca": F.col("a"), "cb": F.col("b")}), "edges")
    state = nodes.select(F.col("ref"), F.col("ref").alias("root"))
    ids = nodes.select(F.col("ref").alias("root"), F.col("id"))
    merges, refused = [], []
    while not open_.isEmpty():
        known = open_.join(ids.select(F.col("root").alias("ca"), F.col("id").alias("ida")), "ca", "left").join(ids.select(F.col("root").alias("cb"), F.col("id").alias("idb")), "cb", "left")
        known = materialize(known.select(*EDGE, "ord", "ca", "cb", "ida", "idb", F.coalesce(F.col("ida") != F.col("idb"), F.lit(False)).alias("differ")), "edges")
        refused.append(known.filter("differ").select(*EDGE))
        live = known.filter("not differ")
        side = lambda c, own, to, other: live.select(F.col(c).alias("c"), F.struct("ord", F.col(to).alias("to"), F.col(own).alias("own"), F.col(other).alias("other")).alias("e"))
        firsts = side("ca", "ida", "cb", "idb").unionByName(side("cb", "idb", "ca", "ida")).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*")
        picks = materialize(firsts.filter("own is null or own = other").select("c", "to", "ord", F.coalesce("own", "other").alias("id")), "picks")
        taken = picks.select("ord").distinct()
        merges.append(live.join(taken, "ord", "left_semi").select(*EDGE))
        moved = _contracted(picks.select("c", "to"))
        at_root = moved.select(F.col("c").alias("root"), F.col("root").alias("to"))
        ends = {c: moved.select(F.col("c").alias(c), F.col("root").alias(f"t{c}")) for c in ("ca", "cb")}
        next_state = state.join(at_root, "root", "left").select("ref", F.coalesce("to", "root").alias("root"))
        next_ids = ids.join(at_root, "root", "left").groupBy(F.coalesce("to", "root").alias("root")).agg(F.max("id").alias("id"))
        rest = live.join(taken, "ord", "left_anti").select(*EDGE, "ord", "ca", "cb").join(ends["ca"], "ca", "left").join(ends["cb"], "cb", "left")
        rest = rest.select(*EDGE, "ord", F.coalesce("tca", "ca").alias("ca"), F.coalesce("tcb", "cb").alias("cb")).filter("ca <> cb")
        state, ids, open_ = together(nodes.sparkSession, lambda df=next_state: materialize(df, "roots"), lambda df=next_ids: materialize(df, "ids"), lambda df=rest: materialize(df, "edges"))
    empty = edges.select(*EDGE).filter(F.lit(False))
    joined = lambda parts: reduce(DataFrame.unionByName, parts, empty)
    return state, joined(merges), joined(refused)


def entities(cad: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """membership (ref, id, pos) and entities (id, names, e-mails, ...) of clusters, numbered by their first record."""
    placed = cad.join(labels, "ref")
    firsts = placed.groupBy("root").agg(F.min("pos").alias("first"))
    # a rank over all clusters: counts per range of first positions, then ranks within each range
    numbered = _dense_numbers(firsts, "first").select("root", F.concat(F.lit("ENT-"), F.when(F.col("n") < 10000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string"))).alias("id"), "first")
    member = placed.join(numbered, "root")
    return member.select("ref", "id", "pos"), identity(member).join(_city(member), "id", "left").withColumn("cidade", F.coalesce("cidade", F.lit(""))).join(numbered.select("id", F.col("first").alias("ordem")), "id")


def _dense_numbers(rows: DataFrame, by: str, width: int = 50_000) -> DataFrame:
    """rows with n, their rank by distinct values of `by`, without bringing all rows into one window."""
    marked = rows.withColumn("_part", F.floor(F.col(by) / width))
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "before")
    return marked.join(F.broadcast(before), "_part").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("_part").orderBy(by))).drop("_part", "before")


def _in_order(value: Column) -> Column:
    """Distinct non-empty values of a group by their first pos."""
    pairs = F.array_sort(F.collect_set(F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.col("pos"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def identity(member: DataFrame, key: str = "id") -> DataFrame:
    """What an entity is, from the registry records given."""
    tax = F.when(F.col("cnpjOk"), F.col("cnpj")).otherwise(F.col("cnpjCorrigido"))
    first = lambda source: F.min_by(F.when(F.col("fonte") == source, F.col("nomeOrig")), F.when(F.col("fonte") == source, F.col("pos")))
    some = lambda c: F.when(c != "", c)
    any_ = F.min_by("nomeOrig", "pos")
    has_contract = F.max(F.col("fonte") == "contrato")
    return member.groupBy(key).agg(
        _in_order(F.col("nome")).alias("nomesNorm"), _in_order(F.col("email")).alias("emails"), _in_order(X.company_domain(F.col("email"))).alias("dominios"),
        _in_order(F.col("fone")).alias("fones"), _in_order(tax).alias("cnpjs"),
        F.coalesce(some(first("crm")), some(first("contrato")), some(any_), F.lit("")).alias("nome"),
        F.when(has_contract, first("contrato")).otherwise(F.coalesce(first("erp"), any_, F.lit(""))).alias("razao"),
    )


def _city(member: DataFrame) -> DataFrame:
    counts = member.filter("coalesce(cidade, '') <> ''").groupBy("id", "cidade").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    return counts.groupBy("id").agg(F.min_by("cidade", F.struct((-F.col("n")).alias("n"), F.col("p"))).alias("cidade"))


def economic_groups(ents: DataFrame) -> DataFrame:
    """(id, grupo): other entities with the same eight-digit root of a tax id, in order of first record."""
    roots = ents.select("id", "ordem", F.explode("cnpjs").alias("c")).select("id", "ordem", F.substring("c", 1, 8).alias("raiz")).distinct()
    other = roots.select(F.col("id").alias("o"), F.col("ordem").alias("oo"), "raiz")
    return roots.join(other, "raiz").filter("id <> o").groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct("oo", "o"))), lambda x: x["o"]).alias("grupo"))
