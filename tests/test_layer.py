from __future__ import annotations

import pytest
from sequential import Resolver

from arbelo.layer import EntityLayer
from arbelo.operators import access, evaluate
from arbelo.operators.resolve import Params
from arbelo.sources import synthetic


@pytest.fixture(scope="module")
def sources(spark):
    return {k: v.cache() for k, v in synthetic.generate(spark, 48, seed=5, noise=1.6).items()}


@pytest.fixture(scope="module", params=["atual", "aprende"])
def built(request, sources):
    layer = EntityLayer.build(sources, Params(grupo=request.param))
    rows = [r.asDict(recursive=True) for r in layer.records.collect()]
    return layer, Resolver(rows, layer.params)


def test_clusters_merges_and_refusals_are_those_of_the_sequential_resolver(built):
    layer, seq = built
    found = {r.ref: r.id for r in layer.membership.filter("kind = 0").collect()}
    assert found == {ref: e["id"] for ref, e in seq.of.items()}
    assert sorted((r.a, r.b) for r in layer.merges.collect()) == sorted(seq.merged)
    assert sorted((r.a, r.b) for r in layer.refused.collect()) == sorted(seq.refused)
    assert {r.ref: r.para for r in layer.corrections.collect()} == seq.fixed
    assert {r.id: list(r.grupo) for r in layer.groups.collect()} == {e["id"]: e["group"] for e in seq.ents if e["group"]}


def test_mentions_are_linked_or_pending_alike(built):
    layer, seq = built
    found = {r.ref: (r.id, r.motivoLigacao) for r in layer.records.join(layer.membership.filter("kind = 2"), "ref").collect()}
    assert found == seq.links
    assert {r.ref: list(r.candidatos) for r in layer.pending.collect()} == seq.pending


def test_invariants(built):
    layer, _ = built
    known = {r.ref for r in layer.records.collect()}
    rows = layer.dossier().collect()
    assert len(rows) == layer.entities.count() and all(len(r.cnpj) <= 1 for r in rows)
    assert {r.ref for r in layer.references().collect()} <= known
    for r in rows:
        if r.endereco:
            dates = [d.data for d in r.endereco.declaracoes]
            assert dates == sorted(dates, reverse=True)
            own = [d for d in r.endereco.declaracoes if d.copia_de is None]
            assert r.endereco.atual.ref == (own or r.endereco.declaracoes)[0].ref
    assert layer.statistics()["mencoes_ligadas"] + layer.statistics()["ambiguos"] <= layer.statistics()["mencoes"]


def test_roles_see_only_their_sources(built):
    layer, _ = built
    for role, sources in access.ROLES.items():
        seen = {r.fonte for r in layer.rows_of(role).collect()}
        assert seen <= set(sources)
    assert layer.rows_of("nobody").count() == 0
    assert layer.dossier("nobody").count() == 0
    total = layer.membership.count()
    counts = [(r.registros, r.registros_ocultos) for r in layer.dossier("financeiro").collect()]
    assert sum(a + b for a, b in counts) <= total and all(a > 0 for a, _ in counts)
    assert not [r for r in layer.dossier("financeiro").collect() if r.emails]


def test_search_finds_by_every_key(spark, built):
    layer, seq = built
    e = next(e for e in seq.ents if e["ids"] and not e["group"] and e["mails"] and e["phones"])
    tax = e["ids"][0]
    wrong = tax[:13] + str((int(tax[13]) + 1) % 10)
    asked = spark.createDataFrame([(1, tax), (2, f"{tax[:2]}.{tax[2:5]}.{tax[5:8]}/{tax[8:12]}-{tax[12:]}"), (3, wrong), (4, e["mails"][0].upper()), (5, f"(41) 9{e['phones'][0]}"), (6, e["names"][0]), (7, "  ")], "q int, consulta string")
    best = {r.q: (r.id, r.score, r.motivo) for r in layer.search(asked).filter("rank = 1").collect()}
    assert best[1] == best[2] == (e["id"], 1.0, "CNPJ")
    assert best[3] == (e["id"], 0.9, "CNPJ com 1 dígito diferente")
    assert best[4][1:] == (1.0, "e-mail") and best[5][1:] == (0.95, "telefone") and best[6][1] == 1.0 and 7 not in best


def test_quality_on_the_ground_truth(sources, built):
    layer, _ = built
    both = sources["gabarito"].join(layer.entity_of(), "ref", "left")
    assert evaluate.pair_scores(both, "id", "entidade").first().f1 > 0.9
