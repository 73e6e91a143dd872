from __future__ import annotations

from pyspark.sql import functions as F

from arbelo import trials
from arbelo.sources import synthetic


def test_seeds_draw_their_noise():
    assert synthetic.noise_of(3) == synthetic.noise_of(3) != synthetic.noise_of(4)
    for of, ranges in synthetic.RANGES.items():
        assert all(ranges[k][0] <= v <= ranges[k][1] for k, v in synthetic.noise_of(7, of).items())


def test_homonyms_and_styles(spark):
    made = synthetic.generate(spark, 400, seed=2, noise={"homonym": 3.0, "id": 2.0})
    erp = made["erp_clientes"].select(F.col("_linha") - 2, "razao_social", "cnpj").collect()
    same = [(a, b) for a, b in zip(erp, erp[1:], strict=False) if b[0] % 8 == 5 and a.razao_social == b.razao_social]
    assert len(same) > 30 and all(a.cnpj != b.cnpj for a, b in same)
    crm = made["crm"].collect()
    assert {len(r.cnpj) for r in crm} == {0, 14, 18} and len({r.telefone[:1] for r in crm if r.telefone}) > 2 and any("nº" in r.endereco for r in crm)
    assert made["gabarito"].count() == made["gabarito"].select("ref").distinct().count()


def test_a_run_is_scored(spark):
    rows = trials.runs(spark, [11], 24)
    row = rows.first()
    assert row.semente == 11 and row.entidades == 24 and row.f1 > 0.8 and 0 < row.exatas <= 24 and row.mencoes == 96
    told = trials.accepted(rows, least_f1=0.8, most_wrong=1.0).first()
    assert told.sementes == 1 and told.aceito and told.f1_media == told.f1_minimo == row.f1
