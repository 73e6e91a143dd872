"""Planted damage in a folder of exports, readers with provenance, and the same data under other names and formats."""

from __future__ import annotations

import json

import pytest

from arbelo import profiler
from arbelo.plans import study_queries
from arbelo.sources import readers


def dv(base):
    for weights in ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]):
        r = sum(int(d) * w for d, w in zip(base, weights, strict=True)) % 11
        base += str(0 if r < 2 else 11 - r)
    return base


def tax(i, branch=1):
    return dv(f"{10_000_000 + i * 37:08d}{branch:04d}")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    names = [f"Padaria {a} {b}" for a in ("Alfa", "Beta", "Gama", "Delta", "Zeta", "Kapa", "Sigma", "Omega") for b in ("Norte", "Sul", "Leste", "Oeste", "Centro")]
    rows = []
    for i in range(40):
        cnpj = tax(i)
        if i in (3, 4, 5):
            cnpj = cnpj[:-1] + str((int(cnpj[-1]) + 1) % 10)
        if i in (10, 11):
            cnpj = tax(i + 10)
        if i == 30:
            cnpj = tax(31, 2)
        name = names[0] if i == 39 else names[i]
        rows.append((f"C{i:03d}", name, cnpj, f"contato{i}@{'gmail' if i == 7 else 'firma' + str(i)}.com", f"Rua das Flores, {i + 1} - Curitiba"))
    line = lambda xs: ";".join(f'"{x}"' if any(c in str(x) for c in '";,\n') else str(x) for x in xs)
    (root / "clientes.csv").write_text("\n".join([line(("id", "nome", "cnpj", "email", "endereco"))] + [line(r) for r in rows]) + "\n")
    orders = [(f"{500 + i}", rows[i % 40][0] if i >= 4 else f"X{i:03d}", "2024-01-02", f"{100 + i},50") for i in range(60)]
    (root / "pedidos.csv").write_text("\n".join([line(("pedido", "cliente", "data", "valor"))] + [line(r) for r in orders]) + "\n")
    mirror = [{"codigo": f"M{i}", "cadastro": {"cnpj": tax(i), "endereco": rows[i][4] if i not in (20, 21) else f"Rua Nova, {i} - Londrina"}, "origem": "IMPORT"} for i in range(40)]
    (root / "espelho.jsonl").write_text("\n".join(json.dumps(m) for m in mirror) + "\n\n")
    (root / "docs").mkdir()
    for i, t in enumerate([f"cnpj {tax(1)}", "fale com CONTATO2@firma2.com", f"{tax(8)[:2]}.{tax(8)[2:5]}.{tax(8)[5:8]}/{tax(8)[8:12]}-{tax(8)[12:]}", f"conversa com {names[9]} ontem", "nada aqui"]):
        (root / "docs" / f"d{i}.txt").write_text(t)
    (root / "gabarito.json").write_text("[]")
    return root


@pytest.fixture(scope="module")
def report(spark, folder):
    return profiler.profile(spark, f"file://{folder}")


def test_types_and_planted_damage(report):
    kinds = {(r.source, r.col): r.tipo for r in report.columns.collect()}
    assert kinds[("clientes.csv", "cnpj")] == "cnpj" and kinds[("clientes.csv", "email")] == "email" and kinds[("clientes.csv", "nome")] == "nome"
    assert kinds[("clientes.csv", "endereco")] == "endereco" and kinds[("pedidos.csv", "valor")] == "valor" and kinds[("pedidos.csv", "data")] == "data" and kinds[("clientes.csv", "id")] == "id"
    risks = {(r.onde, r.regra): r.n for r in report.risks.collect()}
    assert risks[("clientes.csv::cnpj", "invalid id")] == 3
    assert risks[("clientes.csv::cnpj", "repeated id")] == 2
    assert risks[("clientes.csv::cnpj", "branch groups")] == 1
    assert risks[("clientes.csv::nome", "homonyms")] == 1
    assert risks[("clientes.csv::email", "generic mail")] == 1
    assert risks[("pedidos.csv::cliente", "orphans of clientes.csv::id")] == 4
    assert ("espelho.jsonl::origem", "import mark") in risks


def test_copies_links_and_documents(report):
    copies = {(r.campo, r.igual_a): r for r in report.copies.collect()}
    assert copies[("clientes.csv::endereco", "espelho.jsonl::cadastro.endereco")].leitura == profiler.CONFIRMED
    assert any(r.chave == "cnpj" and r.em_comum >= 30 for r in report.links.collect())
    d = report.documents.first()
    assert (d.fonte, d.documentos, d.por_chave, d.por_nome, d.sem_ligacao) == ("docs/", 5, 3, 1, 1)
    text = report.markdown()
    assert text.startswith("# Laudo") and "invalid id" in text and json.loads(profiler.as_json(report))["riscos"]
    order = [r.ordem for r in report.risks.orderBy("ordem").collect()]
    assert order == sorted(order)


def test_reports_are_written(spark, report, tmp_path):
    report.write(f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/riscos").count() == report.risks.count()


def test_csv_with_quotes_line_breaks_and_empty_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k;v\n1;"two ""quoted""; lines\nhere"\n2;\n')
    rows = readers.read_csv(spark, f"file://{tmp_path}/a.csv").orderBy("_linha").collect()
    assert [(r.k, r.v, r._linha, r._file) for r in rows] == [("1", 'two "quoted"; lines\nhere', 2, "a.csv"), ("2", "", 3, "a.csv")]
    assert readers.sniff_separator("a,b;c,d") == "," and readers.sniff_separator("a;b,c") == ";" and readers.sniff_separator("a\tb") == "\t"


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "o": {"x": [1, 2], "y": null}}\n\n{"id": "2"}\n')
    rows = readers.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string").orderBy("_linha").collect()
    assert [(r.id, r._linha) for r in rows] == [("1", 1), ("2", 2)]
    kind, flat = readers.read_source(spark, f"file://{tmp_path}/a.jsonl")
    assert kind == "tabela" and {c for c in flat.columns} == {"id", "o.x", "o.y", "_linha"} or {c for c in flat.columns} == {"id", "o.x", "_linha"}
    (tmp_path / "b.json").write_text('{"exported": "x", "items": [{"n": 1}, {"n": 2}]}')
    kind, rows = readers.read_source(spark, f"file://{tmp_path}/b.json")
    assert sorted(r.n for r in rows.collect()) == ["1", "2"]


def test_csv_round_trip_and_resumable_jobs(spark, tmp_path):
    df = spark.createDataFrame([("1", "plain"), ("2", 'a;b "c"')], "id string, v string")
    readers.write_csv(df, f"file://{tmp_path}/w")
    assert {(r.id, r.v) for r in readers.read_csv(spark, f"file://{tmp_path}/w").collect()} == {("1", "plain"), ("2", 'a;b "c"')}
    assert [r.id for r in readers.pending_jobs(df, df.filter("id = '1'")).collect()] == ["2"]
    assert readers.public_columns(df.withColumnRenamed("v", "_v")).columns == ["id"]


def test_the_risks_of_a_registry_read_it_once(spark, monkeypatch):
    kept, real = [], study_queries.materialize
    monkeypatch.setattr(study_queries, "materialize", lambda df, name: kept.append(name) or real(df, name))
    found = study_queries.risk_ranking(spark, "/root/testdata/sf0.001")
    assert kept == ["values", "stats"] and found.count() == 5
    assert "customer.parquet" not in "".join(found.inputFiles())
