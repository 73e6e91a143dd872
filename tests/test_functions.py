from __future__ import annotations

from pyspark.sql import functions as F

from arbelo.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_tax_ids(spark):
    rows = spark.createDataFrame([("11222333000181",), ("11222333000182",), ("00000000000000",), ("1122233300018",), (None,), ("",)], "v string")
    assert [r.x for r in rows.select(X.valid_tax_id(F.col("v")).alias("x")).collect()] == [True, False, False, False, False, False]


def test_names(spark):
    assert one(spark, "MERC BOM PRECO COM LTDA", X.normalise_name) == one(spark, "Mercado Bom Preço Comércio Ltda", X.normalise_name) == "MERCADO BOM PRECO"
    assert one(spark, None, X.normalise_name) == "" and one(spark, "A b", X.normalise_name) == ""


def test_addresses(spark):
    styles = ["Rua XV de Novembro, 123 - Centro, Curitiba", "R. XV de Novembro 123, Curitiba", "RUA XV DE NOVEMBRO, 123 - CENTRO - CURITIBA", "R. XV de Novembro, 123 (Curitiba)"]
    found = {(e.chave, e.cidade) for e in (one(spark, s, X.address) for s in styles)}
    assert len(found) == 1 and next(iter(found))[1] == "CURITIBA"
    assert one(spark, "", X.address) is None and one(spark, "sem numero", X.address).chave is None
    assert one(spark, "Bom dia. O endereço correto agora é R. das Flores, 10 - Centro. Obrigado.", X.address_in_text) == "R. das Flores, 10 - Centro"


def jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, pairs = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == x and j not in used), None)
        if j is not None:
            used.add(j)
            pairs.append(i)
    m = len(pairs)
    if not m:
        return 0.0
    t = sum(a[i] != b[j] for i, j in zip(pairs, sorted(used), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < 4 and same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def test_similarities(spark):
    pairs = [("mercado", "farmacia"), ("abxyzqw", "abklmno"), ("martha", "marhta"), ("a", "a"), ("a", "b"), ("", "a"), ("ab", "abcdef"), ("dwayne", "duane")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", X.jaro_winkler(a, b).alias("jw"), X.dice(a, b).alias("d"), X.lev_ratio(a, b).alias("l")).collect()
    for r in rows:
        assert abs(r.jw - jaro_winkler(r.a, r.b)) < 1e-12
        assert 0 <= r.d <= 1 and 0 <= r.l <= 1
    assert {(r.a, r.b): r.d for r in rows}[("", "a")] == 0.0
    assert spark.createDataFrame([("B A", "A B")], "a string, b string").select(X.token_sort_ratio(a, b).alias("x")).first().x == 1.0


def test_digits_and_phones(spark):
    assert one(spark, "+55 (41) 99999-1234", X.phone_digits) == "41999991234" and one(spark, "(41) 99999-1234", X.phone_key) == "99991234" and one(spark, "123", X.phone_key) == "123"
    assert one(spark, "1.234,56", X.money) == 1234.56
    assert sorted(one(spark, "12", X.one_digit_neighbours)) == sorted({f"{d}2" for d in "023456789"} | {f"1{d}" for d in "013456789"})
    assert one(spark, "Casas azuis da R2D2@x.com", X.search_terms) == ["casa", "azui", "da", "r2d2@x.com"]
    assert one(spark, "a@gmail.com", X.company_domain) == "" and one(spark, "a@firma.com", X.company_domain) == "firma.com"
