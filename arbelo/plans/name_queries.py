"""Queries over names, ids and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import resolve, search
from arbelo.operators.tables import materialize
from arbelo.plans.tables import table


def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", F.lit("part").alias("src"), F.col("p_partkey").cast("long").alias("k"), F.concat(F.lit("MERC. "), "p_name", F.lit(" Comércio Ltda ")).alias("name"))
    nation = table(spark, sf_dir, "nation", F.lit("nation").alias("src"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return part.unionByName(nation).select("src", "k", X.normalise_name(F.col("name")).alias("norm"), X.normalise_text(F.col("name")).alias("plain"))


NORM_NAME = """
    WITH n AS (SELECT 'part' AS src, p_partkey::BIGINT AS k, 'MERC. ' || p_name || ' Comércio Ltda ' AS name FROM part UNION ALL SELECT 'nation', n_nationkey::BIGINT, n_name FROM nation),
    t AS (SELECT src, k, regexp_replace(upper(strip_accents(name)), '[^A-Z0-9 ]+', ' ', 'g') AS s, regexp_replace(upper(strip_accents(name)), '[^A-Z0-9]+', ' ', 'g') AS p FROM n),
    w AS (SELECT src, k, p, list_transform(list_filter(string_split(s, ' '), lambda x: x <> ''), lambda x: CASE WHEN x = 'MERC' THEN 'MERCADO' ELSE x END) AS l FROM t)
    SELECT src, k, array_to_string(list_filter(l, lambda x: length(x) > 1 AND x NOT IN ('LTDA', 'COMERCIO', 'COM', 'ME', 'DE', 'DA', 'DO', 'E')), ' ') AS norm, trim(p) AS plain FROM w"""


def mask_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [("customer", "c_name"), ("supplier", "s_name"), ("part", "p_brand")]
    parts = [table(spark, sf_dir, t, F.lit(c).alias("col"), X.mask(F.col(c)).alias("mask")) for t, c in cols]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("col", "mask").agg(F.count(F.lit(1)).alias("n"))


MASK_FORMATS = """
    SELECT col, regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS mask, count(*) AS n
    FROM (SELECT 'c_name' AS col, c_name AS v FROM customer UNION ALL SELECT 's_name', s_name FROM supplier UNION ALL SELECT 'p_brand', p_brand FROM part) GROUP BY 1, 2"""


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids built from customer keys: check digits, their validity, and that of one wrong last digit."""
    base = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("0001"))
    rows = table(spark, sf_dir, "customer", "c_custkey", base.alias("base")).withColumn("dv", X.check_digits(F.col("base")))
    full = F.concat("base", "dv")
    wrong = F.concat(F.substring(full, 1, 13), ((F.substring(full, 14, 1).cast("int") + 1) % 10).cast("string"))
    return rows.select("c_custkey", "dv", X.valid_tax_id(full).alias("valid"), X.valid_tax_id(wrong).alias("valid_wrong"))


CHECK_DIGITS = """
    WITH b AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') || '0001' AS base FROM customer),
    d AS (SELECT c_custkey, base, [substr(base, i::INT, 1)::INT FOR i IN range(1, 13)] AS x FROM b),
    s AS (SELECT *, list_sum(list_transform(list_zip(x, [5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r1 FROM d),
    f AS (SELECT *, CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AS d1 FROM s),
    g AS (SELECT *, list_sum(list_transform(list_zip(list_append(x, d1), [6,5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r2 FROM f)
    SELECT c_custkey, d1::VARCHAR || (CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END)::VARCHAR AS dv, true AS valid, false AS valid_wrong FROM g"""


def hamming_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part keys, as four digits, that differ in one place: neighbours are generated and met by an equi-join."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    near = table(spark, sf_dir, "supplier", "s_suppkey", F.explode(X.one_digit_neighbours(pad("s_suppkey"))).alias("k"))
    return near.join(table(spark, sf_dir, "part", "p_partkey", pad("p_partkey").alias("k")), "k").select("s_suppkey", "p_partkey")


HAMMING_ONE = """
    SELECT s_suppkey, p_partkey FROM supplier, part
    WHERE hamming(lpad(s_suppkey::VARCHAR, 6, '0'), lpad(p_partkey::VARCHAR, 6, '0')) = 1"""


def _name_pairs(spark: SparkSession, sf_dir: str, measure: str, floor: float) -> DataFrame:
    """Pairs of distinct part names that can reach the floor.

    Dice and Jaccard need a shared bigram; the others do not: names meet in
    salted blocks, and what a pair can reach at most is compared with the floor.
    """
    names = table(spark, sf_dir, "part", X.normalise_name(F.col("p_name")).alias("n")).distinct()
    a, b = names.select(F.col("n").alias("a")), names.select(F.col("n").alias("b"))
    if measure in ("dice", "jaccard"):
        grams = lambda side, c: side.select(c, F.explode(F.array_distinct(X.bigrams(F.col(c)))).alias("g"))
        return grams(a, "a").join(grams(b, "b"), "g").filter("a < b").select("a", "b").distinct()
    most = X.jaro_winkler_most if measure == "jw" else X.lev_ratio_most
    return search.crossed(a, b).filter("a < b").filter(most(F.col("a"), F.col("b")) >= floor - 1e-9)


_GRAMS = """
    n AS (SELECT DISTINCT array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) > 1), ' ') AS n FROM part),
    g AS (SELECT n, gram, count(*) AS c FROM (SELECT n, unnest([substr(' ' || replace(n, ' ', '') || ' ', i::INT, 2) FOR i IN range(1, length(replace(n, ' ', '')) + 2)]) AS gram FROM n) GROUP BY 1, 2),
    sz AS (SELECT n, sum(c) AS s FROM g GROUP BY 1),
    p AS (SELECT x.n AS a, y.n AS b FROM n x, n y WHERE x.n < y.n),
    dc AS (SELECT x.n AS a, y.n AS b, 2.0 * sum(least(x.c, y.c)) / (any_value(sx.s) + any_value(sy.s)) AS dice
           FROM g x JOIN g y USING (gram) JOIN sz sx ON sx.n = x.n JOIN sz sy ON sy.n = y.n GROUP BY 1, 2),
    jc AS (SELECT a, b, len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE
                  / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS jac FROM (SELECT x.n AS a, y.n AS b FROM n x, n y)),
    sim AS (SELECT jc.a, jc.b, CASE WHEN jc.a = jc.b THEN 1.0 ELSE greatest(coalesce(dice, 0), jac) END AS sim FROM jc LEFT JOIN dc ON dc.a = jc.a AND dc.b = jc.b)"""


def _measured(name: str, floor: float = 0.5):
    measure = {"dice": X.dice, "jaccard": X.jaccard, "levratio": X.lev_ratio, "tokensort": X.token_sort_ratio, "jw": X.jaro_winkler}[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = _name_pairs(spark, sf_dir, name, floor).withColumn("v", measure(F.col("a"), F.col("b")))
        return scored.filter(F.col("v") >= floor).select("a", "b", F.round("v", 6).alias("v"))

    query.__name__ = f"name_{name}"
    return query


NAME_DICE = f"WITH {_GRAMS} SELECT a, b, round(dice, 6) AS v FROM dc WHERE a < b AND dice >= 0.5"
NAME_JACCARD = f"WITH {_GRAMS} SELECT a, b, round(jac, 6) AS v FROM jc WHERE a < b AND jac >= 0.3"
NAME_LEVRATIO = f"WITH {_GRAMS} SELECT a, b, round(v, 6) AS v FROM (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS v FROM p) WHERE v >= 0.5"
NAME_TOKENSORT = f"""WITH {_GRAMS} SELECT a, b, round(v, 6) AS v FROM (SELECT a, b, 1 - levenshtein(sa, sb) / greatest(length(sa), length(sb))::DOUBLE AS v
    FROM (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM p)) WHERE v >= 0.75"""


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as 1.234,56 and read again."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.floor(cents / 100)
    shown = F.concat(F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders", "o_orderkey", shown.alias("shown")).withColumn("value", X.money(F.col("shown")))


MONEY_PARSE = """
    WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)
    SELECT o_orderkey, CASE WHEN c >= 100000 THEN (c // 100000)::VARCHAR || '.' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') ELSE (c // 100)::VARCHAR END || ',' || lpad((c % 100)::VARCHAR, 2, '0') AS shown,
           c / 100.0 AS value FROM o"""


def digits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", X.digits(F.col("c_name")).alias("digits"), X.phone_key(F.col("c_name")).alias("key8"), X.phone_digits(F.concat(F.lit("+55 (41) "), F.lpad(F.col("c_custkey").cast("string"), 8, "3"))).alias("phone"))


DIGITS_ONLY = """
    SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 8) AS key8, '41' || lpad(c_custkey::VARCHAR, 8, '3') AS phone FROM customer"""

EMAIL = "[^\\s@\"'<>]+@[^\\s@\"'<>]+\\.[a-zA-Z]{2,}"
PHONE = "\\(?[0-9]{2}\\)?\\s?[0-9]{4,5}[\\s\\-]?[0-9]{4}"


def email_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "documents", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("e"))
    return mails.select(X.company_domain(F.lower("e")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


EMAIL_DOMAIN = f"""
    SELECT CASE WHEN d IN ('gmail.com', 'hotmail.com', 'outlook.com', 'yahoo.com.br', 'yahoo.com', 'uol.com.br', 'bol.com.br') THEN '' ELSE d END AS domain, count(*) AS n
    FROM (SELECT split_part(lower(e), '@', 2) AS d FROM (SELECT unnest(regexp_extract_all(text, '{EMAIL.replace("'", "''")}')) AS e FROM documents)) GROUP BY 1"""


def pii_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)).alias("e"), F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)).alias("p"))
    return rows.select("doc_id", F.size("e").cast("long").alias("emails"), F.size("p").cast("long").alias("phones"), F.lower(F.coalesce(F.get("e", F.lit(0)), F.lit(""))).alias("first_email"), X.digits(F.get("p", F.lit(0))).alias("first_phone"))


PII_EXTRACT = f"""
    SELECT doc_id, len(e)::BIGINT AS emails, len(p)::BIGINT AS phones, lower(coalesce(e[1], '')) AS first_email, regexp_replace(coalesce(p[1], ''), '[^0-9]', '', 'g') AS first_phone
    FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL.replace("'", "''")}') AS e, regexp_extract_all(text, '{PHONE}') AS p FROM documents)"""


def exact_block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to the first one with the same text, met by a hash of the text."""
    rows = table(spark, sf_dir, "documents", F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("key"))
    return resolve.first_in_block(rows, "key").filter("pos <> first").select(F.col("first").alias("a"), F.col("pos").alias("b"))


EXACT_BLOCK_EDGES = "SELECT f AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f <> doc_id"


def _parts(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "part", F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("ref"), X.normalise_name(F.col("p_name")).alias("nome"), F.lit("").alias("cidade"), F.col(key).alias("key"))


def guarded_block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.guarded_edges(_parts(spark, sf_dir, "p_brand"), "key", 0.35).select(F.col("pos_a").alias("a"), F.col("pos_b").alias("b"))


GUARDED_BLOCK_EDGES = f"""
    WITH {_GRAMS}, r AS (SELECT p_partkey AS k, p_brand AS brand, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) > 1), ' ') AS n FROM part)
    SELECT min(x.k) AS a, y.k AS b FROM r x JOIN r y ON x.brand = y.brand AND x.k < y.k JOIN sim ON sim.a = x.n AND sim.b = y.n WHERE sim >= 0.35 GROUP BY y.k"""


def near_identical_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = materialize(resolve.keyed_rows(_parts(spark, sf_dir, "p_type"), [resolve.Rule(resolve.NEAR, F.col("key"), 0.86)]), "keyed")
    found = resolve.earlier_near(keyed, resolve.near_names(keyed, ["rule", "cell"], 0.86))
    return found.select(F.col("pos").alias("b"), "n", "first")


NEAR_IDENTICAL_BLOCK = f"""
    WITH {_GRAMS}, r AS (SELECT p_partkey AS k, p_type AS ty, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) > 1), ' ') AS n FROM part)
    SELECT y.k AS b, count(*) AS n, min(x.k) AS first FROM r x JOIN r y ON x.ty = y.ty AND x.k < y.k JOIN sim ON sim.a = x.n AND sim.b = y.n WHERE sim >= 0.86 GROUP BY y.k"""


def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in four styles from customer keys: each gives the same key and city ("NO" before a word counts as "number")."""
    n = F.col("c_custkey").cast("string")
    styles = F.array(
        F.concat(F.lit("Rua XV de Novembro, "), n, F.lit(" - Centro, São José")), F.concat(F.lit("R. XV de Novembro "), n, F.lit(", São José")),
        F.concat(F.lit("RUA XV DE NOVEMBRO, "), n, F.lit(" - CENTRO - SAO JOSE")), F.concat(F.lit("R. XV de Novembro, "), n, F.lit(" (São José)")),
    )
    rows = table(spark, sf_dir, "customer", "c_custkey", F.posexplode(styles).alias("style", "txt"))
    parsed = rows.withColumn("e", X.address(F.col("txt")))
    return parsed.select("c_custkey", F.col("style").cast("long").alias("style"), F.col("e.chave").alias("chave"), F.col("e.cidade").alias("cidade"))


ADDRESS_KEYS = "SELECT c_custkey, s AS style, 'RUA XV DE VEMBRO, ' || c_custkey::VARCHAR AS chave, 'SAO JOSE' AS cidade FROM customer, range(4) t(s)"

QUERIES = {
    "norm_name": norm_name, "mask_formats": mask_formats, "check_digits": check_digits, "hamming_one": hamming_one,
    "name_dice": _measured("dice"), "name_jaccard": _measured("jaccard", 0.3), "name_levratio": _measured("levratio"), "name_tokensort": _measured("tokensort", 0.75), "name_jw": _measured("jw"),
    "money_parse": money_parse, "digits_only": digits_only, "email_domain": email_domain, "pii_extract": pii_extract, "address_keys": address_keys,
    "exact_block_edges": exact_block_edges, "guarded_block_edges": guarded_block_edges, "near_identical_block": near_identical_block,
}
ORACLE_SQL = {
    "norm_name": NORM_NAME, "mask_formats": MASK_FORMATS, "check_digits": CHECK_DIGITS, "hamming_one": HAMMING_ONE,
    "name_dice": NAME_DICE, "name_jaccard": NAME_JACCARD, "name_levratio": NAME_LEVRATIO, "name_tokensort": NAME_TOKENSORT,
    "money_parse": MONEY_PARSE, "digits_only": DIGITS_ONLY, "email_domain": EMAIL_DOMAIN, "pii_extract": PII_EXTRACT, "address_keys": ADDRESS_KEYS,
    "exact_block_edges": EXACT_BLOCK_EDGES, "guarded_block_edges": GUARDED_BLOCK_EDGES, "near_identical_block": NEAR_IDENTICAL_BLOCK,
}
