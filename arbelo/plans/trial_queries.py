"""Queries over models of designed experiments, answers, errors, traps, noise and leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import noise
from arbelo.operators import access, benchmark, evaluate, experiments, models, ranking
from arbelo.plans.study_queries import _clusters, _names, _paired
from arbelo.plans.tables import table


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines and those sent back."""
    lines = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("y"))
    return lines.join(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")


_RETURNS = """
    r AS (SELECT l_orderkey AS k, count(*) AS m, count(*) FILTER (l_returnflag = 'R') AS y FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderpriority AS p, count(*) AS n, sum(y)::DOUBLE AS y, sum(m)::DOUBLE AS m, sum(y * y / m::DOUBLE) AS yy FROM r JOIN orders ON k = o_orderkey GROUP BY 1),
    t AS (SELECT sum(y) AS y, sum(m) AS m, sum(n) - count(*) AS df, count(*) - 1 AS gl, (sum(yy * m / y) - sum(y)) / (sum(n) - count(*)) AS phi FROM c)"""


def poisson_one_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rate of lines sent back depends on the priority."""
    design = models.cells(_returns(spark, sf_dir), ["o_orderpriority"], "y", "m")
    return models.term_tests(design, ["o_orderpriority"]).select("termo", "gl", *[F.round(c, 6).alias(c) for c in ("diferenca", "f", "dispersao")])


POISSON_ONE_TERM = f"""
    WITH {_RETURNS}, d AS (SELECT 2 * sum(c.y * ln((c.y / c.m) / (t.y / t.m))) AS dd FROM c, t)
    SELECT 'o_orderpriority' AS termo, gl, round(dd, 6) AS diferenca, round(dd / gl / phi, 6) AS f, round(phi, 6) AS dispersao FROM d, t"""


def poisson_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of lines sent back of each priority against the least one, with 95 % intervals."""
    runs = _returns(spark, sf_dir)
    levels = sorted(r[0] for r in runs.select("o_orderpriority").distinct().collect())
    design = models.cells(runs, ["o_orderpriority"], "y", "m")
    found = models.contrasts(design, ["o_orderpriority"], [("o_orderpriority", levels[0], b) for b in levels[1:]])
    return found.select("de", "para", *[F.round(c, 6).alias(c) for c in ("razao", "ic_inf", "ic_sup")])


POISSON_CONTRASTS = f"""
    WITH {_RETURNS}, a AS (SELECT * FROM c ORDER BY p LIMIT 1),
    s AS (SELECT a.p AS de, c.p AS para, ln((c.y / c.m) / (a.y / a.m)) AS d, 1.96 * sqrt(phi * (1 / a.y + 1 / c.y)) AS w FROM c, a, t WHERE c.p <> a.p)
    SELECT de, para, round(exp(d), 6) AS razao, round(exp(d - w), 6) AS ic_inf, round(exp(d + w), 6) AS ic_sup FROM s"""


def poisson_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority and status together, and their interaction."""
    names = ["o_orderpriority", "o_orderstatus"]
    design = models.cells(_returns(spark, sf_dir), names, "y", "m")
    return models.term_tests(design, names).unionByName(models.interaction_tests(design, names, [tuple(names)]))


def anova_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers by market segment: least squares."""
    design = models.cells(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return models.term_tests(design, ["c_mktsegment"], poisson=False).select("termo", "gl", F.round("diferenca", 2).alias("soma_quadrados"), F.round("f", 6).alias("f"))


ANOVA_TERM = """
    WITH c AS (SELECT count(*) AS n, avg(c_acctbal) AS a, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY c_mktsegment),
    s AS (SELECT sum(n * (a - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS b, sum(w) AS w, sum(n) - count(*) AS df, count(*) - 1 AS gl FROM c)
    SELECT 'c_mktsegment' AS termo, gl, round(b, 2) AS soma_quadrados, round(b / gl / (w / df), 6) AS f FROM s"""


def paired_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.least_effect(_paired(spark, sf_dir), "a", "b").withColumn("mde", F.round("mde", 4))


PAIRED_MDE = """
    WITH p AS (SELECT (sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END) - sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END))::DOUBLE AS d FROM orders GROUP BY o_custkey)
    SELECT count(d) AS n, round(2.8 * stddev_samp(d) / sqrt(count(d)), 4) AS mde FROM p"""


def finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand searches for its cheapest part; equal types and sizes come in once."""
    parts = table(spark, sf_dir, "part", "p_brand", F.col("p_retailprice").alias("preco"), "p_type", F.col("p_size").cast("long").alias("p_size"))
    return experiments.finalists(parts, "p_brand", "preco", ["p_type", "p_size"])


FINALISTS = """
    WITH b AS (SELECT p_brand, p_retailprice AS preco, p_type, p_size::BIGINT AS p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_type, p_size) = 1)
    SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_brand, preco) = 1"""


def exact_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a source are found exactly if no other source has the text; benchmark items are in no cluster."""
    both = _clusters(spark, sf_dir).withColumn("t", F.md5(F.concat_ws(":", "source", "pred")))
    return evaluate.exact_truths(both.unionByName(table(spark, sf_dir, "benchmark", F.lit(None).cast("string").alias("pred"), F.lit("benchmark").alias("source"), F.col("item_id").cast("string").alias("t"))), "pred", "t")


EXACT_TRUTHS = """
    WITH c AS (SELECT DISTINCT md5(text) AS p, source AS t FROM documents), u AS (SELECT p, count(*) AS n FROM c GROUP BY 1)
    SELECT (SELECT count(*) FROM c) + (SELECT count(DISTINCT item_id) FROM benchmark) AS entidades, (SELECT count(*) FROM u WHERE n = 1) AS exatas"""


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under another source than their cluster's commonest, by language; sources of even and odd numbers are groups."""
    both = table(spark, sf_dir, "documents", F.md5("text").alias("pred"), "source", F.coalesce("lang", F.lit("?")).alias("lang"))
    groups = both.select("source").distinct().withColumn("grupo", F.right("source", F.lit(1)).try_cast("int") % 2)
    return evaluate.error_kinds(both, "pred", "source", "lang", groups)


ERROR_KINDS = """
    WITH d AS (SELECT md5(text) AS p, source AS t, coalesce(lang, '?') AS lang FROM documents WHERE text IS NOT NULL),
    o AS (SELECT p, t AS dono FROM (SELECT p, t, count(*) AS n FROM d GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, t) = 1)
    SELECT lang, count(*) AS erros, count(*) FILTER (try_cast(right(t, 1) AS INT) % 2 = try_cast(right(dono, 1) AS INT) % 2) AS mesmo_grupo FROM d JOIN o USING (p) WHERE dono <> t GROUP BY 1"""


def answers_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about each order, some wrong, some missing: its price, whether it is finished, the address of its customer."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    number = F.struct(F.lit("numero").alias("tipo"), F.when(k % 7 != 0, F.translate((price + (k % 3) * F.lit(0.01).cast("decimal(18,2)")).cast("string"), ".", ",")).alias("dada"), price.cast("string").alias("ouro"))
    done = F.struct(F.lit("booleano").alias("tipo"), F.when(k % 5 == 0, "sim").when(k % 2 == 0, "True").otherwise("False").alias("dada"), (F.col("o_orderstatus") == "F").cast("string").alias("ouro"))
    key = F.concat(F.lit("RUA DAS FLORES, "), F.col("o_custkey").cast("string"))
    street = noise.address(k, F.lit("Rua das Flores"), F.col("o_custkey") + F.when(k % 11 == 0, 1).otherwise(0), F.lit("Centro"), F.lit("São José"))
    place = F.struct(F.lit("endereco").alias("tipo"), street.alias("dada"), key.alias("ouro"))
    rows = table(spark, sf_dir, "orders", "o_orderkey", F.explode(F.array(number, done, place)).alias("x"))
    return rows.groupBy("x.tipo").agg(F.count(F.lit(1)).alias("n"), F.count_if(benchmark.is_right(F.col("x.tipo"), F.col("x.dada"), F.col("x.ouro"))).alias("certas"))


ANSWERS_RIGHT = """
    SELECT 'numero' AS tipo, count(*) AS n, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 3 < 2) AS certas FROM orders
    UNION ALL SELECT 'booleano', count(*), count(*) FILTER (o_orderkey % 5 <> 0 AND (o_orderkey % 2 = 0) = (o_orderstatus = 'F')) FROM orders
    UNION ALL SELECT 'endereco', count(*), count(*) FILTER (o_orderkey % 11 <> 0) FROM orders"""


def group_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fit several parts: the words that all parts of a brand and first word share."""
    names = _names(spark, sf_dir).join(table(spark, sf_dir, "part", F.col("p_partkey").alias("ordem"), "p_brand"), "ordem")
    return benchmark.shared_names(names.withColumn("grupo", F.concat_ws(":", "p_brand", F.element_at(F.split("nome", " "), 1))))


GROUP_TRAPS = """
    WITH n AS (SELECT p_partkey AS k, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) > 1), ' ') AS nome, p_brand FROM part),
    g AS (SELECT *, p_brand || ':' || string_split(nome, ' ')[1] AS grupo FROM n),
    h AS (SELECT grupo, count(*) AS unidades, string_split(arg_min(nome, k), ' ') AS w FROM g GROUP BY 1 HAVING count(*) > 1),
    x AS (SELECT grupo, unidades, i, w[i] AS word FROM h, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
    y AS (SELECT x.grupo, unidades, i, word FROM x JOIN g USING (grupo) WHERE contains(nome, word) GROUP BY ALL HAVING count(*) = unidades)
    SELECT grupo, unidades, string_agg(word, ' ' ORDER BY i) AS consulta FROM y GROUP BY 1, 2"""


def shuffle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shuffled(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 7)


SHUFFLE_ORDERS = "SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5('7:' || o_orderkey::VARCHAR), 1, 8), o_orderkey) AS n FROM orders"


def noise_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with one typing error, and a phone in one of four styles."""
    k = F.col("p_partkey")
    digits = F.concat(F.lit("41"), F.lpad(k.cast("string"), 8, "3"))
    return table(spark, sf_dir, "part", "p_partkey", noise.typo(F.col("p_name"), k, k).alias("nome"), noise.phone(k, digits).alias("fone"))


NOISE_FORMATS = """
    WITH p AS (SELECT p_partkey, p_name AS t, (p_partkey % greatest(length(p_name) - 2, 1))::INT + 2 AS i, '41' AS a, substr(lpad(p_partkey::VARCHAR, 8, '3'), 1, 4) AS b, substr(lpad(p_partkey::VARCHAR, 8, '3'), 5, 4) AS c FROM part)
    SELECT p_partkey, CASE WHEN length(t) < 5 THEN t WHEN p_partkey % 3 = 0 THEN substr(t, 1, i - 1) || substr(t, i + 1) WHEN p_partkey % 3 = 1 THEN substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) ELSE substr(t, 1, i) || substr(t, i) END AS nome,
           CASE p_partkey % 4 WHEN 0 THEN '(' || a || ') ' || b || '-' || c WHEN 1 THEN a || b || c WHEN 2 THEN a || ' ' || b || ' ' || c ELSE '+55 ' || a || ' ' || b || c END AS fone FROM p"""


def exclusive_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer words that documents outside src0 hold and that stand in no word of src0, not even as a part."""
    words = table(spark, sf_dir, "documents", "source", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).filter("w <> ''")
    return access.exclusive_inside(words, F.col("source") == "src0", "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


EXCLUSIVE_INSIDE = """
    WITH d AS (SELECT source, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS w FROM documents),
    s AS (SELECT DISTINCT w AS x FROM d WHERE source = 'src0' AND length(w) >= 6), o AS (SELECT w, count(*) AS n FROM d WHERE source <> 'src0' AND length(w) >= 6 GROUP BY 1)
    SELECT w, n FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(x, w))"""

QUERIES = {
    f.__name__: f
    for f in (
        poisson_one_term, poisson_contrasts, poisson_terms, anova_term, paired_mde, finalists, exact_truths, error_kinds, answers_right, group_traps,
        shuffle_orders, noise_formats, exclusive_inside,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
