"""Queries over search, retrieval, profiling, evaluation and experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import evaluate, experiments, profiling, ranking, retrieval, search
from arbelo.operators.tables import dealt, materialize
from arbelo.plans.name_queries import _GRAMS, EMAIL
from arbelo.plans.tables import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", X.normalise_name(F.col("p_name")).alias("nome"), F.col("p_partkey").alias("ordem"))


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as a careless writer types them: without their third letter."""
    n = X.normalise_name(F.col("p_name"))
    return table(spark, sf_dir, "part", F.concat(F.substring(n, 1, 2), F.substring(n, 4, 100)).alias("query")).distinct().select(F.col("query").alias("q"), "query")


_SEARCH = f"""
    {_GRAMS}, qs AS (SELECT DISTINCT substr(n, 1, 2) || substr(n, 4) AS q FROM n),
    qg AS (SELECT q, gram, count(*) AS c FROM (SELECT q, unnest([substr(' ' || replace(q, ' ', '') || ' ', i::INT, 2) FOR i IN range(1, length(replace(q, ' ', '')) + 2)]) AS gram FROM qs) GROUP BY 1, 2),
    qsz AS (SELECT q, sum(c) AS s FROM qg GROUP BY 1),
    qd AS (SELECT qg.q, g.n, 2.0 * sum(least(qg.c, g.c)) / (any_value(qsz.s) + any_value(sz.s)) AS d FROM qg JOIN g USING (gram) JOIN qsz ON qsz.q = qg.q JOIN sz ON sz.n = g.n GROUP BY 1, 2),
    qsim AS (SELECT q, n, CASE WHEN q = n THEN 1.0 ELSE greatest(d, len(list_intersect(string_split(q, ' '), string_split(n, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(q, ' '), string_split(n, ' '))))) END AS s FROM qd),
    ord AS (SELECT array_to_string(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) > 1), ' ') AS n, min(p_partkey) AS ordem FROM part GROUP BY 1)"""


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_names(_noisy(spark, sf_dir), _names(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


SEARCH_TOPK = f"""
    WITH {_SEARCH}, sc AS (SELECT q, n, ordem, floor(s * 100 + 0.5) / 100 AS score FROM qsim JOIN ord USING (n) WHERE floor(s * 100 + 0.5) / 100 >= 0.40),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ordem) AS rank FROM sc QUALIFY rank <= 5),
    t AS (SELECT q, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) < 0.05 AS e FROM r GROUP BY 1)
    SELECT q, n AS nome, ordem, score, rank, coalesce(e, false) AS empate FROM r JOIN t USING (q)"""


def incomplete_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last words of names and how many names hold them: more than one makes a query ambiguous."""
    names = _names(spark, sf_dir)
    asked = names.select(F.element_at(F.split("nome", " "), -1).alias("q")).distinct().withColumn("query", F.col("q"))
    found = search.contained(asked, names)
    return found.groupBy("q").agg(F.count(F.lit(1)).alias("serve_para"), F.max(F.col("q") == F.col("nome")).alias("exato")).select("q", "serve_para", ((F.col("serve_para") > 1) & ~F.col("exato")).alias("ambiguo"))


INCOMPLETE_NAME = f"""
    WITH {_GRAMS}, q AS (SELECT DISTINCT string_split(n, ' ')[-1] AS q FROM n)
    SELECT q, count(*) AS serve_para, count(*) > 1 AND NOT bool_or(q = n) AS ambiguo FROM q JOIN n ON list_contains(string_split(n, ' '), q) GROUP BY 1"""


def margin_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.link_by_margin(_noisy(spark, sf_dir), _names(spark, sf_dir))
    return found.select("q", "nome", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "ligado")


MARGIN_LINK = f"""
    WITH {_SEARCH}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS k FROM qsim),
    b AS (SELECT q, any_value(n) FILTER (k = 1) AS nome, max(s) FILTER (k = 1) AS s1, coalesce(max(s) FILTER (k = 2), 0) AS s2 FROM r GROUP BY 1)
    SELECT q, nome, round(s1, 6) AS s1, round(s2, 6) AS s2, s1 >= 0.72 AND s1 - s2 >= 0.08 AS ligado FROM b"""


def pending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name, the pending queries that may mean it."""
    found = search.pending(_noisy(spark, sf_dir), _names(spark, sf_dir))
    return found.groupBy("candidato").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("primeiro"))


PENDING_CANDIDATES = f"""
    WITH {_SEARCH}, r AS (SELECT q, n FROM qsim WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 3)
    SELECT n AS candidato, count(*) AS n, min(q) AS primeiro FROM r GROUP BY 1"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    asked = table(spark, sf_dir, "benchmark", F.col("item_id").alias("q"), F.col("text").alias("query"))
    return retrieval.bm25_top(table(spark, sf_dir, "documents", "doc_id", "text"), asked).select("q", "doc", "score", F.col("rank").cast("long").alias("rank"))


_TERMS = "list_transform(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9@.]+'), lambda x: length(x) > 1), lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END)"
BM25_TOPK = f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), z AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d),
    p AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS t FROM d), tf AS (SELECT t, doc_id, l, count(*) AS f FROM p GROUP BY 1, 2, 3), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT item_id AS q, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
    s AS (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM q JOIN tf USING (t) JOIN df USING (t), z GROUP BY 1, 2)
    SELECT q, doc_id AS doc, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20"""


def _profiled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return {
        "customer": table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
        "orders": table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", day("o_orderdate"), F.format_string("%.2f", "o_totalprice").alias("o_totalprice")),
        "part": table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"),
        "supplier": table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"),
        "nation": table(spark, sf_dir, "nation", "n_nationkey", "n_name"),
        "users": table(spark, sf_dir, "events", "user_id", "event_type"),
    }


_CELLS = """
    cells AS (
        SELECT 'customer' AS source, unnest(['c_custkey', 'c_name', 'c_mktsegment', 'c_nationkey']) AS col, unnest([c_custkey::VARCHAR, c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer
        UNION ALL SELECT 'orders', unnest(['o_orderkey', 'o_custkey', 'o_orderpriority', 'o_orderdate', 'o_totalprice']), unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), printf('%.2f', o_totalprice)]) FROM orders
        UNION ALL SELECT 'part', unnest(['p_partkey', 'p_name', 'p_brand', 'p_type']), unnest([p_partkey::VARCHAR, p_name, p_brand, p_type]) FROM part
        UNION ALL SELECT 'supplier', unnest(['s_suppkey', 's_name', 's_nationkey']), unnest([s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR]) FROM supplier
        UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name']), unnest([n_nationkey::VARCHAR, n_name]) FROM nation
        UNION ALL SELECT 'users', unnest(['user_id', 'event_type']), unnest([user_id::VARCHAR, event_type]) FROM events),
    st AS (SELECT source, col, count(*) AS registros, count(*) FILTER (value <> '') AS cheios, count(DISTINCT nullif(value, '')) AS distintos, max(length(value)) AS maior, avg(length(value)) FILTER (value <> '') AS media,
        avg((regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'))::INT) AS fdata, avg(regexp_full_match(value, '-?[0-9]+')::INT) AS fint,
        avg((regexp_full_match(value, '(R\\$\\s?)?-?([0-9]{1,3}(\\.[0-9]{3})+|[0-9]+)(,[0-9]{1,2})?') OR regexp_full_match(value, '(R\\$\\s?)?-?[0-9]+\\.[0-9]{1,2}'))::INT) AS fval, avg(regexp_matches(value, '[.,][0-9]{2}$')::INT) AS fdec,
        avg((regexp_full_match(value, '[A-Za-z][A-Za-z0-9 .&''-]+') AND contains(value, ' ') AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 0.6 * length(value))::INT) AS fnome, avg(regexp_full_match(value, '[A-Za-z0-9._/-]{1,20}')::INT) AS fcod
        FROM cells GROUP BY 1, 2),
    ty AS (SELECT *, CASE WHEN cheios = 0 THEN 'vazia' WHEN fdata >= 0.8 THEN 'data' WHEN fint >= 0.95 AND distintos >= 0.98 * cheios THEN 'id' WHEN fval >= 0.9 AND fdec >= 0.5 THEN 'valor' WHEN fint >= 0.95 THEN 'numero'
        WHEN distintos >= 0.98 * cheios AND maior <= 16 THEN 'id' WHEN distintos <= greatest(12, cheios * 0.02) AND media < 30 THEN 'categoria' WHEN media > 80 THEN 'texto' WHEN fnome >= 0.7 THEN 'nome' WHEN fcod >= 0.95 AND distintos >= 5 THEN 'codigo' ELSE 'outro' END AS tipo FROM st)"""


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profiling.column_stats(profiling.column_values(_profiled(spark, sf_dir)))
    return stats.select("source", "col", "registros", "preenchida", "distintos", "repetidos", "tipo")


COLUMN_PROFILE = f"WITH {_CELLS} SELECT source, col, registros, floor(1000.0 * cheios / registros + 0.5) / 10 AS preenchida, distintos, cheios - distintos AS repetidos, tipo FROM ty"


def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = materialize(profiling.column_values(_profiled(spark, sf_dir)), "values")
    sets = materialize(profiling.comparable(values, materialize(profiling.column_stats(values), "stats")), "sets")
    return profiling.links(sets, ("id", "numero", "codigo"))


LINK_DISCOVERY = f"""
    WITH {_CELLS}, s AS (SELECT DISTINCT source, col, tipo, value FROM cells JOIN ty USING (source, col) WHERE tipo IN ('id', 'numero', 'codigo') AND value <> ''),
    z AS (SELECT source, col, count(*) AS n FROM s GROUP BY 1, 2),
    c AS (SELECT a.source AS sa, a.col AS ca, b.source AS sb, b.col AS cb, a.tipo, count(*) AS k FROM s a JOIN s b ON a.tipo = b.tipo AND a.value = b.value AND a.source < b.source GROUP BY ALL)
    SELECT sa || '::' || ca AS a, sb || '::' || cb AS b, tipo AS chave, k AS em_comum, floor(1000.0 * k / x.n + 0.5) / 10 AS cobertura_a, floor(1000.0 * k / y.n + 0.5) / 10 AS cobertura_b
    FROM c JOIN z x ON x.source = sa AND x.col = ca JOIN z y ON y.source = sb AND y.col = cb"""


def inclusion_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = materialize(profiling.column_values(_profiled(spark, sf_dir)), "values")
    stats = materialize(profiling.column_stats(values), "stats")
    return profiling.foreign_keys(materialize(profiling.comparable(values, stats), "sets"), stats)


INCLUSION_DEPS = f"""
    WITH {_CELLS}, s AS (SELECT DISTINCT source, col, tipo, value FROM cells JOIN ty USING (source, col) WHERE tipo IN ('id', 'numero', 'codigo') AND value <> ''),
    z AS (SELECT source, col, count(*) AS n FROM s GROUP BY 1, 2),
    k AS (SELECT source, col FROM ty WHERE tipo IN ('id', 'numero') AND cheios = distintos AND cheios > 0.95 * registros),
    i AS (SELECT a.source AS sa, a.col AS ca, b.source AS sb, b.col AS cb, count(*) AS d FROM s a JOIN s b ON a.value = b.value AND a.source <> b.source JOIN k ON k.source = b.source AND k.col = b.col GROUP BY ALL)
    SELECT sa || '::' || ca AS coluna, sb || '::' || cb AS aponta_para, n AS distintos, n - d AS orfaos FROM i JOIN z ON z.source = sa AND z.col = ca WHERE n >= 5 AND d >= 0.9 * n"""


def copy_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of same-typed fields across keys: order status with line status, and customer with supplier nations."""
    lines = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_linenumber", "l_partkey")
    # the status comes last in the order, so that lines of one number and part give the same result in every run
    last = profiling.last_per_key(lines.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_linestatus")), "o_orderkey", "o")
    a = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").join(last, "o_orderkey")
    b = table(spark, sf_dir, "customer", F.col("c_custkey").alias("k"), "c_nationkey").join(table(spark, sf_dir, "supplier", F.col("s_suppkey").alias("k"), "s_nationkey"), "k")
    c = table(spark, sf_dir, "documents", F.lower("text").alias("a"), F.upper("text").alias("b"))
    rows = [profiling.agreement(p, x, y, kind).select(F.lit(n).alias("campo"), "pares", "iguais", "identicos", "copia") for n, p, x, y, kind in (("status", a, "o_orderstatus", "l_linestatus", "codigo"), ("nation", b, "c_nationkey", "s_nationkey", "codigo"), ("text", c, "a", "b", "texto"))]
    return reduce(DataFrame.unionByName, rows)


COPY_DETECTION = """
    WITH l AS (SELECT l_orderkey, l_linestatus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1),
    p AS (SELECT 'status' AS campo, count(*) AS pares, count(*) FILTER (o_orderstatus = l_linestatus) AS iguais FROM orders JOIN l ON l_orderkey = o_orderkey
        UNION ALL SELECT 'nation', count(*), count(*) FILTER (c_nationkey = s_nationkey) FROM customer JOIN supplier ON s_suppkey = c_custkey
        UNION ALL SELECT 'text', count(*) FILTER (text <> ''), count(*) FILTER (text <> '') FROM documents)
    SELECT campo, pares, iguais, CASE WHEN pares = 0 THEN 0.0 ELSE floor(1000.0 * iguais / pares + 0.5) / 10 END AS identicos, pares >= 10 AND iguais >= 0.7 * pares AS copia FROM p"""


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source that cite an e-mail of src0's documents, hold the first words of a benchmark item, or neither."""
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text", "source")
    keys = docs.filter("source = 'src0'").select(F.lit("email").alias("tipo"), F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("v")).select("tipo", F.lower("v").alias("v"))
    names = table(spark, sf_dir, "benchmark", F.array_join(F.slice(F.split(X.normalise_name(F.col("text")), " "), 1, 4), " ").alias("nome"))
    linked = profiling.document_links(docs, keys, names)
    return docs.join(linked, "doc").groupBy("source").agg(F.count(F.lit(1)).alias("documentos"), F.count_if("by_key").alias("por_chave"), F.count_if("by_name").alias("por_nome")).withColumn("sem_ligacao", F.col("documentos") - F.col("por_chave") - F.col("por_nome"))


_WORDS = "list_filter(string_split_regex(regexp_replace(upper(strip_accents(replace(text, 'ß', 'SS'))), '[^A-Z0-9 ]+', ' ', 'g'), ' +'), lambda x: length(x) > 1 AND x NOT IN ('LTDA','ME','EPP','EIRELI','SA','COMERCIO','COM','SERVICOS','DISTRIBUICAO','DIST','ALIMENTOS','DE','DA','DO','DAS','DOS','E','SHOP','PETISCARIA'))"
DOC_LINKS = f"""
    WITH ab(k, v) AS (VALUES ('MERC','MERCADO'),('SUPERM','SUPERMERCADO'),('PAD','PADARIA'),('FARM','FARMACIA'),('REST','RESTAURANTE'),('LANCH','LANCHONETE'),('ACOUG','ACOUGUE'),('HORTI','HORTIFRUTI'),('EMP','EMPORIO'),('DROG','DROGARIA'),('CONV','CONVENIENCIA'),('POUS','POUSADA')),
    e AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{EMAIL.replace("'", "''")}')) AS e FROM documents),
    bk AS (SELECT DISTINCT doc_id FROM e WHERE lower(e) IN (SELECT lower(e) FROM e WHERE source = 'src0')),
    nm AS (SELECT DISTINCT ' ' || array_to_string(({_WORDS})[1:4], ' ') || ' ' AS nome FROM benchmark WHERE length(array_to_string(({_WORDS})[1:4], ' ')) >= 6),
    dt AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents),
    bn AS (SELECT DISTINCT doc_id FROM dt JOIN nm ON contains(t, nome))
    SELECT source, count(*) AS documentos, count(*) FILTER (doc_id IN (SELECT doc_id FROM bk)) AS por_chave, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM bk) AND doc_id IN (SELECT doc_id FROM bn)) AS por_nome,
           count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM bk) AND doc_id NOT IN (SELECT doc_id FROM bn)) AS sem_ligacao FROM documents GROUP BY 1"""


def doc_links_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source that cite an e-mail of the conversations, hold four neighbouring words of a benchmark item (all of one that has fewer), or neither."""
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text", "source")
    keys = table(spark, sf_dir, "conversations", F.lit("email").alias("tipo"), F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("v")).select("tipo", F.lower("v").alias("v"))
    words = table(spark, sf_dir, "benchmark", F.split(X.normalise_name(F.col("text")), " ").alias("w"))
    names = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(4)), " "))).alias("nome"))
    linked = profiling.document_links(docs, keys, names)
    return docs.join(linked, "doc").groupBy("source").agg(F.count(F.lit(1)).alias("documentos"), F.count_if("by_key").alias("por_chave"), F.count_if("by_name").alias("por_nome")).withColumn("sem_ligacao", F.col("documentos") - F.col("por_chave") - F.col("por_nome"))


DOC_LINKS_WHOLE = DOC_LINKS.replace("(SELECT lower(e) FROM e WHERE source = 'src0')", f"(SELECT lower(unnest(regexp_extract_all(text, '{EMAIL.replace("'", "''")}'))) FROM conversations)").replace(
    f"SELECT DISTINCT ' ' || array_to_string(({_WORDS})[1:4], ' ') || ' ' AS nome FROM benchmark WHERE length(array_to_string(({_WORDS})[1:4], ' ')) >= 6",
    f"SELECT DISTINCT ' ' || nome || ' ' AS nome FROM (SELECT array_to_string(w[i:i + 3], ' ') AS nome FROM (SELECT w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM (SELECT {_WORDS} AS w FROM benchmark))) WHERE length(nome) >= 6",
)


def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of a registry of customers made from the tables: broken and missing ids, shared roots, generic mail, sparse columns."""
    k = F.col("c_custkey")
    base = F.concat(F.lpad(F.floor(k / 2).cast("string"), 8, "0"), F.lpad((k % 2 + 1).cast("string"), 4, "0"))
    dv = X.check_digits(base)
    tax = F.when(k % 17 == 3, F.lit("")).when(k % 11 == 5, F.concat(base, F.lit("00"))).otherwise(F.concat(base, dv))
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.when(k % 5 == 0, "@gmail.com").otherwise("@firma.com.br"))
    registry = dealt(table(spark, sf_dir, "customer", "c_custkey", "c_name")).select("c_custkey", tax.alias("documento"), mail.alias("mail"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("extra"))
    values = materialize(profiling.column_values({"registry": registry}), "values")
    stats = materialize(profiling.column_stats(values), "stats")
    return profiling.column_risks(stats, profiling.column_extras({"registry": registry}, values, stats)).withColumn("ordem", F.col("ordem").cast("long"))


RISK_RANKING = """
    WITH b AS (SELECT c_custkey AS k, lpad((c_custkey // 2)::VARCHAR, 8, '0') || lpad((c_custkey % 2 + 1)::VARCHAR, 4, '0') AS base FROM customer),
    d AS (SELECT k, base, [substr(base, i::INT, 1)::INT FOR i IN range(1, 13)] AS x FROM b),
    s AS (SELECT *, list_sum(list_transform(list_zip(x, [5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r1 FROM d),
    f AS (SELECT *, CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AS d1 FROM s),
    g AS (SELECT *, list_sum(list_transform(list_zip(list_append(x, d1), [6,5,4,3,2,9,8,7,6,5,4,3,2]), lambda z: z[1] * z[2]))::INT % 11 AS r2 FROM f),
    t AS (SELECT k, CASE WHEN k % 17 = 3 THEN 'none' WHEN k % 11 = 5 AND NOT (d1 = 0 AND r2 < 2) THEN 'bad' ELSE 'ok' END AS c FROM g)
    SELECT 0::BIGINT AS ordem, 'alta' AS gravidade, 'registry::documento' AS onde, 'invalid id' AS regra, count(*) AS n FROM t WHERE c = 'bad' HAVING count(*) > 0
    UNION ALL SELECT 0, 'alta', 'registry::documento', 'missing id', count(*) FROM t WHERE c = 'none' HAVING count(*) > 0
    UNION ALL SELECT 0, 'alta', 'registry::documento', 'branch groups', count(*) FROM (SELECT k // 2 FROM t WHERE c = 'ok' GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 1, 'media', 'registry::mail', 'generic mail', count(*) FROM customer WHERE c_custkey % 5 = 0 HAVING count(*) > 0
    UNION ALL SELECT 2, 'baixa', 'registry::extra', 'sparse column', count(*) FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", F.md5("text").alias("pred"), "source")


def pair_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal texts against the sources."""
    s = evaluate.pair_scores(_clusters(spark, sf_dir), "pred", "source")
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("vp", "pp", "pv")], *[F.round(c, 9).alias(c) for c in ("precisao", "revocacao", "f1")])


PAIR_PRF = """
    WITH c AS (SELECT md5(text) AS p, source AS t, count(*) AS n FROM documents GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM c) AS vp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS pp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM c GROUP BY t)) AS pv)
    SELECT vp::BIGINT AS vp, pp::BIGINT AS pp, pv::BIGINT AS pv, round(vp / pp, 9) AS precisao, round(vp / pv, 9) AS revocacao, round(2 * (vp / pp) * (vp / pv) / (vp / pp + vp / pv), 9) AS f1 FROM s"""


def mention_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents right, wrong and loose when each cluster of equal texts belongs to its commonest source; texts of one word are loose."""
    both = _clusters(spark, sf_dir).unionByName(table(spark, sf_dir, "benchmark", F.lit(None).cast("string").alias("pred"), F.lit("benchmark").alias("source")))
    return evaluate.outcomes(both, "pred", "source")


MENTION_OUTCOMES = """
    WITH c AS (SELECT md5(text) AS p, source AS t, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT p, t AS dono FROM c QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, t) = 1)
    SELECT sum(n)::BIGINT + (SELECT count(*) FROM benchmark) AS total, sum(n) FILTER (t = dono)::BIGINT AS certas, coalesce(sum(n) FILTER (t <> dono), 0)::BIGINT AS erradas, (SELECT count(*) FROM benchmark) AS soltas FROM c JOIN o USING (p)"""


def cluster_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.splits(_clusters(spark, sf_dir), "pred", "source")


CLUSTER_SPLITS = """
    WITH c AS (SELECT DISTINCT md5(text) AS p, source AS t FROM documents)
    SELECT 'merged' AS kind, p AS id, count(*) AS n FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'split', t, count(*) FROM c GROUP BY 2 HAVING count(*) > 1"""


def bench_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: rows, range and upper median of the value."""
    events = table(spark, sf_dir, "events", "event_type", "value")
    ends = events.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("menor"), F.max("value").alias("maior"))
    return ends.join(ranking.upper_median(events, ["event_type"], "value", 0.5), "event_type")


BENCH_AGG = """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, any_value(n) AS n, min(value) AS menor, max(value) AS maior, max(value) FILTER (i = n // 2) AS mediana FROM r GROUP BY 1"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th order of each priority, in the order of keys: the sampling operator itself."""
    rows = ranking.numbered(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 10_000.0)
    return rows.filter("n % 50 = 1").select("o_orderkey", "o_orderpriority", "n")


STRATIFIED_SAMPLE = "SELECT o_orderkey, o_orderpriority, n FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n % 50 = 1"


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the dearest order beats that of every earlier day: one row per day is left before the window."""
    days = table(spark, sf_dir, "orders", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dia"), "o_totalprice").groupBy("dia").agg(F.max("o_totalprice").alias("maior"))
    before = F.max("maior").over(Window.orderBy("dia").rowsBetween(Window.unboundedPreceding, -1))
    return days.withColumn("antes", before).filter("antes is null or maior > antes").select("dia", "maior")


PARETO_FRONT = """
    WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS dia, max(o_totalprice) AS maior FROM orders GROUP BY 1)
    SELECT dia, maior FROM (SELECT *, max(maior) OVER (ORDER BY dia ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM d) WHERE a IS NULL OR maior > a"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v")).filter("o_orderstatus in ('O', 'F')")
    return o.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("v"))).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("v"))).alias("b")).filter("a is not null and b is not null")


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open against finished totals of each customer: pairs, mean difference, wins, ties, losses."""
    return experiments.paired_summary(_paired(spark, sf_dir), "a", "b").withColumn("media", F.round("media", 4))


PAIRED_DIFF = """
    WITH p AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END) AS b FROM orders GROUP BY 1)
    SELECT count(*) AS n, round((sum(a - b))::DOUBLE / count(*), 4) AS media, count(*) FILTER (a > b) AS vitorias, count(*) FILTER (a = b) AS empates, count(*) FILTER (a < b) AS derrotas FROM p WHERE a IS NOT NULL AND b IS NOT NULL"""


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.paired_bootstrap(_paired(spark, sf_dir), "o_custkey", "a", "b")


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.wilcoxon(_paired(spark, sf_dir), "a", "b", 10_000.0)


WILCOXON = """
    WITH p AS (SELECT (sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END) - sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END))::DOUBLE AS d FROM orders GROUP BY o_custkey),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM p WHERE d IS NOT NULL AND d <> 0)
    SELECT count(*) AS n, sum(k) FILTER (d > 0) AS w, round((sum(k) FILTER (d > 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2.0 * count(*) + 1) / 24.0), 6) AS z FROM r"""

QUERIES = {
    f.__name__: f
    for f in (
        search_topk, incomplete_name, margin_link, pending_candidates, bm25_topk, column_profile, link_discovery, inclusion_deps, copy_detection, doc_links, doc_links_whole, risk_ranking,
        pair_prf, mention_outcomes, cluster_splits, bench_agg, stratified_sample, pareto_front, paired_diff, paired_bootstrap, wilcoxon,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
