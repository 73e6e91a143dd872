"""Queries over facts: joins, identities, latest declarations, finance, timelines, the dossier, permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import access, facts, resolve
from arbelo.plans.tables import table

_DEC = "decimal(18,2)"


def _dec(c: str):
    return F.col(c).cast(_DEC)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text, by merges of ordered edges: the smallest id of each cluster."""
    rows = table(spark, sf_dir, "documents", F.col("doc_id").alias("ref"), F.sha2("text", 256).alias("key"))
    edges = resolve.first_in_block(rows.withColumnRenamed("ref", "pos"), "key").filter("pos <> first")
    edges = edges.select(F.lit(1).alias("phase"), F.lit(0).alias("block"), F.col("pos").alias("pos_b"), F.col("first").alias("pos_a"), F.col("first").alias("a"), F.col("pos").alias("b"), F.lit("same text").alias("motivo"), F.lit(1.0).alias("forca"))
    labels, _, _ = resolve.constrained_merge(rows.select("ref", F.lit(None).cast("string").alias("id")), edges)
    least = labels.groupBy("root").agg(F.min("ref").alias("label"))
    return labels.join(least, "root").select(F.col("ref").alias("doc_id"), "label")


COMPONENTS = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS label FROM documents"


def constrained_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and name merge into the first one unless their types differ: merged or refused."""
    rows = table(spark, sf_dir, "part", F.col("p_partkey").alias("ref"), F.concat_ws("|", "p_brand", "p_name").alias("key"), F.col("p_type").alias("id"))
    edges = resolve.first_in_block(rows.withColumnRenamed("ref", "pos"), "key").filter("pos <> first")
    edges = edges.select(F.lit(1).alias("phase"), F.lit(0).alias("block"), F.col("pos").alias("pos_b"), F.col("first").alias("pos_a"), F.col("first").alias("a"), F.col("pos").alias("b"), F.lit("same name").alias("motivo"), F.lit(1.0).alias("forca"))
    _, merges, refused = resolve.constrained_merge(rows.select("ref", "id"), edges)
    return merges.select("a", "b", F.lit(True).alias("merged")).unionByName(refused.select("a", "b", F.lit(False).alias("merged")))


CONSTRAINED_MERGE = """
    WITH p AS (SELECT p_partkey, p_type, first_value(p_partkey) OVER w AS f, first_value(p_type) OVER w AS t FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey))
    SELECT f AS a, p_partkey AS b, p_type = t AS merged FROM p WHERE f <> p_partkey"""


def economic_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose tax ids share their first eight digits (built from the key), and their group."""
    tax = F.concat(F.lpad(F.floor(F.col("c_custkey") / 4).cast("string"), 8, "0"), F.lpad((F.col("c_custkey") % 4).cast("string"), 6, "0"))
    ents = table(spark, sf_dir, "customer", F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("ordem"), F.array(tax).alias("cnpjs"))
    return resolve.economic_groups(ents).select(F.col("id").cast("long").alias("c_custkey"), F.array_join("grupo", ",").alias("grupo"))


ECONOMIC_GROUP = """
    SELECT a.c_custkey, string_agg(b.c_custkey::VARCHAR, ',' ORDER BY b.c_custkey) AS grupo FROM customer a JOIN customer b ON a.c_custkey // 4 = b.c_custkey // 4 AND a.c_custkey <> b.c_custkey GROUP BY 1"""


def facts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines summed per order before they meet orders: the large table is shuffled once, already reduced."""
    lines = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), _dec("l_extendedprice").alias("v")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    joined = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(lines, "o_orderkey")
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.sum("v").cast("double").alias("total"))


FACTS_JOIN = """
    SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


def identity_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    sets = orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))
    return sets.join(facts.mode(orders, "o_custkey", "o_orderpriority", F.col("o_orderpriority")), "o_custkey")


IDENTITY_AGG = """
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    m AS (SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1)
    SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, any_value(m.o_orderpriority) AS o_orderpriority FROM orders JOIN m USING (o_custkey) GROUP BY 1"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("day"), "event_id")
    return facts.latest_wins(events, "user_id", "event_type", "day", "event_id", F.col("event_type") == "error")


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the latest event type, errors counting as copies, against the naive majority."""
    return _latest(spark, sf_dir)


_LATEST = """
    e AS (SELECT user_id, event_type, ts, event_id FROM events),
    own AS (SELECT user_id, event_type AS v FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1),
    al AS (SELECT user_id, event_type AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1),
    ct AS (SELECT user_id, event_type AS m, count(*) AS n, max(ts) AS t FROM e GROUP BY 1, 2),
    mj AS (SELECT user_id, m FROM ct QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t DESC) = 1),
    lw AS (SELECT al.user_id, coalesce(own.v, al.v) AS atual, (SELECT count(DISTINCT event_type) FROM e WHERE e.user_id = al.user_id) AS valores_distintos, m AS maioria_ingenua, m <> coalesce(own.v, al.v) AS maioria_erraria
           FROM al LEFT JOIN own USING (user_id) JOIN mj USING (user_id))"""
LATEST_WINS = f"WITH {_LATEST} SELECT * FROM lw"


def _finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", _dec("o_totalprice").alias("v"), "o_orderstatus")
    contract = table(spark, sf_dir, "customer", F.col("c_custkey").alias("o_custkey"), (F.abs("c_acctbal") * 50).alias("k"))
    return facts.finance(orders, "o_custkey", "v", F.col("o_orderstatus") == "O", contract, "k")


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: orders, open total, mean, deviation from a contract value of fifty balances."""
    f = _finance(spark, sf_dir)
    return f.select("o_custkey", "notas", F.col("total_atrasado").cast("double").alias("total_atrasado"), F.col("media_faturada").cast("double").alias("media_faturada"), F.round("desvio_contrato", 1).alias("desvio_contrato"), facts.diverges(F.col("desvio_contrato")).alias("diverge"))


_FIN = """
    s AS (SELECT o_custkey, count(*) AS notas, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS atr, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS media FROM orders GROUP BY 1),
    f AS (SELECT o_custkey, notas, floor(atr * 100 + 0.5) / 100 AS total_atrasado, floor(media * 100 + 0.5) / 100 AS media_faturada,
                 CASE WHEN c_acctbal <> 0 AND media <> 0 THEN floor((media - abs(c_acctbal) * 50) / (abs(c_acctbal) * 50) * 1000 + 0.5) / 10 END AS desvio_contrato
          FROM s LEFT JOIN customer ON c_custkey = o_custkey)"""
FINANCE = f"WITH {_FIN} SELECT o_custkey, notas, total_atrasado, media_faturada, round(desvio_contrato, 1) AS desvio_contrato, coalesce(abs(desvio_contrato) > 4, false) AS diverge FROM f"


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of divergence by key: more versions than one, deviation from contract, a copy among the declarations."""
    latest, fin = _latest(spark, sf_dir), _finance(spark, sf_dir)
    versions = latest.filter("valores_distintos > 1").select(F.col("user_id").alias("k"), F.lit("versions").alias("campo"), F.col("maioria_erraria").cast("string").alias("detalhe"))
    off = fin.filter(facts.diverges(F.col("desvio_contrato"))).select(F.col("o_custkey").alias("k"), F.lit("contract").alias("campo"), F.when(F.col("desvio_contrato") > 0, "above").otherwise("below").alias("detalhe"))
    copies = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).cast("string").alias("detalhe")).select("k", F.lit("copies").alias("campo"), "detalhe")
    return versions.unionByName(off).unionByName(copies)


DIVERGENCES = f"""
    WITH {_LATEST}, {_FIN}
    SELECT user_id AS k, 'versions' AS campo, maioria_erraria::VARCHAR AS detalhe FROM lw WHERE valores_distintos > 1
    UNION ALL SELECT o_custkey, 'contract', CASE WHEN desvio_contrato > 0 THEN 'above' ELSE 'below' END FROM f WHERE abs(desvio_contrato) > 4
    UNION ALL SELECT user_id, 'copies', count(*)::VARCHAR FROM events WHERE event_type = 'error' GROUP BY 1"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no source knows of a customer: no order, no event."""
    customers = table(spark, sf_dir, "customer", "c_custkey")
    orders = table(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey")).distinct().withColumn("o", F.lit(True))
    events = table(spark, sf_dir, "events", F.col("user_id").alias("c_custkey")).distinct().withColumn("e", F.lit(True))
    both = customers.join(orders, "c_custkey", "left").join(events, "c_custkey", "left")
    found = F.filter(F.array(F.when(F.col("o").isNull(), "no order"), F.when(F.col("e").isNull(), "no event")), lambda x: x.isNotNull())
    return both.select("c_custkey", F.array_join(found, "; ").alias("lacunas")).filter("lacunas <> ''")


GAPS = """
    SELECT c_custkey, concat_ws('; ', CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no order' END,
        CASE WHEN NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 'no event' END) AS lacunas
    FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, shipments and events of a customer as one stream of dated events."""
    orders = table(spark, sf_dir, "orders")
    a = orders.select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("data"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("evento"))
    lines = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    b = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("k")), "o_orderkey").select("k", F.date_format("l_shipdate", "yyyy-MM-dd").alias("data"), F.concat(F.lit("shipment "), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("evento"))
    c = table(spark, sf_dir, "events", F.col("user_id").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("data"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("evento"))
    return facts.timeline([a, b, c])


TIMELINE = """
    SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS data, 'order ' || o_orderkey || ' ' || o_orderstatus AS evento FROM orders
    UNION ALL SELECT o_custkey, strftime(l_shipdate, '%Y-%m-%d'), 'shipment ' || o_orderkey || '/' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'event ' || event_id || ' ' || event_type FROM events"""


def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: identity, latest declaration, finance, gaps; every part is grouped before it is joined."""
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_name")
    fin = _finance(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "notas", F.col("total_atrasado").cast("double").alias("total_atrasado"), F.round("desvio_contrato", 1).alias("desvio_contrato"))
    now = _latest(spark, sf_dir).select(F.col("user_id").alias("c_custkey"), "atual", "valores_distintos", "maioria_erraria")
    joined = customers.join(F.broadcast(nation), "c_nationkey").join(fin, "c_custkey", "left").join(now, "c_custkey", "left")
    gap = F.concat_ws("; ", F.when(F.col("notas").isNull(), "no order"), F.when(F.col("atual").isNull(), "no event"))
    return joined.select("c_custkey", "c_name", "n_name", F.coalesce("notas", F.lit(0)).alias("notas"), F.coalesce("total_atrasado", F.lit(0.0)).alias("total_atrasado"), "desvio_contrato", facts.diverges(F.col("desvio_contrato")).alias("diverge"), F.coalesce("atual", F.lit("")).alias("atual"), F.coalesce("valores_distintos", F.lit(0)).alias("versoes"), F.coalesce("maioria_erraria", F.lit(False)).alias("maioria_erraria"), gap.alias("lacunas"))


DOSSIER = f"""
    WITH {_LATEST}, {_FIN}
    SELECT c_custkey, c_name, n_name, coalesce(notas, 0)::BIGINT AS notas, coalesce(total_atrasado, 0.0) AS total_atrasado, round(desvio_contrato, 1) AS desvio_contrato, coalesce(abs(desvio_contrato) > 4, false) AS diverge,
           coalesce(atual, '') AS atual, coalesce(valores_distintos, 0)::BIGINT AS versoes, coalesce(maioria_erraria, false) AS maioria_erraria,
           concat_ws('; ', CASE WHEN notas IS NULL THEN 'no order' END, CASE WHEN atual IS NULL THEN 'no event' END) AS lacunas
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON o_custkey = c_custkey LEFT JOIN lw ON user_id = c_custkey"""

#: Roles of the events table for the permission queries.
ROLES = {"sales": ["click", "purchase"], "support": ["error"], "audit": ["signup", "view", "click", "error", "purchase"]}


def profile_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role sees of each user: the filter comes first, all else is computed from what is left."""
    events = table(spark, sf_dir, "events", "user_id", "event_type", _dec("value").alias("v"))
    views = [access.visible(events, role, "event_type", ROLES).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total")).select(F.lit(role).alias("role"), "user_id", "n", "total") for role in (*ROLES, "nobody")]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


PROFILE_VIEW = """
    SELECT role, user_id, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
    FROM events JOIN (VALUES ('sales', 'click'), ('sales', 'purchase'), ('support', 'error'), ('audit', 'signup'), ('audit', 'view'), ('audit', 'click'), ('audit', 'error'), ('audit', 'purchase')) r(role, event_type) USING (event_type) GROUP BY 1, 2"""


def hidden_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_type")
    return access.hidden(events, "sales", "user_id", "event_type", ROLES)


HIDDEN_COUNT = "SELECT user_id, count(*) FILTER (event_type IN ('click', 'purchase')) AS visiveis, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS ocultos FROM events GROUP BY 1"


def exclusive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that only documents outside src0 hold: what a reader of src0 must never see."""
    words = table(spark, sf_dir, "documents", "source", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).filter("w <> ''")
    return access.exclusive(words, F.col("source") == "src0", "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


EXCLUSIVE_TOKENS = """
    WITH d AS (SELECT source, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS w FROM documents)
    SELECT w, count(*) AS n FROM d WHERE w <> '' AND w NOT IN (SELECT w FROM d WHERE source = 'src0') GROUP BY 1"""


def denorm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", _dec("o_totalprice").alias("v"))
    joined = orders.join(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", "left")
    return joined.select("o_orderkey", F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "c_name", "o_orderstatus", F.col("v").cast("string")).alias("txt"))


DENORM_TEXT = "SELECT o_orderkey, concat_ws(' ', 'order', o_orderkey::VARCHAR, c_name, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR) AS txt FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", F.from_json("props", "k long")["k"].alias("k"))


FLATTEN_JSON = "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events"


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversation turns that are not blank: the first, the last, how many."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "conversations", "conv_id", "turn", lines.alias("l")).select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("l", F.size("l") - 1), F.lit("")).alias("last"))


TEXT_LINES = """
    SELECT conv_id, turn, len(l)::BIGINT AS n, coalesce(l[1], '') AS first, coalesce(l[-1], '') AS last
    FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)"""

QUERIES = {f.__name__: f for f in (components, constrained_merge, economic_group, facts_join, identity_agg, latest_wins, finance, divergences, gaps, timeline, dossier, profile_view, hidden_count, exclusive_tokens, denorm_text, flatten_json, text_lines)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
