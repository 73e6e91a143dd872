"""Search by name: candidates share what a positive similarity needs (a bigram, or a character for Jaro-Winkler and edit distances), so none is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators import ranking
from arbelo.operators.alike import ALL_PAIRS, scored
from arbelo.operators.tables import materialize


#: Names of a salted block.
BLOCK = 1_000
#: What a score in two digits may be rounded up by, and a little more.
ROUNDING = 0.0051


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows of two tables: each row goes to the salted blocks of one row or column, and each pair meets in one block."""
    m, n = (max(1, -(-side.count() // BLOCK)) for side in (left, right))
    own = lambda side, k: F.pmod(F.xxhash64(*side.columns), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    x = left.select(*left.columns, own(left, m).alias("_i"), every(n).alias("_j"))
    y = right.select(*right.columns, every(m).alias("_i"), own(right, n).alias("_j"))
    return x.join(y, ["_i", "_j"]).drop("_i", "_j")


def candidates(queries: DataFrame, names: DataFrame, sim: str = "max", least: float = 0.0) -> DataFrame:
    """(q, query, nome, s): similarity of every query to every name that shares a bigram or word with it, or, for the measures by characters, a character.

    least: pairs below it are not wanted; queries and names then meet on their rarest bigrams and words only.
    """
    known = names.select("nome").distinct()
    if sim == "max":
        asked = queries.select("q", "query").distinct()
        met = scored(asked.select(F.col("query").alias("name")), known.select(F.col("nome").alias("name")), least)
        return asked.join(met.select(F.col("a").alias("query"), F.col("b").alias("nome"), "s"), "query").select("q", "query", "nome", "s")
    share = F.arrays_overlap(F.split("query", ""), F.split("nome", "")) | (F.col("query") == F.col("nome"))
    pairs = crossed(queries.select("q", "query").distinct(), known).filter(share)
    return pairs.withColumn("s", X.name_similarity(F.col("query"), F.col("nome"), sim))


#: Similarities from which the best names are looked for before the least one that counts.
LEVELS = (0.5,)


def nearest(queries: DataFrame, names: DataFrame, others: DataFrame, n: int, sim: str, least: float) -> DataFrame:
    """(q, id, s): by name, the entities among which the n best of each query (q, query) are, if others (q, id, s) count with them.

    names: id, nome, w (weight of the similarity).  A query that has n entities
    better, in two digits, than a level asks for no less similar names: those
    could not come before them.  Only the other queries go on to the next level.
    """
    levels = [x for x in LEVELS if x > least] if sim == "max" and queries.count() * names.count() > ALL_PAIRS else []
    out = []
    for level in [*levels, least]:
        pairs = candidates(queries, names.select("nome"), sim, level)
        found = pairs.join(names, "nome").groupBy("q", "id").agg(F.max(F.col("s") * F.col("w")).alias("s"))
        if level == least:
            out.append(found)
            break
        found = materialize(found, "found-by-name")
        all_ = others.select("q", "id", "s").unionByName(found.join(others.select("q", "id"), ["q", "id"], "left_anti"))
        settled = materialize(all_.filter(X.round_half_up(F.col("s"), 2) > X.round_half_up(F.lit(level), 2)).groupBy("q").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= n).select("q"), "settled")
        out.append(found.join(settled, "q", "left_semi"))
        queries = materialize(queries.join(settled, "q", "left_anti"), "asked")
        if queries.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def top_names(queries: DataFrame, names: DataFrame, n: int = 5, least: float = 0.40, margin: float = 0.05, sim: str = "max") -> DataFrame:
    """The n best names (nome, ordem) per query: rounded score, rank, and whether the first two are too close to tell."""
    scored = candidates(queries, names, sim, least - ROUNDING).join(names.groupBy("nome").agg(F.min("ordem").alias("ordem")), "nome")
    scored = scored.withColumn("score", X.round_half_up(F.col("s"), 2)).filter(F.col("score") >= least)
    best = ranking.top_k(scored, ["q"], n, F.col("score").desc(), F.col("ordem"))
    firsts = best.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    tie = F.coalesce(F.col("s1") - F.col("s2") < margin, F.lit(False))
    return best.join(firsts.select("q", tie.alias("empate")), "q").select("q", "nome", "ordem", "score", "rank", "empate")


def contained(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(q, nome) of names that hold every token of the query; they meet on the query's rarest token only."""
    asked = queries.select("q", F.array_distinct(F.split("query", " ")).alias("ts"))
    known = materialize(names.select("nome").distinct().select("nome", F.array_distinct(F.split("nome", " ")).alias("held")), "name-tokens")
    posted = known.select("nome", "held", F.explode("held").alias("t"))
    df = posted.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # a token that no name has: the query fits none
    rarest = asked.select("q", "ts", F.explode("ts").alias("t")).join(df, "t", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")).alias("r"), F.first("ts").alias("ts"))
    met = rarest.filter("r.df > 0").select("q", "ts", F.col("r.t").alias("t")).join(posted, "t")
    return met.filter(F.size(F.array_except("ts", "held")) == 0).select("q", "nome")


def link_by_margin(queries: DataFrame, names: DataFrame, least: float = 0.72, margin: float = 0.08, sim: str = "max") -> DataFrame:
    """Per query the best name, linked only if good enough and ahead of the runner-up; else pending."""
    best = ranking.two_best(candidates(queries, names, sim), ["q"], "s", "nome", "nome")
    sure = (F.col("s1") >= least) & (F.col("s1") - F.col("s2") >= margin)
    return best.select("q", "nome", "s1", "s2", sure.alias("ligado"))


def pending(queries: DataFrame, names: DataFrame, least: float = 0.5, most: int = 3, sim: str = "max") -> DataFrame:
    """(q, candidato, rank): up to three names that a pending query may mean."""
    scored = candidates(queries, names, sim, least)
    return ranking.top_k(scored.filter(F.col("s") >= least), ["q"], most, F.col("s").desc(), F.col("nome")).select("q", F.col("nome").alias("candidato"), "rank")
