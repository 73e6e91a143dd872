r"""Exact dedup (operator 7): DataFrame functions only.

Texts are equal when identical after deleting `[\x20\x09-\x0D]`.  A first pass
keeps of every row its key, size, the 128-bit hash of its normalised text and
that text's SHA-256.  Hashes that several rows share are candidates; only the
texts under them move, grouped by hash and by the text itself, so that bytes
are compared inside groups and a hash collision gives two groups.  Each task
sends one row per distinct text, whatever part of all rows are its copies.

Of a group, the row with the most code points in the original text stays, then
the smallest key (null keys last).  Edge cases: null counts as empty, all empty
texts are one group; of rows that repeat the winner's key, text and size exactly
one stays (of rows that differ in other columns or in their blanks only, any
one); an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, free_name, materialize

BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of hashes or keys (some 60 bytes each) that may be broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _small(rows: DataFrame) -> DataFrame:
    """rows to be joined with a large table: broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


def _chars(text: str) -> Column:
    return F.length(F.coalesce(F.col(text), F.lit("")))


def _grouped(docs: DataFrame, key: str, text: str, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows (key, chars, h, sha, copies) and the groups of two or more (h, sha, size, keep, keep_chars)."""
    norm = normalised(text)
    texts = docs.select(F.col(key).alias("key"), _chars(text).alias("chars"), norm.alias("norm")).withColumn("h", hashed(F.col("norm")))
    rows = texts.select("key", "chars", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    rows = materialize(rows.groupBy("key", "chars", "h", "sha").agg(F.count(F.lit(1)).alias("copies")), "exact-rows")
    shared = materialize(rows.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1").select("h"), "exact-shared")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("key").isNull().alias("none"), F.col("key").alias("key")))
    same = texts.join(_small(shared), "h", "left_semi").groupBy("h", "norm").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).filter("size > 1")
    groups = same.select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "size", F.col("best.key").alias("keep"), (-F.col("best.less")).alias("keep_chars"))
    groups = materialize(groups, "exact-groups")
    discard(shared)
    return rows, groups


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = hash128) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row."""
    rows, groups = _grouped(docs, key, text, hashed)
    told = rows.join(_small(groups), ["h", "sha"], "left")
    alone = F.col("size").isNull()
    wins = alone | (F.col("key").eqNullSafe(F.col("keep")) & (F.col("chars") == F.col("keep_chars")))
    each = told.select("*", wins.alias("wins"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("wins") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = hash128) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, groups = _grouped(docs, key, text, hashed)
    told = rows.join(_small(groups), ["h", "sha"])
    wins = F.col("key").eqNullSafe(F.col("keep")) & (F.col("chars") == F.col("keep_chars"))
    lost = materialize(told.filter(~wins).select("h", "sha", "key", "chars"), "exact-lost")
    repeated = materialize(told.filter(wins & (F.col("copies") > 1)).select("h", "sha", "key", "chars"), "exact-repeated")
    h, n, sha = (free_name(docs, c) for c in ("_h", "_n", "_sha"))
    marked = docs.withColumns({h: hashed(normalised(text)), n: _chars(text), sha: F.unhex(F.sha2(normalised(text).cast("binary"), 256))})

    def on(side: DataFrame) -> Column:
        return (marked[h] == side["h"]) & (marked[sha] == side["sha"]) & marked[key].eqNullSafe(side["key"]) & (marked[n] == side["chars"])

    out = marked
    for side in (lost, repeated):
        few = _small(side)
        out = out.join(few, on(few), "left_anti")
    if not repeated.isEmpty():
        some = _small(repeated)
        out = out.unionByName(marked.join(some, on(some), "left_semi").dropDuplicates([h, sha, key, n]))
    return out.drop(h, n, sha)
