r"""Benchmark decontamination (operator 5): Wu-Manber search over words.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.  A pattern
is a window of `window` consecutive item words, or a whole item that has fewer.
Patterns of one length share a table of shifts: a block of two words that ends
no pattern tells how far the search may jump, at most the pattern's length less
one; a shift of 0 leads to a bucket of patterns by their last block, and direct
comparison confirms an occurrence.

Documents are never shuffled.  Items are taken in blocks of at most
`block_words` words, a documented bound on what the driver holds and
broadcasts; with more than one block, documents pass once per block and carry
their hits along, as a table in the shared folder.

Edge cases: null has no words; an item without words has no windows; repeated
items or ids count once per id; a null item id is left out of the id list.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbelo.llm.common import alnum_words, free_name, materialize

WINDOW = 10
#: Item words in a block: the driver and each worker hold the tables of one block, some 700 bytes a word (840 while they are built).
BLOCK_WORDS = 1_000_000


class WuManber:
    """Finds the windows of items in lists of words."""

    def __init__(self, tables: list):
        self.tables = tables

    @staticmethod
    def build(items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> list:
        """The tables of these items, as plain data that can be broadcast."""
        patterns: dict[int, dict[tuple, set]] = {}
        for item_id, words in items:
            if words:
                n = min(window, len(words))
                own = patterns.setdefault(n, {})
                for i in range(len(words) - n + 1):
                    own.setdefault(tuple(words[i : i + n]), set()).add(item_id)
        tables = []
        for n, own in sorted(patterns.items()):
            size = min(2, n)
            far = n - size + 1
            shifts: dict[tuple, int] = {}
            buckets: dict[tuple, list] = {}
            for pattern, ids in own.items():
                for end in range(size, n + 1):
                    block = pattern[end - size : end]
                    shifts[block] = min(shifts.get(block, far), n - end)
                buckets.setdefault(pattern[n - size :], []).append((list(pattern), ids))
            tables.append((n, size, far, shifts, buckets))
        return tables

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words (end exclusive), and the ids of items that occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        total = len(words)
        for n, size, far, shifts, buckets in self.tables:
            get, i = shifts.get, n - 1
            while i < total:
                block = (words[i - 1], words[i]) if size == 2 else (words[i],)
                shift = get(block, far)
                if shift:
                    i += shift
                    continue
                here = words[i - n + 1 : i + 1]
                for pattern, ids in buckets[block]:
                    if pattern == here:
                        spans.append((i - n + 1, i + 1))
                        found |= ids
                i += 1
        return merge(spans), found


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "hit_spans", "item_ids")) -> DataFrame:
    """All columns of docs, its number of words, the spans of hit words and the sorted ids (as strings) of items found."""
    if clash := {c.lower() for c in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has {sorted(clash)}")
    spark = docs.sparkSession
    source = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * block_words)))  # a word and its separator are two characters at least
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], _SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])
    width = len(docs.columns)
    out = docs
    for k in range(blocks):
        own = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(WuManber.build(((r.id, alnum_words(r.text)) for r in own.toLocalIterator()), window))

        def run(batches, shared=shared, first=k == 0):
            matcher = WuManber(shared.value)
            for batch in batches:
                counts, spans, ids = [], [], []
                for i, value in enumerate(batch.column(batch.num_columns - 1)):
                    words = alnum_words(value.as_py())
                    hits, found = matcher.search(words)
                    found.discard(None)
                    if not first:
                        hits = merge([*hits, *((x["start"], x["end"]) for x in batch.column(width + 1)[i].as_py())])
                        found |= set(batch.column(width + 2)[i].as_py())
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hits])
                    ids.append(sorted(found))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(ids, pa.list_(pa.string()))], names=schema.names)

        out = out.withColumn(free_name(out, "_searched"), F.col(text)).mapInArrow(run, schema)
        if k + 1 < blocks:
            out = materialize(out, "decontam")
    return out


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = find(docs.select(key, "text"), items, **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without any hit word, with their own columns."""
    names = tuple(free_name(docs, x) for x in ("_n_words", "_hit_spans", "_item_ids"))
    return find(docs, items, names=names, **options).filter(F.size(names[1]) == 0).drop(*names)
