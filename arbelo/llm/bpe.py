"""Byte-level BPE encoding and decoding (operator 1).

Every regex match of a text ("piece") is encoded on its own.  A segment tree
over the byte positions of the piece stores, at each position, the rank of the
pair that starts there; an inner node holds the leftmost minimum of its span.
The root is therefore the next merge; a merge updates at most three positions
(the merged pair, its right half, its live left neighbour), each in O(log n).

Edge cases: a null or empty text has no tokens and decodes to no bytes; a
piece of any length is encoded whole; a byte missing from the vocabulary raises
ValueError; repeated rows are encoded as often as they occur.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Pieces whose encodings a task remembers; beyond it the cache starts anew.
CACHE_PIECES = 100_000
#: Children of a node of the segment tree, a power of two: the least of 16 by the built-in min costs less than four two-way steps.
FAN_BITS = 4
FAN = 1 << FAN_BITS


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def latin_pattern(pattern: str) -> str:
    r"""`pattern` with \p{L}, \p{N} and \s spelt out for code points below 256.

    On texts that hold no others it matches as `regex` does, in half the time.
    The members are read off the `regex` module itself.
    """
    members = {k: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out = pattern.replace(r"\S", f"[^{members[chr(92) + 's']}]")
    for inner in re.findall(r"\[\^?[^\]]*\\[ps][^\]]*\]", pattern):
        spelt = inner
        for k, v in members.items():
            spelt = spelt.replace(k, v)
        out = out.replace(inner, spelt)
    for k, v in members.items():
        out = out.replace(k, f"[{v}]")
    return out


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by repeated leftmost-minimum merges on a segment tree."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    shift, none = n.bit_length(), 1 << 62
    mask = (1 << shift) - 1
    leaves = [none if (r := get(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)] or [none]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, upper = levels[-1], range(1, len(levels))
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n - 1))  # start of the live token to the left
    while (least := min(top)) != none:
        i = least & mask
        j = after[i]
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
            leaves[i] = none if r is None else r << shift | i
            leaves[j] = none
        else:
            leaves[i] = none
            if j < n - 1:
                leaves[j] = none
        if h >= 0:
            r = get(piece[h:k])
            leaves[h] = none if r is None else r << shift | h
        if upper:
            for p in (h, i, j):
                if 0 <= p < n - 1:
                    for level in upper:
                        p >>= FAN_BITS
                        v = min(levels[level - 1][p << FAN_BITS : (p + 1) << FAN_BITS])
                        if levels[level][p] == v:
                            break
                        levels[level][p] = v
    out, i = [], 0
    while i < n:
        r = get(piece[i : after[i]])
        if r is None:
            raise ValueError(f"byte {piece[i]} is not in the vocabulary")
        out.append(r)
        i = after[i]
    return out


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find_any, self.find_latin, self.known = ranks, regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall, {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def pack(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            text.encode("latin-1")
            pieces = self.find_latin(text)
        except UnicodeEncodeError:
            pieces = self.find_any(text)
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = np.array(merge_piece(p.encode("utf-8"), self.ranks), dtype="<u4").tobytes()
                if len(p) < 200:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def unpack(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _per_text(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str, outputs: dict[str, tuple[pa.DataType, Callable]]) -> DataFrame:
    """Adds a column per output to docs[keep]; an output is a function of (packed ids, encoder)."""
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: a file of fixed size
    kinds = {"string": T.StringType(), "int64": T.LongType(), "binary": T.BinaryType(), "list<item: int64>": T.ArrayType(T.LongType())}
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kinds[str(kind)]) for c, (kind, _) in outputs.items()])

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            cols = {c: [] for c in outputs}
            for value in batch.column(batch.num_columns - 1):
                packed = encoder.pack(value.as_py())
                for c, (_, f) in outputs.items():
                    cols[c].append(f(packed, encoder))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(cols[c], outputs[c][0]) for c in outputs], names=schema.names)

    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_bpe_text"))
    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, vocab_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row; the decoded bytes come from the ids."""
    spark = docs.sparkSession
    return _per_text(spark, docs, load_ranks(vocab_path), pattern, [key], text, {
        "n_tokens": (pa.int64(), lambda p, e: len(p) // 4),
        "ids_sha256": (pa.string(), lambda p, e: hashlib.sha256(p).hexdigest()),
        "decoded_sha256": (pa.string(), lambda p, e: hashlib.sha256(e.unpack(p)).hexdigest()),
    })


def encode(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """All columns of docs and the token ids of `text` as an array column."""
    if into in docs.columns:
        raise ValueError(f"docs already has a column {into}")
    return _per_text(docs.sparkSession, docs, load_ranks(vocab_path), pattern, docs.columns, text, {into: (pa.list_(pa.int64()), lambda p, e: np.frombuffer(p, "<u4").tolist())})


def decode(docs: DataFrame, vocab_path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """All columns of docs and the decoded bytes of the array column `ids`; null ids give no bytes."""
    if into in docs.columns:
        raise ValueError(f"docs already has a column {into}")
    spark, keep = docs.sparkSession, docs.columns
    tokens: list[bytes] = []
    for token, rank in load_ranks(vocab_path).items():
        tokens.extend([b""] * (rank + 1 - len(tokens)))
        tokens[rank] = token
    shared = spark.sparkContext.broadcast(tokens)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches):
        table = shared.value
        for batch in batches:
            out = [b"".join([table[i] for i in row]) if (row := x.as_py()) else b"" for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return docs.select(*[docs[f"`{c}`"] for c in keep]).mapInArrow(run, schema)
