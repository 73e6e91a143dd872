"""Quality classifier (operator 4): Bradley-Terry pairwise ranking.

Every text becomes a vector of plain measures (length, shares of kinds of
characters, repetition of words, neighbours and lines).  Of the labelled rows
outside the held-out fold a sample of at most `SAMPLE` (a documented bound)
gives the measures' bins and the preference pairs: each row of one label against
`PARTNERS` rows of the other, dealt out in a fixed order.  Logistic loss on
differences of the binned measures learns weights; a text's rank is its weighted
sum.  The rank at the share of low labels splits the sample, and maps to a score
of `THRESHOLD`; a logistic slope spreads ranks over 0 to 1.

Edge cases: null and empty texts are measured as empty; without labels of both
kinds every score is the share of good labels (1 without labels); labels with
nulls are left out, repeated ones count once; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbelo.llm.common import fold, free_name, labelled_sample

FOLDS, HELD_OUT = 4, 2
SAMPLE, PARTNERS, BINS, RIDGE = 12_000, 16, 12, 1e-3
PAIRS = 4_000
THRESHOLD = 0.7

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
MEASURES = ["n_words", "distinct", "top_word", "neighbours", "word_length", "line_repeats", "lines", "upper", "lower", "digit", "blank", "other", "punctuation", *(f"char_{c}" for c in _PUNCTUATION)]


def measure(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    top = max(Counter(words).values(), default=0)
    distinct = len(set(words))
    same = sum(map(eq, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower, digit = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    blank = int(counts[32] + counts[9:14].sum())
    marks = counts[_PUNCTUATION]
    return [
        math.log1p(n), math.log1p(distinct) / math.log1p(n) if n else 0.0, top / n if n else 0.0, same / n if n else 0.0, (size - blank) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(lines) / (n + 1), upper / (upper + lower + 1), lower / size, digit / size, blank / size,
        int(counts[128:].sum()) / size, int(marks.sum()) / (n + 1), *(marks / (n + 1)).tolist(),
    ]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One column per bin edge: whether a measure exceeds it."""
    return np.column_stack([x[:, [i]] > e[None, :] for i, e in enumerate(edges)]).astype(np.int8) if edges else np.zeros((len(x), 0), np.int8)


def bradley_terry(features: np.ndarray, y: np.ndarray, partners: int = PARTNERS, ridge: float = RIDGE, seed: int = 7) -> np.ndarray:
    """Weights under which the good row of each preference pair tends to rank higher."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    a = np.repeat(few, partners)
    b = rng.permutation(np.resize(many, max(len(many), len(a))))[: len(a)]
    better, worse = (b, a) if few is bad else (a, b)
    w = np.zeros(features.shape[1])
    for _ in range(30):
        grad, hess = -ridge * len(a) * w, ridge * len(a) * np.eye(len(w))
        for i in range(0, len(a), PAIRS):  # differences of some pairs at a time
            diff = features[better[i : i + PAIRS]].astype(np.float32) - features[worse[i : i + PAIRS]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad += diff.T @ p
            hess += (diff * (p * (1 - p))[:, None].astype(np.float32)).T @ diff
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """edges, weights, cut, slope: plain data, to be broadcast."""
    sample = labelled_sample(docs, labels, label, HELD_OUT, FOLDS, SAMPLE, key, text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([measure(x.as_py()) for x in batch.column(0)], pa.list_(pa.float64())), batch.column(2)], names=["y", "x", "k"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("text", "y", "doc_id").mapInArrow(run, f"y int, x array<double>, k {kind}").collect()  # SAMPLE rows at most
    rows.sort(key=lambda r: (r.k, r.y, r.x))  # the same pairs whatever order tasks end in
    y = np.array([int(r.y > 0) for r in rows])
    if not len(y) or not 0 < y.mean() < 1:
        return {"edges": [], "weights": np.zeros(0), "cut": 0.0, "slope": 0.0, "level": float(y.mean()) if len(y) else 1.0}
    x = np.array([r.x for r in rows])
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) for i in range(x.shape[1])]
    edges = [np.unique(np.concatenate((e, np.quantile(x[:, i][x[:, i] > 0], [0.05, 0.25, 0.5]) if (x[:, i] > 0).any() else [], [0.0]))) for i, e in enumerate(edges)]
    features = _binned(x, edges)
    w = bradley_terry(features, y)
    rank = features.astype(np.float32) @ w
    order = np.sort(rank)
    k = int((y == 0).sum())
    cut = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    slope = 1.0
    base = math.log(THRESHOLD / (1 - THRESHOLD))
    for _ in range(40):  # one-dimensional Newton on the slope
        p = 1 / (1 + np.exp(-np.clip(slope * (rank - cut) + base, -30, 30)))
        g = ((y - p) * (rank - cut)).sum() - 1e-2 * slope
        h = (p * (1 - p) * (rank - cut) ** 2).sum() + 1e-2
        slope = min(50.0, max(0.05, slope + g / h))
    return {"edges": edges, "weights": w, "cut": cut, "slope": float(slope), "level": THRESHOLD}


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs and the quality score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            x = np.array([measure(v.as_py()) for v in batch.column(batch.num_columns - 1)]).reshape(-1, len(MEASURES))
            if len(m["weights"]):
                z = m["slope"] * (_binned(x, m["edges"]) @ m["weights"] - m["cut"]) + math.log(THRESHOLD / (1 - THRESHOLD))
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                out = np.full(len(x), m["level"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=schema.names)

    return docs.withColumn(free_name(docs, "_to_rank"), F.col(text)).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of every row."""
    docs = docs.select(key, "text")
    scored = score(docs, fit(docs, labels, key))
    return scored.select(key, (fold(key, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
