r"""Toxicity (operator 2): maximum-scoring segment search over token log-odds.

Fit: of the labelled rows outside the held-out fold, a sample of at most
`SAMPLE` (a documented bound) gives, for each token, the log-odds of standing in
a toxic rather than a clean text.  A Dirichlet prior of `PRIOR` texts, dealt to
the classes in proportion to their sizes, draws the log-odds of seldom tokens
towards zero.  Log-odds of either sign count; those nearer to zero than
`LEAST_ODDS` count as zero, which keeps words seen once in a clean text out of
the model's table (59,751 tokens instead of 134,101 at sf0.1; the same held-out
texts are found without the cut).  A drift, of `DRIFTS` the one under which the
calibrated scores fit the sample best, is added for every token, so that texts
without evidence tend downwards.

Scan: a linear pass finds all maximal-scoring segments of a text.  The best
segment of clean texts follows an extreme-value law whose location grows with
the logarithm of the length.  It is fitted on clean texts whose scores come from
the log-odds of the sample's other half, since a text's own tokens score it too
high; it turns a segment's score into an excess over chance.  Segments with an excess over `SIGNIFICANT`
are toxic passages; their excesses are summed, and a logistic curve fitted on
the same scores turns the sum into a score from 0 to 1.

Edge cases: null and empty texts have no tokens and get the score of no
evidence; without labels of both kinds every score is the share of toxic labels
(0 without labels); labels with nulls are left out, repeated ones count once;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbelo.llm.common import alnum_words, fold, free_name, labelled_sample, materialize

FOLDS, HELD_OUT = 3, 1
SAMPLE = 20_000
PRIOR, LEAST_ODDS, SIGNIFICANT = 5.0, 0.25, 1.0
DRIFTS = (-0.5, -1.0, -1.5, -2.0, -3.0)
THRESHOLD = 0.7


@dataclass
class Model:
    """Plain data, to be broadcast."""

    odds: dict[bytes, float] = field(default_factory=dict)
    rate: float = 0.0  # of the extreme-value law: its scale's inverse
    log_k: float = 0.0  # and its location at length 1, times rate
    slope: float = 0.0
    offset: float = -30.0
    drift: float = DRIFTS[0]


def tokens(text: str | None) -> list[bytes]:
    return alnum_words(text.lower()) if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    A candidate keeps the running total before it (left) and after it (right).
    A new positive item looks for the nearest candidate with a smaller left
    total; if that one's right total is smaller too, the two and all between
    become one candidate, which looks again.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, nearest with a smaller left
    for i in positive.tolist():
        right = float(total[i])
        start, left = i, right - float(scores[i])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def scan(words: list[bytes], odds: dict[bytes, float], drift: float) -> list[tuple[int, int, float]]:
    get = odds.get
    return segments(np.fromiter((get(w, 0.0) for w in words), float, len(words)) + drift) if words else []


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, log_k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The summed excess over chance of the significant segments, and those segments."""
    base = log_k + math.log(max(n, 1))
    passages = [(a, b, rate * s - base) for a, b, s in found if rate * s - base > SIGNIFICANT]
    return sum(x for *_, x in passages), passages


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of tokens that stand in so many toxic and clean texts, of so many, under the prior."""
    share = n_toxic / (n_toxic + n_clean)
    return np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))


def _token_counts(sample: DataFrame) -> DataFrame:
    """(token, t0, c0, t1, c1): in how many toxic and clean texts of either half a token stands; the empty token counts texts."""

    def count(batches):
        for batch in batches:
            by = [Counter(), Counter(), Counter(), Counter()]
            for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by[2 * half + (y <= 0)].update({b"", *tokens(text.as_py())})
            words = sorted(set().union(*by))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([own[w] for w in words], pa.int64()) for own in by]], names=["token", "t0", "c0", "t1", "c1"])

    sums = [F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")]
    return materialize(sample.select("text", "y", "half").mapInArrow(count, "token binary, t0 long, c0 long, t1 long, c1 long").groupBy("token").agg(*sums), "token-counts")


def _odds(counts: DataFrame) -> tuple[list[dict[bytes, float]], dict[bytes, float]]:
    """Log-odds by either half of the sample, and by all of it; tokens of small log-odds in all three are left out in Spark."""
    total = counts.filter(F.length("token") == 0).first()
    if total is None:
        return [{}, {}], {}
    sides = [(("t0",), ("c0",)), (("t1",), ("c1",)), (("t0", "t1"), ("c0", "c1"))]
    ends = [[sum(total[c] for c in side) for side in both] for both in sides]
    if any(not x for both in ends for x in both):
        ends[:2] = [ends[2], ends[2]]  # a class that one half lacks: both halves learn from all
        sides[:2] = [sides[2], sides[2]]
    if any(not x for x in ends[2]):
        return [{}, {}], {}
    strong = F.lit(False)
    for (t, c), (n1, n0) in zip(sides, ends, strict=True):
        share = n1 / (n1 + n0)
        up, down = (sum((F.col(x) for x in side[1:]), F.col(side[0])) for side in (t, c))
        strong = strong | (F.abs(F.log((up + PRIOR * share) / (down + PRIOR * (1 - share))) - math.log(share / (1 - share))) >= LEAST_ODDS)
    rows = counts.filter((F.length("token") > 0) & strong).toArrow()
    words = [bytes(w) for w in rows.column("token").to_pylist()]
    column = lambda names: sum(rows.column(c).to_numpy() for c in names)
    out = []
    for (t, c), (n1, n0) in zip(sides, ends, strict=True):
        delta = log_odds(column(t), column(c), n1, n0)
        keep = np.flatnonzero(np.abs(delta) >= LEAST_ODDS)
        out.append({words[i]: float(delta[i]) for i in keep.tolist()})
    return out[:2], out[2]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps."""
    design = np.column_stack((x, np.ones_like(x)))
    penalty = np.array([ridge * len(y), 1e-9])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    w = np.array([0.0, math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-9 * np.eye(2), design.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _segment_scores(batches, halves: list[dict[bytes, float]]):
    """(y, n, scores of segments under each drift) from batches (text, y, half), by the log-odds of the other half."""
    for batch in batches:
        sizes, found = [], [[] for _ in DRIFTS]
        for text, half in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
            words = tokens(text.as_py())  # of one text at a time: those of a batch take several times its texts
            sizes.append(len(words))
            for own, drift in zip(found, DRIFTS, strict=True):
                own.append(np.array([s for *_, s in scan(words, halves[1 - half], drift)], float))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), *[pa.array(own, pa.list_(pa.float64())) for own in found]], names=["y", "n", *[f"d{i}" for i in range(len(DRIFTS))]])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, label, HELD_OUT, FOLDS, SAMPLE, key, text)
    sample = materialize(sample.select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "toxic-sample")
    halves, odds = _odds(_token_counts(sample))
    shared = sample.sparkSession.sparkContext.broadcast(halves)

    names = [f"d{i}" for i in range(len(DRIFTS))]
    rows = sample.select("text", "y", "half").mapInArrow(lambda batches: _segment_scores(batches, shared.value), "y int, n long, " + ", ".join(f"{c} array<double>" for c in names)).toArrow()  # SAMPLE rows at most
    y = np.clip(rows.column("y").to_numpy(), 0, 1).astype(float)
    if not len(y) or not 0 < y.mean() < 1:
        share = float(y.mean()) if len(y) else 0.0
        return Model(offset=math.log((share + 1e-13) / (1 - share + 1e-13)))
    logs = np.log(np.maximum(rows.column("n").to_numpy(), 1))
    tried = []
    for drift, name in zip(DRIFTS, names, strict=True):
        lists = rows.column(name).combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
        tops = np.zeros(len(y))
        np.maximum.at(tops, owner, flat)
        clean = y == 0
        rate = math.pi / math.sqrt(6) / max(float(tops[clean].std()), 0.25)
        log_k = rate * float(tops[clean].mean()) - 0.5772156649 - float(logs[clean].mean())
        excess = rate * flat - log_k - logs[owner]
        x = np.log1p(np.bincount(owner, np.where(excess > SIGNIFICANT, excess, 0.0), len(y)))
        slope, offset = _logistic(x, y)
        z = slope * x + offset
        tried.append((float((np.logaddexp(0, z) - y * z).sum()), Model(odds, rate, log_k, slope, offset, drift)))
    return min(tried, key=lambda t: t[0])[1]


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """All columns of docs, the score and the toxic passages (word numbers, end exclusive, and excess over chance)."""
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("excess", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.ArrayType(passage))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(batch.num_columns - 1):
                words = tokens(value.as_py())
                total, passages = evidence(scan(words, m["odds"], m["drift"]), len(words), m["rate"], m["log_k"])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m["slope"] * math.log1p(total) + m["offset"])))))
                spans.append([{"start": a, "end": b, "excess": x} for a, b, x in passages])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return docs.withColumn(free_name(docs, "_scanned"), F.col(text)).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of every row."""
    docs = docs.select(key, "text")
    scored = score(docs, fit(docs, labels, key))
    return scored.select(key, (fold(key, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    names = (free_name(docs, "_toxic_score"), free_name(docs, "_toxic_passages"))
    return score(docs, fit(docs, labels, key), into=names).filter(F.col(names[0]) < THRESHOLD).drop(*names)
