"""Hard-negative mining (operator 12): segment summary filtering.

A vector is cut into segments of equal length; each keeps its mean and deviation.
For a segment of length L of two vectors, L * mean * mean' plus or minus
L * deviation * deviation' bounds its part of the inner product, so the sums over
the segments bound the score from both sides.  Summaries are kept at `LEVELS`
numbers of segments; a pair that the coarse ones cannot exclude is bounded by the
finer ones, and only what is left is scored exactly.

Rows are sorted by label and id and packed into blocks of `BLOCK` vectors with
their summaries, a table in the shared folder; anchors are packed in the same
way, `ANCHORS` a block.  Every block of anchors meets the row blocks by a nested
loop over blocks (never over rows), many of them in one task, which keeps the
best so far of each anchor: its worst kept score is the bound that later blocks
must reach.  Tasks send those few rows an anchor, and a ranked window takes the
best of them.  Positives only meet blocks of their own label.  Then bands (half
to 95 hundredths of a positive's score) give each anchor a lower and an upper
bound for its negatives.

Scores are exact integers: sums below 2^53 come by floating products, larger
ones by integer products; vectors whose inner products might pass 2^63 raise an
error, as no long could hold them.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; a shorter vector counts as followed by zeros, an empty
one as zeros; of rows that repeat an anchor's id the one with the least label and
vector asks, all take part as others, and a row is never a partner of its own
id; anchors without another row of their label have no rows in the result, nor
have positives without a row in their band; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, materialize

LEVELS = (4, 16)
BLOCK, ANCHORS = 4096, 512
POSITIVES, NEGATIVES = 5, 3
#: A band: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
EXACT_FLOAT, EXACT_LONG = 2.0**53, 2.0**63
#: Bounds are computed in floating point; they are widened by this share of the vectors' lengths.
SLACK = 1e-9
NONE = -(1 << 63)
_BLOCK = "label_from int, label_to int, n long, dim int, top double, ids binary, labels binary, vectors binary, summaries binary, ask binary"


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """key, label, vector of the rows that take part; a component x becomes floor(scale * x)."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fit = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return fit.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), F.transform(v, lambda x: F.floor(scale * x.cast("double"))).alias("vector"))


def summarise(vectors: np.ndarray) -> np.ndarray:
    """Per vector, for each level: means and deviations of its segments, both times the root of a segment's length."""
    out = []
    n, dim = vectors.shape
    for level in LEVELS:
        parts = vectors.reshape(n, level, dim // level)
        root = np.sqrt(dim // level)
        out += [parts.mean(axis=2) * root, parts.std(axis=2) * root]
    return np.hstack(out)


def _padded(lists: list, dim: int) -> np.ndarray:
    """The vectors as rows of a matrix, followed by zeros up to dim."""
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def pack(rows: DataFrame, size: int, ask: bool = False) -> DataFrame:
    """Blocks of at most `size` vectors with their summaries; rows: key, label, vector (, ask: array<long>)."""

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.sort_by("key")  # of equal scores the first columns win
        column = part["vector"].combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        dim = int(-(-max(1, sizes.max(initial=1)) // LEVELS[-1]) * LEVELS[-1])
        if (sizes == dim).all():
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), dim)
        else:
            vectors = _padded(column.to_pylist(), dim)
        labels = part["label"].to_numpy().astype(np.int32)
        top = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        asked = b""
        if ask:
            lists = part["ask"].to_pylist()
            asked = np.array([x + [NONE] * (POSITIVES - len(x)) for x in lists], np.int64).tobytes()
        row = [labels.min(), labels.max(), len(labels), dim, top, part["key"].to_numpy().astype(np.int64).tobytes(), labels.tobytes(), vectors.astype(np.int64).tobytes(), summarise(vectors.astype(np.float64)).tobytes(), asked]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held = table.slice(size).to_batches()
                n -= size
        if n:
            yield block(pa.Table.from_batches(held))

    dealt = rows.repartitionByRange("label", "key").sortWithinPartitions("label", "key")
    return dealt.mapInArrow(run, _BLOCK)


class _Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, side: str):
        def of(name: str):
            return row[f"{side}_{name}"]

        n, self.dim, self.top = of("n"), of("dim"), of("top")
        self.ids, self.labels = np.frombuffer(of("ids"), np.int64), np.frombuffer(of("labels"), np.int32)
        self.vectors = np.frombuffer(of("vectors"), np.int64).reshape(n, self.dim)
        self.summaries = np.frombuffer(of("summaries"), np.float64).reshape(n, -1)
        self.ask = np.frombuffer(of("ask"), np.int64).reshape(n, -1) if of("ask") else None

    def wider(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and summaries as of a length of dim."""
        if dim == self.dim:
            return self.vectors, self.summaries
        vectors = np.pad(self.vectors, ((0, 0), (0, dim - self.dim)))
        return vectors, summarise(vectors.astype(np.float64))


def inner(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer vectors; most: no sum of products exceeds it."""
    if most < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= EXACT_LONG:
        raise OverflowError("inner products of these vectors do not fit a long")
    return a @ b.T


def survivors(a: _Block, b: _Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, rows, scores): indices and the exact scores of a rectangle that holds all allowed pairs with low <= score <= high.

    Pairs that the bounds exclude have the score NONE.  counts gets the number
    of allowed pairs, and of those left after each level.
    """
    dim = max(a.dim, b.dim)
    (va, sa), (vb, sb) = a.wider(dim), b.wider(dim)
    slack = SLACK * a.top * b.top + 1e-6
    i, j, mask, at = np.arange(len(a.ids)), np.arange(len(b.ids)), allowed, 0
    if counts is not None:
        counts[0] += np.count_nonzero(mask)
    for step, level in enumerate(LEVELS):
        i_on, j_on = mask.any(axis=1), mask.any(axis=0)
        i, j, mask = i[i_on], j[j_on], mask[np.ix_(i_on, j_on)]
        if not mask.size:
            break
        mean, spread = slice(at, at + level), slice(at + level, at + 2 * level)
        middle, width = sa[i, mean] @ sb[j, mean].T, sa[i, spread] @ sb[j, spread].T + slack
        mask &= (middle + width >= low[i, None]) & (middle - width <= high[i, None])
        at += 2 * level
        if counts is not None:
            counts[step + 1] += np.count_nonzero(mask)
    i_on, j_on = mask.any(axis=1), mask.any(axis=0)
    i, j, mask = i[i_on], j[j_on], mask[np.ix_(i_on, j_on)]
    if not mask.size:
        return i, j, np.zeros((len(i), len(j)), np.int64)
    return i, j, np.where(mask, inner(va[i], vb[j], a.top * b.top), NONE)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k greatest scores of each row but NONE; of equal ones the first columns."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, [-k]]
        more = scores > least
        ties = (scores == least) & (least > NONE)
        ties &= np.cumsum(ties, axis=1, dtype=np.int32) <= k - np.count_nonzero(more, axis=1)[:, None]
        more |= ties
    else:
        more = scores > NONE
    return np.nonzero(more & (scores > NONE))


class _Best:
    """The k best partners so far of each of n askers: score high, then id low."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.who, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, NONE, np.int64)

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        who, score, ids = np.concatenate((self.who, who)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        first = np.searchsorted(who, np.arange(self.n))
        rank = np.arange(len(who)) - first[who]
        keep = rank < self.k
        self.who, self.score, self.id = who[keep], score[keep], ids[keep]
        full = self.who[rank[keep] == self.k - 1]
        self.floor[full] = self.score[rank[keep] == self.k - 1]


def _search(pairs: DataFrame, schema: str, begin, take, give) -> DataFrame:
    """Runs take(anchors, rows, state) over the pairs of blocks; the state of an anchor block is given out when the next one comes."""

    def run(batches):
        key, anchors, state = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if row["a_ids"] != key:
                    if key is not None:
                        yield give(anchors, state)
                    key, anchors = row["a_ids"], _Block(row, "a")
                    state = begin(anchors)
                take(anchors, _Block(row, "b"), state)
        if key is not None:
            yield give(anchors, state)

    return pairs.mapInArrow(run, schema)


def _meet(anchors: DataFrame, blocks: DataFrame, on: Column | None) -> DataFrame:
    """Every block of anchors with every row block (that `on` lets through): some thousand vectors a side."""
    a, b = (side.select(*[F.col(c).alias(f"{name}_{c}") for c in side.columns]) for side, name in ((anchors, "a"), (blocks, "b")))
    b = b.hint("shuffle_replicate_nl")
    return a.join(b, on) if on is not None else a.crossJoin(b)


def _top(rows: DataFrame, by: list[str], order: list, k: int, into: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(into) <= k)


def positives(anchors: DataFrame, blocks: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor, positive, score, rank: the k best other rows of each anchor's label."""

    def take(a: _Block, b: _Block, state: _Best) -> None:
        allowed = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
        high = np.full(len(a.ids), np.inf)
        i, j, scores = survivors(a, b, allowed, state.floor.astype(np.float64), high)
        if scores.size:
            x, y = best(scores, k)
            state.add(i[x], scores[x, y], b.ids[j[y]])

    def give(a: _Block, state: _Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.ids[state.who]), pa.array(state.id), pa.array(state.score)], names=["anchor", "positive", "score"])

    same = (F.col("a_label_from") <= F.col("b_label_to")) & (F.col("b_label_from") <= F.col("a_label_to"))
    found = _search(_meet(anchors, blocks, same), "anchor long, positive long, score long", lambda a: _Best(len(a.ids), k), take, give)
    return _top(found, ["anchor"], [F.desc("score"), "positive"], k, "rank")


def negatives(asking: DataFrame, blocks: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor, slot, negative, score, rank: of each anchor's bands (ask: its positives' scores) the k best rows of other labels."""

    def bands(a: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each band; those of missing positives hold nothing."""
        there = a.ask != NONE
        return np.where(there, -(-low * a.ask // 100), 1), np.where(there, high * a.ask // 100, 0)

    def take(a: _Block, b: _Block, state: list[_Best]) -> None:
        least, most = bands(a)
        floors = np.maximum(least, np.stack([s.floor for s in state], axis=1))
        open_ = floors <= most
        lowest = np.where(open_, floors, np.iinfo(np.int64).max).min(axis=1)
        highest = np.where(open_, most, NONE).max(axis=1)
        allowed = (a.labels[:, None] != b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :]) & open_.any(axis=1)[:, None]
        i, j, scores = survivors(a, b, allowed, lowest.astype(np.float64), highest.astype(np.float64))
        if not scores.size:
            return
        for slot, s in enumerate(state):
            rows = np.flatnonzero(open_[i, slot])
            if len(rows):
                inside = np.where((scores[rows] >= floors[i[rows], slot][:, None]) & (scores[rows] <= most[i[rows], slot][:, None]), scores[rows], NONE)
                x, y = best(inside, k)
                s.add(i[rows[x]], inside[x, y], b.ids[j[y]])

    def give(a: _Block, state: list[_Best]) -> pa.RecordBatch:
        who, ids, score = (np.concatenate([getattr(s, f) for s in state]) for f in ("who", "id", "score"))
        slot = np.repeat(np.arange(len(state)), [len(s.who) for s in state])
        return pa.RecordBatch.from_arrays([pa.array(a.ids[who]), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)], names=["anchor", "slot", "negative", "score"])

    differ = ~((F.col("a_label_from") == F.col("a_label_to")) & (F.col("b_label_from") == F.col("b_label_to")) & (F.col("a_label_from") == F.col("b_label_from")))
    found = _search(_meet(asking, blocks, differ), "anchor long, slot int, negative long, score long", lambda a: [_Best(len(a.ids), k) for _ in range(POSITIVES)], take, give)
    return _top(found, ["anchor", "slot"], [F.desc("score"), "negative"], k, "rank")


def mine(rows: DataFrame, asks: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: key, label, vector (whole numbers); asks: which keys are anchors."""
    blocks = materialize(pack(rows, BLOCK), "negative-blocks")
    who = rows.filter(asks).groupBy("key").agg(F.min(F.struct("label", "vector")).alias("row")).select("key", "row.label", "row.vector")
    who = materialize(who, "negative-anchors")
    anchors = materialize(pack(who, ANCHORS), "negative-anchor-blocks")
    good = materialize(positives(anchors, blocks), "negative-positives")
    scores = good.groupBy(F.col("anchor").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("ask"))
    asking = materialize(pack(who.join(scores, "key"), ANCHORS, ask=True), "negative-asking")
    bad = negatives(asking, blocks)
    out = bad.join(good.select("anchor", (F.col("rank") - 1).alias("slot"), "positive", F.col("score").alias("positive_score")), ["anchor", "slot"])
    out = materialize(out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(blocks, who, anchors, good, asking)
    return out


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: every id divisible by 50 asks; where the id is divisible by 7 the label is the next one of ten."""
    rows = whole_vectors(embeddings)
    rows = rows.withColumn("label", F.when(F.col("key") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int"))
    return mine(rows, F.col("key") % 50 == 0)
