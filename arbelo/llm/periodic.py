r"""Periodic run detection (operator 13): internal pattern matching with dyadic blocks.

A run of words is a stretch with smallest period q and length >= max(12, 2q) that
no neighbouring word extends.  Texts of an Arrow batch are laid end to end, some
`CHUNK` words at a time (a longer text alone), and worked on as arrays:

* Ranks of all factors of length 1, 2, 4, ... by prefix doubling; the last ranks
  are the suffix array.  Words of different texts differ, and a word that occurs
  once ends each text, so no factor is shared by two texts.
* A block of length b = 2^k (4 at least) stands for the periods of 2b-1 to 4b-2
  words (4: 1 to 14).  A run of such a period holds a whole block and its next
  occurrence one period later, so the occurrences of each block in the window of
  4b-2 words after it are asked for: range successors over the block's interval
  of the suffix array, in a wavelet tree over it.
* Occurrences that overlap by half form a progression whose step d is the block's
  own period.  If the block lies in the same stretch of period d, that is the
  only candidate; else the distances between the two stretches' starts and their
  ends, and where the stretches touch, all distances of the progression up to
  which both hold a whole period: each of those is one.
* A candidate is extended to both sides by the ranks of the factors.  Of
  candidates with the same stretch the smallest period stays.

The work grows as n log n with a text's words, also inside one long period.  A
text is one task's work; of a chunk the task holds some 4 bytes a word for every
length of factor that repeats.

Edge cases: null and empty texts have no words and no runs; texts of any length
are taken whole; a null key counts as the empty text where the query plants its
periods; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbelo.llm.common import free_name
from arbelo.llm.spans import bind

LEAST = 12
CHUNK = 200_000
#: The least block: with one at every second word, a stretch of 5 words holds a whole block.
BASE = 4
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Factors:
    """Ranks of the factors of length 2^k of an array of symbols, and its suffix array.

    The last symbol must occur once.  `rank[k][i]` is the number of suffixes that
    come before all those that share i's first 2^k symbols.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        counts = np.bincount(symbols, minlength=1)
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        rank = before[symbols].astype(np.int32)
        self.rank, self.n = [rank], n
        open_ = np.flatnonzero(counts[symbols] > 1)
        length = 1
        while len(open_):
            second = np.where(open_ + length < n, rank[np.minimum(open_ + length, n - 1)], 0).astype(np.int64)
            order = np.argsort(rank[open_].astype(np.int64) * n + second, kind="stable")
            at, second = open_[order], second[order]
            first = rank[at]
            new_group = np.concatenate(([True], first[1:] != first[:-1]))
            new = new_group | np.concatenate(([True], second[1:] != second[:-1]))
            place = np.arange(len(at))
            offset = place - np.maximum.accumulate(np.where(new_group, place, 0))
            start = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[at] = first + offset[start]
            alone = new & np.concatenate((new[1:], [True]))
            self.rank.append(rank)
            open_ = np.sort(at[~alone])
            length *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank] = np.arange(n, dtype=np.int32)

    def level(self, k: int) -> np.ndarray:
        """Ranks of length 2^k, or where all shorter factors differ, those."""
        return self.rank[min(k, len(self.rank) - 1)]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i < j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            rank, x, y = self.rank[k], i + out, j + out
            out += np.where((y < self.n) & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)]), 1 << k, 0)
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j (i < j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            rank, x, y = self.rank[k], i - out - (1 << k), j - out - (1 << k)
            out += np.where((x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]), 1 << k, 0)
        return out


class WaveletTree:
    """Range successors over an array of distinct values: the least value >= x inside a slice."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.ranks = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.ranks.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))  # zeros before each place
            self.zeros.append(int(self.ranks[-1][-1]))
            values = np.concatenate((values[~one], values[one]))

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each slice are less than x."""
        out, left, right = np.zeros(len(left), np.int64), left.copy(), right.copy()
        top = x >> self.bits > 0
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            low, high = self.ranks[level][left], self.ranks[level][right]
            one = (x >> bit & 1).astype(bool)
            out += np.where(one, high - low, 0)
            left = np.where(one, self.zeros[level] + left - low, low)
            right = np.where(one, self.zeros[level] + right - high, high)
        return np.where(top, 1 << 62, out)

    def nth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each slice that k others of it are less than."""
        out, left, right, k = np.zeros(len(left), np.int64), left.copy(), right.copy(), k.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            low, high = self.ranks[level][left], self.ranks[level][right]
            one = k >= high - low
            k -= np.where(one, high - low, 0)
            out |= np.where(one, 1 << bit, 0)
            left = np.where(one, self.zeros[level] + left - low, low)
            right = np.where(one, self.zeros[level] + right - high, high)
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        k = self.below(left, right, x)
        there = k < right - left
        out = np.full(len(left), none, np.int64)
        out[there] = self.nth(left[there], right[there], k[there])
        return out


def _spread(first: np.ndarray, step: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + step, ... of each row, count of them."""
    row = np.repeat(np.arange(len(first)), count)
    return first[row] + step[row] * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))


class _Blocks:
    """Candidates (place, period) from the occurrences of the blocks of one length."""

    def __init__(self, factors: Factors, tree: WaveletTree, slot: np.ndarray, k: int):
        self.f, self.tree, self.b = factors, tree, 1 << k
        self.window = 4 * self.b - 2
        rank = factors.level(k)
        size = np.bincount(rank, minlength=factors.n + 1)
        at = np.arange(0, factors.n, self.b if self.b > BASE else 2)
        at = at[size[rank[at]] > 1]
        self.at, self.left = at, slot[rank[at]]
        self.right = self.left + size[rank[at]]
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def next(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The next occurrence from x on, or a place far away."""
        return self.tree.successor(self.left[rows], self.right[rows], x, 4 * self.f.n + 4 * self.b)

    def stretch(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch of period d around the block at x, which has that period."""
        return x - self.f.behind(x, x + d), x + d + self.f.ahead(x, x + d)

    def last(self, x: np.ndarray, d: np.ndarray, end: np.ndarray) -> np.ndarray:
        return x + (end - self.b - x) // d * d

    def keep(self, place: np.ndarray, period: np.ndarray) -> None:
        fits = (period > 0) & (period <= self.window)
        self.found.append((place[fits], period[fits]))

    def run(self) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(self.at))
        x = self.next(rows, self.at + 1)
        # blocks that overlap their next occurrence by half: the progression that starts at the block itself
        d = x - self.at
        own = d <= self.b // 2
        self.keep(self.at[own], d[own])
        _, end = self.stretch(self.at[own], d[own])
        x[own] = self.next(rows[own], self.last(self.at[own], d[own], end) + 1)
        while True:
            near = x - self.at[rows] <= self.window
            rows, x = rows[near], x[near]
            if not len(rows):
                return self.found
            y = self.next(rows, x + 1)
            d = y - x
            many = d <= self.b // 2
            self.keep(self.at[rows[~many]], (x - self.at[rows])[~many])
            if many.any():
                i, first, step = self.at[rows[many]], x[many], d[many]
                start, end = self.stretch(first, step)
                start0, end0 = self.stretch(i, step)
                self.keep(i, start - start0)
                self.keep(i, end - end0)
                touch = start <= end0
                most = np.minimum(np.minimum(np.minimum(end0 - start0, end - start), (end - start0) // 2), self.window)
                count = np.where(touch, np.maximum(0, (np.minimum(most, self.last(first, step, end) - i) - (first - i)) // step + 1), 0)
                self.keep(np.repeat(i, count), _spread(first - i, step, count))
                y[many] = self.next(rows[many], self.last(first, step, end) + 1)
            x = y


def runs_of(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; the last symbol must occur once."""
    factors = Factors(symbols)
    none = np.zeros(0, np.int64)
    base = BASE.bit_length() - 1
    if len(factors.rank) <= base:
        return none, none, none
    # only suffixes whose first BASE symbols occur again can answer: the tree is built over those
    rank = factors.level(base)
    shared = np.bincount(rank, minlength=factors.n + 1)
    keep = shared[rank[factors.suffixes]] > 1
    if not keep.any():
        return none, none, none
    slot = np.concatenate(([0], np.cumsum(keep)))
    tree = WaveletTree(factors.suffixes[keep].astype(np.int64))
    found = []
    for k in range(base, len(factors.rank)):
        found += _Blocks(factors, tree, slot, k).run()
    place, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    place, period = np.divmod(np.unique(place * (factors.n + 1) + period), factors.n + 1)
    start = place - factors.behind(place, place + period)
    end = place + period + factors.ahead(place, place + period)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
    return start, end - start, period


def _words(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+`, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _solve(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a chunk."""
    symbols, used = np.empty(sum(map(len, texts)) + len(texts), np.int64), 0
    firsts, at = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        firsts.append(at)
        symbols[at : at + len(words)] = [own.setdefault(w, len(own)) for w in words]
        symbols[at : at + len(words)] += used
        at += len(words)
        symbols[at] = used + len(own)  # ends the text
        at, used = at + 1, used + len(own) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    start, length, period = runs_of(symbols, least)
    owner = np.searchsorted(firsts, start, "right") - 1
    for t, s, n, q in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        out[t].append((s - firsts[t], n, q))
    return out


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """All columns of docs, each text's number of words, its runs by start, then period, and the text without repetitions."""
    for c in (words, runs, collapsed):
        if c in docs.columns:
            raise ValueError(f"docs already has a column {c}")
    if least < 2 * BASE + 1:
        raise ValueError(f"runs of fewer than {2 * BASE + 1} words need not hold a whole block twice")
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])

    def chunks(column):
        chunk, n = [], 0
        for value in column:
            chunk.append(_words(value.as_py()))
            n += len(chunk[-1])
            if n >= CHUNK:
                yield chunk
                chunk, n = [], 0
        if chunk:
            yield chunk

    def run(batches):
        for batch in batches:
            done = 0
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                found = _solve(chunk, least)
                new = [
                    pa.array(map(len, chunk), pa.int64()), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found], _RUNS),
                    pa.array([_collapse(w, x).decode("utf-8", "surrogatepass") for w, x in zip(chunk, found, strict=True)], pa.string()),
                ]
                part = batch.slice(done, len(chunk))
                done += len(chunk)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return docs.withColumn(free_name(docs, "_run_text"), F.col(f"`{text}`")).mapInArrow(run, schema)


def plant(key: str, text: str) -> Column:
    """The text with the contract's period: every tenth key's words repeat from some word on."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return bind(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    return F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), bind(words, repeated)).otherwise(F.col(text))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256 of every row."""
    rows = find_runs(docs.select(F.col(key).alias("key"), plant(key, text).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = rows.select("key", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select(
        F.col("key").alias(key), "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
