r"""Language ID (operator 10): script ranges, word scores, and a Viterbi pass with a switching penalty.

Fit: a sample of `SAMPLE` labelled rows (give or take their square root)
outside the held-out fold, a documented bound, gives the counts of letter
n-grams per language, however rare, each with half a count more.  A word's score
for a language is the sum of its n-grams' log-probabilities; only languages that
write the word's script (by ranges of code points) are candidates.  Over the words of a text, Viterbi finds
the best sequence of languages when each switch costs `SWITCH`; runs of one
language are spans, and the language with most letters is the text's.

Edge cases: null, empty and letterless texts are `und` with score 0; a script
that no language was learned in leaves all languages as candidates; nothing
learned makes every text `und`; ties go to the first language by name;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbelo.llm.common import fold, free_name, materialize

FOLDS, HELD_OUT = 5, 0
SAMPLE, SWITCH = 8_000, 12.0
SCRIPT_LEAST = 0.001  # share of a language's letters that makes it write a script
UNDETERMINED = "und"
CACHE_WORDS, BATCH_WORDS = 300_000, 300_000
WALL = 1e4  # more than a run of one text may cross for a gain

#: First and last code point of ranges of scripts.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]

_WORD = re.compile(r"[^\W\d_]+")
#: Numerals count as word characters there, but are no letters: such runs are cut again.
_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    return found if text.isascii() or all(map(str.isalpha, found)) else [x for w in found for x in ([w] if w.isalpha() else _LETTERS.findall(w))]


def script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [*w, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]


def _code(gram: str) -> int:
    """One to three letters as a number of their own."""
    return functools.reduce(lambda n, c: n << 21 | ord(c), gram, 0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """langs, grams (n-gram -> log-probability per language), unseen, scripts: plain data, to be broadcast."""
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (fold("k", FOLDS) != HELD_OUT))
    total = usable.select("k").count()
    share = min(1.0, SAMPLE / max(total, 1))
    # by a hash of the key, in the tasks that read the rows; a limit would bring the sample into one task
    chosen = usable.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)

    def count(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for value, l in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = by.setdefault(l, Counter())
                for w, n in Counter(words(value.as_py())).items():
                    for g in grams(w):
                        own["g" + g] += n
                    own["s" + script(w)] += n * len(w)
            rows = [(l, g, n) for l, own in by.items() for g, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["l", "g", "n"])

    counts = materialize(chosen.select("t", "l").mapInArrow(count, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "gram-counts")
    # n-grams of one to three letters, of a bounded sample: the table is bounded too
    rows = counts.filter(F.col("g").startswith("g")).collect()
    scripts = counts.filter(F.col("g").startswith("s")).collect()  # languages x scripts
    langs = sorted({r.l for r in scripts})
    at = {l: i for i, l in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r.g[1:], np.zeros(len(langs)))[at[r.l]] += r.n
    if not langs:
        return {"langs": [], "grams": {}, "unseen": np.zeros(0), "scripts": {}}
    size = sum(table.values(), np.zeros(len(langs))) + 0.5 * (len(table) + 1)
    letters = np.zeros(len(langs))
    for r in scripts:
        letters[at[r.l]] += r.n
    writes: dict[str, np.ndarray] = {}
    for r in scripts:
        writes.setdefault(r.g[1:], np.zeros(len(langs), bool))[at[r.l]] = r.n >= SCRIPT_LEAST * letters[at[r.l]]
    return {"langs": langs, "grams": {g: np.log((v + 0.5) / size) for g, v in table.items()}, "unseen": np.log(0.5 / size), "scripts": writes}


class Labeller:
    """Scores words, each once, and finds the best sequence of languages."""

    def __init__(self, model: dict, switch: float = SWITCH):
        self.model, self.switch, self.known = model, switch, {}
        codes = np.array([_code(g) for g in model["grams"]], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        rows = np.array([*model["grams"].values()]).reshape(len(codes), -1)[order] if len(codes) else np.empty((0, len(model["unseen"])))
        self.table = np.vstack([rows, model["unseen"]])  # the last row: a gram never seen
        self.scores = np.empty((0, len(model["langs"])))

    def _learn(self, new: list[str]) -> None:
        """Scores of new words: sums over their grams, all at once."""
        for w in new:
            self.known[w] = len(self.known)
        lens = np.fromiter(map(len, new), np.int64, len(new)) + 2
        c = np.frombuffer(f"^{'$^'.join(new)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        left = np.repeat(starts + lens, lens) - np.arange(len(c))  # letters from each place to its word's end
        two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
        pairs = c[two] << 21 | c[two + 1]
        total = self._summed(c, starts)
        total += self._summed(pairs, starts - np.arange(len(starts)))
        total += self._summed(c[three] << 42 | c[three + 1] << 21 | c[three + 2], starts - 2 * np.arange(len(starts)))
        total -= total.max(axis=1, keepdims=True)
        for name, own in self.model["scripts"].items():
            if own.any() and not own.all():
                these = [i for i, w in enumerate(new) if script(w) == name]
                total[np.ix_(these, np.flatnonzero(~own))] = -1e6
        self.scores = np.vstack([self.scores, total])

    def _summed(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of the table of grams by code, summed from each start on."""
        at = np.searchsorted(self.codes, codes)
        if len(self.codes):
            at[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] = len(self.codes)
        return np.add.reduceat(self.table[at], starts, axis=0)

    def _settled(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text the language that all its words have on the best path, or -1 where only a pass can tell.

        Against one language throughout, a path gains only in its runs of other
        languages, and pays a switch for all runs but one; so if no run gains
        more than half a switch, no path does better.
        """
        table = self.scores
        totals = np.add.reduceat(table[flat], starts, axis=0)
        best = totals.argmax(axis=1)
        lens = np.diff(np.append(starts, len(flat)))
        text = np.repeat(np.arange(len(starts)), lens)
        base = table[flat, best[text]]
        most = np.zeros(len(starts))
        apart = starts + np.arange(len(starts))  # a wall before each text
        place = np.arange(len(flat)) + text + 1
        run = np.empty(len(flat) + len(starts))
        for lang in range(table.shape[1]):
            run[apart] = -WALL
            run[place] = np.maximum(table[flat, lang] - base, -WALL)
            total = np.cumsum(run)
            gain = total - np.minimum.accumulate(total)  # of the best run that ends here
            most = np.maximum(most, np.maximum.reduceat(gain, apart))
        return np.where(most <= self.switch / 2, best, -1)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the number of the language of each word."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = list({w for t in texts for w in t if w not in self.known})
        if new:
            self._learn(new)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        get = self.known.__getitem__
        rows = {i: np.fromiter(map(get, texts[i]), np.int64, len(texts[i])) for i in some}
        lens = np.array([len(rows[i]) for i in some])
        settled = self._settled(np.concatenate([rows[i] for i in some]), np.concatenate(([0], np.cumsum(lens)))[:-1])
        for i, lang in zip(some, settled.tolist(), strict=True):
            if lang >= 0:
                out[i] = np.full(len(rows[i]), lang, np.int64)
        left = sorted((i for i, lang in zip(some, settled, strict=True) if lang < 0), key=lambda i: -len(rows[i]))
        if left:
            for i, path in zip(left, self._viterbi([rows[i] for i in left]), strict=True):
                out[i] = path
        return out

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best paths of texts, longest first; all are advanced by one word at a time."""
        table, n = self.scores, len(rows)
        lens = np.array([len(r) for r in rows])
        starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
        flat = np.concatenate(rows)
        alive = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # texts with more than t words
        best = table[flat[starts]]
        stay, came = np.empty((len(flat), table.shape[1]), bool), np.empty(len(flat), np.int16)  # back pointers of every word
        ends = np.empty(n, np.int64)
        for t in range(1, int(lens[0])):
            k = int(alive[t])
            if k < len(best):
                ends[k : len(best)] = best[k:].argmax(axis=1)
                best = best[:k]
            top = best.argmax(axis=1)
            moved = best[np.arange(k), top] - self.switch
            keep = best >= moved[:, None]
            stay[starts[:k] + t], came[starts[:k] + t] = keep, top
            best = np.where(keep, best, moved[:, None]) + table[flat[starts[:k] + t]]
        ends[: len(best)] = best.argmax(axis=1)
        path = np.empty(len(flat), np.int64)
        state = np.empty(n, np.int64)
        for t in range(int(lens[0]) - 1, -1, -1):
            k, j = int(alive[t]), int(alive[t + 1]) if t + 1 < lens[0] else 0
            if j:
                state[:j] = np.where(stay[starts[:j] + t + 1, state[:j]], state[:j], came[starts[:j] + t + 1])
            state[j:k] = ends[j:k]
            path[starts[:k] + t] = state[:k]
        return [path[a : a + m] for a, m in zip(starts, lens, strict=True)]


def label(docs: DataFrame, model: dict, text: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "lang_spans"), switch: float = SWITCH) -> DataFrame:
    """All columns of docs, the language, its share of the letters, and the spans of words in one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType()), T.StructField(into[2], T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        labeller = Labeller(shared.value, switch)
        langs = shared.value["langs"]
        for batch in batches:
            preds, scores, spans, held, n = [], [], [], [], 0

            def flush():
                for own, path in zip(held, labeller.label(held) if langs else [None] * len(held), strict=True):
                    if path is None or not own:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    letters = np.bincount(path, [len(w) for w in own], len(langs))
                    best = int(letters.argmax())
                    preds.append(langs[best])
                    scores.append(float(letters[best] / letters.sum()))
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"start": a, "end": b, "lang": langs[int(path[a])]} for a, b in zip(cuts, cuts[1:], strict=False)])

            for value in batch.column(batch.num_columns - 1):
                held.append(words(value.as_py()))
                n += len(held[-1])
                if n >= BATCH_WORDS:
                    flush()
                    held, n = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return docs.withColumn(free_name(docs, "_to_label"), F.col(text)).mapInArrow(run, schema)


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score of every row."""
    model = fit(docs, key)
    found = label(docs.select(key, "text"), model)
    return found.select(key, (fold(key, FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
