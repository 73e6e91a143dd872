r"""N-gram Jaccard join (operator 6): count vectors in R-trees, as Spark jobs.

A document's set holds its distinct shingles of `SIZE` words (words
`[^\x20\x09-\x0D]+` after lower-casing A-Z; fewer words: all of them as one).
Two documents link when 100 |A n B| >= 85 |A u B|.

1. Shingles that many documents of a task share are counted and the commonest
   (a documented bound) ranked last in the one order of all shingles.
2. A row per document: set size, 128-bit fingerprint of the set, the counts of
   its shingles in hash groups (a point: `GROUPS` coordinates for the trees, and
   a finer one of a power of two near a quarter of the set's size), and its
   prefix: the first n - ceil(0.85 n) + 1 shingles in that order.  Two sets that
   link share a shingle of their prefixes, so prefixes deal the work out and
   lose no link.
3. Equal sets are one class, stood for by its smallest id.
4. Classes under a shared prefix shingle are first compared with the smallest
   of them.  The sum of coordinate minima of two points bounds the overlap of
   their sets; pairs it allows are verified on the texts.
5. Of shingles whose classes are not all linked yet, the points form R-trees:
   boxes, then points, between which the bound leaves too little overlap are
   skipped; pairs of unlinked classes that survive, and survive the bound of
   their finer points, are verified on the texts.
6. Components over all verified links.
7. For pairs and numbers of links: all links lie inside components, whose
   classes meet in salted blocks and are compared there, each pair once; classes
   count by the number of their documents.

Groups under one shingle are split into blocks (5) or salted (verification),
never gathered; equal sets and linked classes are never paired again, so a
large group of copies costs a few pairs for each member.  Lone count-vector
trees cannot deal the work out: random documents' points lie so close together
that boxes over them prune nothing, hence the prefixes in step 2.

Edge cases: null, empty or blank texts have an empty set and link with nothing;
a null key is linked with nothing (its component is null); rows that repeat a
key are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, free_name, materialize
from arbelo.llm.components import least_reachable
from arbelo.llm.shingles import fingerprint, shingle_sets

SIZE, NUM, DEN = 4, 85, 100
#: Coordinates of a point.
GROUPS = 128
#: Shingles ranked last at most: the broadcast table has 16 bytes for each.
COMMON = 100_000
#: Documents of a task among which a shingle is counted, by their shingles; and the count that makes it common.
COMMON_CHUNK, COMMON_LEAST = 4_000_000, 12
#: Members of a block of an R-tree, and of a salted part of a verification.
BLOCK, PART = 500, 100
LEAF = 16

#: Coordinates of the finer point at most, and counts that its bytes hold at most: a full byte says "that many or more".
FINE_LEAST, FINE_MOST, FULL, FULL_COARSE = 32, 1 << 16, 127, 32_767
#: Rows of (pivot, partner) that may be broadcast to the texts, some 40 bytes each; beyond, both sides are shuffled.
BROADCAST_ROWS = 20_000


def links(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or den * small < num * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * same >= num * (small + large - same)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n + (-num * n) // den + 1 if n else 0


def common_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents share, sorted, and log2 of how many do; only the order of shingles depends on them.

    Equal sets of one chunk count once.
    """

    def run(batches):
        held, seen, n = [], set(), 0

        def counted():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= COMMON_LEAST
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), size):
                if not len(own) or (print_ := (len(own), int(own[0]), int(np.bitwise_xor.reduce(own)))) in seen:
                    continue
                seen.add(print_)
                held.append(own)
                n += len(own)
                if n >= COMMON_CHUNK:
                    yield counted()
                    held, n = [], 0
                    seen.clear()
        if held:
            yield counted()

    rows = docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    shingles = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.log2(np.array([r.n for r in rows], np.float64)).astype(np.int64)[order]


def _prefix(u: np.ndarray, length: int, common: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order of (rank, hash): those that are not common, and those that are."""
    if not len(common) or not len(u):
        return u[:length], u[:0]
    at = np.minimum(np.searchsorted(common, u), len(common) - 1)
    often = common[at] == u
    rare = u[~often]
    if len(rare) >= length:
        return rare[:length], u[:0]
    known = np.flatnonzero(often)
    known = known[np.argsort(ranks[at[known]], kind="stable")]
    return rare, u[known[: length - len(rare)]]


def signatures(docs: DataFrame, key: str, text: str, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """id, n, s1, s2 (fingerprint), point, fine, prefix and its common shingles (often) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, size))  # COMMON rows at most

    def run(batches):
        common, ranks = shared.value
        zero = np.zeros(1, np.int64)
        for batch in batches:
            n, s1, s2, points, fines, prefixes, often = [], [], [], [], [], [], []
            for u in shingle_sets(batch.column(1), size):
                n.append(len(u))
                for salt, to in ((0, s1), (2, s2)):
                    to.append(int(fingerprint(u, zero, salt)[0]) if len(u) else 0)
                place, groups = (u >> np.uint64(20)).astype(np.int64), _fine_groups(len(u))
                fine = np.bincount(place % groups, minlength=groups)
                coarse = fine.reshape(-1, GROUPS).sum(axis=0) if groups >= GROUPS else np.bincount(place % GROUPS, minlength=GROUPS)
                points.append(np.minimum(coarse, FULL_COARSE).astype(np.int16))
                fines.append(np.minimum(fine, FULL).astype(np.int8))
                first, last = _prefix(u, prefix_length(len(u), num, den), common, ranks)
                prefixes.append(first.view(np.int64))
                often.append(last.view(np.int64))
            offsets = lambda xs: pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32))
            columns = ((points, pa.int16()), (fines, pa.int8()), (prefixes, pa.int64()), (often, pa.int64()))
            lists = [pa.ListArray.from_arrays(offsets(xs), pa.array(np.concatenate(xs), kind)) if xs else pa.array([], pa.list_(kind)) for xs, kind in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *lists], names=["id", "n", "s1", "s2", "point", "fine", "prefix", "often"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, point array<smallint>, fine array<tinyint>, prefix array<long>, often array<long>")


def _fine_groups(n: int) -> int:
    """A power of two near n / 4: sets of nearly one size have one number of groups, or one twice the other."""
    return min(FINE_MOST, max(FINE_LEAST, 1 << max(0, (n // 4 - 1).bit_length())))


class CountTree:
    """An R-tree over count vectors, filled by sorting on set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        order = np.argsort(sizes, kind="stable")
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        starts = np.arange(0, len(order), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts))]
        while len(self.levels[-1][1]) > 1:
            hi, small, large = self.levels[-1]
            starts = np.arange(0, len(small), LEAF)
            self.levels.append((np.maximum.reduceat(hi, starts), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts)))

    def _allowed(self, q: np.ndarray, n: int, hi: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """Whether sets of sizes small..large within boxes up to hi can link with q; overlap >= num (a + b) / (num + den)."""
        fits = (self.den * large >= self.num * n) & (self.den * n >= self.num * small)
        overlap = np.minimum(hi, q).sum(axis=1)
        least = np.maximum(small, -(-self.num * n // self.den))
        return fits & ((self.num + self.den) * overlap >= self.num * (n + least))

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Numbers (in the given order) of the points that the bound allows."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, small, large = self.levels[depth]
            nodes = nodes[self._allowed(q, n, hi[nodes], small[nodes], large[nodes])]
            below = len(self.levels[depth - 1][1]) if depth else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        return self.order[nodes[self._allowed(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first n_keys columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tree_pairs(rows: DataFrame, kind: str, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of different comp that the bound allows, from rows (tok, bi, bj, own, id, comp, n, point) in R-tree blocks."""

    def run(batches):
        for group in _groups(batches, 3):
            _, bi, bj = group[0][:3]
            own, ids, comps = [r[3] for r in group], [r[4] for r in group], [r[5] for r in group]
            if len(set(comps)) < 2:
                continue
            sizes, points = np.array([r[6] for r in group]), np.array([r[7] for r in group], np.int64)
            points[points >= FULL_COARSE] = 1 << 40  # "that many or more"
            tree = CountTree(points, sizes, num, den)
            a, b = [], []
            for i in range(len(group)):
                for j in tree.search(points[i], int(sizes[i])):
                    if ids[i] < ids[j] and comps[i] != comps[j] and (bi == bj or own[i] != own[j]):
                        a.append(ids[i])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.select("tok", "bi", "bj", "own", "id", "comp", "n", "point").repartition("tok", "bi", "bj").sortWithinPartitions("tok", "bi", "bj")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and summed minima of their finer points allow a link."""
    left = points.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("fine").alias("pa"))
    right = points.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("pb"))
    fits = (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)
    near = pairs.join(left, "a").join(right, "b").filter(fits)
    groups = F.least(F.size("pa"), F.size("pb"))
    full = F.greatest("na", "nb")
    count = lambda x: F.when(x == FULL, full).otherwise(x.cast("long"))

    def folded(p: str):
        """A point with twice the groups has those of the other in its two halves."""
        halves = F.zip_with(F.slice(p, F.lit(1), groups), F.slice(p, groups + 1, groups), lambda x, y: count(x) + count(y))
        return F.when(F.size(p) == groups, F.transform(p, count)).when(F.size(p) == 2 * groups, halves)

    overlap = F.aggregate(F.zip_with(folded("pa"), folded("pb"), lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    allowed = overlap * (num + den) >= (F.col("na") + F.col("nb")) * num
    return near.filter(F.coalesce(allowed, F.lit(True))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, kind: str, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts link. Each part of a pivot's partners meets one copy of the pivot's text."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("role"), F.col("b").alias("id"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("id"))
    wanted = materialize(dealt.unionByName(pivots), "to-verify")
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "id")

    def run(batches):
        at, sets = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, part, role, other, own in zip(*(c.to_pylist() for c in batch.columns[:4]), shingle_sets(batch.column(4), size), strict=True):
                if (a, part) != at:
                    at, sets = (a, part), []
                if role == 0:
                    sets.append(own)
                elif any(links(own, x, num, den) for x in sets):
                    a_out.append(a)
                    b_out.append(other)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out), pa.array(b_out)], names=["a", "b"])

    return rows.select("a", "part", "role", "id", "_text").repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, f"a {kind}, b {kind}")


def _resolved(docs: DataFrame, key: str, text: str, size: int, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sizes and fingerprints of all rows, and every class (n, s1, s2, rep) with its component."""
    kind = docs.schema[key].dataType.simpleString()
    signed = materialize(signatures(docs, key, text, size, num, den), "signatures")
    sets = signed.filter("n > 0 and id is not null")
    classes = materialize(sets.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = materialize(sets.drop("s1", "s2").join(classes.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi"), "class-points")
    points = reps.select("id", "n", "fine")

    # least and greatest class of each prefix shingle leave the tasks as partial aggregates; of common shingles there are COMMON at most
    def dealt(column: str, small: bool) -> DataFrame:
        rows = reps.select("id", F.explode(column).alias("tok"))
        pivots = rows.groupBy("tok").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).filter("pivot <> other").select("tok", "pivot")
        return rows.join(F.broadcast(pivots) if small else pivots.hint("shuffle_hash"), "tok").select("tok", "id", "pivot")

    shared = materialize(dealt("prefix", False).unionByName(dealt("often", True)), "shared")
    tried = materialize(shared.filter("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("c")), "tried")

    # every class is compared with the pivot with which it shares most of its prefix, then with those to whose family that did not bring it
    best = tried.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b")
    near = materialize(_verified(_bounded(best, points, num, den), docs, key, text, kind, size, num, den), "links")
    family = near.select(F.col("b").alias("v"), F.col("a").alias("f"))
    family = family.join(family.select(F.col("v").alias("f"), F.col("f").alias("ff")), "f", "left").select("v", F.coalesce("ff", "f").alias("f"))
    left = tried.join(best, ["a", "b"], "left_anti").join(family.select(F.col("v").alias("a"), F.col("f").alias("fa")), "a", "left").join(family.select(F.col("v").alias("b"), F.col("f").alias("fb")), "b", "left")
    stars = materialize(_bounded(left.filter(F.coalesce("fa", "a") != F.coalesce("fb", "b")).select("a", "b"), points, num, den), "stars")
    linked = materialize(near.unionByName(_verified(stars, docs, key, text, kind, size, num, den)), "links")
    labels = least_reachable(linked)
    discard(near, stars)

    placed = shared.join(labels.withColumnRenamed("v", "id"), "id", "left").select("tok", "id", F.coalesce("label", "id").alias("comp"))
    # shingles that the same classes share deal out the same pairs: one of them, by two hashes of their members, is enough
    members = placed.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2"))
    mixed = members.filter("lo <> hi").groupBy("m", "h1", "h2").agg(F.min("tok").alias("tok")).select("tok", F.ceil(F.col("m") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cells = (
        placed.join(mixed, "tok").withColumn("own", own)
        .select("tok", "id", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
        .select("tok", "id", "comp", "own", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"))
        .join(reps.select("id", "n", "point"), "id")
    )
    rest = materialize(_bounded(_tree_pairs(cells, kind, num, den).join(tried, ["a", "b"], "left_anti"), points, num, den), "candidates")
    if not rest.isEmpty():
        linked = materialize(linked.unionByName(_verified(rest, docs, key, text, kind, size, num, den)), "links")
        labels = least_reachable(linked)
    member = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("n", "s1", "s2", "rep", F.coalesce("label", "rep").alias("component"))
    member = materialize(member, "class-components")
    told = materialize(signed.select("id", "n", "s1", "s2"), "set-sizes")
    discard(signed, classes, reps, shared, tried, rest, linked, labels)
    return told, member


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    signed, member = _resolved(docs, key, text, size, num, den, block)
    out = signed.join(member.drop("rep"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set, how many shingles it shares with every one."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    known, place = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    for i in range(len(sets)):
        own = place[starts[i] : starts[i + 1]]
        mark[own] = 1
        yield np.add.reduceat(mark[place], starts[:-1])
        mark[own] = 0


def _cell_links(held: list[tuple], bi: int, bj: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of members (own block, id, weight, set) of a cell, and of those they link with; each ordered pair in one cell."""
    own, sizes = np.array([x[0] for x in held]), np.array([len(x[3]) for x in held])
    for i, same in enumerate(_overlaps([x[3] for x in held])):
        found = den * same >= num * (sizes + sizes[i] - same)
        found[i] = False
        if bi != bj:
            found &= own != own[i]
        yield i, np.flatnonzero(found)


def _linked_cells(docs: DataFrame, classes: DataFrame, key: str, text: str, emit, schema: str, size: int, num: int, den: int, part: int) -> DataFrame:
    """What emit gives for the links inside components, from classes (rep, component, weight).

    A component's classes are dealt out in salted blocks of `part` members, and
    each pair of blocks is one group, which holds its members' sets at most.
    """
    several = classes.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("component", F.ceil(F.col("m") / part).alias("blocks"))
    dealt = (
        classes.join(several, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .select("component", F.col("rep").alias("id"), "weight", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
        .select("component", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own", "id", "weight")
    )
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).join(materialize(dealt, "link-cells").hint("shuffle_hash"), "id")

    def run(batches):
        at, held, ids = None, [], set()
        for batch in batches:
            cells = zip(*(c.to_pylist() for c in batch.columns[:6]), shingle_sets(batch.column(6), size), strict=True)
            for component, bi, bj, own, id_, weight, own_set in cells:
                if (component, bi, bj) != at:
                    if len(held) > 1:
                        yield from emit(held, _cell_links([x[1] for x in held], at[1], at[2], num, den))
                    at, held, ids = (component, bi, bj), [], set()
                if id_ not in ids and len(own_set):  # rows that repeat a key are one document
                    ids.add(id_)
                    held.append((id_, (own, id_, weight, own_set)))
        if len(held) > 1:
            yield from emit(held, _cell_links([x[1] for x in held], at[1], at[2], num, den))

    return rows.select("component", "bi", "bj", "own", "id", "weight", "_text").repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj").mapInArrow(run, schema)


def link_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(a, b), a < b: every pair of distinct sets that links, each set stood for by the smallest key that has it."""
    kind = docs.schema[key].dataType.simpleString()
    _, member = _resolved(docs, key, text, size, num, den, block)

    def emit(held, found):
        for i, others in found:
            a = held[i][0]
            bs = [held[j][0] for j in others.tolist() if a < held[j][0]]
            if bs:
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(bs)), pa.array(bs)], names=["a", "b"])

    return _linked_cells(docs, member.select("rep", "component", F.lit(1).cast("long").alias("weight")), key, text, emit, f"a {kind}, b {kind}", size, num, den, part)


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, block: int = BLOCK, part: int = PART) -> DataFrame:
    """key, n_shingles, component_id, n_links of every row: n_links counts the other documents it links with, those of its own set among them."""
    kind = docs.schema[key].dataType.simpleString()
    signed, member = _resolved(docs, key, text, size, num, den, block)
    weights = signed.filter("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.count_distinct("id").alias("weight"))
    classes = materialize(member.join(weights, ["n", "s1", "s2"]), "weighted-classes")

    def emit(held, found):
        weight = np.array([x[1][2] for x in held], np.int64)
        counts = [int(weight[others].sum()) for _, others in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array(counts, pa.int64())], names=["rep", "links"])

    counted = _linked_cells(docs, classes.select("rep", "component", "weight"), key, text, emit, f"rep {kind}, links long", size, num, den, part)
    told = classes.join(counted.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").select("n", "s1", "s2", "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.join(told, ["n", "s1", "s2"], "left")
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), n_links.alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose component they name: one document of each group, with all columns; rows without a key stay.

    Of rows that repeat a key, which are one document, the one with the longest text stays, then that with the greatest hash of its text.
    """
    found = link_components(docs, key, text, **options)
    named = materialize(found.filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("_stay")).agg(F.count(F.lit(1)).alias("rows")), "ngram-stay")
    here = free_name(docs, "_key")
    marked = docs.withColumn(here, F.col(key))

    def those(stay: DataFrame) -> DataFrame:
        stay = stay.select("_stay").hint("shuffle_hash")
        return marked.filter(F.col(here).isNotNull()).join(stay, F.col(here) == F.col("_stay"), "left_semi")

    out = those(named.filter("rows = 1")).drop(here).unionByName(docs.filter(F.col(key).isNull()))
    if not (several := named.filter("rows > 1")).isEmpty():
        order = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(text))
        one = those(several).groupBy(here).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(here + "r"))
        out = out.unionByName(one.select(*[F.col(f"{here}r")[c].alias(c) for c in docs.columns]))
    return out
