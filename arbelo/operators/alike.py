"""Similar names: pairs whose Dice or Jaccard similarity reaches a threshold, each met once, with its score from counts of shared parts.

A name's parts are its bigrams, numbered among equal ones so that a multiset
becomes a set, and its distinct words.  Distinct names are cut into parts once,
as a table.  If all pairs are few they are scored in salted blocks.  Otherwise
an inverted index brings names together: parts stand in one order, rarest first,
and of the first ones, that a threshold calls for between names of two classes of
size, the combinations of up to three are posted, as many as names must share.  A
pair is taken at the first parts that both names hold, so none comes twice and
nothing has to be made distinct; sizes and places of the parts bound the overlap
before it is counted, and the score is that count: no pair is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.functions import text as X
from arbelo.operators.tables import discard, materialize, spread, together

#: So many pairs at most are scored without an index, in so many blocks.
ALL_PAIRS, BLOCKS = 4_000_000, 16
#: Groups of so many pairs at most are compared directly, whatever the others need.
FEW = 1_000
#: More pairs than this meet on three shared parts instead of two, where the threshold asks for so many.
DEEP = 200_000_000
#: The smallest size of each class of sizes; pairs meet in the two classes of their sizes.
CLASSES = [*range(1, 9), 10, 12, 14, 16, 19, 22, 26, 31, 37, 44, 53, 64, 80, 100, 150, 250, 500, 1_000, 2**31 - 1]
EPS = 1e-9


def _numbered(items: Column) -> Column:
    """The items of an array with their number among equal ones: a multiset as a set."""
    return F.transform(items, lambda x, i: F.concat(x, F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def cut(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., name, grams, words of the distinct names, as a table in the shared folder."""
    names = spread(rows.select(*by, "name").filter("name <> ''").distinct()).withColumn("grams", X.bigrams(F.col("name")))
    return materialize(names.select(*by, "name", _numbered(F.col("grams")).alias("grams"), F.array_distinct(F.split("name", " ")).alias("words")), "name-parts")


def _side(parts: DataFrame, by: list[str], s: str, *more: str) -> DataFrame:
    return parts.select(*by, *more, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "grams", "words")])


def _shared(kind: str) -> Column:
    return F.array_intersect(f"{kind}_a", f"{kind}_b")


def _dice(shared: Column) -> Column:
    return 2.0 * shared / (F.size("grams_a") + F.size("grams_b"))


def _jaccard(shared: Column) -> Column:
    return shared / (F.size("words_a") + F.size("words_b") - shared)


def _ordered(parts: DataFrame, by: list[str], counts: DataFrame) -> DataFrame:
    """parts with grams and words in the order of (frequency, part), each with the letter of its kind in front."""
    each = parts.select(*by, "name", F.explode(F.concat(F.transform("grams", lambda x: F.concat(F.lit("g"), x)), F.transform("words", lambda x: F.concat(F.lit("w"), x)))).alias("part"))
    placed = each.join(counts, "part", "left").groupBy(*by, "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "part"))).alias("p"))
    of = lambda kind: F.transform(F.filter("p", lambda x: F.startswith(x["part"], F.lit(kind))), lambda x: x["part"])
    return placed.select(*by, "name", of("g").alias("grams"), of("w").alias("words"))


def _least_of_class(n: Column) -> Column:
    return F.array_max(F.filter(F.expr(f"array({', '.join(map(str, CLASSES))})"), lambda x: x <= n))


def _needed(n: Column, m: Column, least: Column) -> Column:
    """How many parts names of n and of m or more parts of column _kind share at least."""
    both = F.when(F.col("_kind") == "g", (n + m) / 2).otherwise((n + m) / (1 + least))
    return F.greatest(F.ceil(least * both - EPS).cast("int"), F.lit(1))


def _combinations(x: Column, k: int) -> Column:
    """The combinations of k items of an array in its order, each with the place of its last item."""
    def after(start: Column, head: tuple, left: int) -> Column:
        rest = F.slice(x, start + 1, F.size(x))
        if left == 1:
            return F.transform(rest, lambda v, i: F.struct(F.array(*head, v).alias("part"), (start + i).alias("at")))
        return F.flatten(F.transform(rest, lambda v, i: after(start + i + 1, (*head, v), left - 1)))

    return after(F.lit(0), (), k)


def _classes(ordered: DataFrame) -> dict[str, list[int]]:
    """The classes of size that occur, of each kind of part: at most as many as CLASSES has."""
    found = lambda kind: F.collect_set(F.when(F.size(kind) > 0, _least_of_class(F.size(kind)))).alias(kind)
    return {kind: sorted(sizes) for kind, sizes in ordered.agg(found("grams"), found("words")).first().asDict().items()}


def _posted(ordered: DataFrame, by: list[str], least: Column, s: str, others: dict[str, list[int]], depth: int) -> DataFrame:
    """A row per name, class of the other's size and combination of first parts, with the place of its last part.

    Of two names with sizes in two classes, the overlap asked for tells how many
    parts stand before the first `level` shared ones at most, so no pair is lost.
    """
    def part_of(kind: str, share: Column) -> Column:
        n = F.size(kind)
        towards = [f"named_struct('m', {m}, 'most', {CLASSES[CLASSES.index(m) + 1] - 1})" for m in others[kind]]
        near = F.filter(F.expr(f"array({', '.join(towards)})"), lambda x: (x["most"] >= n * share - EPS) & (x["m"] <= n / share + EPS)) if towards else F.array().cast("array<struct<m:int,most:int>>")
        return F.struct(F.lit(kind[0]).alias("kind"), F.col(kind).alias("items"), n.alias("n"), _least_of_class(n).alias("own"), F.ceil(n * share - EPS).cast("int").alias("shared"), near.alias("near"))

    kinds = F.array(part_of("grams", least / (2 - least)), part_of("words", least))
    each = ordered.select(*by, "name", "grams", "words", F.explode(kinds).alias("_k")).select(*by, "name", "grams", "words", "_k", F.explode("_k.near").alias("_to"))
    each = each.select(*by, "name", "grams", "words", "_to", *[F.col(f"_k.{c}").alias(f"_{c}") for c in ("kind", "items", "n", "own", "shared")])
    needed = F.greatest(_needed(F.col("_n"), F.col("_to.m"), least), "_shared")
    level = F.least(F.lit(depth), _needed(F.col("_own"), F.col("_to.m"), least))
    each = each.filter((F.col("_n") > 0) & (needed <= F.col("_n")) & (needed <= F.col("_to.most")))
    head = F.slice("_items", F.lit(1), F.col("_n") - needed + level)
    sets = F.when(level == 1, _combinations(head, 1))
    for k in range(2, depth + 1):
        sets = sets.when(level == k, _combinations(head, k))
    pair = ("_own", "_to.m") if s == "a" else ("_to.m", "_own")
    posted = each.select(*by, "name", "grams", "words", "_kind", F.col(pair[0]).alias("_ca"), F.col(pair[1]).alias("_cb"), F.explode(sets).alias("_x"))
    return _side(posted, by, s, "_kind", "_ca", "_cb", "_x").select("*", F.col("_x.part").alias("_part"), F.col("_x.at").alias(f"at_{s}")).drop("_x")


def _compared(a: DataFrame, b: DataFrame, by: list[str], least: Column, order: bool, blocks: int) -> DataFrame:
    """The rows of scored() from all pairs of a group, in salted blocks."""
    x = _side(a, by, "a").withColumn("_salt", F.pmod(F.xxhash64("name_a"), F.lit(blocks)))
    y = _side(b, by, "b").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = x.join(y, [*by, "_salt"])
    met = met.filter("name_a < name_b") if order else met
    met = met.withColumns({"dice": _dice(F.size(_shared("grams"))), "jac": _jaccard(F.size(_shared("words")))})
    found = met.select(*by, F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.greatest("dice", "jac").alias("s"))
    return found.filter(F.col("s") >= least)


def scored(left: DataFrame, right: DataFrame, least: Column | float, by: list[str] | None = None, order: bool = False) -> DataFrame:
    """(by..., a, b, s): pairs of names of left and right (by..., name) that agree in `by`, with a similarity s of `least` or more, over 0.

    least may be an expression of the columns of `by`.  order: only pairs with a < b.
    """
    by = by or []
    same = left is right
    a, b = [cut(left, by)] * 2 if same else together(left.sparkSession, lambda: cut(left, by), lambda: cut(right, by))
    least = F.greatest(F.lit(EPS), least if isinstance(least, Column) else F.lit(float(least)))
    n = [side.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n{k}")) for k, side in enumerate((a, b))]
    pairs = (n[0].join(n[1], by) if by else n[0].crossJoin(n[1])).agg(F.sum(F.col("n0").cast("double") * F.col("n1"))).first()[0] or 0  # without by: one row each
    if pairs <= ALL_PAIRS:
        return _compared(a, b, by, least, order, BLOCKS)
    direct = None
    if by:
        # groups of few names are compared as they are; the index is for the others
        few = materialize(n[0].join(n[1], by).filter(F.col("n0") * F.col("n1") <= FEW).select(*by), "small-groups")
        small = [side.join(few, by, "left_semi") for side in (a, b)]
        direct = _compared(*small, by, least, order, 1)
        a = materialize(a.join(few, by, "left_anti"), "name-parts")
        b = a if same else materialize(b.join(few, by, "left_anti"), "name-parts")
    parts = b.select(F.explode(F.concat(F.transform("grams", lambda x: F.concat(F.lit("g"), x)), F.transform("words", lambda x: F.concat(F.lit("w"), x)))).alias("part"))
    counts = materialize(parts.groupBy("part").agg(F.count(F.lit(1)).alias("df")), "part-counts")

    def placed(side: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
        # a row makes many postings: few rows must not lie in few files
        ordered = materialize(spread(_ordered(side, by, counts)), "parts-in-order")
        return ordered, _classes(ordered)

    (x, sizes_x), (y, sizes_y) = [placed(a)] * 2 if same else together(a.sparkSession, lambda: placed(a), lambda: placed(b))
    discard(counts)
    depth = 2 if pairs <= DEEP else 3
    # a name makes hundreds of postings, of which its file's size tells nothing: neither side may be sent to all tasks through the driver
    met = _posted(x, by, least, "a", sizes_y, depth).hint("merge").join(_posted(y, by, least, "b", sizes_x, depth), [*by, "_kind", "_ca", "_cb", "_part"])
    met = met.filter("name_a < name_b") if order else met
    gram = F.col("_kind") == "g"
    small = lambda kind: F.least(F.size(f"{kind}_a"), F.size(f"{kind}_b"))
    rest = lambda kind: F.size("_part") - 1 + F.least(F.size(f"{kind}_a") - F.col("at_a"), F.size(f"{kind}_b") - F.col("at_b"))
    both = lambda kind: F.size(f"{kind}_a") + F.size(f"{kind}_b")
    asked = F.when(gram, least * both("grams") / 2).otherwise(least * both("words") / (1 + least)) - EPS
    met = met.filter((F.when(gram, small("grams")).otherwise(small("words")) >= asked) & (F.when(gram, rest("grams")).otherwise(rest("words")) >= asked))
    met = met.withColumns({"_g": _shared("grams"), "_w": _shared("words")}).filter(F.slice(F.when(gram, F.col("_g")).otherwise(F.col("_w")), F.lit(1), F.size("_part")) == F.col("_part"))
    met = met.withColumns({"dice": _dice(F.size("_g")), "jac": _jaccard(F.size("_w"))})
    # pairs that the bigrams give are not given by the words again
    met = met.filter(F.when(gram, F.col("dice") >= least).otherwise((F.col("jac") >= least) & (F.col("dice") < least)))
    found = met.select(*by, F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.greatest("dice", "jac").alias("s"))
    return found if direct is None else found.unionByName(direct)


def alike(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None, order: bool = False) -> DataFrame:
    """(by..., a, b) of scored()."""
    return scored(left, right, least, by, order).drop("s")
