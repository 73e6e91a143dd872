"""Places of regex matches, and running sums, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """What join makes of the first 1, 2, ... items; kind: the array's type.

    Step k joins an item with the one 2^k before it, as the last step left it,
    so time grows as n log n; an accumulated array would be copied for every item.
    """
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(items), F.lit(1)))).cast("int") - 1))

    def step(have: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(have, lambda x, i: F.when(i >= back, join(F.get(have, i - back), x)).otherwise(x)).cast(kind)

    return F.aggregate(steps, items.cast(kind), step)


def match_spans(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start,end>> (code points, end exclusive) of the leftmost, non-overlapping matches.

    The pieces between matches and the matches themselves alternate, so running
    sums of their lengths give the places; another measure than the length
    counts in its own unit.  The pattern must not match the empty text.
    """

    def placed(hits: Column) -> Column:
        sizes = F.transform(hits, measure)
        gaps = F.slice(F.transform(F.split(text, pattern, F.lit(-1)), measure), F.lit(1), F.size(hits))
        ends = bind(F.zip_with(gaps, sizes, lambda g, h: g + h), lambda both: running(both, lambda a, b: a + b, "array<int>"))
        return F.zip_with(ends, sizes, lambda e, h: F.struct((e - h).alias("start"), e.alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return bind(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
