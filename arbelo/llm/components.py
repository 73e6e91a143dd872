"""Connected components by least-label propagation with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, materialize


def least_reachable(links: DataFrame) -> DataFrame:
    """(v, label) of every end of links(a, b): the smallest id that links reach from v.

    A round takes the least label among neighbours (partial minima leave each
    task, so a vertex with very many links is no hot group) and then the label
    of that label.  Each round is a table in the shared folder.
    """
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("v")).agg(F.min(F.col("v")).alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    last = labels
    while True:
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        far = labels.select(F.col("v").alias("l"), F.col("label").alias("ll"))
        after = materialize(step.join(far, "l", "left").select("v", "old", F.least("l", F.coalesce("ll", "l")).alias("label")), "labels")
        done = after.filter("label <> old").isEmpty()
        discard(last)
        last, labels = after, after.select("v", "label")
        if done:
            out = materialize(labels, "labels")
            discard(last, both)
            return out
