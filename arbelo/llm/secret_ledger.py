r"""Secret scans (operator 9): an incremental blob ledger, DataFrame functions only.

Every version of a text is a blob named by its SHA-256.  The ledger, an
append-only Parquet table partitioned by a blob's first byte, holds for each
blob the rule versions it was scanned with and what they found.  A run hashes
all texts, takes one row per blob (the smallest key), drops the (blob, rule
version) pairs that the ledger knows, scans the rest, appends the result, and
joins the findings back to all rows that hold the blob.  Of the ledger, a run
opens only the partitions that its blobs fall in, and groups only its blobs'
entries (semi-joined first), so history that it does not touch is not shuffled.
A run that fails commits nothing; the next one scans the same pairs.

Edge cases: null counts as empty; repeated rows share a blob; a null key gets
its row too; a changed rule gets a new version and is the only one scanned
again; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, fold, materialize, new_folder
from arbelo.llm.spans import bind, match_spans


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    part: int = 0  # the group whose length counts
    least: int = 0  # and how long it must be
    needs: str = ""  # a text without this cannot match

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # whole runs of 24 or more: the same as dropping shorter runs
]
ADDED = [
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", needs="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("map_key", 1, r"AIza[A-Za-z0-9_-]{35}", needs="AIza"),
    Rule("live_key", 1, r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", needs="k_"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]{3,}+@[A-Za-z0-9.-]+", needs="://"),
]
RULES = [*BASE, *ADDED]

#: Partitions of the ledger.
PARTS = 256
_FOUND = "array<struct<start:int,end:int>>"


def _scan(text: Column, rule: Rule) -> Column:
    spans = match_spans(text, F.lit(rule.pattern))
    if rule.least:
        parts = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part)), lambda x: F.length(x) >= rule.least)
        spans = bind(spans, lambda own: F.when(F.size(own) > 0, F.filter(F.zip_with(own, parts, lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())).otherwise(own))
    return F.when(F.contains(text, F.lit(rule.needs)), spans) if rule.needs else spans


def _named(spans: Column, rule: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _part(blob: str) -> Column:
    """The ledger's partition of a blob: its first byte in hex."""
    return F.hex(F.substring(blob, 1, 1))


def _entries(seen: DataFrame, blobs: DataFrame) -> DataFrame:
    """The ledger's rows of some blobs (a table on disk; there are 256 partitions at most to name)."""
    parts = [r.p for r in blobs.select(_part("blob").alias("p")).distinct().collect()]
    return seen.filter(F.col("part").isin(parts)).join(blobs.select("blob"), "blob", "left_semi")


def update(docs: DataFrame, ledger: str, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> None:
    """Scans the unseen (blob, rule version) pairs of docs and appends them."""
    spark = docs.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    rows = docs.select(F.col(key).alias("key"), _blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    todo = rows.groupBy("blob").agg(F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"))).alias("first"))
    temporary = []
    if (seen := read(spark, ledger)) is not None:
        todo = materialize(todo, "run-blobs")
        temporary.append(todo)
        known = _entries(seen, todo).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        todo = todo.join(known, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))))
    else:
        todo = todo.withColumn("rules", names)
    todo = todo.filter(F.size("rules") > 0).select(F.col("blob").alias("unseen"), F.col("first.key").alias("first"), "rules")
    on = (F.col("blob") == F.col("unseen")) & F.col("key").eqNullSafe(F.col("first"))
    texts = rows.join(todo.hint("shuffle_hash"), on).select("blob", "rules", "text")
    found = [F.when(F.array_contains("rules", r.name), _scan(F.col("text"), r)).alias(r.kind) for r in rules]
    spread = texts.select("blob", "rules", *found)
    pieces = [_named(F.coalesce(F.col(r.kind), F.array().cast(_FOUND)), r.name) for r in rules]
    out = spread.select(_part("blob").alias("part"), "blob", "rules", F.concat(*pieces).alias("found"))
    # one shuffle of findings: a partition of the ledger is written by one task, and blobs of rows that repeat a key fall together there
    out.repartition(PARTS, "part").dropDuplicates(["part", "blob"]).write.mode("append").partitionBy("part").parquet(ledger)
    discard(*temporary)


def read(spark, ledger: str) -> DataFrame | None:
    """The ledger's table; None before its first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("blob binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>, part string").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and found (rule, start, end; by start, then the rules' order) of every row of docs."""
    spark = docs.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = read(spark, ledger)
    placed = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.array_position(names, x["rule"]).alias("rank"), x["end"].alias("end"), x["rule"].alias("rule")))
    # a table of its own, so that the join below meets plain rows on both sides and a blob with very many paths can be split
    # two runs at once may have scanned a blob under one rule: equal findings stand side by side once sorted
    once = lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1)))
    named = materialize(docs.select(F.col(key), _blob(text).alias("blob")), "named-rows")
    runs = _entries(seen, named.select("blob").distinct()).select("blob", F.filter(placed, lambda x: x["rank"] > 0).alias("found")).groupBy("blob").agg(bind(F.array_sort(F.flatten(F.collect_list("found"))), once).alias("found"))
    by_blob = materialize(runs, "findings")
    return named.join(by_blob, "blob", "left").select(key, "found")


def report(docs: DataFrame, key: str = "doc_id", ledger: str | None = None, rules: list[Rule] = RULES, increments: int = 2) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of every row; the rows come to the ledger in some increments, by a hash of the key."""
    ledger = ledger or new_folder(docs.sparkSession, "blob-ledger")
    for n in range(increments):
        update(docs.filter(fold(key, increments) == n), ledger, rules, key)
    found = findings(docs, ledger, rules, key)
    base = [r.name for r in BASE]
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.split_part(x["rule"], F.lit("@"), F.lit(1)), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda r: F.size(F.filter("found", lambda x: x["rule"] == r.name)).cast("long").alias(f"n_{r.kind}")
    return found.select(key, *[count(r) for r in BASE], F.sha2(told(F.filter("found", lambda x: x["rule"].isin(base))).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
