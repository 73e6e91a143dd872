"""URL filters (operator 11): ordered host and path rules, and gradient-boosted trees where no rule fits.  DataFrame functions only.

A URL's host stands after its first `://` (A-Z lower-cased), its path up to `?`,
`#` or the end.  A rule (host, path, verdict) fits its host and all subdomains,
if the URL's path starts with the rule's; of those that fit, the longest wins.

URLs under a rule are the labelled ones.  Of their distinct URLs a sample of at
most `SAMPLE` (a documented bound), chosen by a hash of the URL, trains boosted
trees on lexical features: lengths, depths, shares of digits and marks, entropy
of the characters, numbers of parameters, and statistics of the host's suffixes
(how often the last one, two and three labels were blocked, shrunken to the mean;
a training URL sees those of the other half of the sample only).  The sample is
sorted into one partition, so that the same table gives the same trees.  Suffix
statistics have at most `3 * SAMPLE` rows and are broadcast; all else is one pass
over the URLs without a shuffle, so hosts of any size stay spread.

Edge cases: a null URL, or one without `://`, has an empty host and path and no
rule; without labels of both kinds the verdict where no rule fits is the labels'
own, `allow` without any; texts of any length are measured whole; repeated rows
each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.llm.common import discard, free_name, materialize
from arbelo.llm.spans import bind

SAMPLE = 20_000
TREES, DEPTH, STEP, LEAST_ROWS = 20, 4, 0.2, 5
#: Suffix statistics count as many URLs of the mean as this.
SHRINK = 5.0
THRESHOLD = 0.5
SUFFIXES = (1, 2, 3)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./?&=%_:#-*"
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<name,verdict> of the longest rule that fits, or null; of rules of one length the first by name."""

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))

    none = F.lit(None).cast("struct<name:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    found = [F.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*found, none)


def with_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url", into: tuple[str, str, str, str] = ("host", "path", "rule", "rule_verdict")) -> DataFrame:
    """All columns of pages; host, path, rule, and the rule's verdict (null where none fits)."""
    host, path, rule, verdict = into
    for c in into:
        if c in pages.columns:
            raise ValueError(f"pages already has a column {c}")
    found = free_name(pages, "_rule")
    out = pages.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))}).withColumn(found, rule_of(F.col(host), F.col(path), rules))
    return out.withColumns({rule: F.col(f"{found}.name"), verdict: F.col(f"{found}.verdict")}).drop(found)


def suffix(host: Column, labels: int) -> Column:
    """The host's last labels, with their number in front."""
    return F.concat(F.lit(f"{labels}:"), F.substring_index(host, ".", -labels))


def _entropy(text: Column) -> Column:
    """Bits a character, over a-z, 0-9 and the usual marks; all others count as one character."""
    classed = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9./?&=%_:#-]", "*")
    each = F.array(*[F.lit(c) for c in SYMBOLS])

    def of(t: Column) -> Column:
        p = F.transform(each, lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.greatest(F.length(t), F.lit(1)))
        return F.aggregate(p, F.lit(0.0), lambda sum_, x: sum_ - F.when(x > 0, x * F.log2(x)).otherwise(0.0))

    return bind(classed, of)


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def features(url: str, host: str, path: str) -> dict[str, Column]:
    """The lexical features of a URL by name."""
    whole, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(whole, r"(?s)\?([^#]*)", 1)
    tail = F.regexp_extract(p, r"(?s)([^/]*)/*\z", 1)

    def share(text: Column, marks: str) -> Column:
        return _count(text, marks) / F.greatest(F.length(text), F.lit(1))

    return {
        "length": F.log1p(F.length(whole)), "host_length": F.length(h), "path_length": F.log1p(F.length(p)), "query_length": F.log1p(F.length(query)),
        "host_depth": _count(h, "."), "path_depth": _count(p, "/"), "host_digits": share(h, "0123456789"), "path_digits": share(p, "0123456789"), "hyphens": _count(h, "-"),
        "host_entropy": _entropy(h), "path_entropy": _entropy(p), "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")), "values": _count(query, "="),
        "escapes": _count(whole, "%"), "fragment": (F.locate("#", whole) > 0).cast("int"), "secure": F.startswith(whole, F.lit("https")).cast("int"), "www": F.startswith(h, F.lit("www.")).cast("int"),
        "tail_length": F.length(tail), "extension": F.when(F.locate(".", tail) > 0, F.length(F.substring_index(tail, ".", -1))).otherwise(0), "closing_slash": F.endswith(p, F.lit("/")).cast("int"),
        "upper_case": share(whole, UPPER),
    }


def _with_suffixes(rows: DataFrame, known: DataFrame, mean: float, half: bool) -> DataFrame:
    """rows with each suffix's shrunken share of blocked URLs and count; known: suffix, half, n, y, few rows."""
    for k in SUFFIXES:
        own = known.select(F.col("suffix").alias(f"_s{k}"), *([F.col("half").alias("half")] if half else []), F.col("n").alias(f"_n{k}"), F.col("y").alias(f"_y{k}"))
        rows = rows.withColumn(f"_s{k}", suffix(F.col("_host"), k)).join(F.broadcast(own), [f"_s{k}", *(["half"] if half else [])], "left")
    n = {k: F.coalesce(F.col(f"_n{k}"), F.lit(0)) for k in SUFFIXES}
    return rows.withColumns({f"suffix_{k}": (F.coalesce(F.col(f"_y{k}"), F.lit(0)) + SHRINK * mean) / (n[k] + SHRINK) for k in SUFFIXES} | {f"suffix_{k}_urls": F.log1p(n[k]) for k in SUFFIXES})


class UrlModel(NamedTuple):
    """Boosted trees and suffix statistics, or a constant where labels are of one kind."""

    trees: object | None
    known: DataFrame | None
    mean: float
    columns: list[str]

    def score(self, pages: DataFrame, url: str, host: str, path: str, into: str = "score") -> DataFrame:
        """All columns of pages and how likely each URL is to be blocked, 0 to 1."""
        if into in pages.columns:
            raise ValueError(f"pages already has a column {into}")
        if self.trees is None:
            return pages.withColumn(into, F.lit(self.mean))
        whole = free_name(pages, "_page")
        rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias(whole), F.col(host).alias("_host"), *[c.cast("double").alias(k) for k, c in features(url, host, path).items()])
        rows = _with_suffixes(rows, self.known, self.mean, False)
        out = self.trees.transform(VectorAssembler(inputCols=self.columns, outputCol="features").transform(rows))
        return out.select(f"{whole}.*", F.element_at(vector_to_array(F.col("probability")), 2).alias(into))


def fit(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path", label: str = "rule_verdict") -> UrlModel:
    """Learns from the URLs that have a label: `block` or `allow`."""
    rows = pages.filter(F.col(label).isNotNull() & F.col(url).isNotNull())
    rows = rows.groupBy(F.col(url).alias("_url"), F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.max((F.col(label) == BLOCK).cast("int")).alias("y"))
    sample = rows.orderBy(F.xxhash64("_url"), "_url").limit(SAMPLE)
    sample = materialize(sample.withColumn("half", F.pmod(F.crc32(F.col("_url").cast("binary")), F.lit(2)).cast("int")), "url-sample")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < blocked < n:
        discard(sample)
        return UrlModel(None, None, blocked / n if n else 0.0, [])
    mean = blocked / n
    each = sample.select("half", "y", F.explode(F.array_distinct(F.array(*[suffix(F.col("_host"), k) for k in SUFFIXES]))).alias("suffix"))
    known = materialize(each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("y")), "url-suffixes")
    other = each.groupBy("suffix", (1 - F.col("half")).alias("half")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    measured = _with_suffixes(sample.select("_url", "_host", "half", "y", *[c.cast("double").alias(k) for k, c in features("_url", "_host", "_path").items()]), other, mean, True)
    columns = [*features("_url", "_host", "_path"), *[f"suffix_{k}" for k in SUFFIXES], *[f"suffix_{k}_urls" for k in SUFFIXES]]
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(measured).select("_url", "y", "features")
    ready = materialize(ready.coalesce(1).sortWithinPartitions("_url"), "url-training")  # SAMPLE rows at most
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=LEAST_ROWS, seed=11).fit(ready.select("y", "features"))
    discard(sample, ready)
    return UrlModel(trees, known, mean, columns)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", model: UrlModel | None = None) -> DataFrame:
    """All columns of pages; host, path, rule, score (of the trees, for every URL) and verdict."""
    ruled = with_rules(pages, rules, url, ("host", "path", "rule", "_rule_verdict"))
    model = model or fit(ruled, url, label="_rule_verdict")
    scored = model.score(ruled, url, "host", "path")
    own = F.when(F.col("score") >= THRESHOLD, BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce("_rule_verdict", own)).drop("_rule_verdict")


def report(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score of every row."""
    out = judge(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), rules)
    return out.select(F.col("key").alias(key), "host", "path", "rule", "verdict", "score")
