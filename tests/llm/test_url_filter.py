"""URL filter (op11): rules by plain Python, trees on planted URLs, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from arbelo.llm import url_filter
from arbelo.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, verdict_ string, score_ int"
LOWER = str.maketrans(url_filter.UPPER, url_filter.LOWER)
URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://A.COM/x", "http://com/", "https://notcom/", "ftp://x.example.com/en/1?q=1#f", "http://www.example.com/en/", "http://WWW.example.com/en/2", "http://awww.example.com/en/2",
    "http://b.net/es/1", "http://b.net/ES/1", "http://b.net/fr", "http://b.net/fr/?x", "http://b.net?/fr/", "http://b.net#/fr/", "a?b://c.net/es/", "x://y://z.net/es/", "http://é.net/fr/ü%20", "http://b.net:80/fr/", "http://u@b.net/fr/x\ny", "\nhttp://b.net/fr/",
    "http://" + "a." * 5000 + "net/es/" + "p/" * 20_000, "http://b.net/fr/", "http://b.net/fr/",
]


def told(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, rule and rule.host + rule.path, rule and rule.verdict


def test_rules_by_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "v", 1) for i, u in enumerate(URLS)], SCHEMA)
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = told(u, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
        assert 0 <= got[i].score <= 1


def planted(n, seed):
    """Blocked hosts are long, with digits and hyphens; allowed ones are short words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        bad = rng.random() < 0.4
        word = "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
        host = f"{word}-{rng.randrange(10**6)}-{rng.randrange(10**6)}.info" if bad else f"{word}.org"
        rows.append((i, f"http://{host}/{word}{'?a=1&b=2&c=3' if bad else ''}", "block" if bad else "allow"))
    return rows


def test_trees_learn_from_labelled_urls(spark):
    rows = planted(1500, 1)
    pages = url_filter.with_rules(spark.createDataFrame(rows, "page_id long, url string, kind string"), [])
    model = url_filter.fit(pages.filter("page_id < 1000"), label="kind")
    assert model.trees.getNumTrees == url_filter.TREES
    scored = model.score(pages.filter("page_id >= 1000"), "url", "host", "path").collect()
    right = sum((r.score >= url_filter.THRESHOLD) == (r.kind == "block") for r in scored)
    assert len(scored) == 500 and right >= 495


def test_same_table_same_scores(spark):
    pages = spark.createDataFrame([(i, u if i % 3 else u.replace(".org/", ".net/fr/").replace(".info/", ".com/"), "", 0) for i, u, _ in planted(400, 2)], SCHEMA)
    a, b = (sorted((r.page_id, r.verdict, r.score) for r in url_filter.report(pages.repartition(n), URL_RULES).collect()) for n in (2, 7))
    assert a == b and len({r[2] for r in a}) > 2


def test_entropy_and_counts(spark):
    texts = ["", "aaaa", "ab", "abcd1234", "ééz", "A.b-C/?"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter._entropy(F.col("t")).alias("e")).collect()]
    for t, e in zip(texts, got, strict=True):
        low = ["*" if ord(c) > 127 else c for c in t.translate(LOWER)]
        assert abs(e - sum(-c / len(low) * math.log2(c / len(low)) for c in Counter(low).values())) < 1e-9
    row = spark.createDataFrame([("https://www.a-b.com/x1/y.html?a=1&b=2#top",)], "url string").withColumns({"host": url_filter.url_host(F.col("url")), "path": url_filter.url_path(F.col("url"))})
    f = row.select(*[c.alias(k) for k, c in url_filter.features("url", "host", "path").items()]).first()
    assert (f.host_depth, f.path_depth, f.hyphens, f.parameters, f["values"], f.fragment, f.secure, f.www, f.tail_length, f.extension, f.closing_slash) == (2, 2, 1, 2, 2, 1, 1, 1, 6, 4, 0)


def test_labels_of_one_kind_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "v", 1), (2, "http://b.net/fr/1", "v", 1), (None, None, None, None)], SCHEMA)
    assert {(r.page_id, r.verdict) for r in url_filter.report(pages, URL_RULES).collect()} == {(1, "block"), (2, "block"), (None, "block")}
    assert {r.verdict for r in url_filter.report(pages, []).collect()} == {"allow"}
    assert url_filter.report(pages.filter("1 = 0"), URL_RULES).count() == 0
