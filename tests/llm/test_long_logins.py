from __future__ import annotations

from arbelo.llm import secret_ledger


def test_logins_of_any_length(spark):
    texts = [f"see https://bob:{'x' * n}@host.example/a" for n in (3, 64, 65, 93, 5_000)] + [f"ftp://{'u' * 70}:abc@h", "http://a:bc@h"]
    rows = secret_ledger.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.doc_id for r in sorted(rows) if "url_login:" in r.spans] == [0, 1, 2, 3, 4, 5]
    assert {r.doc_id: r.spans for r in rows}[3] == f"url_login:4:{4 + len('https://bob:@host.example') + 93}"
