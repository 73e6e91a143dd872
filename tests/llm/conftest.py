from __future__ import annotations

import pytest

ODD = [None, "", " \n\t", "a", "word " * 30_000, "x" * 50_000, "ÀÉ中🙂", "same text of some words here", "same text of some words here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short and very long texts, ties, repeated rows, null keys, clashing columns."""
    rows = [(i, t, "en", "s", 1, 0.5, True, "q", "r") for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 1, 0.5, True, "q", "r"), (None, "no key", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean, h string, _h string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")
