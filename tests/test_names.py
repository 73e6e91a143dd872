"""Pairs of names that share no bigram, against brute force."""

from __future__ import annotations

import pytest

from arbelo.functions import text as X
from arbelo.operators import search
from arbelo.plans import name_queries
from test_functions import jaro_winkler

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [7, 1_000])
def test_jaro_winkler_as_brute_force_on_all_names(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rows = name_queries.table(spark, SF, "part", X.normalise_name(name_queries.F.col("p_name")).alias("n")).distinct().collect()
    names = sorted(r.n for r in rows)
    wanted = {(a, b): v for i, a in enumerate(names) for b in names[i + 1 :] if (v := jaro_winkler(a, b)) >= 0.5}
    found = [(r.a, r.b, r.v) for r in name_queries.QUERIES["name_jw"](spark, SF).collect()]
    assert len(found) == len(wanted)
    assert {(a, b): v for a, b, v in found} == pytest.approx(wanted, abs=2e-6)


def test_edit_distance_needs_no_bigram(spark, tmp_path):
    spark.createDataFrame([("XA YB ZC UU",), ("RA SB TC WW",), ("MARTHA",), ("KLO",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [(r.a, r.b, r.v) for r in name_queries.QUERIES["name_levratio"](spark, str(tmp_path)).collect()] == [("RA SB TC WW", "XA YB ZC UU", round(6 / 11, 6))]


@pytest.mark.parametrize("sim", ["jw", "tsort"])
def test_candidates_without_a_common_bigram(spark, sim):
    queries = spark.createDataFrame([(1, "NEW RING")], "q long, query string")
    names = spark.createDataFrame([("RED WIDGET",), ("QQQQ",)], "nome string")
    found = {r.nome: r.s for r in search.candidates(queries, names, sim).collect()}
    assert set(found) == {"RED WIDGET"} and found["RED WIDGET"] > 0
