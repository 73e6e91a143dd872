"""Language identification (op10) of a handful of labelled rows, and the shared folder where none is set."""

from __future__ import annotations

import subprocess
import sys

from arbelo.llm import langid


def test_six_rows_in_three_languages(spark):
    texts = {"en": ["the cat and the dog are here", "this is what they think of it"], "fr": ["le chat et le chien sont ici", "voila ce que nous pensons de cela"], "de": ["der hund und die katze sind hier", "das ist was wir davon denken"]}
    ids = [i for i in range(1, 40) if __import__("zlib").crc32(str(i).encode()) % 5 != 0]
    rows = [(ids.pop(), t, lang) for lang, own in texts.items() for t in own]
    found = langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: lang for i, _, lang in rows}


def test_a_folder_of_its_own_where_none_is_set(tmp_path):
    """In a Spark of its own, without the machine's defaults."""
    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
from arbelo.llm import common
from arbelo.operators import tables
a, b = common.shared_folder(s), tables.shared_folder(s)
assert a == b and a.startswith("file:")
t = common.materialize(s.range(3), "t")
assert t.count() == 3
common.discard(t)
"""
    (tmp_path / "spark-defaults.conf").write_text("")
    import os

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=180)
