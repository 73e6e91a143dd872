"""CSV files read by splits, against a reader of one character at a time."""

from __future__ import annotations

import json
import random

import pytest

from arbelo.sources import readers


def by_character(text, sep=";"):
    """(number, fields) of the rows after the header; empty lines do not count, rows of one field do."""
    rows, row, field, inside, i, some = [], [], "", False, 0, False
    text = text.replace("\r", "")
    while i < len(text):
        c = text[i]
        some = some or c != "\n"
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                inside = False
            else:
                field += c
        elif c == '"':
            inside = True
        elif c == sep:
            row, field = [*row, field], ""
        elif c == "\n":
            if some:
                rows.append([*row, field])
            row, field, some = [], "", False
        else:
            field += c
        i += 1
    if some:
        rows.append([*row, field])
    return [(k, r) for k, r in enumerate(rows[1:], 2) if len(r) > 1]


def some_field(rng):
    kind = rng.random()
    if kind < 0.35:
        return "".join(rng.choices("abçé 1", k=rng.randint(0, 8)))
    inside = "".join(rng.choices(["a", "b", ";", "\n", "\r\n", '""', " ", "é"], k=rng.randint(0, 12)))
    return f'"{inside}"' if kind < 0.9 else f'x"{inside}"y'


@pytest.mark.parametrize("size", ["64", "257", "128m"])
def test_as_by_character(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for name in ("a.csv", "b.csv"):
        lines = ["p;q;r"] + [";".join(some_field(rng) for _ in range(rng.choice([1, 2, 3, 3, 3, 4]))) if rng.random() < 0.95 else "" for _ in range(250)]
        text = "\n".join(lines) + rng.choice(["", "\n"])
        (tmp_path / name).write_bytes(text.encode())
        want |= {(name, k): [*r, "", ""][:3] for k, r in by_character(text)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_csv(spark, f"{tmp_path}/*.csv")
        rows = df.collect()
        assert (spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 20) == (size != "128m")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == len(want) and {(r._file, r._linha): [r.p, r.q, r.r] for r in rows} == want


def test_a_row_over_many_splits(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;b\n1;\"" + "line\n" * 400 + "\"\n2;x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("_linha").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.a, r.b, r._linha) for r in rows] == [("1", "line\n" * 400, 2), ("2", "x", 3)]


def test_first_array_of_a_json_object(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"when": "x", "itens": [{"a": 1}, {"a": 2}], "also": [{"b": 3}]}))
    kind, rows = readers.read_source(spark, str(tmp_path / "f.json"))
    assert kind == "tabela" and [(r.a, r._linha) for r in rows.orderBy("_linha").collect()] == [("1", 1), ("2", 2)]
