from __future__ import annotations

from arbelo.sources import readers


def test_rows_of_one_field_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c\n1;2;3\nlone\n4;;\n5;\n"x;y"\n"p;q";r;s\n"line\nbreak";t;u\n6;7;8;9\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("_linha").collect()
    assert [(r.a, r.b, r.c, r._linha) for r in rows] == [("1", "2", "3", 2), ("4", "", "", 4), ("5", "", "", 5), ("p;q", "r", "s", 7), ("line\nbreak", "t", "u", 8), ("6", "7", "8", 9)]
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).count() == 6


def test_one_column_files_keep_their_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("only\nx\ny\n")
    assert sorted(r.only for r in readers.read_csv(spark, str(tmp_path / "b.csv")).collect()) == ["x", "y"]


def test_files_of_one_name_in_two_folders_are_numbered_apart(spark, tmp_path):
    for k in ("p", "q"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "a.csv").write_text(f"a;b\n{k}1;x\n{k}2;y\n")
    rows = readers.read_csv(spark, str(tmp_path / "*" / "a.csv")).collect()
    assert sorted((r.a, r._file, r._linha) for r in rows) == [("p1", "a.csv", 2), ("p2", "a.csv", 3), ("q1", "a.csv", 2), ("q2", "a.csv", 3)]
    lines = readers.read_lines(spark, str(tmp_path / "*" / "a.csv")).collect()
    assert sorted((r.value, r._linha) for r in lines if r.value != "a;b") == [("p1;x", 2), ("p2;y", 3), ("q1;x", 2), ("q2;y", 3)]
