import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tablewright import ROW_ID, read_csv
from tablewright.sources import quoted_lines, tables


def text_of(cells, end="\n"):
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator=end).writerows(cells)
    return buffer.getvalue()


def planted(seed, count):
    """Cells with line ends, commas, quotes, blank lines and lines that look like records."""
    rng = random.Random(seed)
    bits = ["a", "b,c", '"', '""', "\n", "\n\n", "x,y,z", ',"', '",', "word " * 5, "é", "5\" pipe"]
    return [[str(i), "v" + "".join(rng.choices(bits, k=rng.randint(0, 9))) + "v", str(i % 7)] for i in range(count)]


def in_splits(spark, size):
    return {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def splits(spark):
    before = {k: spark.conf.get(k) for k in in_splits(spark, 1)}

    def use(size):
        for key, value in in_splits(spark, size).items():
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [13, 61, 400, 10**8])
def test_any_split_gives_the_same_records(spark, tmp_path, splits, size):
    cells = [["id", "note", "k"], *planted(size, 60)]
    path = tmp_path / "t.csv"
    path.write_text(text_of(cells), encoding="utf-8")
    splits(size)
    df = read_csv(spark, str(path), row_id=True)
    assert df.schema["id"].dataType.simpleString() == "bigint"
    found = df.orderBy(ROW_ID).select(F.col("id").cast("string"), "note", F.col("k").cast("string")).collect()
    assert [list(r) for r in found] == cells[1:]
    if size == 61:
        assert df.rdd.getNumPartitions() > 8


def test_a_cell_longer_than_many_splits(spark, tmp_path, splits):
    cells = [["a", "b"], ["1", "x\n" * 500 + "end"], ["2", "y"], ["3", '"q"\n,"' * 40]]
    (tmp_path / "t.csv").write_text(text_of(cells))
    splits(37)
    assert [list(map(str, r)) for r in read_csv(spark, str(tmp_path), row_id=True).orderBy(ROW_ID).select("a", "b").collect()] == cells[1:]


def test_several_files_orders_and_headers_over_lines(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text(text_of([["two\nlines", "n"], ["p\nq", "1"], ["r", "2"]]))
    (tmp_path / "b.csv").write_text("\n\n" + text_of([["n", "two\nlines"], ["3", "s\n\nt"]], "\r\n"), newline="")
    (tmp_path / "c.csv").write_bytes("﻿".encode() + text_of([["two\nlines", "n"], ["é", "4"]]).encode())
    for size in (7, 10**8):
        splits(size)
        df = read_csv(spark, str(tmp_path))
        assert df.columns == ["two_lines", "n"]
        assert sorted(map(tuple, df.collect())) == [("p\nq", 1), ("r", 2), ("s\n\nt", 3), ("é", 4)]


def test_latin1_and_missing_cells(spark, tmp_path, splits):
    (tmp_path / "t.csv").write_bytes('a,b,c\n"ñ\n",,1\n"",NA\n"x\ny",5" pipe,3\n'.encode("latin-1"))
    splits(9)
    found = read_csv(spark, str(tmp_path / "t.csv"), row_id=True).orderBy(ROW_ID).select("a", "b", "c").collect()
    assert [tuple(r) for r in found] == [("ñ\n", None, 1.0), (None, None, None), ("x\ny", '5" pipe', 3.0)]


@pytest.mark.parametrize("size", [11, 10**8])
def test_a_cell_that_is_never_closed(spark, tmp_path, splits, size):
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",1\n' + "p,2\n" * 9 + '"open,3\nq,4\n')
    splits(size)
    with pytest.raises(ValueError, match="never closed"):
        read_csv(spark, str(tmp_path / "t.csv"))


def walked(line, state):
    """Whether the line ends inside quotes, one character after the other; C: a cell begins, U: inside a bare one."""
    for place, char in enumerate(line):
        if state == "escape":
            state = "Q"
        elif state == "Q":
            doubled = line[place + 1:place + 2] == '"'
            state = "Q" if char != '"' else "escape" if doubled else "U"
        else:
            state = "," if char == "," else "Q" if char == '"' and state in ("C", ",") else "U"
    return state in ("Q", "escape")


def test_states_of_a_line(spark):
    rng = random.Random(5)
    lines = ["", '"', '""', '"""', '5" pipe,"x', 'x","y', '"a"b"c', '"a,""",b', *("".join(rng.choices('"",,ax ', k=rng.randint(1, 12))) for _ in range(3000))]
    shown = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select(
        "i", quoted_lines.left_open(F.col("line")).alias("outside"),
        quoted_lines.left_open(F.concat(F.lit(quoted_lines.INSIDE), "line")).alias("inside"))
    for row in shown.collect():
        line = lines[row["i"]]
        assert (row["outside"], row["inside"]) == (walked(line, "C"), walked(line, "Q")), line
        assert row["outside"] == quoted_lines.is_left_open(line)


def test_lines_are_searched_once_and_only_for_single_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n""y"", z\n"\n2,"""w"""\n')
    lines = spark.read.text(str(tmp_path))
    checks = tables._line_checks(lines)
    assert checks.first().asDict() == {"undecodable": 0, "open_lines": 2, "widest": 2}
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    shown = {r["text"]: r["ends"] for r in quoted_lines._numbered(lines, "UTF-8").collect()}
    assert shown == {"a,b": 2, '1,"x': 1, '""y"", z': 2, '"': 1, '2,"""w"""': 0}
