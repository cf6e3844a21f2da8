import pytest
from comparing import rows

from tablewright import ROW_ID, column_groups, deduplicate, group_summary, melt, pivot_table, read_csv, read_parquet, treat_missing
from tablewright.sources.sinks import write_csv, write_data_dictionary, write_parquet
from tablewright.sources.tables import clean_names, require_usable


def put(tmp_path, text, name="t.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_names():
    assert clean_names([" Net-Sales ", "net sales", "", "My\tCol  2", None, "net_sales"]) == [
        "net_sales", "net_sales_2", "column", "my_col_2", "none", "net_sales_3",
    ]
    assert clean_names(["a", "A", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


@pytest.fixture
def business(tmp_path):
    import datetime

    lines = ["date,region,revenue,cost,group"]
    for i in range(36):
        day = datetime.date(2023 + i // 12, i % 12 + 1, 1)
        lines.append(f"{day},{['West', 'East', 'North'][i % 3]},{'' if i == 5 else 100 + 10 * i},{50 + 4 * i},{'AB'[i % 2]}")
    return put(tmp_path, "\n".join(lines) + "\n", "business.csv")


def test_business_file(spark, business):
    df = read_csv(spark, business)
    assert [f.dataType.simpleString() for f in df.schema] == ["timestamp_ntz", "string", "double", "bigint", "string"]
    assert tuple(column_groups(df)) == (["revenue", "cost"], ["region", "group"], ["date"])
    assert treat_missing(df, "revenue", "Drop rows").count() == 35
    assert dict(rows(group_summary(df, ["region"], ["revenue"], "sum"))) == {"West": 3180, "East": 3300, "North": 3270}
    assert pivot_table(df, ["group"], "region", "cost", "sum").count() == 2
    assert melt(df, ["date"], ["revenue", "cost"]).count() == 72


def test_headers(spark, tmp_path):
    assert read_csv(spark, put(tmp_path, "a,a,,A,a\n1,2,3,4,5\n")).columns == ["a", "a.1", "unnamed:_2", "a_2", "a.2"]


def test_long_quoted_cells(spark, tmp_path):
    cell = '"' + 'say ""hi"", ' * 20_000 + '"'
    df = read_csv(spark, put(tmp_path, f"t,n\n{cell},1\n{cell},2\n"))
    assert df.count() == 2 and len(df.first()["t"]) == len('say "hi", ') * 20_000


def test_types_and_missing_tokens(spark, tmp_path):
    path = put(tmp_path, 'A,a,b,flag,none,id\n1,x,1.5,True,,007\nNA,NaN,1e3,FALSE,null,5d\n3,"",n/a,TRUE,,1\n')
    df = read_csv(spark, path)
    assert df.columns == ["a", "a_2", "b", "flag", "none", "id"]
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string", "double", "boolean", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1.0, "x", 1.5, True, None, "007"), (None, None, 1000.0, False, None, "5d"), (3.0, None, None, True, None, "1"),
    ]


def test_latin1(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "Café,n\nñandú,1\n", encoding="latin-1"))
    assert df.columns == ["café", "n"] and df.first()[0] == "ñandú"
    assert read_csv(spark, put(tmp_path, "﻿Café,n\nñandú,1\n", "u.csv")).columns == ["café", "n"]


def test_quoting(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, 'a,b\n"x, ""y""",1\n5" pipe,2\n'))
    assert [tuple(r) for r in df.collect()] == [('x, "y"', 1), ('5" pipe', 2)]
    spanning = read_csv(spark, put(tmp_path, 'a,b\n"two\nlines",1\nx,2\n', "s.csv"))
    assert [tuple(r) for r in spanning.collect()] == [("two\nlines", 1), ("x", 2)]


@pytest.mark.parametrize("text", ["", "\n\n", 'a,b\n"open,1\nx,2\n', "a,b\n1,2,3\n"])
def test_unreadable_files_are_rejected(spark, tmp_path, text):
    with pytest.raises(ValueError):
        read_csv(spark, put(tmp_path, text))


def test_headers_only_is_not_usable(spark, tmp_path):
    with pytest.raises(ValueError):
        require_usable(read_csv(spark, put(tmp_path, "a,b\n")))


def test_dates_are_inferred_conservatively(spark, tmp_path):
    lines = ["order_date,created_time,code,birth_year"] + [f"2025-01-{d:02d},01/{d:02d}/2025 10:30,2025-01-{d:02d},19{d}" for d in range(10, 20)]
    lines += ["soon,01/20/2025 10:30,x,1999"]
    df = read_csv(spark, put(tmp_path, "\n".join(lines)))
    assert [f.dataType.simpleString() for f in df.schema] == ["timestamp_ntz", "timestamp_ntz", "string", "bigint"]
    assert df.filter("order_date is null").count() == 1 and df.filter("created_time is null").count() == 0


def test_row_order(spark, tmp_path):
    path = put(tmp_path, "k,v\n" + "".join(f"{i % 3},{100 - i}\n" for i in range(30)))
    df = read_csv(spark, path, row_id=True)
    assert rows(deduplicate(df, ["k"]), "k", "v") == [(0, 100), (1, 99), (2, 98)]
    assert rows(deduplicate(df.repartition(5), ["k"], "last"), "k", "v") == [(0, 73), (1, 72), (2, 71)]
    out = str(tmp_path / "p")
    write_parquet(df, out)
    again = read_parquet(spark, out, row_id=True)
    assert again.columns == ["k", "v", ROW_ID]
    assert rows(deduplicate(again, ["k"]), "k", "v") == [(0, 100), (1, 99), (2, 98)]


def test_sinks(spark, frame, tmp_path):
    write_csv(frame, str(tmp_path / "c"))
    again = read_csv(spark, str(tmp_path / "c"))
    assert again.columns == ["region", "group", "revenue", "cost", "code"] and again.count() == 6
    assert again.filter("revenue is null").count() == 1
    write_data_dictionary(frame, str(tmp_path / "d"))
    assert read_csv(spark, str(tmp_path / "d")).columns == ["field", "dtype", "non_null", "unique"]


def test_files_in_another_order_of_fields(spark, tmp_path):
    put(tmp_path, "region,revenue\nWest,1\n", "a.csv")
    put(tmp_path, "revenue,region\n30,North\n", "b.csv")
    df = read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("region", "revenue").collect())) == [("North", 30), ("West", 1)]
    put(tmp_path, "revenue,place\n30,North\n", "c.csv")
    with pytest.raises(ValueError, match="same fields"):
        read_csv(spark, str(tmp_path))
