"""Sparse CSV files: goldens, edge cases, round trips."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rowtide.functions.names import check_table_name, normalize_columns, normalize_names
from rowtide.sources.sparse_csv import (
    SparseFormat,
    iter_chunks,
    iter_rows,
    read_sparse_csv,
    with_chunks,
    write_sparse_csv,
)


@pytest.fixture
def put(tmp_path):
    def write(text, name="in.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
        return str(path)

    return write


def read(spark, path, **options):
    return [
        tuple(r)[1:] for r in read_sparse_csv(spark, path, **options).orderBy("row_index").collect()
    ]


SERIES = """name,age,city,timestamp,value
Alice,30,Beijing,1000,10.5
,,,1100,20.0
Bob,,,1200,
,,Shanghai,1300,40.0
Charlie,25,,1400,50.0
,,,1500,60.0
,27,,1600,70.0
David,35,Shenzhen,1700,80.0
,,,1800,90.0
,,,1900,100.0
"""


def test_hinted_golden(spark, put):
    path = put("name,age,city,score\nAlice,30,Beijing,95\n,,Shanghai,\nBob,25,,\n,27,Guangzhou,88\n")
    df = read_sparse_csv(spark, path, type_hints={"age": int, "score": "int"})
    assert dict(df.dtypes)["age"] == "bigint"
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [
        (0, "Alice", 30, "Beijing", 95),
        (1, "Alice", 30, "Shanghai", 95),
        (2, "Bob", 25, "Shanghai", 95),
        (3, "Bob", 27, "Guangzhou", 88),
    ]


def test_series_golden_with_inference(spark, put):
    df = read_sparse_csv(spark, put(SERIES))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "string", "bigint", "double"]
    got = [tuple(r)[1:] for r in df.orderBy("row_index").collect()]
    assert got[:4] == [
        ("Alice", 30, "Beijing", 1000, 10.5),
        ("Alice", 30, "Beijing", 1100, 20.0),
        ("Bob", 30, "Beijing", 1200, 20.0),
        ("Bob", 30, "Shanghai", 1300, 40.0),
    ]
    assert got[6] == ("Charlie", 27, "Shanghai", 1600, 70.0)
    assert got[9] == ("David", 35, "Shenzhen", 1900, 100.0)


def test_ragged_golden(spark, put):
    path = put("t1,t2,t3,t4,t5\n1,2,3,4,5\n,,6,7,\n6,7,8,9,10\n11,12,13,14,15\n,,,,,\n,,16,,,\n16,17,18,19,20\n")
    assert read(spark, path) == [
        (1, 2, 3, 4, 5),
        (1, 2, 6, 7, 5),
        (6, 7, 8, 9, 10),
        (11, 12, 13, 14, 15),
        (11, 12, 13, 14, 15),
        (11, 12, 16, 14, 15),
        (16, 17, 18, 19, 20),
    ]


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("a,b\n,1\n,\n", {}, [(None, 1), (None, 1)]),
        ("a,b\nx,1\nNULL,\n,\n", {}, [("x", 1), (None, 1), (None, 1)]),
        ("a,b\nx,1\n\ny,2\n", {}, [("x", 1), ("x", 1), ("y", 2)]),
        ("a,b\nx,1\n \t,2\n", {}, [("x", 1), ("x", 2)]),
        ("a,b\nx,1\n ,2\n", {"inherit": "empty"}, [("x", 1), (" ", 2)]),
        ("a,b\n ,1\n,2\nx,3\n", {}, [(None, 1), (None, 2), ("x", 3)]),
        ("a,b\nx,1\n-,2\n ,3\n", {"inherit": "marker", "marker": "-"}, [("x", 1), ("x", 2), (" ", 3)]),
        ("a,b\nx,1\n?,2\n", {"inherit": lambda c: c == "?"}, [("x", 1), ("x", 2)]),
        ("a,b,c\nx,1,2\ny,3\nz,4,5,6\n", {}, [("x", 1, 2), ("y", 3, 2), ("z", 4, 5)]),
        ('a,b\n"p,q",1\n"say ""hi""",\n"",2\n', {}, [("p,q", 1), ('say "hi"', 1), ('say "hi"', 2)]),
        ("a;b\n'p;q';1\n;2\n", {"delimiter": ";", "quote": "'"}, [("p;q", 1), ("p;q", 2)]),
        ("a,b\n1,0\nabc,2\n", {}, [("1", 0), ("abc", 2)]),
        ("a,b\n0,true\n1,no\n", {}, [(0, True), (1, False)]),
        ("a,b\n1d,0x1p3\n2,1e-5\n", {}, [("1d", "0x1p3"), ("2", "1e-5")]),
        ("a,b\n1,nan\n2.5,inf\n", {"infer": False}, [("1", "nan"), ("2.5", "inf")]),
        ("x,1\n,2\n", {"has_header": False}, [("x", 1), ("x", 2)]),
        ("a,b\nx,1\n,2\n,3\ny,4\n", {"skip_rows": 2}, [(None, 3), ("y", 4)]),
        ("a,b\r\nx,1\r\n,2\r\n", {}, [("x", 1), ("x", 2)]),
    ],
)
def test_edge_cases(spark, put, text, options, want):
    assert read(spark, put(text), **options) == want


def test_no_header_names_and_given_names(spark, put):
    path = put("x,1\n,2\n")
    assert read_sparse_csv(spark, path, has_header=False).columns == ["row_index", "_c0", "_c1"]
    assert read_sparse_csv(spark, path, has_header=False, columns=["p", "q"]).columns[1:] == ["p", "q"]


def test_empty_inputs(spark, put):
    assert read_sparse_csv(spark, put("")).count() == 0
    df = read_sparse_csv(spark, put("a,b\n"), type_hints={"b": float})
    assert df.columns == ["row_index", "a", "b"] and df.count() == 0


def test_hint_breach_names_row_and_column(spark, put):
    path = put("name,age\na,1\nb,x\n")
    with pytest.raises(Exception, match="row 1, column 'age'"):
        read_sparse_csv(spark, path, type_hints={"age": int}).collect()
    assert read(spark, path, type_hints={"age": int}, on_error="null") == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        read_sparse_csv(spark, path, type_hints={"agee": int})


def test_quoted_line_breaks_and_other_encodings(spark, put):
    assert read(spark, put('a,b\n"p\nq",1\n,2\n'), multi_line=True) == [("p\nq", 1), ("p\nq", 2)]
    path = put("a,b\nüé,1\n,2\n", encoding="latin-1")
    assert read(spark, path, encoding="latin-1") == [("üé", 1), ("üé", 2)]
    with pytest.raises(Exception, match="not UTF-8"):
        read(spark, path)
    assert read(spark, path, strict_encoding=False) == [("\ufffd\ufffd", 1), ("\ufffd\ufffd", 2)]


def test_files_start_anew_and_rows_are_numbered_over_all(spark, put, tmp_path):
    for name, text in [("d/1.csv", "a,b\nx,1\n,2\n"), ("d/2.csv", "a,b\n,3\ny,\n"), ("d/3.csv", "a,b\n")]:
        os.makedirs(tmp_path / "d", exist_ok=True)
        put(text, name)
    got = read_sparse_csv(spark, str(tmp_path / "d")).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, "x", 1), (1, "x", 2), (2, None, 3), (3, "y", 3)]
    put("b,a\n1,x\n", "d/4.csv")
    with pytest.raises(Exception, match="header differs"):
        read_sparse_csv(spark, str(tmp_path / "d")).collect()


def test_many_splits_equal_one_loop(spark, put, tmp_path):
    import random

    rng = random.Random(9)
    want, lines = [], {}
    os.makedirs(tmp_path / "d")
    for f in range(3):
        above, out = [None, None, None], ["k,rare,often"]
        for i in range(4000 + f):
            cells = [str(i), "r%d" % i if rng.random() < 0.001 else "", rng.choice(["", " ", "p", "q"])]
            above = [c if c.strip() else a for c, a in zip(cells, above)]
            want.append((len(want), int(above[0]), above[1], above[2]))
            out.append(",".join(cells))
        put("\n".join(out) + "\n", f"d/{f}.csv")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        df = read_sparse_csv(spark, str(tmp_path / "d"))
        got = [tuple(r) for r in df.orderBy("row_index").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == want


def test_chunks_and_iteration(spark, put):
    df = read_sparse_csv(spark, put(SERIES))
    assert [r["timestamp"] for r in iter_rows(df)] == list(range(1000, 2000, 100))
    assert [len(c) for c in iter_chunks(df, 4)] == [4, 4, 2]
    assert [len(c) for c in iter_chunks(df, 0)] == [10]
    sizes = with_chunks(df, 4).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [tuple(r) for r in sizes] == [(0, 4), (1, 4), (2, 2)]
    assert with_chunks(df, 0).select("chunk_id").distinct().count() == 1


def lines_of(path):
    return [open(p).read().splitlines() for p in sorted(glob.glob(path + "/part-*.csv"))]


def test_write_golden(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "Alice", 30, "Beijing"), (1, "Alice", 30, "Shanghai"), (2, "Bob", 25, "Shanghai")],
        "i int, name string, age bigint, city string",
    )
    out = str(tmp_path / "o")
    assert write_sparse_csv(df, out, "i", columns=["name", "age", "city"]) == 3
    assert lines_of(out) == [["name,age,city", "Alice,30,Beijing", ",,Shanghai", "Bob,25,"]]
    assert write_sparse_csv(df.limit(0), out, "i") == 0
    assert read_sparse_csv(spark, out).columns == ["row_index", "i", "name", "age", "city"]


def test_write_adds_missing_columns_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "i int, a string")
    out = str(tmp_path / "o")
    write_sparse_csv(df, out, "i", columns=["a", "missing"])
    assert lines_of(out) == [["a,missing", "x,NULL", ","]]
    assert read(spark, out) == [("x", None), ("x", None)]


@pytest.mark.parametrize("blocks", [1, 5])
@pytest.mark.parametrize(
    "options",
    [{}, {"inherit": "marker", "marker": "-"}, {"has_header": False}, {"delimiter": "|", "inherit": "empty"}],
)
def test_round_trip(spark, tmp_path, blocks, options):
    values = ["x", "x", None, None, "y", 'say "hi"', "p,q|r", " lead", "tail ", "back\\slash", None, "ü"]
    rows = [(i, values[i % len(values)], float(i // 3), i % 7 < 4) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, t string, d double, b boolean").repartition(4)
    out = str(tmp_path / "o")
    assert write_sparse_csv(df, out, "i", blocks=blocks, **options) == 300
    for part in lines_of(out):  # each file can be read alone
        first = part[0 if options.get("has_header") is False else 1]
        sep = options.get("delimiter", ",")
        assert first.split(sep)[0].isdigit()
    back = read_sparse_csv(spark, out, columns=df.columns if options.get("has_header") is False else None, **options)
    assert [t for _, t in back.dtypes] == ["bigint", "bigint", "string", "double", "boolean"]
    assert [tuple(r)[1:] for r in back.orderBy("row_index").collect()] == rows


def test_one_column_and_copies_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "a string")
    out = str(tmp_path / "o")
    assert write_sparse_csv(df, out) == 5
    assert read(spark, out) == [(None,), (None,), ("x",), ("x",), ("y",)]


def test_line_breaks_need_multi_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "p\nq"), (2, "p\nq")], "i int, t string")
    with pytest.raises(Exception, match="multi_line"):
        write_sparse_csv(df, str(tmp_path / "a"), "i")
    out = str(tmp_path / "b")
    write_sparse_csv(df, out, "i", multi_line=True)
    assert read(spark, out, multi_line=True) == [(1, "p\nq"), (2, "p\nq")]


def test_format_checks():
    for bad in ({"delimiter": ",,"}, {"quote": ""}, {"skip_rows": -1}, {"inherit": "x"}):
        with pytest.raises(ValueError):
            SparseFormat(**bad)


def test_names(spark):
    assert normalize_names(["Speed (m/s)", "speed_m_s", "3v3", "", "温度", "speed", "Speed", "__a__b"]) == [
        "speed_m_s", "speed_m_s_1", "signal_2", "signal_3", "signal_4", "speed", "speed_1", "a_b",
    ]
    df = spark.createDataFrame([(1, 2)], "`A b` int, `9` int")
    assert normalize_columns(df).columns == ["a_b", "signal_1"]
    assert check_table_name("sim_record") == "sim_record"
    with pytest.raises(ValueError):
        check_table_name("1x; drop")
