"""The file object, range queries, typing, and the registered queries."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from rowtide.api import SparseCsv
from rowtide.functions.typing import infer_types, typed_columns
from rowtide.operators.lookup import range_query, write_sorted
from test_sparse_csv import SERIES


def test_a_file_end_to_end(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(SERIES)
    files, path = SparseCsv(spark), str(path)

    def at(df):
        return sorted(r["row_index"] for r in df.collect())

    assert at(files.read_all(path)) == list(range(10))
    assert at(files.range_query(path, "timestamp", 1000, 1500)) == [0, 1, 2, 3, 4, 5]
    assert at(files.row_query(path, row_numbers=[0, 2, 4])) == [0, 2, 4]
    assert at(files.row_query(path, rowid_range=(1, 10))) == list(range(10))
    assert at(files.row_query(path, rowid_set={1, 5, 10})) == [0, 4, 9]
    kept = at(files.sample(path, "lttb", sample_size=5, time_field="timestamp", value_field="value"))
    assert len(kept) == 5 and kept[0] == 0 and kept[-1] == 9
    groups = at(files.sample(path, "cluster", field="city", n_clusters=1))
    assert groups in ([0, 1, 2], [3, 4, 5, 6], [7, 8, 9])
    assert len(at(files.sample(path, "system", block_size=5, start=3))) == 2
    assert len(at(files.sample(path, "reservoir", size=4))) == 4
    assert at(files.sample(path, "bernoulli", probability=1.0)) == list(range(10))
    assert [len(c) for c in files.read_chunks(path, 6)] == [6, 4]
    assert [r["timestamp"] for r in files.iter_rows(path)][::9] == [1000, 1900]
    out = str(tmp_path / "out")
    assert files.write_all(out, files.read_all(path)) == 10
    assert files.read_all(out).orderBy("row_index").collect() == files.read_all(path).orderBy("row_index").collect()


@pytest.mark.parametrize("kind", ["double", "float", "decimal(10,2)", "bigint", "string", "boolean"])
@pytest.mark.parametrize("low, high", [(None, None), (0, None), (None, 0), (-2, 3), (3, 20), (-20, -1), (5, 2)])
def test_range_bounds_count_towards_zero(spark, kind, low, high):
    values = [-20.7, -20.0, -1.99, -1.0, -0.5, 0.0, 0.5, 1.0, 2.99, 3.99, 4.0, 20.7, 21.0, None]
    if kind in ("double", "float"):
        values += [math.nan, math.inf, -math.inf]
    if kind == "bigint":
        values = [None if v is None else int(v) for v in values]
    if kind == "string":
        values = ["5", " 7 ", "x", "10.5", "", None, "-3", "1_0"]
    if kind == "boolean":
        values = [True, False, None]

    def matches(v):
        try:
            n = int(v.replace("_", "x")) if isinstance(v, str) else int(v)
        except (TypeError, ValueError, OverflowError):
            return False
        return (low is None or n >= low) and (high is None or n <= high)

    base = "string" if kind == "string" else "boolean" if kind == "boolean" else "bigint" if kind == "bigint" else "double"
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {base}").withColumn("v", F.col("v").cast(kind) if "decimal" not in kind else F.expr(f"try_cast(v as {kind})"))
    got = sorted(r["i"] for r in range_query(df, "v", low, high).collect())
    assert got == [i for i, v in enumerate(values) if matches(v)]


def test_range_bounds_beyond_exact_doubles(spark):
    df = spark.createDataFrame([(float(2**53),), (float(2**53 + 2),)], "v double")
    assert range_query(df, "v", 2**53 + 1, None).count() == 1
    assert range_query(df, "v", None, 2**53 + 1).count() == 1
    with pytest.raises(TypeError):
        range_query(spark.range(1).select(F.array("id").alias("a")), "a", 0, 1)


def test_range_filter_reaches_the_scan(spark, table, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # else plans are shown cut off
    write_sorted(table("orders"), str(tmp_path / "s"), "o_orderkey", files=4)
    copy = spark.read.parquet(str(tmp_path / "s"))
    for df, field in ((copy, "o_orderkey"), (table("orders"), "o_totalprice")):
        plan = range_query(df, field, 10, 20)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and f"GreaterThanOrEqual({field}" in plan
    assert range_query(copy, "o_orderkey", 10, 20).count() == 11


def test_typing_rules(spark):
    df = spark.createDataFrame(
        [("0", "1", "yes", "a", "9" * 30, "NULL", " 5 ", "1.5"), ("1", "2.5", "No", "1", "1", "", "NA", "inf")],
        "i string, d string, b string, s string, big string, none string, pad string, f string",
    )
    assert infer_types(df) == {
        "i": "bigint", "d": "double", "b": "boolean", "s": "string", "big": "double",
        "none": "string", "pad": "bigint", "f": "double",
    }
    row = typed_columns(df, type_hints={"i": bool}).collect()[0]
    assert row["i"] is False and row["b"] is True and row["pad"] == 5 and row["none"] is None
    with pytest.raises(Exception, match="column 's'"):
        typed_columns(df, type_hints={"s": "bigint"}).collect()
    assert typed_columns(df, type_hints={"s": "bigint"}, on_error="null").collect()[0]["s"] is None


def test_queries_have_sql_and_the_flagship_runs(spark):
    assert {q.__name__ for q in entry.core_queries()} <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


NAMES = list(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf_dir), name, sf_dir) is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_rows_out_of_single_tasks(spark):
    """Windows over rows are partitioned; unneeded columns are not read."""
    sf_dir = "/root/testdata/sf0.1"
    for name in ("sparsify_events", "row_index_events_by_time", "sparsify_lineitem"):
        plan = plan_of(entry.queries()[name](spark, sf_dir))
        assert "hashpartitioning(__rt_block" in plan
        for part in plan.split("Exchange SinglePartition")[1:]:
            below = part.lstrip().split("\n", 2)[1]
            assert "Aggregate" in below, name  # only block tables, already aggregated
    plan = plan_of(entry.queries()["row_index_events_by_time"](spark, sf_dir))
    assert "props" not in plan and "event_type" not in plan
    plan = plan_of(entry.queries()["cluster_lineitem"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
