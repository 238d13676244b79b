"""Cases that once gave wrong results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recording_bytes import MARKER, header
from rowtide.functions.names import check_table_name
from rowtide.operators.lttb import _areas, hull_candidates
from rowtide.operators.sparse import expand_sparse
from rowtide.sources import recordings
from rowtide.sources.recordings import audit_recordings
from rowtide.sources.sparse_csv import read_sparse_csv, write_sparse_csv


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_a_null_key_is_the_first_row_for_any_number_of_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr("rowtide.plans.order.ROWS_PER_BLOCK", max(1, 41 // blocks))
    rows = [(None, "v")] + [(i, "") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, cell string")
    full = expand_sparse(df, "k")
    assert full.where(F.col("cell") == "v").count() == 41


def test_catalog_names_are_no_table_names():
    for name in ("_files", "_SIGNALS"):
        with pytest.raises(ValueError):
            check_table_name(name)


def test_a_walk_holds_a_few_megabytes_and_gives_all_frames(tmp_path):
    signals = [("time_ns", 0, (), ""), ("v", 4, (), "")]
    count = 1_200_000
    body = np.zeros(count, dtype=[("bits", "u1"), ("t", "<u8"), ("v", "<i8")])
    body["bits"], body["t"] = 3, np.arange(count)
    path = tmp_path / "long.bin"
    path.write_bytes(header(signals) + body.tobytes() + MARKER)
    file = recordings._File(str(path), path.stat().st_size)
    held, frames = 0, 0
    for data, runs in recordings.walk_frames(file, recordings.read_header(file)):
        held = max(held, len(data))
        frames += sum(len(anchors) for _, anchors in runs)
    assert frames == count
    assert held < 2 * recordings._READ_BYTES


def test_audit_tells_version_and_marker_of_rejected_files(spark, tmp_path):
    signals = [("time_ns", 0, (), "")]
    (tmp_path / "a.bin").write_bytes(header(signals, 99) + MARKER)
    (tmp_path / "b.bin").write_bytes(header(signals))
    (tmp_path / "c.bin").write_bytes(b"abc")
    found = audit_recordings(spark, str(tmp_path)).orderBy("file_path").collect()
    assert [r["format_version"] for r in found] == [99, 1, None]
    assert [r["eof_valid"] for r in found] == [True, False, False]
    assert [r["status"] for r in found] == ["rejected"] * 3


def test_an_own_line_separator_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "a int, b string")
    path = str(tmp_path / "out")
    assert write_sparse_csv(df, path, "a", line_sep=";") == 3
    got = read_sparse_csv(spark, path, line_sep=";").orderBy("a")
    assert [tuple(r)[1:] for r in got.collect()] == [(1, "x"), (2, "x"), (3, "y")]


@pytest.mark.parametrize("encoding, word", [("latin-1", "üé"), ("cp1252", "€"), ("gbk", "中文")])
def test_blank_lines_and_splits_in_other_encodings(spark, tmp_path, encoding, word):
    path = tmp_path / "in.csv"
    path.write_bytes(f"a,b\n1,{word}\n\n2,y\n".encode(encoding))
    got = read_sparse_csv(spark, str(path), encoding=encoding).orderBy("row_index")
    assert [tuple(r) for r in got.collect()] == [(0, 1, word), (1, 1, word), (2, 2, "y")]


def test_bytes_of_another_encoding_raise(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b"a,b\n1,\xff\xff\n")
    with pytest.raises(Exception, match="gbk"):
        read_sparse_csv(spark, str(path), encoding="gbk").collect()


def test_points_of_equal_time_are_pruned():
    rng = np.random.default_rng(3)
    code = np.zeros(100_000, dtype=int)
    x = np.sort(rng.integers(0, 10, len(code))).astype(float)
    y = rng.normal(size=len(code))
    keep = hull_candidates(code, x, y)
    assert keep.sum() <= 20
    for a, c in [((-1.0, 0.3), (12.0, -0.2)), ((0.0, 1.0), (10.0, 5.0)), ((-2.0, -9.0), (9.5, 9.0))]:
        areas = _areas(a, x, y, c)
        assert keep[np.argmax(areas)]
