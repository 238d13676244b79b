"""Memory of a task stays the same as tables grow."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from rowtide.llm.elias_fano import EliasFano
from rowtide.operators.lttb import pruned_batches
from rowtide.plans.order import fill_forward
from rowtide.plans.staging import stage
from rowtide.sources.recording_writer import write_recordings
from rowtide.sources.recordings import read_recordings


def test_one_file_is_sorted_in_pieces(spark, tmp_path, monkeypatch):
    """Frames of one file are sorted by many tasks, and stand in order all the same."""
    from rowtide.sources import recording_writer

    seen = []

    def staged(df, label):
        out = stage(df, label)
        seen.extend(out.collect() if label == "recording-pieces" else ())
        return out

    monkeypatch.setattr(recording_writer, "_PIECE_ROWS", 100)
    monkeypatch.setattr(recording_writer, "stage", staged)
    df = spark.range(2000).selectExpr("if(id % 10 = 0, 'few', 'most') as file", "2000 - id as time_ns", "id as value")
    done = write_recordings(df, str(tmp_path), "file", "time_ns", ["value"], ["time_ns"])
    assert sorted(r["frames"] for r in done.collect()) == [200, 1800]
    assert max(r["frames"] for r in seen) < 600
    got = read_recordings(spark, str(tmp_path)).orderBy("file_path", "frame_index").collect()
    for name, step in (("few", lambda v: v % 10 == 0), ("most", lambda v: v % 10)):
        values = [r["value"] for r in got if r["file_path"].endswith(f"/{name}.bin")]
        assert values == [v for v in range(1999, -1, -1) if step(v)]
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["few.bin", "most.bin"]


def test_short_lines_are_filled_in_many_blocks_and_tasks(spark, tmp_path, monkeypatch):
    """One split with many short lines: neither a block nor a task holds all of them."""
    from rowtide.plans import order
    from rowtide.sources import sparse_csv

    seen = []

    def filled(rows, values):
        blocks = rows.df.groupBy(*rows.group, *rows.blocks).count().collect()
        seen.append(max(r["count"] for r in blocks))
        out = fill_forward(rows, values)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(order, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(sparse_csv, "_BLOCK_BITS", 6)
    monkeypatch.setattr(sparse_csv, "fill_forward", filled)
    expected, lines, last = [], ["a,b,c"], [None, None, None]
    for i in range(3000):
        cells = [i if i % 3 == 0 else "", i if i % 700 == 5 else "", i if i == 2 else ""]
        last = [c if c != "" else x for c, x in zip(cells, last)]
        lines.append(",".join(map(str, cells)))
        expected.append((i, *last))
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = sparse_csv.read_sparse_csv(spark, str(tmp_path / "a.csv")).orderBy("row_index")
    assert [tuple(r) for r in got.collect()] == expected
    assert seen == [64, 30]


def test_lttb_holds_few_points_of_many_small_series():
    """Series with hardly a point to prune: a task gives out what it holds in small pieces."""
    n, step = 400_000, 10_000

    def batches():
        for at in range(0, n, step):
            i = np.arange(at, at + step)
            yield pd.DataFrame({"s0": i // 14, "b": i % 14, "i": i % 14, "x": i.astype(float), "y": (i * 7 % 13).astype(float)})

    out = list(pruned_batches(batches(), ["s0", "b"]))
    assert sum((o["kind"] == 1).sum() for o in out) == n
    assert max(map(len, out)) < 200_000


def test_texts_of_quoted_records_are_written_once(spark, tmp_path, monkeypatch):
    from rowtide.sources import quoted_records, sparse_csv

    with_text = []

    def staged(df, label):
        with_text.extend([label] if "value" in df.columns else ())
        return stage(df, label)

    monkeypatch.setattr(quoted_records, "stage", staged)
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"\n"\n"3",z\n')
    got = sparse_csv.read_sparse_csv(spark, str(tmp_path / "a.csv"), multi_line=True, inherit="empty").orderBy("row_index")
    assert [tuple(r) for r in got.collect()] == [(0, 1, "x\ny"), (1, 2, "\n"), (2, 3, "z")]
    assert with_text == ["csv-lines"]


def test_sparse_files_follow_the_block_numbers(spark, tmp_path, monkeypatch):
    """Larger tables get more files, in order and without a pass that samples blocks."""
    from rowtide.sources import sparse_csv

    monkeypatch.setattr(sparse_csv, "ROWS_PER_TASK", 1000)
    df = spark.range(25_000).selectExpr("(id * 7919) % 25000 as k", "id % 3 as v")
    assert sparse_csv.write_sparse_csv(df, str(tmp_path / "out"), "k", blocks=100) == 25_000
    files = [p.read_text().split()[1:] for p in sorted((tmp_path / "out").glob("part-*"))]
    assert len(files) == 25 and max(map(len, files)) < 2500
    assert [int(line.split(",")[0]) for f in files for line in f] == list(range(25_000))


def test_elias_fano_takes_numbers_apart_in_runs():
    """Sequences longer than a run read back, in a few bytes of memory a number."""
    for n, universe in ((400_001, 300_000), (300_003, 1 << 44), (7, 1000), (0, 5)):
        values = np.sort(np.random.default_rng(n).integers(0, universe, n))
        tracemalloc.start()
        arrays = EliasFano.arrays("x", values, universe)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 14 * n + 12_000_000
        found = EliasFano(arrays, "x")
        assert (found.access(np.arange(n)) == values).all()
        whole = np.zeros(n, np.int64), np.full(n, n)
        assert (found.successor(values, *whole) == np.searchsorted(values, values)).all()


def test_ids_of_a_batch_take_one_text_at_a_time():
    """Texts with wide characters take four bytes for each; a batch of them is not held as strings."""
    from rowtide.llm.byte_bpe import id_lists

    class Encoder:
        def text_ids(self, text):
            return len(text).to_bytes(4, "little") * 2 if text else b""

    texts = pa.array(["\U0001f600" + "a" * 20_000, None, ""] * 500)
    tracemalloc.start()
    got = id_lists(texts, Encoder())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    assert got.to_pylist() == [[20_001, 20_001], [], []] * 500
