"""Recordings: goldens, every type, damaged files, many files, import."""

import random
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recording_bytes import MARKER, SAMPLE_ROWS, SAMPLE_SIGNALS, header, recording
from rowtide.operators.profile import column_check, frame_count, presence
from rowtide.sources import recordings
from rowtide.sources import manifests, recording_import
from rowtide.sources.recording_import import (
    import_recordings,
    read_imported,
    recording_files,
    recording_signals,
)
from rowtide.sources.recordings import audit_recordings, frame_time, read_recording_signals, read_recordings

TIME = ("time_ns", 0, (), "")


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        return str(path)

    return write


def test_sample_golden(spark, put):
    path = put("sim.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    df = read_recordings(spark, path)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "decimal(20,0)", "double", "float", "string", "array<double>"]
    got = [tuple(r)[1:] for r in df.orderBy("frame_index").collect()]
    assert [r[:3] + r[4:] for r in got] == [
        (0, Decimal(1000), 12.5, "warmup", [1.0, 2.0, 3.0]),
        (1, Decimal(2000), 15.0, "stable", [1.5, 2.5, 3.5]),
        (2, Decimal(3000), 9.75, None, None),
    ]
    assert [r[3] and round(r[3], 5) for r in got] == [3.3, None, 3.1]
    assert tuple(column_check(df, ["voltage", "status"], ["speed"]).first()) == (3, 2, 2, 37.25)
    assert frame_count(df).first()["frame_count"] == 3
    shares = {r["column"]: r["presence"] for r in presence(df).collect()}
    assert shares["time_ns"] == 1.0 and shares["voltage"] == 2 / 3
    assert df.schema["spectrum"].metadata["dimensions_json"] == "[3]"
    assert df.schema["speed"].metadata["formula"] == "m/s"
    signals = read_recording_signals(spark, path).orderBy("signal_index").collect()
    assert [tuple(r)[1:] for r in signals][4] == (
        4, "spectrum", "spectrum", 11, 1, "[3]", "three-bin spectrum", "array<double>",
    )
    audit = audit_recordings(spark, path).first()
    assert tuple(audit)[1:] == (Decimal(1), 5, 3, True, len(recording(SAMPLE_SIGNALS, SAMPLE_ROWS)), "valid", None)


def all_types():
    signals, values = [TIME], [2**64 - 1]
    scalars = {
        0: 2**64 - 1, 1: 2**32 - 1, 2: 65535, 3: 255, 4: -(2**63), 5: -(2**31), 6: -32768, 7: -128,
        8: 2, 9: -5, 10: 1.5, 11: 1e300, 12: "zä", 13: b"\x00\xff", 14: (1.5, -2.5), 15: (1e200, 2.0),
    }
    for code, v in scalars.items():
        signals.append((f"s{code}", code, (), ""))
        values.append(v)
        if code not in (12, 13):
            signals.append((f"a{code}", code, (2, 2), ""))
            values.append([v, v, v, v])
    return signals, values


@pytest.mark.parametrize("complex_", ["struct", "array"])
def test_every_type(spark, put, complex_):
    signals, values = all_types()
    none = [5] + [None] * (len(values) - 1)
    path = put("all.bin", recording(signals, [values, none, values]))
    rows = read_recordings(spark, path, complex=complex_).orderBy("frame_index").collect()
    assert all(v is None for v in tuple(rows[1])[3:])
    for row in (rows[0], rows[2]):
        for (name, code, dims, _), v in zip(signals, values):
            want = v[0] if dims else v
            if code == 0:
                want = Decimal(want)
            if code == 8:
                want = True
            if code in (14, 15) and complex_ == "array":
                want = list(want)
            got = row[name]
            if dims:
                assert len(got) == 4
                got = got[0]
            assert (tuple(got) if code in (14, 15) and complex_ == "struct" else got) == want, name


def test_changing_patterns_and_buffer_borders(spark, put, monkeypatch):
    rng = random.Random(1)
    signals = [TIME, ("a", 5, (), ""), ("t", 12, (), ""), ("b", 11, (2,), ""), ("u", 12, (), ""), ("c", 8, (), "")]
    rows = []
    for i in range(3000):
        row = [i, i * 2, "t" * rng.randrange(30), [i / 2, 1.0], "", i % 2]
        rows.append([row[0]] + [v if rng.random() < 0.6 else None for v in row[1:]])
    fixed = [s for s in signals if s[1] != 12]
    fixed_rows = [[r[0], r[1] if i % 50 < 40 else None, r[3], r[5]] for i, r in enumerate(rows)]
    put("d/x.bin", recording(signals, rows))
    put("d/y.bin", recording(fixed, fixed_rows))
    # the same files through a buffer much shorter than a file, in this process
    monkeypatch.setattr(recordings, "_READ_BYTES", 101)
    monkeypatch.setattr(recordings, "_BATCH_FRAMES", 7)
    for name, sig, want in [("x", signals, rows), ("y", fixed, fixed_rows)]:
        (path, size), = [f for f in recordings.list_recordings(put("d/z.txt", b"")[:-6]) if f[0].endswith(name + ".bin")]
        file = recordings._File(path, size)
        head, seen = recordings.read_header(file), []
        for data, runs in recordings.walk_frames(file, head):
            present, values = recordings.decode(head, data, runs)[1]
            seen += [int(v[0]) if p else None for p, v in zip(present, values)]
        assert seen == [r[1] for r in want]
    df = read_recordings(spark, put("d/z.txt", b"")[:-6])
    got = df.where("file_path like '%x.bin'").orderBy("frame_index").collect()
    assert [[r["time_ns"], r["a"], r["t"], r["b"], r["u"], r["c"]] for r in got] == [
        [Decimal(r[0])] + list(r[1:5]) + [None if r[5] is None else bool(r[5])] for r in rows
    ]
    got = df.where("file_path like '%y.bin'").orderBy("frame_index").collect()
    assert [[r["a"], r["b"], r["t"]] for r in got] == [[r[1], r[2], None] for r in fixed_rows]


def bad_files():
    good = recording(SAMPLE_SIGNALS, SAMPLE_ROWS)
    head = header(SAMPLE_SIGNALS)
    return {
        "version": recording(SAMPLE_SIGNALS, SAMPLE_ROWS, version=99),
        "labels": recording([TIME, ("labels", 12, (2,), "")], []),
        "cut": good[:-4],
        "empty": b"",
        "no_marker": good[:-8],
        "trailing": good + b"\x00",
        "no_time_bit": head + b"\x02" + struct.pack("<Qd", 1, 1.0) + MARKER,
        "first_not_time": recording([("x", 11, (), "")], []),
        "time_array": recording([("t", 0, (1,), "")], []),
        "blank_name": recording([TIME, ("  ", 5, (), "")], []),
        "type_code": recording([TIME], [])[:0] + struct.pack("<QQBI", 1, 1, 77, 0) + b"\x00" * 40,
        "dims": header([TIME])[:8] + struct.pack("<Q", 1) + struct.pack("<BI", 0, 9) + b"\x00" * 60,
        "zero_dim": recording([TIME, ("a", 5, (0,), "")], []),
        "huge_dims": recording([TIME, ("a", 5, (2**31 - 1, 2), "")], []),
        "no_signals": struct.pack("<QQ", 1, 0) + MARKER,
        "many_signals": struct.pack("<QQ", 1, 1025) + MARKER,
        "long_name": struct.pack("<QQBIQ", 1, 1, 0, 0, 2**21) + b"x" * (2**21) + MARKER,
        "long_text": header([TIME, ("s", 12, (), "")]) + b"\x03" + struct.pack("<QQ", 1, 2**40) + MARKER,
    }


def test_bad_files_are_rejected_whole(spark, put, tmp_path):
    for name, data in bad_files().items():
        put(f"d/{name}.bin", data)
    put("d/good.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    folder = str(tmp_path / "d")
    audit = {r["file_path"].split("/")[-1]: r for r in audit_recordings(spark, folder).collect()}
    assert len(audit) == len(bad_files()) + 1
    for name in bad_files():
        row = audit[name + ".bin"]
        assert row["status"] == "rejected" and row["error"] and row["imported_frame_count"] == 0, name
    assert audit["good.bin"]["status"] == "valid"
    assert read_recordings(spark, folder, on_bad_file="skip").count() == 3
    with pytest.raises(Exception):
        read_recordings(spark, folder).collect()
    with pytest.raises(Exception, match="end marker|ended"):
        read_recordings(spark, folder + "/cut.bin").collect()


def test_empty_recording_has_no_frames(spark, put):
    path = put("none.bin", recording(SAMPLE_SIGNALS, []))
    assert read_recordings(spark, path).count() == 0
    assert audit_recordings(spark, path).first()["status"] == "valid"


def test_many_files_are_united_by_name(spark, put, tmp_path):
    for i in range(30):
        signals = [TIME, ("Speed (m/s)", 11, (), ""), (f"extra {i % 2}", 5, (), "")]
        put(f"d/{i % 3}/r{i}.bin", recording(signals, [(k, float(i), k) for k in range(i)]))
    df = read_recordings(spark, str(tmp_path / "d"))
    assert df.columns == ["file_path", "frame_index", "time_ns", "speed_m_s", "extra_0", "extra_1"]
    assert df.count() == sum(range(30))
    assert frame_count(df).count() == 29
    assert df.agg(F.sum("extra_1")).first()[0] == sum(k for i in range(1, 30, 2) for k in range(i))
    put("d/clash.bin", recording([TIME, ("extra 0", 11, (), "")], []))
    with pytest.raises(ValueError, match="several types"):
        read_recordings(spark, str(tmp_path / "d"))


def test_small_files_share_tasks():
    files = [(f"f{i:03}", 1000) for i in range(100)] + [("big", 10**9)]
    packs = recordings._packs(files, 1 << 20)
    assert packs[0].files == [("big", 10**9)]
    assert sum(len(p.files) for p in packs) == 101 and len(packs) < 12


def test_frame_time(spark):
    df = spark.createDataFrame([(Decimal(1_500_000_000_123_456_789),)], "time_ns decimal(20,0)")
    assert df.select(F.unix_micros(frame_time())).first()[0] == 1_500_000_000_123_456


def test_import(spark, put, tmp_path):
    put("in/a.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    root, folder = str(tmp_path / "lake"), str(tmp_path / "in")
    result = import_recordings(spark, folder, root, "sim_record")
    assert (result.imported_files, result.rejected_files, result.frame_count) == (1, 0, 3)
    assert tuple(column_check(read_imported(spark, root, "sim_record"), ["voltage", "status"], ["speed"]).first()) == (3, 2, 2, 37.25)
    assert recording_signals(spark, root, "sim_record").count() == 5

    # a bad file: nothing changes
    put("in/b.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS)[:-4])
    with pytest.raises(ValueError, match="1 bad recordings"):
        import_recordings(spark, folder, root, "sim_record")
    assert read_imported(spark, root, "sim_record").count() == 3
    # or is listed while the others go in; the import replaces the first one
    result = import_recordings(spark, folder, root, "sim_record", on_bad_file="quarantine")
    assert (result.imported_files, result.rejected_files) == (1, 1)
    assert read_imported(spark, root, "sim_record").count() == 3
    files = recording_files(spark, root, "sim_record").collect()
    assert sorted(r["status"] for r in files) == ["rejected", "valid"]
    assert recording_signals(spark, root, "sim_record").count() == 5

    # another table is on its own; appending twice under one id counts once
    for _ in range(2):
        import_recordings(spark, folder + "/a.bin", root, "other", mode="append", import_id="batch-1")
    import_recordings(spark, folder + "/a.bin", root, "other", mode="append", import_id="batch-2")
    assert read_imported(spark, root, "other").count() == 6
    assert read_imported(spark, root, "sim_record").count() == 3
    with pytest.raises(ValueError):
        import_recordings(spark, folder, root, "bad name")
    with pytest.raises(ValueError):
        read_imported(spark, root, "missing")


def test_a_bad_file_with_another_type_is_quarantined(spark, put, tmp_path):
    """Signals of files that are not valid count for nothing."""
    put("in/a.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    other = [s if s[0] != "speed" else ("speed", 12, (), "") for s in SAMPLE_SIGNALS]
    put("in/b.bin", recording(other, [])[:-4])
    root = str(tmp_path / "lake")
    result = import_recordings(spark, str(tmp_path / "in"), root, "t", on_bad_file="quarantine")
    assert (result.imported_files, result.rejected_files, result.frame_count) == (1, 1, 3)
    assert read_imported(spark, root, "t").schema["speed"].dataType.simpleString() == "double"
    assert recording_signals(spark, root, "t").count() == 5


def test_only_audited_files_are_imported(spark, put, tmp_path, monkeypatch):
    """A file that arrives after the audit is in no table, one that grew is read as it was."""
    put("in/a.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    root, audited = str(tmp_path / "lake"), recording_import.audited_signals

    def meanwhile(files, *args):
        put("in/b.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
        with open(tmp_path / "in" / "a.bin", "ab") as f:
            f.write(b"more")
        return audited(files, *args)

    monkeypatch.setattr(recording_import, "audited_signals", meanwhile)
    result = import_recordings(spark, str(tmp_path / "in"), root, "t")
    assert result.imported_files == 1 and read_imported(spark, root, "t").count() == 3
    assert [r["file_path"][-5:] for r in recording_files(spark, root, "t").collect()] == ["a.bin"]


def test_an_import_counts_from_its_manifest_on(spark, put, tmp_path, monkeypatch):
    put("in/a.bin", recording(SAMPLE_SIGNALS, SAMPLE_ROWS))
    root, folder = str(tmp_path / "lake"), str(tmp_path / "in")
    import_recordings(spark, folder, root, "t")
    with monkeypatch.context() as m:
        m.setattr(recording_import, "add_manifest", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            import_recordings(spark, folder, root, "t", mode="append")
    assert read_imported(spark, root, "t").count() == 3 and recording_files(spark, root).count() == 1
    # a manifest that was never finished, and one that another writer makes meanwhile
    at = f"{root}/_manifests/t"
    (tmp_path / "lake/_manifests/t/000000000001.json").write_text('{"entr')
    assert manifests.last_manifest(spark, at)[0] == 1 and len(manifests.last_manifest(spark, at)[1]) == 1
    raced = []

    def change(entries):
        return [*entries, {"import_id": "x", "n": len(raced)}]

    last = manifests.last_manifest

    def slow(*args):
        found = last(*args)
        if not raced:
            raced.append(1)
            manifests.add_manifest(spark, at, lambda e: [*e, {"import_id": "faster"}])
        return found

    monkeypatch.setattr(manifests, "last_manifest", slow)
    assert manifests.add_manifest(spark, at, change) == 3
    assert [e["import_id"] for e in last(spark, at)[1]][1:] == ["faster", "x"]


def test_pieces_become_columns():
    raw = "aé漢".encode() + b"\xff\xe6\xbc" + b"z" * 5000
    text = recordings.Signal(1, 12, (), "t", "")
    blob = recordings.Signal(1, 13, (), "b", "")

    def column(signal, spans, type_):
        data = np.frombuffer(raw, np.uint8)
        present = np.array([s is not None for s in spans])
        start, length = np.array([s or (0, 0) for s in spans]).T
        return recordings.to_arrow(signal, present, recordings.Pieces(data, start, length), type_).to_pylist()

    assert column(text, [(0, 1), None, (1, 2), (3, 3), (2, 0)], pa.string()) == ["a", None, "é", "漢", ""]
    # a character cut in two is whole in the buffer, but not in its pieces
    assert column(text, [(1, 1), (2, 1), (6, 1), (0, 3)], pa.string()) == ["\ufffd", "\ufffd", "\ufffd", "aé"]
    assert column(blob, [(6, 3), None, (9, 5000), (9, 0)], pa.binary()) == [b"\xff\xe6\xbc", None, b"z" * 5000, b""]
    assert column(text, [None, None], pa.string()) == [None, None]
