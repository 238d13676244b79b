"""

Every query runs over whole tables. Files the queries read (sparse CSV, recordings,
stream input) are written by Spark from the tables of the same folder first, below
the folder named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)
if _HERE not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # for Python workers
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (_HERE, os.environ.get("PYTHONPATH")) if p)

from rowtide.functions.names import normalize_columns  # noqa: E402
from rowtide.functions.typing import infer_types, typed_columns  # noqa: E402
from rowtide.operators.lookup import (  # noqa: E402
    add_row_index,
    preview,
    range_query,
    row_query,
    write_sorted,
)
from rowtide.operators.lttb import lttb  # noqa: E402
from rowtide.operators.profile import column_check, frame_count, presence  # noqa: E402
from rowtide.operators.sampling import (  # noqa: E402
    bernoulli,
    cluster,
    reservoir,
    systematic,
    systematic_start,
)
from rowtide.operators.sparse import (  # noqa: E402
    compare_orders,
    expand_rows,
    expand_sparse,
    sparse_rows,
    sparsify,
    sparsity_stats,
)
from rowtide.plans.order import order_rows  # noqa: E402
from rowtide.plans.staging import scratch_path  # noqa: E402
from rowtide.sources.recording_import import (  # noqa: E402
    import_recordings,
    read_imported,
    recording_files,
)
from rowtide.sources.recording_writer import write_bytes, write_recordings  # noqa: E402
from rowtide.sources.recordings import (  # noqa: E402
    audit_recordings,
    frame_time,
    read_recording_signals,
    read_recordings,
)
from rowtide.sources.sparse_csv import read_sparse_csv, with_chunks, write_sparse_csv  # noqa: E402
from rowtide.sources.stored_order import read_stored_order  # noqa: E402
from rowtide.streaming.expand import expand_stream  # noqa: E402
from rowtide.streaming.sinks import import_recording_stream, write_sparse_stream  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
SEED = 42


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- expand and sparsify -----------------------------------------------------------

EVENT_CELLS = ["user_id", "event_type", "props"]


def sparsify_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", *EVENT_CELLS)
    return sparsify(events, "event_id")


def expand_events(spark, sf_dir):
    """Sparsify and expand in one order: the rows are cut into blocks once."""
    events = _table(spark, sf_dir, "events").select("event_id", *EVENT_CELLS)
    rows = order_rows(events, "event_id")
    sparse = rows.with_df(sparse_rows(rows, EVENT_CELLS))
    full = expand_rows(sparse, EVENT_CELLS, null_values=["NULL"])
    return full.select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "event_type", "props")


def expand_sparse_events(spark, sf_dir):
    """The same from a sparse table whose order is not known yet."""
    sparse = sparsify_events(spark, sf_dir)
    full = expand_sparse(sparse, "event_id", null_values=["NULL"])
    return full.withColumn("user_id", F.col("user_id").cast("bigint"))


def expand_last_purchase_by_user(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    bought = events.withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return expand_sparse(bought, "event_id", ["last_purchase"], "user_id").drop("value")


def expand_orders_by_priority(spark, sf_dir):
    """Typed columns of several kinds, NULL as the marker; ordered by date, then key."""
    orders = _table(spark, sf_dir, "orders")
    open_ = F.col("o_orderstatus") == "O"
    marked = orders.select(
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        F.when(open_, F.col("o_totalprice")).alias("open_price"),
        F.when(open_, F.col("o_custkey")).alias("open_customer"),
    )
    cols = ["open_price", "open_customer"]
    return expand_sparse(marked, ["o_orderdate", "o_orderkey"], cols, "o_orderpriority")


def expand_null_key_events(spark, sf_dir):
    """One event lost its id: NULL is the first position."""
    events = _table(spark, sf_dir, "events").select("event_id", *EVENT_CELLS)
    some = events.agg(F.max("event_id")).first()[0]
    lost = events.withColumn("event_id", F.when(F.col("event_id") != some, F.col("event_id")))
    marked = lost.withColumn("props", F.when(F.col("event_type") == "purchase", F.col("props")))
    return expand_sparse(marked, "event_id", ["props"], blocks=7)


def expand_events_aggregate(spark, sf_dir):
    """Sparsify, expand again, aggregate per event type."""
    full = expand_events(spark, sf_dir)
    return full.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.sum("user_id").alias("sum_user"),
    )


def sparsify_lineitem(spark, sf_dir):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return sparsify(_table(spark, sf_dir, "lineitem").select(*cols))


def sparsity_stats_events(spark, sf_dir):
    return sparsity_stats(_table(spark, sf_dir, "events"), "event_id", ["event_id", *EVENT_CELLS])


def sparsity_stats_lineitem(spark, sf_dir):
    return sparsity_stats(_table(spark, sf_dir, "lineitem"))


def compare_orders_lineitem(spark, sf_dir):
    cols = ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    items = _table(spark, sf_dir, "lineitem").select(*cols)
    return compare_orders(items, [["l_returnflag", "l_linestatus"], ["l_shipdate"], ["l_suppkey"]])


# --- lookups -----------------------------------------------------------------------


def range_orders_key(spark, sf_dir):
    return range_query(_table(spark, sf_dir, "orders"), "o_orderkey", 1000, 2500)


def range_orders_price(spark, sf_dir):
    return range_query(_table(spark, sf_dir, "orders"), "o_totalprice", 100_000, 200_000)


def range_events_value_below(spark, sf_dir):
    return range_query(_table(spark, sf_dir, "events"), "value", None, 20).drop("ts")


def range_parts_text(spark, sf_dir):
    """A text field: only cells with an integer form match."""
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("size_text"),
    )
    return range_query(parts, "size_text", 20, None)


def range_sorted_copy_lineitem(spark, sf_dir):
    """On a sorted copy the filter skips files and row groups."""
    path = scratch_path(spark, "lineitem-sorted")
    write_sorted(_table(spark, sf_dir, "lineitem"), path, "l_partkey")
    return range_query(spark.read.parquet(path), "l_partkey", 100, 300)


def row_numbers_orders(spark, sf_dir):
    return row_query(_table(spark, sf_dir, "orders"), "o_orderkey", row_numbers=[0, 2, 4, 777, 14_999])


def rowid_range_orders(spark, sf_dir):
    return row_query(_table(spark, sf_dir, "orders"), "o_orderkey", rowid_range=(101, 350))


def rowid_set_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return row_query(documents, "doc_id", rowid_set={1, 5, 10, 500, 1000})


def rowid_range_lineitem(spark, sf_dir):
    return row_query(_table(spark, sf_dir, "lineitem"), rowid_range=(20_001, 20_400))


def row_numbers_many_lineitem(spark, sf_dir):
    """As many positions as there are orders, from a table."""
    orders = _table(spark, sf_dir, "orders")
    return row_query(_table(spark, sf_dir, "lineitem"), row_numbers=orders.select(F.col("o_orderkey") * 4))


def row_numbers_stored_orders(spark, sf_dir):
    """By position in the stored file: a plain filter, no shuffle."""
    orders = read_stored_order(spark, f"{sf_dir}/orders.parquet")
    return row_query(orders, row_numbers=[0, 2, 4, 777, 14_999], row_index="row_index")


def systematic_stored_orders(spark, sf_dir):
    orders = read_stored_order(spark, f"{sf_dir}/orders.parquet")
    return systematic(orders, 100, seed=SEED, row_index="row_index").drop("row_index")


def row_index_events_by_time(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return add_row_index(events, ["ts", "event_id"]).drop("ts")


def chunks_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    indexed = add_row_index(turns, ["conv_id", "turn"])
    return with_chunks(indexed, 100).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("row_index").alias("first_row"),
        F.sum(F.length("text")).alias("characters"),
    )


def preview_orders(spark, sf_dir):
    return preview(_table(spark, sf_dir, "orders"), 10)


# --- sampling ----------------------------------------------------------------------


def bernoulli_orders(spark, sf_dir):
    return bernoulli(_table(spark, sf_dir, "orders"), 0.1, "o_orderkey", SEED)


def bernoulli_conversations(spark, sf_dir):
    return bernoulli(_table(spark, sf_dir, "conversations"), 0.25, ["conv_id", "turn"], SEED)


def reservoir_orders(spark, sf_dir):
    return reservoir(_table(spark, sf_dir, "orders"), 50, "o_orderkey", SEED)


def reservoir_orders_large(spark, sf_dir):
    return reservoir(_table(spark, sf_dir, "orders"), 5000, "o_orderkey", SEED)


def reservoir_documents(spark, sf_dir):
    return reservoir(_table(spark, sf_dir, "documents"), 100, "doc_id", SEED)


def systematic_orders(spark, sf_dir):
    return systematic(_table(spark, sf_dir, "orders"), 100, "o_orderkey", SEED)


def systematic_lineitem(spark, sf_dir):
    return systematic(_table(spark, sf_dir, "lineitem"), 250, seed=SEED)


def cluster_customers(spark, sf_dir):
    return cluster(_table(spark, sf_dir, "customer"), "c_nationkey", n_clusters=5, seed=SEED)


def cluster_lineitem(spark, sf_dir):
    return cluster(_table(spark, sf_dir, "lineitem"), "l_suppkey", n_clusters=7, seed=SEED)


def cluster_orders_with_null_key(spark, sf_dir):
    """NULL is a cluster like any other."""
    orders = _table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    keyed = orders.select("o_orderkey", "o_custkey", status.alias("priority"))
    return cluster(keyed, "priority", n_clusters=3, seed=1)


def lttb_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return lttb(events, 100, "ts", "value", "event_id").select("event_id", "user_id", "value")


def lttb_events_by_user(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return lttb(events, 12, "ts", "value", "event_id", "user_id").select("event_id", "user_id", "value")


def lttb_orders(spark, sf_dir):
    """Many points share a time; ties are ordered by key."""
    orders = _table(spark, sf_dir, "orders")
    return lttb(orders, 60, "o_orderdate", "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


# --- aggregates, typing, names -----------------------------------------------------


def check_lineitem(spark, sf_dir):
    return column_check(_table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_suppkey"], ["l_quantity"])


def presence_events(spark, sf_dir):
    """Presence of cells in a sparse view of the events."""
    events = _table(spark, sf_dir, "events")
    sparse = events.select(
        "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"),
        F.when(F.col("user_id") > 50, F.col("props")).alias("props"),
    )
    return presence(sparse)


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def infer_types_events(spark, sf_dir):
    events = _as_text(_table(spark, sf_dir, "events"))
    found = infer_types(events)
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in found.items()])
    return events.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(lines))


def typed_events(spark, sf_dir):
    """NULL tokens, hints and inference on text cells; flags by their words."""
    events = _table(spark, sf_dir, "events")
    text = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") == "view", "NULL").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "purchase", "Yes").otherwise("no").alias("bought"),
        F.when(F.col("event_type") == "click", "x").otherwise(F.col("user_id").cast("string")).alias("mixed"),
    )
    return typed_columns(text, type_hints={"value": float})


def normalized_names_part(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return normalize_columns(part.toDF("Part Key!", " Name (Text)", "3rd", "part_key"))


# --- sparse files ------------------------------------------------------------------


def csv_round_trip_events(spark, sf_dir):
    """Events to sparse files and back, typed by inference; times as text."""
    events = _table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-csv")
    write_sparse_csv(events.withColumn("ts", F.col("ts").cast("string")), path, "event_id")
    return read_sparse_csv(spark, path).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def csv_round_trip_lineitem(spark, sf_dir):
    """A table without a key, written in the order of all its columns."""
    items = _table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "lineitem-csv")
    write_sparse_csv(items.withColumn("l_shipdate", F.col("l_shipdate").cast("date")), path)
    back = read_sparse_csv(spark, path, row_index=None, type_hints={"l_quantity": float, "l_discount": float})
    return back.withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


def csv_round_trip_documents(spark, sf_dir):
    """Whole texts with line breaks and quotes, a marker of its own, NULLs kept."""
    documents = _table(spark, sf_dir, "documents")
    path = scratch_path(spark, "documents-csv")
    shown = documents.withColumn("source", F.when(F.col("lang") != "en", F.col("source")))
    fmt = dict(multi_line=True, inherit="marker", marker="^", null_values=("<null>",), null_token="<null>")
    write_sparse_csv(shown, path, ["lang", "doc_id"], **fmt)
    return read_sparse_csv(spark, path, type_hints={"text": str, "lang": str, "source": str}, **fmt)


def csv_utf16_documents(spark, sf_dir):
    """Whole texts with quoted line breaks in UTF-16."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "documents-utf16")
    fmt = dict(multi_line=True, encoding="utf-16", inherit="marker", marker="^", null_values=("<null>",), null_token="<null>")
    write_sparse_csv(documents, path, "doc_id", **fmt)
    return read_sparse_csv(spark, path, type_hints={"text": str, "lang": str}, **fmt)


def csv_ragged_and_blank_orders(spark, sf_dir):
    """Four lines for each order, without a header: whole, short, blank, and too long."""
    orders = _table(spark, sf_dir, "orders")
    key, customer, status = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus"))
    whole, long_ = F.concat_ws(",", key, customer, status), F.concat_ws(",", key, F.lit(""), F.lit("x"), F.lit("more"), F.lit("and more"))
    lines = F.concat_ws("\n", whole, F.concat(F.lit("-"), key), F.lit(""), long_)
    path = scratch_path(spark, "orders-ragged")
    orders.select(lines).write.text(path)
    hints = {"key": int, "customer": int, "status": str}
    return read_sparse_csv(spark, path, columns=list(hints), type_hints=hints, has_header=False, row_index=None)


def csv_skipped_rows_orders(spark, sf_dir):
    """Files with a row to be skipped, under names of one's own."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = scratch_path(spark, "orders-skipped")
    orders.write.option("header", True).csv(path)
    names = ["key", "customer", "priority"]
    return read_sparse_csv(spark, path, columns=names, has_header=False, skip_rows=1, row_index=None)


def csv_empty_orders(spark, sf_dir):
    """No rows: a header is written and read back."""
    none = _table(spark, sf_dir, "orders").where("o_orderkey < 0")
    path = scratch_path(spark, "orders-empty")
    written = write_sparse_csv(none, path, "o_orderkey")
    back = read_sparse_csv(spark, path)
    return back.agg(
        F.lit(written).alias("written"), F.count(F.lit(1)).alias("rows"), F.lit(len(back.columns) - 1).alias("columns")
    )


def csv_rows_written(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    written = write_sparse_csv(orders, path, "o_orderkey", columns=["o_orderstatus", "o_orderkey", "missing"])
    back = read_sparse_csv(spark, path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("o_orderkey").alias("keys"),
        F.count("missing").alias("missing"),
        F.lit(written).alias("written"),
    )


# --- recordings --------------------------------------------------------------------


def _recorded(spark, sf_dir) -> str:
    """Events as recordings, one file per day; purchases carry their value."""
    events = _table(spark, sf_dir, "events")
    frames = events.select(
        F.date_format("ts", "yyyyMMdd").alias("day"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        F.col("event_id").alias("Event ID"),
        F.col("user_id").cast("int").alias("user"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value (EUR)"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("props"),
        (F.col("event_type") == "purchase").alias("bought"),
    )
    path = scratch_path(spark, "recordings")
    signals = ["Event ID", "user", "value (EUR)", "props", "bought"]
    write_recordings(frames, path, "day", "time_ns", signals, ["Event ID"]).agg(F.sum("frames")).collect()
    return path


def _file_name(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.element_at(F.split("file_path", "/"), -1)).drop("file_path")


def recording_frames(spark, sf_dir):
    frames = _file_name(read_recordings(spark, _recorded(spark, sf_dir)))
    return frames.withColumn("time_ns", F.col("time_ns").cast("bigint")).withColumn(
        "time_us", F.unix_micros(frame_time("time_ns"))
    )


def recording_signals_by_file(spark, sf_dir):
    return _file_name(read_recording_signals(spark, _recorded(spark, sf_dir))).drop("spark_type")


def recording_audit(spark, sf_dir):
    audit = _file_name(audit_recordings(spark, _recorded(spark, sf_dir)))
    return audit.select("file", "signal_count", "imported_frame_count", "eof_valid", "status")


def recording_frame_counts(spark, sf_dir):
    return _file_name(frame_count(read_recordings(spark, _recorded(spark, sf_dir))))


def recording_import_check(spark, sf_dir):
    root = scratch_path(spark, "lake")
    import_recordings(spark, _recorded(spark, sf_dir), root, "recorded_events")
    frames = read_imported(spark, root, "recorded_events")
    files = recording_files(spark, root, "recorded_events")
    return column_check(frames, ["value_eur", "props"], ["user"]).withColumns(
        {
            "files": files.agg(F.count(F.lit(1))).scalar(),
            "frames": files.agg(F.sum("imported_frame_count")).scalar(),
        }
    )


#: Type codes and dimensions of the signals of ``recording_all_types``.
ALL_TYPES = {
    "u64": (0, ()), "u32": (1, ()), "u16": (2, ()), "u8": (3, ()), "i64": (4, ()), "i32": (5, ()), "i16": (6, ()),
    "i8": (7, ()), "bool": (8, ()), "enum": (9, ()), "f32": (10, ()), "f64": (11, ()), "text": (12, ()),
    "blob": (13, ()), "c32": (14, ()), "c64": (15, ()), "grid": (5, (2, 3)), "bins": (11, (3,)),
}


def recording_all_types(spark, sf_dir):
    """Orders as recordings with all 16 scalar types and two arrays; every third order lacks half of them."""
    key, customer, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast("double")
    priority = F.col("o_orderpriority")
    cells = {
        "u64": key, "u32": customer, "u16": key % 60_000, "u8": key % 250, "i64": -key, "i32": -customer,
        "i16": key % 30_000 - 15_000, "i8": key % 250 - 125, "bool": key % 2 == 0, "enum": key * 3,
        "f32": (key % 1000) / 8, "f64": price, "text": priority, "blob": F.concat(priority, F.lit("ü")).cast("binary"),
        "c32": F.array((key % 100) / 4, F.lit(0.5)), "c64": F.array(price, -price),
        "grid": F.array(*[(key % 1000 + i).cast("int") for i in range(6)]),
        "bins": F.array(*[((key + i) % 7).cast("double") for i in range(3)]),
    }
    few = list(cells)[1::2]
    shown = [F.when(key % 3 != 0, c).alias(n) if n in few else c.alias(n) for n, c in cells.items()]
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file"), key.alias("time_ns"), *shown)
    path = scratch_path(spark, "all-types")
    write_recordings(orders, path, "file", "time_ns", list(cells), ["time_ns"], ALL_TYPES).agg(F.sum("frames")).collect()
    frames = _file_name(read_recordings(spark, path))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("time_ns", "u64", "u32", "u16", "u8", "i64", "i32", "i16", "i8", "enum")]
    parts = [F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in ("c32", "c64") for p in ("re", "im")]
    arrays = [F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), " ").alias(c) for c in ("grid", "bins")]
    return frames.select(
        "file", *whole, "bool", F.col("f32").cast("double").alias("f32"), "f64", "text", F.hex("blob").alias("blob"), *parts, *arrays
    )


def recording_quarantine_check(spark, sf_dir):
    """Whole recordings beside cut-off ones, one for each day, whose user is text; only the whole ones count."""
    path, root = _recorded(spark, sf_dir), scratch_path(spark, "lake")
    whole = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches):
        for rows in batches:
            for name, raw in zip(rows["path"], rows["content"]):
                # the type of the signal "user" is the byte before its dimensions and name
                at = raw.index(b"user") - 13
                write_bytes(name.removesuffix(".bin") + "-cut.bin", raw[:at] + b"\x0c" + raw[at + 1 : -4])
            yield rows[["path"]]

    files = whole.mapInPandas(cut, "path string").count()
    result = import_recordings(spark, path, root, "recorded_events", on_bad_file="quarantine")
    frames = read_imported(spark, root, "recorded_events")
    return column_check(frames, ["value_eur"], ["user"]).withColumns(
        {"valid": F.lit(result.imported_files), "rejected": F.lit(result.rejected_files), "written": F.lit(files)}
    )


# --- streams -----------------------------------------------------------------------


def _event_stream(spark, sf_dir, columns):
    """Events as files of a stream, one range of event ids per file."""
    events = _table(spark, sf_dir, "events").select(*columns)
    path = scratch_path(spark, "event-stream")
    events.repartitionByRange(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("latestFirst", False).parquet(path)


def stream_expand_by_user(spark, sf_dir):
    columns = ["event_id", "user_id", "event_type", "value"]
    stream = _event_stream(spark, sf_dir, columns).withColumn(
        "last_purchase", F.when(F.col("event_type") == "purchase", F.col("value"))
    ).drop("value")
    out, state, checkpoint = (scratch_path(spark, f"expand-{n}") for n in ("out", "state", "log"))
    expand_stream(stream, "event_id", ["last_purchase"], out, state, checkpoint, "user_id").awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def stream_bernoulli(spark, sf_dir):
    stream = _event_stream(spark, sf_dir, ["event_id", "user_id", "value"])
    out, checkpoint = scratch_path(spark, "sample-out"), scratch_path(spark, "sample-log")
    sampled = bernoulli(stream, 0.2, "event_id", SEED)
    query = sampled.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start(out, format="parquet").awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, value double").parquet(out)


def stream_sparse_sink(spark, sf_dir):
    stream = _event_stream(spark, sf_dir, ["event_id", *EVENT_CELLS])
    out, checkpoint = scratch_path(spark, "sparse-out"), scratch_path(spark, "sparse-log")
    write_sparse_stream(stream, out, "event_id", checkpoint).awaitTermination()
    return read_sparse_csv(spark, out, row_index=None)


def stream_recording_import(spark, sf_dir):
    root, checkpoint = scratch_path(spark, "stream-lake"), scratch_path(spark, "import-log")
    import_recording_stream(
        spark, _recorded(spark, sf_dir), root, "recorded_events", checkpoint
    ).awaitTermination()
    frames = read_imported(spark, root, "recorded_events")
    return frames.groupBy("bought").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# --- SQL forms ---------------------------------------------------------------------


def _sparse_sql(cells: list[str]) -> str:
    """Delta-encoded events: the marker '' where a cell equals the one above."""
    parts = [
        f"CASE WHEN row_number() OVER w > 1 AND {c} IS NOT DISTINCT FROM lag({c}) OVER w THEN ''"
        f" ELSE coalesce(CAST({c} AS VARCHAR), 'NULL') END AS {c}"
        for c in cells
    ]
    return f"SELECT event_id, {', '.join(parts)} FROM events WINDOW w AS (ORDER BY event_id)"


def _fill_sql() -> str:
    fills = [
        f"nullif(last_value(nullif({c}, '') IGNORE NULLS) OVER w, 'NULL') AS {c}" for c in EVENT_CELLS
    ]
    return (
        f"WITH s AS ({_sparse_sql(EVENT_CELLS)}), f AS (SELECT event_id, {', '.join(fills)} FROM s WINDOW w AS"
        " (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
        " SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, props FROM f"
    )


LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _stats_sql(table: str, cols: list[str], order: list[str]) -> str:
    """Elided cells and bytes per column. Text forms are as in the engine itself."""
    flags = ", ".join(
        f"row_number() OVER w > 1 AND {c} IS NOT DISTINCT FROM lag({c}) OVER w AS e_{c},"
        f" octet_length(encode(coalesce(CAST({c} AS VARCHAR), 'NULL'))) AS b_{c}"
        for c in cols
    )
    lines = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (e_{c}) AS cells_elided,"
        f" CAST(coalesce(sum(b_{c}) FILTER (e_{c}), 0) AS BIGINT) AS bytes_saved FROM f"
        for c in cols
    )
    return f"WITH f AS (SELECT {flags} FROM {table} WINDOW w AS (ORDER BY {', '.join(order)})) {lines}"


def _compare_sql() -> str:
    cols = ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    parts = []
    for order in (["l_returnflag", "l_linestatus"], ["l_shipdate"], ["l_suppkey"]):
        full = order + [c for c in cols if c not in order]
        stats = _stats_sql("lineitem", cols, full)
        parts.append(
            f"SELECT '{','.join(order)}' AS sort_order, max(rows) AS rows, CAST(sum(cells_elided) AS BIGINT) AS"
            f" cells_elided, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM ({stats})"
        )
    return " UNION ALL ".join(parts)


def _lttb_sql(size: int, table: str, key: str, x: str, y: str, series: str, columns: str) -> str:
    """The published algorithm as a recursion over buckets, series by series."""
    inner = size - 2
    return f"""
    WITH RECURSIVE p AS (
      SELECT {series} AS s, {key} AS k, {x} AS x, {y} AS y,
             row_number() OVER (PARTITION BY {series} ORDER BY {x}, {key}) - 1 AS i,
             count(*) OVER (PARTITION BY {series}) AS n
      FROM {table}),
    q AS (
      SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN {inner + 1}
                     ELSE (i * {inner} - 1) // (n - 2) + 1 END AS b
      FROM p WHERE n > {size}),
    m AS (SELECT s, b, avg(x) AS mx, avg(y) AS my FROM q GROUP BY s, b),
    c AS (
      SELECT s, k, x, y, b FROM q WHERE b = 0
      UNION ALL
      SELECT q.s,
             arg_max(q.k, (abs((c.x - m.mx) * (q.y - c.y) - (c.x - q.x) * (m.my - c.y)), -q.i)) AS k,
             arg_max(q.x, (abs((c.x - m.mx) * (q.y - c.y) - (c.x - q.x) * (m.my - c.y)), -q.i)) AS x,
             arg_max(q.y, (abs((c.x - m.mx) * (q.y - c.y) - (c.x - q.x) * (m.my - c.y)), -q.i)) AS y,
             q.b
      FROM c JOIN q ON q.s = c.s AND q.b = c.b + 1 JOIN m ON m.s = c.s AND m.b = c.b + 2
      GROUP BY q.s, q.b)
    SELECT {columns} FROM {table} t JOIN (
      SELECT s, k FROM c UNION SELECT s, k FROM q WHERE b = {inner + 1}
      UNION SELECT s, k FROM p WHERE n <= {size}) chosen
    ON t.{key} = chosen.k"""


def _hash(*key: str) -> str:
    return f"md5('{SEED}:' || " + " || ':' || ".join(key) + ")"


def _threshold(probability: float) -> str:
    return f"{int(probability * 2**32):08x}"


_DAY = "strftime(ts, '%Y%m%d') || '.bin'"
_FRAMES = f"""
SELECT {_DAY} AS file, row_number() OVER (PARTITION BY {_DAY} ORDER BY event_id) - 1 AS frame_index,
       epoch_us(ts) * 1000 AS time_ns, event_id, CAST(user_id AS INTEGER) AS "user",
       CASE WHEN event_type <> 'view' THEN value END AS value_eur,
       CASE WHEN event_type <> 'click' THEN props END AS props,
       event_type = 'purchase' AS bought, epoch_us(ts) AS time_us
FROM events"""
_PURCHASES = """
SELECT event_id, user_id, event_type,
       last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase
FROM events"""


def _all_types_sql() -> str:
    key, price = "o_orderkey", "CAST(o_totalprice AS DOUBLE)"
    cells = {
        "u64": key, "u32": "o_custkey", "u16": f"{key} % 60000", "u8": f"{key} % 250", "i64": f"-{key}", "i32": "-o_custkey",
        "i16": f"{key} % 30000 - 15000", "i8": f"{key} % 250 - 125", "bool": f"{key} % 2 = 0", "enum": f"{key} * 3",
        "f32": f"({key} % 1000) / 8", "f64": price, "text": "o_orderpriority", "blob": "hex(encode(o_orderpriority || 'ü'))",
        "c32": None, "c64": None, "grid": f"concat_ws(' ', {', '.join(f'{key} % 1000 + {i}' for i in range(6))})",
        "bins": f"concat_ws(' ', {', '.join(f'({key} + {i}) % 7' for i in range(3))})",
    }
    few = list(cells)[1::2]
    cells |= {"c32_re": f"({key} % 100) / 4", "c32_im": "0.5", "c64_re": price, "c64_im": f"-{price}"}
    shown = [
        f"CASE WHEN {key} % 3 <> 0 THEN {c} END AS \"{n}\"" if n.split("_")[0] in few else f"{c} AS \"{n}\""
        for n, c in cells.items()
        if c
    ]
    return f"SELECT o_orderstatus || '.bin' AS file, {key} AS time_ns, {', '.join(shown)} FROM orders"


def _numbered(table: str, order: str, where: str, columns: str = "*") -> str:
    return (
        f"SELECT {columns} FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS row_index, * FROM {table})"
        f" WHERE {where}"
    )


def _llm():
    """The pipeline and the queries for training data, or None without their files."""
    try:
        import corpus_pipeline
        from rowtide.llm import queries as llm
    except ImportError:  # their files or a library they need are not there
        return None
    return corpus_pipeline, llm


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if (found := _llm()) is None:
        return {}
    pipeline, llm = found
    return llm.queries() | {"pipeline": pipeline.run}


def _llm_sql() -> dict[str, str]:
    if (found := _llm()) is None:
        return {}
    pipeline, llm = found
    return llm.oracle_sql() | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB with the same columns as the query of the same name."""
    all_items = ", ".join(LINEITEM)
    some_items = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    items_sql = (
        _sparse_sql(some_items)
        .replace("SELECT event_id, ", "SELECT ")
        .replace("FROM events", "FROM lineitem")
        .replace("ORDER BY event_id", f"ORDER BY {', '.join(some_items)}")
    )
    return {
        "sparsify_events": _sparse_sql(EVENT_CELLS),
        "expand_events": _fill_sql(),
        "expand_sparse_events": _fill_sql(),
        "expand_null_key_events": """
            WITH e AS (SELECT nullif(event_id, (SELECT max(event_id) FROM events)) AS event_id, user_id, event_type,
                              CASE WHEN event_type = 'purchase' THEN props END AS p FROM events)
            SELECT event_id, user_id, event_type, last_value(p IGNORE NULLS) OVER (
                     ORDER BY event_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props FROM e""",
        "expand_last_purchase_by_user": _PURCHASES,
        "expand_orders_by_priority": """
            SELECT o_orderkey, o_orderdate, o_orderpriority,
                   last_value(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END IGNORE NULLS) OVER w AS open_price,
                   last_value(CASE WHEN o_orderstatus = 'O' THEN o_custkey END IGNORE NULLS) OVER w AS open_customer
            FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "expand_events_aggregate": f"""
            SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users,
                   CAST(sum(user_id) AS BIGINT) AS sum_user
            FROM ({_fill_sql()}) GROUP BY event_type""",
        "sparsify_lineitem": items_sql,
        "sparsity_stats_events": _stats_sql("events", ["event_id", *EVENT_CELLS], ["event_id"]),
        "sparsity_stats_lineitem": _stats_sql("lineitem", LINEITEM, LINEITEM),
        "compare_orders_lineitem": _compare_sql(),
        "range_orders_key": "SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 2500",
        "range_orders_price": "SELECT * FROM orders WHERE trunc(o_totalprice) BETWEEN 100000 AND 200000",
        "range_events_value_below": """
            SELECT event_id, user_id, event_type, value, props FROM events WHERE trunc(value) <= 20""",
        "range_parts_text": """
            SELECT * FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE p_type END
                           AS size_text FROM part)
            WHERE regexp_full_match(size_text, '[0-9]+') AND try_cast(size_text AS BIGINT) >= 20""",
        "range_sorted_copy_lineitem": "SELECT * FROM lineitem WHERE l_partkey BETWEEN 100 AND 300",
        "row_numbers_orders": _numbered("orders", "o_orderkey", "row_index IN (0, 2, 4, 777, 14999)"),
        "row_numbers_many_lineitem": _numbered("lineitem", all_items, "row_index IN (SELECT o_orderkey * 4 FROM orders)"),
        "row_numbers_stored_orders": _numbered("orders", "o_orderkey", "row_index IN (0, 2, 4, 777, 14999)"),
        "systematic_stored_orders": _numbered(
            "orders", "o_orderkey", f"row_index % 100 = {systematic_start(100, SEED)}", "* EXCLUDE (row_index)"
        ),
        "rowid_range_orders": _numbered("orders", "o_orderkey", "row_index + 1 BETWEEN 101 AND 350"),
        "rowid_set_documents": _numbered("documents", "doc_id", "row_index + 1 IN (1, 5, 10, 500, 1000)"),
        "rowid_range_lineitem": _numbered("lineitem", all_items, "row_index + 1 BETWEEN 20001 AND 20400"),
        "row_index_events_by_time": _numbered("events", "ts, event_id", "true", "row_index, event_id, user_id"),
        "chunks_conversations": """
            SELECT row_index // 100 AS chunk_id, count(*) AS rows, min(row_index) AS first_row,
                   CAST(sum(length(text)) AS BIGINT) AS characters
            FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index, text FROM conversations)
            GROUP BY 1""",
        "preview_orders": "SELECT * FROM orders LIMIT 10",
        "bernoulli_orders": f"""
            SELECT * FROM orders WHERE substr({_hash('o_orderkey')}, 1, 8) < '{_threshold(0.1)}'""",
        "bernoulli_conversations": f"""
            SELECT * FROM conversations
            WHERE substr({_hash('conv_id', 'turn')}, 1, 8) < '{_threshold(0.25)}'""",
        "reservoir_orders": f"SELECT * FROM orders ORDER BY {_hash('o_orderkey')}, o_orderkey LIMIT 50",
        "reservoir_orders_large": f"SELECT * FROM orders ORDER BY {_hash('o_orderkey')}, o_orderkey LIMIT 5000",
        "reservoir_documents": f"SELECT * FROM documents ORDER BY {_hash('doc_id')}, doc_id LIMIT 100",
        "systematic_orders": _numbered(
            "orders", "o_orderkey", f"row_index % 100 = {systematic_start(100, SEED)}", "* EXCLUDE (row_index)"
        ),
        "systematic_lineitem": _numbered(
            "lineitem", all_items, f"row_index % 250 = {systematic_start(250, SEED)}", "* EXCLUDE (row_index)"
        ),
        "cluster_customers": f"""
            SELECT * FROM customer WHERE c_nationkey IN (
              SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer)
              ORDER BY {_hash('c_nationkey')}, c_nationkey LIMIT 5)""",
        "cluster_lineitem": f"""
            SELECT * FROM lineitem WHERE l_suppkey IN (
              SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem)
              ORDER BY {_hash('l_suppkey')}, l_suppkey LIMIT 7)""",
        "cluster_orders_with_null_key": """
            WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority <> '1-URGENT'
                       THEN o_orderpriority END AS priority FROM orders),
            k AS (SELECT priority FROM (SELECT DISTINCT priority FROM o)
                  ORDER BY md5('1:' || coalesce(priority, chr(0) || 'null')), priority NULLS FIRST LIMIT 3)
            SELECT o.* FROM o JOIN k ON o.priority IS NOT DISTINCT FROM k.priority""",
        "lttb_events": _lttb_sql(
            100, "events", "event_id", "CAST(epoch_us(ts) AS DOUBLE)", "value", "0", "event_id, user_id, value"
        ),
        "lttb_events_by_user": _lttb_sql(
            12, "events", "event_id", "CAST(epoch_us(ts) AS DOUBLE)", "value", "user_id",
            "event_id, user_id, value",
        ),
        "lttb_orders": _lttb_sql(
            60, "orders", "o_orderkey", "CAST(epoch_us(o_orderdate) AS DOUBLE)", "o_totalprice", "0",
            "o_orderkey, o_totalprice",
        ),
        "check_lineitem": """
            SELECT count(*) AS rows, count(l_shipdate) AS count_l_shipdate, count(l_suppkey) AS count_l_suppkey,
                   sum(l_quantity) AS sum_l_quantity FROM lineitem""",
        "presence_events": """
            WITH t AS (SELECT count(*) AS n, count(event_id) AS a,
                              count(CASE WHEN event_type = 'purchase' THEN value END) AS b,
                              count(CASE WHEN user_id > 50 THEN props END) AS c FROM events)
            SELECT 'event_id' AS "column", n AS rows, a AS present, a / n AS presence FROM t
            UNION ALL SELECT 'purchase_value', n, b, b / n FROM t
            UNION ALL SELECT 'props', n, c, c / n FROM t""",
        "infer_types_events": """
            WITH n AS (SELECT count(*) AS rows FROM events)
            SELECT rows, t.* FROM n, (VALUES ('event_id', 'bigint'), ('ts', 'string'), ('user_id', 'bigint'),
              ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t("column", type)""",
        "typed_events": """
            SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
                   CASE WHEN event_type <> 'view' THEN value END AS value, event_type = 'purchase' AS bought,
                   CASE WHEN event_type = 'click' THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS mixed
            FROM events""",
        "normalized_names_part": """
            SELECT p_partkey AS part_key, p_name AS name_text, p_size AS signal_2, p_retailprice AS part_key_1
            FROM part""",
        "csv_round_trip_events": """
            SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, event_id, epoch_us(ts) AS ts, user_id,
                   event_type, value, props FROM events""",
        "csv_round_trip_lineitem": """
            SELECT * REPLACE (CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate) FROM lineitem""",
        "csv_round_trip_documents": """
            SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_index, doc_id, text, lang,
                   CASE WHEN lang <> 'en' THEN source END AS source, n_chars FROM documents""",
        "csv_utf16_documents": """
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id, lang, text FROM documents""",
        "csv_ragged_and_blank_orders": """
            SELECT o_orderkey AS key, o_custkey AS customer, o_orderstatus AS status FROM orders
            UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus FROM orders
            UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus FROM orders
            UNION ALL SELECT o_orderkey, o_custkey, 'x' FROM orders""",
        "csv_skipped_rows_orders": """
            SELECT o_orderkey AS key, o_custkey AS customer, o_orderpriority AS priority FROM orders""",
        "csv_empty_orders": """
            SELECT count(*) AS written, count(*) AS rows,
                   (SELECT count(*) FROM (DESCRIBE orders)) AS columns FROM orders WHERE o_orderkey < 0""",
        "csv_rows_written": """
            SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, 0 AS missing,
                   (SELECT count(*) FROM orders) AS written FROM orders GROUP BY o_orderstatus""",
        "recording_frames": _FRAMES,
        "recording_signals_by_file": f"""
            SELECT file, t.* FROM (SELECT DISTINCT {_DAY} AS file FROM events), (VALUES
              (0, 'time_ns', 'time_ns', 0, 0, '[]', ''), (1, 'Event ID', 'event_id', 4, 0, '[]', ''),
              (2, 'user', 'user', 5, 0, '[]', ''), (3, 'value (EUR)', 'value_eur', 11, 0, '[]', ''),
              (4, 'props', 'props', 12, 0, '[]', ''), (5, 'bought', 'bought', 8, 0, '[]', ''))
              t(signal_index, original_name, column_name, signal_type, dimension_count, dimensions_json, formula)""",
        "recording_audit": f"""
            SELECT {_DAY} AS file, 6 AS signal_count, count(*) AS imported_frame_count, true AS eof_valid,
                   'valid' AS status FROM events GROUP BY 1""",
        "recording_frame_counts": f"SELECT {_DAY} AS file, count(*) AS frame_count FROM events GROUP BY 1",
        "recording_import_check": f"""
            SELECT count(*) AS rows, count(value_eur) AS count_value_eur, count(props) AS count_props,
                   CAST(sum("user") AS BIGINT) AS sum_user, count(DISTINCT file) AS files, count(*) AS frames
            FROM ({_FRAMES})""",
        "recording_all_types": _all_types_sql(),
        "recording_quarantine_check": f"""
            SELECT count(*) AS rows, count(value_eur) AS count_value_eur, CAST(sum("user") AS BIGINT) AS sum_user,
                   CAST(count(DISTINCT file) AS INTEGER) AS valid, CAST(count(DISTINCT file) AS INTEGER) AS rejected,
                   CAST(count(DISTINCT file) AS INTEGER) AS written
            FROM ({_FRAMES})""",
        "stream_expand_by_user": _PURCHASES,
        "stream_bernoulli": f"""
            SELECT event_id, user_id, value FROM events
            WHERE substr({_hash('event_id')}, 1, 8) < '{_threshold(0.2)}'""",
        "stream_sparse_sink": "SELECT event_id, user_id, event_type, props FROM events",
        "stream_recording_import": """
            SELECT event_type = 'purchase' AS bought, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
            FROM events GROUP BY 1""",
    } | _llm_sql()


def core_queries() -> list[Callable[[SparkSession, str], DataFrame]]:
    """The queries of the order-aware library, without those for training data; each has SQL."""
    return [
        sparsify_events, expand_events, expand_sparse_events, expand_null_key_events, expand_last_purchase_by_user, expand_orders_by_priority,
        expand_events_aggregate, sparsify_lineitem, sparsity_stats_events, sparsity_stats_lineitem,
        compare_orders_lineitem, range_orders_key, range_orders_price, range_events_value_below,
        range_parts_text, range_sorted_copy_lineitem, row_numbers_orders, rowid_range_orders, rowid_set_documents, rowid_range_lineitem,
        row_numbers_many_lineitem, row_numbers_stored_orders, systematic_stored_orders,
        row_index_events_by_time, chunks_conversations, preview_orders, bernoulli_orders,
        bernoulli_conversations, reservoir_orders, reservoir_orders_large, reservoir_documents, systematic_orders,
        systematic_lineitem, cluster_customers, cluster_lineitem, cluster_orders_with_null_key, lttb_events,
        lttb_events_by_user, lttb_orders, check_lineitem, presence_events, infer_types_events, typed_events,
        normalized_names_part, csv_round_trip_events, csv_round_trip_lineitem, csv_round_trip_documents,
        csv_utf16_documents, csv_ragged_and_blank_orders, csv_skipped_rows_orders, csv_empty_orders,
        csv_rows_written, recording_frames, recording_signals_by_file, recording_audit,
        recording_frame_counts, recording_all_types, recording_import_check, recording_quarantine_check, stream_expand_by_user, stream_bernoulli,
        stream_sparse_sink, stream_recording_import,
    ]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator and form; each takes (spark, sf_dir)."""
    return {f.__name__: f for f in core_queries()} | _llm_queries()


def entry(spark: SparkSession) -> DataFrame:
    """Events delta-encoded, expanded again and aggregated per event type."""
    return expand_events_aggregate(spark, SMOKE_DIR)
