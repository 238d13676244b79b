"""Token ids in files of patched frame-of-reference blocks.

File: magic, blocks, documents, index, footer; all numbers little-endian.

* A block holds ``BLOCK`` ids (the last one is filled up): minimum (u4), width (u1), a
  free byte, number of exceptions (u2), then each id minus the minimum, its low
  ``width`` bits packed; then the exceptions, places (u2) and high bits (u4). The width
  is the bit length that ``SHARE`` of the block's differences fit into.
* Packing is in 32 lanes: number r * 32 + k of a block starts at bit r * width of lane k,
  and word j of all lanes comes before word j + 1 of any, so one numpy operation works
  on a row of 32 numbers of all blocks of a width.
* Documents: id (i8), whether the id is NULL (u1), end of the document's ids in the file (u8).
* Index: the byte where each block starts (u8). Footer: numbers of ids, documents and
  blocks (u8 each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.chunk_cache import TextEncoder
from rowtide.llm.shared import column, mapped, new_file, shared_folder
from rowtide.plans.staging import stage

MAGIC = b"RTPFOR1\n"
BLOCK = 1024
SHARE = 0.9
#: Blocks that are packed at once.
RUN = 256
_HEAD, _FOOT = "<IBxH", "<QQQ"
_HEAD_SIZE, _FOOT_SIZE = struct.calcsize(_HEAD), struct.calcsize(_FOOT)
FILES = "part int, path string, first_id long, n_ids long, n_documents long"


# --- blocks --------------------------------------------------------------------------


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """Numbers below 2^width, in rows of BLOCK, as ``width`` * BLOCK / 32 words a row."""
    lanes = rows.reshape(len(rows), -1, 32, 32)
    out = np.zeros((len(rows), lanes.shape[1], width, 32), dtype=np.uint32)
    for r in range(32):
        word, shift = divmod(r * width, 32)
        out[:, :, word] |= lanes[:, :, r] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= lanes[:, :, r] >> np.uint32(32 - shift)
    return out.reshape(len(rows), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), -1, width, 32)
    out = np.empty((len(words), lanes.shape[1], 32, 32), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(32):
        word, shift = divmod(r * width, 32)
        got = lanes[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            got = got | (lanes[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, r] = got & mask
    return out.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Ids, a whole number of blocks, as one string of bytes a block."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    bits = np.frexp(rows.astype(np.float64))[1].astype(np.uint8)  # the bit length, 0 for 0
    kth = int(np.ceil(SHARE * BLOCK)) - 1
    widths = np.maximum(np.partition(bits, kth, axis=1)[:, kth], 1)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        at, width = np.flatnonzero(widths == width), int(width)
        some = rows[at]
        body = _packed(some & np.uint32((1 << width) - 1), width)
        high = (some >> np.uint32(width)) if width < 32 else np.zeros_like(some)
        for k, i in enumerate(at):
            places = np.flatnonzero(high[k])
            out[i] = (
                struct.pack(_HEAD, int(least[i]), width, len(places))
                + body[k].tobytes()
                + places.astype("<u2").tobytes()
                + high[k][places].astype("<u4").tobytes()
            )
    return out


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these bytes."""
    heads = [struct.unpack_from(_HEAD, data, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    for width in np.unique(widths):
        at, size = np.flatnonzero(widths == width), int(width) * BLOCK // 8
        body = np.stack([data[s + _HEAD_SIZE : s + _HEAD_SIZE + size] for s in starts[at].tolist()])
        out[at] = _unpacked(np.ascontiguousarray(body).view("<u4"), int(width))
        for i in at[np.array([heads[i][2] for i in at]) > 0].tolist():
            n, exceptions = heads[i][2], int(starts[i]) + _HEAD_SIZE + size
            places = np.frombuffer(data[exceptions : exceptions + 2 * n].tobytes(), dtype="<u2")
            high = np.frombuffer(data[exceptions + 2 * n : exceptions + 6 * n].tobytes(), dtype="<u4")
            out[i, places] |= high << np.uint32(width)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    return out.ravel()


# --- files ---------------------------------------------------------------------------


class BlockWriter:
    """Writes documents' ids in the order they are added; keeps a run of blocks in memory."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        stream.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= RUN * BLOCK:
            self._write_blocks(False)

    def _write_blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype=np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        if last and len(rest):
            ids, whole = np.concatenate([ids, np.full(BLOCK - len(rest), rest[0])]), whole + BLOCK
            rest = rest[:0]
        for at in range(0, whole, RUN * BLOCK):
            for block in encode_blocks(ids[at : min(whole, at + RUN * BLOCK)]):
                self.starts.append(self.at)
                self.stream.write(block)
                self.at += len(block)
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        self._write_blocks(True)
        self.stream.write(np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes())
        self.stream.write(np.array([d is None for d in self.doc_ids], dtype="u1").tobytes())
        self.stream.write(np.array(self.ends, dtype="<u8").tobytes())
        self.stream.write(np.array(self.starts, dtype="<u8").tobytes())
        self.stream.write(struct.pack(_FOOT, self.n_ids, len(self.doc_ids), len(self.starts)))
        self.stream.close()


class BlockReader:
    """Documents of a file, any of them without those before it: the index leads to its blocks."""

    def __init__(self, path: str):
        self.data = mapped(path)
        if self.data[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError(f"{path} is no file of token blocks")
        self.n_ids, self.n_documents, blocks = struct.unpack(_FOOT, self.data[-_FOOT_SIZE :].tobytes())
        at = len(self.data) - _FOOT_SIZE - 8 * blocks
        self.starts = self._numbers(at, blocks, "<u8")
        self.ends = self._numbers(at - 8 * self.n_documents, self.n_documents, "<u8").astype(np.int64)
        self.is_null = self._numbers(at - 9 * self.n_documents, self.n_documents, "u1").astype(bool)
        self.doc_ids = self._numbers(at - 17 * self.n_documents, self.n_documents, "<i8")

    def _numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.data[at : at + n * np.dtype(kind).itemsize].tobytes(), dtype=kind)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids by their places in the file."""
        if end <= first:
            return np.empty(0, dtype=np.uint32)
        block = first // BLOCK
        got = decode_blocks(self.data, self.starts[block : -(-end // BLOCK)])
        return got[first - block * BLOCK : end - block * BLOCK]

    def documents(self, first: int, end: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place of the first token, and ids of documents by their numbers in the file."""
        at = first
        while at < end:
            begin = int(self.ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + RUN * BLOCK, side="right")))
            stop = min(stop, end)
            ids = self.ids(begin, int(self.ends[stop - 1]))
            for i in range(at, stop):
                start = int(self.ends[i - 1]) if i else 0
                own = ids[start - begin : int(self.ends[i]) - begin]
                yield None if self.is_null[i] else int(self.doc_ids[i]), start, own
            at = stop


# --- tables --------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def one(text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def many(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    return TextEncoder(one, special, many)


def write_token_files(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode whole texts and write them in ascending ``doc_id``; a row for each file.

    A range of ids goes to each task, which writes one file under a name of its own, so
    an attempt that died leaves a file no row names. NULL ids come first; rows of one id
    are ordered by a hash of the text, which also lets many such rows fall into several
    ranges. The rows (``part``, ``path``, ``first_id``, ``n_ids``, ``n_documents``) are
    written to the shared folder: reading them does not encode again.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, writer = _encoder(tokenizer_path), np.array([end_id], dtype=np.uint32), None
        for rows in frames:
            for doc_id, is_null, text in zip(rows["doc_id"], rows["is_null"], rows["text"]):
                if writer is None:
                    path, stream = new_file(folder, ".pfor")
                    writer = BlockWriter(stream)
                ids = np.frombuffer(encode(text or ""), dtype="<u4")
                writer.add(None if is_null else int(doc_id), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            first = writer.doc_ids[0]
            row = (TaskContext.get().partitionId(), path, first, writer.n_ids, len(writer.doc_ids))
            yield pd.DataFrame([row], columns=["part", "path", "first_id", "n_ids", "n_documents"]).astype(
                {"first_id": "Int64"}
            )

    rows = documents.select(column(documents, "doc_id", "bigint"), column(documents, "text", "string"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("is_null"), "text")
    return stage(ordered.mapInPandas(write, FILES), "token-files")


def read_token_files(spark: SparkSession, files: DataFrame, documents_in_task: int = 8192) -> DataFrame:
    """``doc_id``, ``start``, ``token_ids`` of all documents in the files, in any order of rows.

    ``start`` counts the ids of all documents before, over all files. A task reads a run
    of documents of a file through its index.
    """
    return _read(spark, files, documents_in_task, "token_ids array<long>", lambda ids: {"token_ids": ids.astype(np.int64)})


def _read(spark: SparkSession, files: DataFrame, documents_in_task: int, schema: str, made) -> DataFrame:
    # one row for each file, so as many as the tasks that wrote them
    start, runs = 0, []
    for f in files.orderBy("part").collect():
        for first in range(0, f["n_documents"], documents_in_task):
            runs.append((f["path"], start, first, min(f["n_documents"], first + documents_in_task)))
        start += f["n_ids"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for path, before, first, end in rows.itertuples(index=False):
                reader, out, held = BlockReader(path), [], 0
                for doc_id, at, ids in reader.documents(first, end):
                    out.append({"doc_id": doc_id, "start": before + at} | made(ids))
                    held += len(ids)
                    if held > RUN * BLOCK:
                        yield pd.DataFrame(out).astype({"doc_id": "Int64"})
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    table = spark.createDataFrame(runs, "path string, before long, first long, stop long")
    table = table.repartition(max(1, len(runs)))
    return table.mapInPandas(read, "doc_id long, start long, " + schema)


def token_index(documents: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the files.

    Files are written by ``write_token_files`` and read back. NULL and empty texts have
    the end id alone. Rows with one id are neighbours, those with a NULL id first; an
    empty table gives no rows; further columns are not looked at.
    """
    spark = documents.sparkSession
    files = write_token_files(documents, tokenizer_path, shared_folder(spark, "token-blocks"), end_id)

    def digest(ids: np.ndarray) -> dict:
        return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}

    return _read(spark, files, 8192, "n_tokens long, ids_crc32 long", digest)
