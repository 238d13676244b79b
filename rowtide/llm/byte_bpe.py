"""Byte-level BPE from a rank file, by longest matches and backtracking.

Bytes are taken as Latin-1 characters, so an Aho-Corasick automaton of all tokens gives
the longest one at a place. Walking through the piece, a token is accepted if merging
by rank would leave it and the token before it apart (``apart``, remembered for each
pair of neighbours); else the next shorter token at the place is tried, and where none
is left the walk goes back over the last token and never comes to this place again.
Each place is given up once at most, so the walk is linear in the piece, and the one
sequence in which all neighbours stay apart is what the merges produce.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.chunk_cache import REMEMBERED, TextEncoder
from rowtide.llm.shared import column, free_names


class ByteBpe:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranked = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in ranked}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.pieces = regex.compile(pattern)
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known_apart: dict[tuple[int, int], bool] = {}
        self.known_shorter: dict[int, int | None] = {}
        self.known_pieces: dict[str, bytes] = {}
        self.matcher = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._learn(token, rank):
                self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()
        self.known_apart.clear()  # pairs asked for while only some of the merges were known
        self.text_ids = TextEncoder(self.encode)
        in_order = [self.tokens.get(rank, b"") for rank in range(max(self.tokens) + 1)]
        self.all_bytes = np.frombuffer(b"".join(in_order), dtype=np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in in_order])]).astype(np.int32)

    def _learn(self, token: bytes, rank: int) -> bool:
        """Note the merge that makes the token; False if merging never makes it."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is None or right is None or left >= rank or right >= rank:
                continue
            made = all(len(self.tokens[x]) == 1 or x in self.halves for x in (left, right))
            if made and self._stay_apart(left, right):
                self.merges[left, right] = rank
                self.halves[rank] = (left, right)
                return True
        return False

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges that build the two tokens side by side leave the border between them.

        The merges are undone from the latest: at each stage the two parts that touch
        the border must not be a pair that would have been merged before the later of
        the merges undone so far.
        """
        before = float("inf")  # merges at the border count if they come before this rank
        while True:
            merged = self.merges.get((left, right))
            if merged is not None and merged < before:
                return False
            grown_left, grown_right = self.halves.get(left), self.halves.get(right)
            if grown_left is None and grown_right is None:
                return True
            # of equal ranks the merge on the left comes first, so the right one is undone first
            if grown_right is None or (grown_left is not None and left > right):
                before, left = left, grown_left[1]
            else:
                before, right = right + 1, grown_right[0]

    def apart(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.known_apart.get(pair)
        if known is None:
            if len(self.known_apart) >= REMEMBERED:
                self.known_apart.clear()
            known = self.known_apart[pair] = self._stay_apart(left, right)
        return known

    def shorter(self, rank: int) -> int | None:
        """The longest token that the token begins with, other than itself."""
        if rank not in self.known_shorter:
            token = self.tokens[rank]
            found = (self.ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            usable = (r for r in found if r is not None and (len(self.tokens[r]) == 1 or r in self.halves))
            self.known_shorter[rank] = next(usable, None)
        return self.known_shorter[rank]

    def piece_ids(self, piece: bytes) -> list[int]:
        own = self.ranks.get(piece)
        if own is not None:
            return [own]
        text, size, longest = piece.decode("latin-1"), len(piece), self.matcher.iter_long
        known, lengths = self.known_apart, self.lengths
        ids: list[int] = []
        given_up: set[int] = set()
        at, token = 0, next(longest(text))[1]
        while at < size:
            end = at + lengths[token]
            if end not in given_up:
                fits = not ids or known.get((ids[-1], token))
                if fits is None:
                    fits = self.apart(ids[-1], token)
                if fits:
                    ids.append(token)
                    at = end
                    if at < size:
                        token = next(longest(text, at))[1]
                    continue
            less = self.shorter(token)
            if less is not None:
                token = less
            else:
                given_up.add(at)
                token = ids.pop()
                at -= lengths[token]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known_pieces
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = b"".join(map(self.packed.__getitem__, self.piece_ids(piece.encode("utf-8", "replace"))))
                if len(piece) <= 32:
                    if len(known) >= REMEMBERED // 2:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, dtype="<u4")
        out = []
        for k in range(0, len(at), 1 << 14):
            some = at[k : k + (1 << 14)]
            starts = self.ends[some]
            lengths = self.ends[some + 1] - starts
            stops = np.cumsum(lengths, dtype=np.int32)
            places = np.repeat(starts - stops + lengths, lengths)
            places += np.arange(len(places), dtype=np.int32)
            out.append(self.all_bytes.take(places).tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(path, pattern)


def id_lists(texts: pa.Array, bpe: ByteBpe) -> pa.Array:
    """The texts' ids as lists, none for NULL; one text at a time is taken out of Arrow's bytes."""
    found, ends = bytearray(), [0]
    for text in texts:
        found += bpe.text_ids(text.as_py() or "")
        ends.append(len(found) // 4)
    ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)


def tokenize(
    documents: DataFrame, path: str, pattern: str, text_column: str = "text", name: str = "token_ids"
) -> DataFrame:
    """The rows with their text's ids added as an array of integers; a NULL text has none."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return id_lists(texts, byte_bpe(path, pattern))

    return documents.withColumn(name, ids(column(documents, text_column, "string")))


def detokenize(tokens: DataFrame, path: str, pattern: str, ids_column: str = "token_ids", name: str = "bytes"):
    """The rows with the decoded bytes of their ids added."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = byte_bpe(path, pattern)
        return pd.Series([bpe.decode(np.asarray(x, dtype="<u4").tobytes()) for x in ids])

    return tokens.withColumn(name, decoded(column(tokens, ids_column, "array<int>")))


def token_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for each row's whole text.

    NULL and empty texts have no ids and the digests of nothing. Repeated rows give equal
    rows; an empty table gives none; further columns are not looked at. A text's ids live
    only in its task, so a long text takes memory for itself alone.
    """

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for rows in frames:
            out = []
            for text in rows["text"]:
                ids = bpe.text_ids(text or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            digest = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([rows[["doc_id"]].reset_index(drop=True), digest], axis=1)

    rows = documents.select(column(documents, "doc_id", "bigint"), column(documents, "text", "string"))
    # ids travel as text, for a column of integers with NULLs would become one of floats
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(digests, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows, all columns as they are, with ``token_ids`` and ``n_tokens`` (new names if taken)."""
    ids, count = free_names(documents, "token_ids", "n_tokens")
    out = tokenize(documents, path, pattern, name=ids)
    return out.withColumn(count, F.size(ids))
