"""Ranked lexical search by one automaton of all item terms, without a document index.

The terms of the items make an Aho-Corasick automaton, each with a guard on both sides, so
that only whole terms match. Texts are read twice: once for the numbers of documents and
terms and each term's document frequency, once for the scores. In either pass the automaton
runs over the bytes of the text, and its outputs, numbers of terms, lead to the items that
hold them. Tasks keep the best documents of each item only.

The automaton goes to all executors, so its size is bounded: items are dealt into passes
whose terms are at most ``TERM_BYTES`` together (an item with more has a pass of its own).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.llm.shared import column
from rowtide.plans.staging import stage

#: Bytes of distinct terms in one automaton.
TERM_BYTES = 8 << 20
#: Bytes of text in one run of the automaton; only a longer text makes a run longer.
RUN = 1 << 20
#: Scores held at once: documents of a run times items.
SCORES = 1 << 22
_LAST_ID = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII other than letters and digits becomes the guard, A to Z a to z; other bytes stay.
_GUARDED = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)


class Terms:
    """The terms of some items, and the items of each term."""

    def __init__(self, items: np.ndarray, terms: list[str], times: np.ndarray):
        self.words = sorted(set(terms))
        number = {w: i for i, w in enumerate(self.words)}
        which = np.fromiter((number[w] for w in terms), dtype=np.int64, count=len(terms))
        order = np.argsort(which, kind="stable")
        self.n_items = int(items.max()) + 1
        self.items, self.times = items[order], times[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.words) + 1))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, word in enumerate(self.words):
                made.add_word(" " + word.encode("utf-8", "surrogatepass").decode("latin-1") + " ", i)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def runs(self, texts: Iterable[str | None], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each run of at most ``most`` texts: place of the first text, number of terms of
        each text, and for the hits text (from 0 in the run), term, occurrences."""
        held: list[bytes] = []
        size = first = 0
        for i, text in enumerate(texts):
            if held and (size >= RUN or len(held) >= most):
                yield first, *self._hits(held)
                held, size, first = [], 0, i
            held.append((text or "").encode("utf-8", "surrogatepass").translate(_GUARDED))
            size += len(held[-1]) + 1
        if held:
            yield first, *self._hits(held)

    def _hits(self, texts: list[bytes]):
        whole = b" ".join([b"", *texts, b""])
        ends = np.cumsum([len(x) + 1 for x in texts])  # the guard after each text
        data = np.frombuffer(whole, dtype=np.uint8)
        begins = np.flatnonzero((data[1:] != 0x20) & (data[:-1] == 0x20)) + 1
        lengths = np.bincount(np.searchsorted(ends, begins), minlength=len(texts))
        pair = np.dtype([("end", np.int64), ("term", np.int64)])
        found = np.fromiter(self.automaton.iter(whole.decode("latin-1")), dtype=pair)
        text = np.searchsorted(ends, found["end"] - 1)
        keys, tf = np.unique(text * len(self.words) + found["term"], return_counts=True)
        return lengths, keys // len(self.words), keys % len(self.words), tf


def _counted(terms: Terms):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency = np.zeros(len(terms.words), dtype=np.int64)
        documents = words = 0
        for rows in batches:
            for _, lengths, _, term, _ in terms.runs(rows["text"], SCORES):
                documents += int((lengths > 0).sum())
                words += int(lengths.sum())
                frequency += np.bincount(term, minlength=len(frequency))
        seen = np.flatnonzero(frequency)
        yield pd.DataFrame(
            {"term": np.append(seen, -1), "n": np.append(frequency[seen], documents), "words": np.append(seen * 0, words)}
        )

    return count


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each item, equal scores by document."""
    order = np.lexsort((doc, -score, item))
    ranked = item[order]
    return order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]


def _scored(terms: Terms, weights: np.ndarray, documents: int, words: int, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.empty(0, dtype=np.int64)] * 3
        least = np.ones(terms.n_items, dtype=np.int64)
        most = max(1, SCORES // terms.n_items)
        for rows in batches:
            ids = rows["doc_id"].to_numpy()
            for first, lengths, text, term, tf in terms.runs(rows["text"], most):
                m = 75 + (25 * documents * lengths) // words
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[text]))
                n = np.diff(terms.first)[term]  # items of the term of each hit
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(terms.first[term], n)
                sums = np.zeros(len(lengths) * terms.n_items, dtype=np.int64)
                np.add.at(sums, np.repeat(text, n) * terms.n_items + terms.items[place], np.repeat(part, n) * terms.times[place])
                sums = sums.reshape(len(lengths), terms.n_items)
                doc, item = np.nonzero(sums >= least)
                found = [item, sums[doc, item], ids[first + doc]]
                best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                kept = _best(*best, k)
                best = [x[kept] for x in best]
                full = np.flatnonzero(np.bincount(best[0], minlength=terms.n_items) >= k)
                least[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
        yield pd.DataFrame({"item": best[0], "score": best[1], "doc_id": best[2]})

    return score


def _passes(terms: DataFrame, term_bytes: int) -> list[DataFrame]:
    """The terms dealt by item into passes of at most ``term_bytes``, or of one item."""
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term")).alias("bytes"))
    n = sizes.agg(F.coalesce(F.ceil(F.sum(F.least("bytes", F.lit(term_bytes))) / term_bytes), F.lit(1))).first()[0]
    while True:
        number = F.pmod(F.xxhash64("item"), F.lit(n))
        passes = sizes.groupBy(number.alias("pass")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items")).collect()
        if n == 1 or not any(r["bytes"] > term_bytes and r["items"] > 1 for r in passes):
            return [terms.where(number == r["pass"]) for r in passes]
        n *= 2


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 20,
    text_column: str = "text",
    item_text_column: str = "text",
    term_bytes: int = TERM_BYTES,
) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score``: the k best documents of each item.

    Terms are runs of letters and digits of ASCII and of all other characters outside
    ASCII, only A to Z lower-cased. Weights and scores are integers. Rows of ``items`` with
    the same item_id, NULL too, make one item with the terms of all; an item without
    terms, or whose terms no document holds, has no rows. Documents without text or terms
    count for nothing; rows with one doc_id are documents of their own, and a NULL doc_id
    comes last among equal scores. Either table empty: no rows. Other columns do not matter.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.coalesce(column(documents, "doc_id", "bigint"), F.lit(_LAST_ID)).alias("doc_id"),
        column(documents, text_column, "string").alias("text"),
    )
    kind = items.schema["item_id"].dataType
    lowered = F.translate(column(items, item_text_column, "string"), _UPPER, _LOWER)
    split = items.select(
        column(items, "item_id", kind.simpleString()).alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))).alias("term")
    )
    wanted = stage(split.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    empty = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)]))
    ranked = empty.selectExpr("item_id", "cast(0 as int) AS rank", "0L AS doc_id", "0L AS score")
    for part in _passes(wanted, term_bytes):
        rows = part.select("item", "term", "times").collect()  # at most term_bytes of terms
        ids = {r["item"]: None for r in rows}
        numbers = {item: i for i, item in enumerate(ids)}
        terms = Terms(
            np.array([numbers[r["item"]] for r in rows]), [r["term"] for r in rows], np.array([r["times"] for r in rows])
        )
        counts = docs.select("text").mapInPandas(_counted(terms), "term long, n long, words long")
        counts = counts.groupBy("term").agg(F.sum("n"), F.sum("words")).collect()
        counted = {term: (n, words) for term, n, words in counts}
        n_docs, n_words = counted.get(-1, (0, 0))
        if not n_words:
            continue
        weights = np.array(
            [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(i, (0, 0))[0] + 1))) for i in range(len(terms.words))]
        )
        found = docs.mapInPandas(_scored(terms, weights, n_docs, n_words, k), "item long, score long, doc_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, item) for item, i in numbers.items()], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)])
        )
        found = found.join(names, "item").select("item_id", "rank", F.expr(f"nullif(doc_id, {_LAST_ID})").alias("doc_id"), "score")
        ranked = ranked.union(found)
    return ranked
