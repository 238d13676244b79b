"""Text quality by supervised subword embeddings.

A text is the bag of its words, pairs of neighbouring words and character n-grams, each
hashed to one of ``BUCKETS`` rows of a learned table of short vectors; all pairs of a word
with itself share one row, so a text that repeats itself shows. The mean of the rows goes through a softmax over two classes. Table and output layer are trained by
stochastic gradient descent in numpy on a bounded sample of the labelled rows, in one
task. As the layer after the mean is linear, a bucket's vector enters a text's score
only by its product with the difference of the two output columns, so scoring looks up
one number for each feature. Case, signs and repeats of characters stay visible.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.shared import column, crc32_remainder, free_names
from rowtide.llm.text_arrays import mixed, powers
from rowtide.plans.staging import stage

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4)
#: Labelled rows that training sees at most, the ones with the smallest hashes of the id.
TRAIN_ROWS = 4000
STEPS = 12_000
#: Characters that are turned into features at once. N-grams and pairs of words over the
#: border of two pieces of a longer text do not count, a word at the border counts as two.
PIECE = 1 << 18
_GRAM, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_WORD, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def groups(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Runs of texts of about a piece in all, with their places; longer texts are cut into pieces."""
    run: list[str] = []
    places: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = text[at : at + PIECE]
            if held and held + len(part) > PIECE:
                yield run, places
                run, places, held = [], [], 0
            run.append(part)
            places.append(i)
            held += len(part)
    if run:
        yield run, places


def features(run: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of non-empty texts, by kind of feature, and for each the text it is in."""
    points = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(run)), lengths)
    buckets, owners = [], []
    gram = points
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * _GRAM + points[n - 1 :]
        if n in GRAMS and len(gram):
            one_text = owner[n - 1 :] == owner[: len(gram)]
            buckets.append((((gram ^ np.uint32(n)) * _SPREAD) >> np.uint32(16))[one_text])
            owners.append(owner[: len(gram)][one_text])
    words, word_owner = _words(points, ends, owner)
    buckets.append(((words * _WORD) >> np.uint64(48)).astype(np.uint32))
    owners.append(word_owner)
    same = word_owner[1:] == word_owner[:-1]
    pairs = (((words[:-1] * _PAIR + words[1:]) * _WORD) >> np.uint64(48)).astype(np.uint32)
    pairs[words[1:] == words[:-1]] = 0  # a word said twice, whichever it is
    buckets.append(pairs[same])
    owners.append(word_owner[:-1][same])
    return buckets, owners


def _words(points: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = ends[:-1]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * powers(_BASE, len(points)), out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * powers(_INVERSE, len(points))[starts]), owner[starts]


class Model:
    """What a bucket adds to the log odds, and the log odds of a text without features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for run, places in groups(texts):
            own_total, own_count = np.zeros(len(run)), np.zeros(len(run))
            for buckets, owners in zip(*features(run)):
                own_total += np.bincount(owners, self.weights[buckets], len(run))
                own_count += np.bincount(owners, minlength=len(run))
            np.add.at(total, places, own_total)
            np.add.at(count, places, own_count)
        odds = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int | None = None, rate: float = 0.5, seed: int = 7
) -> Model:
    """Fit on bags of (distinct buckets, shares). Without both classes only the base rate is learned."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    # small samples are gone through more often: about STEPS steps, but 5 to 60 times
    epochs = epochs or min(60, max(5, STEPS // len(bags)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            speed = np.float32(rate * (1 - step / steps))
            step += 1
            buckets, shares = bags[i]
            mean = shares @ table[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            logits = mean @ out + bias
            chances = np.exp(logits - logits.max())
            slope = chances / chances.sum()
            slope[labels[i]] -= 1
            back = out @ slope
            out -= speed * np.outer(mean, slope)
            bias -= speed * np.float32(0.1) * slope
            if len(buckets):
                # scaled by the share relative to the largest, as a plain share moves rare features by nothing
                table[buckets] -= speed * (shares / shares.max())[:, None] * back
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, dtype=np.float32)
    for run, _ in groups([text]):
        for buckets in features(run)[0]:
            counts += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at] / max(counts.sum(), 1)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, held_out: int = 2, divisor: int = 4, rows: int = TRAIN_ROWS
) -> DataFrame:
    """``text``, ``label`` of at most ``rows`` labelled texts outside the held-out fold.

    An id labelled both ways, without a label, or NULL teaches nothing. Different texts
    with one id each count, repeated ones once; so the sample stays bounded however many
    documents an id has.
    """
    known = labels.select(column(labels, "doc_id", "bigint"), column(labels, "quality", "int"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(crc32_remainder(F.col("doc_id"), divisor) != held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    known = known.where("label = most").drop("most")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select(column(documents, "doc_id", "bigint"), column(documents, "text", "string"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    taught = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "key", "label").distinct()  # ``rows`` pairs at most
    taught = stage(taught.orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(rows), "quality-sample")
    found = texts.join(F.broadcast(taught), ["doc_id", "key"])  # and ``rows`` rows of numbers
    return found.groupBy("doc_id", "key").agg(F.any_value("text").alias("text"), F.any_value("label").alias("label")).drop("doc_id", "key")


def fit(sample: DataFrame, seed: int = 7) -> Model:
    """Train in one task on the bounded sample."""

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            got = [bag(t) for t in rows["text"]]
            yield pd.DataFrame(
                {
                    "label": rows["label"].to_numpy(),
                    "buckets": [b.tobytes() for b, _ in got],
                    "shares": [s.tobytes() for _, s in got],
                }
            )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "buckets"], ignore_index=True)  # the order rows arrive in must not count
        got = [
            (np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for b, s in zip(rows["buckets"], rows["shares"])
        ]
        model = train(got, rows["label"].to_numpy(), seed=seed)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = sample.mapInPandas(bags, "label int, buckets binary, shares binary").withColumn("one", F.lit(1))
    model = stage(found.groupBy("one").applyInPandas(learn, "weights binary, bias double"), "quality-model").collect()
    if not model:
        return train([], np.empty(0, dtype=np.int64))
    return Model(np.frombuffer(model[0]["weights"], dtype=np.float32), model[0]["bias"])


def with_score(documents: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """The rows with the score of their whole text added."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return documents.withColumn(name, score(column(documents, text_column, "string")))


def score_documents(
    documents: DataFrame, labels: DataFrame, accept: float = 0.7, held_out: int = 2, divisor: int = 4
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row.

    Learns from labels outside the held-out fold only, and from texts only. NULL, empty
    or blank texts without features score the learned base rate; without labels, or
    with labels of one kind, all texts score the smoothed base rate of the labels (0.5
    without any). Repeated rows score alike; an empty table gives no rows; further
    columns are not looked at.
    """
    model = fit(labelled_sample(documents, labels, held_out, divisor))
    rows = documents.select(column(documents, "doc_id", "bigint"), column(documents, "text", "string"))
    scored = with_score(rows, model)
    return scored.select(
        "doc_id",
        (crc32_remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, accept: float = 0.7) -> DataFrame:
    """The rows, all columns as they are, whose text scores at least ``accept``."""
    model = fit(labelled_sample(documents, labels))
    (name,) = free_names(documents, "score")
    return with_score(documents, model, name=name).where(F.col(name) >= accept).drop(name)
