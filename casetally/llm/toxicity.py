"""Operator 3: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, their stems (the first four and five letters), pairs of
neighbouring words and pairs with one word between. They are hashed into a fixed number of coordinates.
The learner keeps a rate for each coordinate and sets weak coordinates to zero (L1), so that the weights
that leave it are a short list; it is broadcast, and documents are scored where they lie, without a shuffle.

The learner sees a bounded sample of labelled rows (``TRAIN_ROWS``), chosen by a hash of the key. It keeps their
coordinates once, end to end, as 32-bit numbers.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy

THRESHOLD = 0.3
TRAIN_ROWS = 16_000
BITS = 21
DIMS = 1 << BITS
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 0.1, 5
_WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Three hashes of each word, packed into one number: word, first four and first five letters."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = [zlib.crc32(x.encode()) & DIMS - 1 for x in (word, "4" + word[:4], "5" + word[:5])]
        self[word] = packed = h[0] | h[1] << BITS | h[2] << 2 * BITS
        return packed


_WORDS = _Words()


def _pairs(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) * _MIX[0] + right.astype(np.uint64) + np.uint64(which)) * _MIX[1]
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Coordinates of all features of the text, repeats included."""
    words = _WORD.findall((text or "").lower())
    packed = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    word, four, five = packed & DIMS - 1, packed >> BITS & DIMS - 1, packed >> 2 * BITS
    return np.concatenate((word, four, five, _pairs(word[:-1], word[1:], 1), _pairs(word[:-2], word[2:], 2)))


class _Rows:
    """Rows of (distinct coordinates, label) in their order, the coordinates end to end in one flat array."""

    def __init__(self):
        self.flat, self.ends, self.labels = array("i"), array("q", [0]), array("i")

    def add(self, batch: pa.RecordBatch) -> None:
        """Take over the rows of a batch of (order, toxic, x)."""
        x = batch.column(2)
        self.flat.frombytes(x.flatten().to_numpy().tobytes())
        for n, y in zip(x.value_lengths().to_pylist(), batch.column(1).to_pylist(), strict=True):
            self.ends.append(self.ends[-1] + n)
            self.labels.append(y)

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        for i, y in enumerate(self.labels):
            yield flat[self.ends[i] : self.ends[i + 1]], y


def ftrl(rows: Iterable[tuple[np.ndarray, int]], alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over rows of (distinct coordinates, label), in their order."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for x, y in rows:
            at = np.append(x, DIMS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - y
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    w = weights(slice(None))
    return w[:DIMS], float(w[DIMS])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> list[tuple[int, float]]:
    """Nonzero weights as (coordinate, weight); coordinate DIMS is the bias.

    ``labels`` has (key, toxic). Of the keys whose crc32, as text, is not 2 modulo 4, the ``rows`` with the
    least hash are the sample; it is joined by broadcast, as ``rows`` bounds it. Of their rows in ``docs``, too,
    only ``rows`` are learned from, those with the least hash of key and text. If a key has several labels,
    the largest counts. Without a labelled row all weights are zero.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_key"), F.col("toxic").cast("int").alias("_toxic")
    )
    usable = usable.where(F.crc32(F.col("_key").cast("string").cast("binary")) % 4 != 2).groupBy("_key").agg(F.max("_toxic").alias("_toxic"))
    sample = usable.withColumn("_order", F.xxhash64("_key")).orderBy("_order", "_key").limit(rows)
    found = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(features(t.as_py())).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(made, pa.list_(pa.int32())), batch.column(3)], names=["order", "toxic", "x", "own"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            rows.add(batch)
        w, b = ftrl(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, DIMS)), pa.array(np.append(w[at], b))], names=["coordinate", "weight"]
        )

    x = found.select("_text", "_order", "_toxic", F.xxhash64("_key", "_text").alias("_own")).mapInArrow(tidy(hashed), "order long, toxic int, x array<int>, own long")
    # A key may be on any number of rows; each task passes on ``rows`` of them at most.
    bounded = x.orderBy("own", "order").limit(rows).select("order", "toxic", "x", "own")
    made = bounded.repartition(1).sortWithinPartitions("order", "own").mapInArrow(tidy(learn), "coordinate long, weight double")
    return [tuple(r) for r in made.collect()]


def with_score(docs: DataFrame, weights: list[tuple[int, float]], text: str = "text", name: str = "score") -> DataFrame:
    """The rows with one more column, the score: 0 to 1, higher for texts that are likelier toxic.

    The text alone makes the score. Null and empty texts get the score of the bias. Equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    dense: dict[str, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "w" not in dense:
            dense["w"] = np.zeros(DIMS + 1)
            for at, w in sent.value:
                dense["w"][at] = w
        w = dense["w"]
        for batch in batches:
            made = []
            for t in batch.column(0):
                x = features(t.as_py())
                x = np.unique(x[w[x] != 0])
                made.append(1.0 / (1.0 + np.exp(-np.clip(w[x].sum() + w[DIMS], -35.0, 35.0))))
            columns = [*batch.columns[1:], pa.array(made, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    out = plain.select(*names, F.lit(0.0).alias("score"))
    schema = pa.schema([pa.field(n, t) for n, t in _arrow(out)])
    at = docs.columns.index(text)
    made = plain.select(F.col(f"c{at}").cast("string").alias("t"), *names).mapInArrow(tidy(run), out.schema)
    return made.toDF(*docs.columns, name)


def _arrow(df: DataFrame) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [(f.name, f.type) for f in to_arrow_schema(df.schema)]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels are learned from rows not held out.

    A null key is not held out. Repeated rows give repeated rows, no rows give none.
    """
    weights = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return with_score(rows, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with the columns of ``docs``, whatever their names.

    Null and empty texts have the score of the bias. Repeated rows stay or go together. Without labels all rows stay.
    """
    name = fresh(docs, "score")
    return with_score(docs, train(docs, labels), name=name).where(F.col(name) < threshold).select(*docs.columns)
