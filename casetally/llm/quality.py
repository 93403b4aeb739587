"""Operator 2: quality by a weak-label model and a hashed linear scorer.

Several heuristic labellers vote good, bad or nothing on each text. They overlap and disagree; how far each
can be trusted is estimated by expectation-maximisation from the votes alone, over all texts: the texts are
counted by their pattern of votes, of which there are at most 3 to the power of the number of labellers. The
posterior of each pattern labels its texts, and a linear scorer over hashed words and word shapes learns from
a bounded sample of them (``TRAIN_ROWS``). It scores every text, also those on which no labeller votes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, TRAIN_ROWS = 0.5, 8_000
BITS = 18
DIMS = 1 << BITS
RATE, L2, EPOCHS = 0.5, 1e-6, 4
_CACHE_WORDS = 400_000
#: Frequent function words of the four languages of the documents.
FUNCTION_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "avec dans de des du elle en est et la le les pas pour que qui sur un une "
    "como con del el es las los no para por se su una y"
).split()


def with_votes(docs: DataFrame, text: str = "text", name: str = "votes") -> DataFrame:
    """The rows with the pattern of votes of their text, one letter a labeller: g(ood), b(ad) or - for no vote.

    Each labeller looks at one trait of the whole text. Traits are columns of their own, so that each is
    computed once a row.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("_words", F.split(F.trim(body), r"\s+"))
    words = F.col("_words")
    counted = rows.withColumns(
        {
            "_n": F.size(words).cast("double"),
            "_chars": F.length(F.replace(body, F.lit(" "), F.lit(""))).cast("double"),
            "_letters": (F.length(body) - F.length(F.regexp_replace(body, r"\p{L}+", ""))).cast("double"),
            "_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("double"),
            "_odd": F.regexp_count(body, F.lit(r"[%$#&*|<>{}\[\]=~^\\/@_+]")).cast("double"),
            "_ends": F.regexp_count(body, F.lit(r"[.!?](?=\s|$)")).cast("double"),
            "_again": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda x: x)).cast("double"),
            # Distinct words within each 200, and distinct runs of five words: neither depends on the length of the text.
            "_distinct": F.expr("aggregate(transform(sequence(0, (size(_words) - 1) div 200), i -> size(array_distinct(slice(_words, int(i) * 200 + 1, 200)))), 0, (a, x) -> a + x)").cast("double"),
            "_runs": F.expr("size(_words) div 5").cast("double"),
            "_new_runs": F.expr("size(array_distinct(transform(sequence(1, greatest(size(_words) div 5, 1)), i -> xxhash64(slice(_words, int(i) * 5 - 4, 5)))))").cast("double"),
            "_function": F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("double"),
        }
    )
    n, chars, letters = (F.greatest(F.col(c), F.lit(1.0)) for c in ("_n", "_chars", "_letters"))
    shares = counted.withColumns(
        {
            "_odd": F.col("_odd") / chars,
            "_upper": F.col("_upper") / letters,
            "_again": F.col("_again") / n,
            "_distinct": F.col("_distinct") / n,
            "_repeats": 1 - F.col("_new_runs") / F.greatest("_runs", F.lit(1.0)),
            "_function": F.col("_function") / n,
            "_ends": F.col("_ends") / n,
            "_alpha": F.col("_letters") / chars,
        }
    )
    rules = [
        ("_odd < 0.01", "_odd > 0.04"),
        ("_upper < 0.15", "_upper > 0.4"),
        ("_again < 0.02", "_again > 0.15"),
        ("_distinct > 0.3 AND _repeats < 0.3", "_distinct < 0.15 OR _repeats > 0.5"),
        ("_function > 0.12", "_function < 0.05"),
        ("_ends > 0.02 AND _ends < 0.3", "_ends < 0.005 OR _ends > 0.6"),
        ("_alpha > 0.9", "_alpha < 0.75"),
    ]
    pattern = F.concat(*(F.expr(f"CASE WHEN _n < 5 THEN '-' WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE '-' END") for good, bad in rules))
    return shares.select(*docs.columns, pattern.alias(name))


def em(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of 'good' for each pattern, and P(vote | class) as [labeller, class, vote].

    Votes are independent given the class. The start takes each labeller at its word three times in four.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([["bg-".index(x) for x in p] for p in patterns])
    table = np.full((v.shape[1], 2, 3), 0.2)
    table[:, 0, 0] = table[:, 1, 1] = 0.6
    prior = np.array([0.3, 0.7])
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.log(prior)[:, None] + sum(np.log(table[m][:, v[:, m]]) for m in range(v.shape[1]))
        made = 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(made - posterior).max() < 1e-9:
            break
        posterior = made
        weight = np.stack((n * (1 - posterior), n * posterior))
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        for m in range(v.shape[1]):
            for vote in range(3):
                table[m, :, vote] = weight[:, v[:, m] == vote].sum(1) + 0.5
            table[m] /= table[m].sum(1, keepdims=True)
    return dict(zip(patterns, posterior.tolist(), strict=True)), table


_UP, _LOW, _NUM = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[0-9]+")


class _Words(dict):
    """Hashes of a word and of its shape, packed into one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        shape = _NUM.sub("0", _UP.sub("A", _LOW.sub("a", word)))[:12]
        self[word] = packed = zlib.crc32(word.lower().encode()) & DIMS - 1 | (zlib.crc32(b"s" + shape.encode()) & DIMS - 1) << BITS
        return packed


_WORDS = _Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of a text and their values: words, shapes, pairs of shapes, and words that repeat the last."""
    words = (text or "").split()
    packed = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    word, shape = packed & DIMS - 1, packed >> BITS
    pair = (shape[:-1] * 31 + shape[1:] * 17 + 7) % DIMS
    same = np.full(int((packed[1:] == packed[:-1]).sum()), zlib.crc32(b"same") & DIMS - 1)
    at, n = np.unique(np.concatenate((word, shape, pair, same)), return_counts=True)
    value = np.sqrt(n)
    return at, value / np.sqrt(max(1.0, float((value**2).sum())))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, with a rate of its own for each coordinate."""
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-3)
    bias, bias2 = 0.0, 1e-3
    for _ in range(EPOCHS):
        for at, value, y in rows:
            g = 1.0 / (1.0 + np.exp(-np.clip(w[at] @ value + bias, -35, 35))) - y
            step = g * value + L2 * w[at]
            g2[at] += step**2
            w[at] -= RATE * step / np.sqrt(g2[at])
            bias2 += g * g
            bias -= RATE * g / np.sqrt(bias2)
    return w, bias


def train(docs: DataFrame, posterior: dict[str, float], rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> tuple[bytes, float]:
    """Weights, as single-precision numbers, and bias. The sample is the ``rows`` keys with the least hash, and ``rows`` of their rows."""
    keys = docs.select(F.col(key).cast("long").alias("_k")).where("_k is not null").distinct()
    keys = keys.withColumn("_h", F.xxhash64("_k", F.lit("quality"))).orderBy("_h", "_k").limit(rows)
    found = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("text")).join(F.broadcast(keys), "_k")
    found = with_votes(found.select(F.coalesce("text", F.lit("")).alias("text"), F.col("_h").alias("h"))).select("text", "votes", "h")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(0)]
            y = [posterior.get(p.as_py(), 0.5) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(y, pa.float64()), pa.array([a for a, _ in made], pa.list_(pa.int64())), pa.array([v for _, v in made], pa.list_(pa.float64()))],
                names=["h", "y", "at", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows)
        ]
        w, bias = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    x = found.mapInArrow(hashed, "h long, y double, at array<long>, value array<double>")
    # A key may be on any number of rows; each task passes on ``rows`` of them at most.
    bounded = x.withColumn("own", F.xxhash64("h", "at", "value")).orderBy("own").limit(rows)
    row = bounded.repartition(1).sortWithinPartitions("h", "own").drop("own").mapInArrow(learn, "w binary, bias double").first()
    return (bytes(row[0]), row[1]) if row else (bytes(4 * DIMS), 0.0)


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for each row; score is the likelihood of good quality, 0 to 1.

    Null texts count as empty; on texts of fewer than five words no labeller votes. Repeated rows give repeated
    rows, no rows give none. A null key is not in the learner's sample.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = {r[0]: r[1] for r in with_votes(rows).groupBy("votes").count().collect()}
    posterior, _ = em(counted)
    data, bias = train(rows, posterior)
    sent = spark.sparkContext.broadcast((data, posterior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(sent.value[0], np.float32)
        for batch in batches:
            scores = []
            for t in batch.column(1):
                at, value = features(t.as_py())
                scores.append(1.0 / (1.0 + float(np.exp(-np.clip(w[at] @ value + bias, -35, 35)))))
            of = [sent.value[1].get(v.as_py(), 0.5) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(of, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "votes", "posterior", "score"])

    made = with_votes(rows).select("doc_id", "text", "votes").mapInArrow(run, "doc_id long, votes string, posterior double, score double")
    return made.withColumn("keep", F.col("score") >= threshold)
