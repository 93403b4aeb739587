"""Operator 4: benchmark decontamination by a BM25 inverted index of the test items with block-max WAND.

The index holds the items; every passage of every document is a query. Impacts are divided by the score an
item gives itself, so that a score is the share of the item's weight found in the passage, and one threshold
serves items of any length. Items are put into blocks by length, and passages are as long as twice the
longest item of a block and overlap by half: each occurrence of an item lies within one of them.

For a block, the largest impact of each term bounds the score of all its items. The commonest terms of an item
are not looked up at first: together they count as a constant, the most that they can add to any item of the
block. Blocks whose bound stays below the threshold are skipped; the others are scored exactly. What is
retrieved is then verified: the share of five-word shingles of the item, its question and its answer, that
the passage has. The answer is the last sentence; of an item of one sentence, the last third of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tidy, written

THRESHOLD, OVERLAP, ANSWER_OVERLAP, SHINGLE = 0.5, 0.8, 0.5, 5
K1, B = 1.2, 0.75
BLOCK = 16
#: Characters of items that one index, and so one broadcast, holds at most; more items make more indexes.
INDEX_CHARS = 8_000_000
#: Share of an item's weight, in its commonest terms, that is not looked up but taken for granted.
_COMMON = 0.3
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 3) if words else 0
    return words[:cut], words[cut:]


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """All runs of k words; of a shorter text the whole."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _order(row: tuple[float, float, float]) -> tuple:
    score, overlap, answer = row
    return overlap >= OVERLAP and answer >= ANSWER_OVERLAP, overlap, answer, score


class Index:
    """Inverted index of items (id, text), with document frequencies of all items, in blocks by length."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], total: int, mean_words: float):
        made = sorted(((len(words_of(t)), i, t) for i, t in items if words_of(t)), key=lambda x: (x[0], x[1] is None, x[1] or 0))
        self.ids = [i for _, i, _ in made]
        self.terms: dict[str, int] = {}
        self.whole, self.answer = [], []
        postings = []
        for at, (n, _, text) in enumerate(made):
            words = words_of(text)
            self.whole.append(shingles(words))
            self.answer.append(shingles(question_and_answer(text)[1]))
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * n / mean_words)
            impact = {w: np.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            own = sum(impact.values())
            postings += [(self.terms.setdefault(w, len(self.terms)), at, v / own) for w, v in impact.items()]
        self.blocks = -(-len(made) // BLOCK)
        self.longest = np.array([made[min(len(made), (b + 1) * BLOCK) - 1][0] for b in range(self.blocks)], np.int64)
        n_terms = len(self.terms)
        # Exact postings of each block: term -> (places in the block, impacts).
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(self.blocks)]
        best: dict[tuple[int, int], float] = {}
        floor = np.zeros(len(made))
        frequency = {t: df[w] for w, t in self.terms.items()}
        for t, at, v in sorted(postings, key=lambda p: (p[1], -frequency[p[0]], p[2])):
            b = at // BLOCK
            self.postings[b].setdefault(t, []).append((at % BLOCK, v))
            if floor[at] + v <= _COMMON:
                floor[at] += v
            else:
                best[t, b] = max(best.get((t, b), 0.0), v)
        self.constant = np.array([floor[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        keys = sorted(best)
        self.block_of = np.array([b for _, b in keys], np.int64)
        self.bound = np.array([best[k] for k in keys])
        self.start = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(n_terms + 2))

    def candidates(self, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(block, window) pairs whose bound reaches the threshold; x has the term of each word, or -1."""
        places = np.flatnonzero(x >= 0)
        t = x[places]
        n = self.start[t + 1] - self.start[t]
        some = n > 0
        places, t, n = places[some], t[some], n[some]
        if not len(t):
            low = np.flatnonzero(self.constant >= threshold - 1e-9)
            return self._all_windows(low, len(x))
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.start[t], n)
        block, bound, place, term = self.block_of[at], self.bound[at], np.repeat(places, n), np.repeat(t, n)
        window = place // self.longest[block]
        size = len(x) + 2
        # Each word lies in the window that starts at its stretch, and in the one before.
        window = np.concatenate((window, window - 1))
        block, bound, term = np.tile(block, 2), np.tile(bound, 2), np.tile(term, 2)
        inside = window >= 0
        key = block[inside] * size + window[inside]
        order = np.lexsort((term[inside], key))
        key, term, bound = key[order], term[inside][order], bound[inside][order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (term[1:] != term[:-1])
        key, bound = key[first], bound[first]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(bound, heads) + self.constant[key[heads] // size]
        hit = key[heads][total >= threshold - 1e-9]
        low = np.flatnonzero(self.constant >= threshold - 1e-9)
        return [(int(k // size), int(k % size)) for k in hit] + self._all_windows(low, len(x))

    def _all_windows(self, blocks: np.ndarray, n: int) -> list[tuple[int, int]]:
        """A block whose common terms alone may reach the threshold has every window looked at."""
        return [(int(b), w) for b in blocks for w in range(-(-n // int(self.longest[b])))]

    def scores(self, block: int, terms: np.ndarray) -> np.ndarray:
        """Exact scores of the items of a block against a passage with these terms."""
        made = np.zeros(BLOCK)
        postings = self.postings[block]
        for t in np.unique(terms[terms >= 0]).tolist():
            for at, v in postings.get(t, ()):
                made[at] += v
        return made

    def search(self, text: str | None, threshold: float = THRESHOLD) -> dict[int, tuple[float, float, float]]:
        """Items retrieved from the whole text: place in the index -> (score, overlap, answer overlap).

        Of the passages of an item one that is a leak comes first, then the one with the largest overlaps.
        """
        words = words_of(text)
        if not words or not self.ids:
            return {}
        x = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        found: dict[int, tuple[float, float, float]] = {}
        for b, w in sorted(set(self.candidates(x, threshold))):
            long = int(self.longest[b])
            span = slice(w * long, (w + 2) * long)
            score = self.scores(b, x[span])
            hits = np.flatnonzero(score >= threshold - 1e-9)
            have = shingles(words[span]) if len(hits) else set()
            for at in hits.tolist():
                at_all = b * BLOCK + at
                whole, answer = self.whole[at_all], self.answer[at_all]
                passage = have if len(next(iter(whole))) == SHINGLE else shingles(words[span], len(next(iter(whole))))
                tail = passage if len(next(iter(answer))) == len(next(iter(whole))) else shingles(words[span], len(next(iter(answer))))
                row = (float(score[at]), len(whole & passage) / len(whole), len(answer & tail) / len(answer))
                if at_all not in found or _order(row) > _order(found[at_all]):
                    found[at_all] = row
        return found


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes that together hold all items, one at a time, none with more than ``chars`` characters of text (one longer item is an index).

    Frequencies are counted over all items, so that an item scores alike however the items are divided.
    Items that are null or have no words are left out. Repeated items, and items that share an id or have
    none, are each an entry. The driver holds the items of one index.
    """
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    rows = written(rows.withColumn("terms", words).where("size(terms) > 0"), "items")
    total, n_words, size = rows.agg(F.count("*"), F.sum(F.size("terms")), F.sum(F.length("text"))).first()
    counts = rows.select(F.explode(F.array_distinct("terms")).alias("w")).groupBy("w").count()

    def made(block: list[tuple[int | None, str]]) -> Index:
        df: dict[str, int] = {}
        for _, t in block:
            for w in set(words_of(t)):
                df[w] = df.get(w, 0) + 1
        if len(block) < total:
            own = rows.sparkSession.createDataFrame([(w,) for w in df], "w string")
            df.update({r[0]: r[1] for r in counts.join(own, "w").collect() if r[0] in df})
        return Index(block, df, total, n_words / total)

    block: list[tuple[int | None, str]] = []
    held = 0
    for r in rows.select("id", "text").toLocalIterator():
        if block and held + len(r["text"]) > chars:
            yield made(block)
            block, held = [], 0
        block.append((r["id"], r["text"]))
        held += len(r["text"])
    if block:
        yield made(block)


HITS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])
)


def with_hits(docs: DataFrame, index: Index, text: str = "text", name: str = "hits", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with one more column: the items retrieved from their text. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    plain = docs.toDF(*names)
    out = T.StructType([*plain.schema.fields, T.StructField("hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            made = [
                [{"item_id": sent.value.ids[k], "score": s, "overlap": o, "answer_overlap": a} for k, (s, o, a) in sorted(sent.value.search(t.as_py(), threshold).items())]
                for t in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, schema.field("hits").type)], schema=schema)

    return plain.select(F.col(f"c{at}").cast("string").alias("t"), *names).mapInArrow(tidy(run), out).toDF(*docs.columns, name)


def _leaks(hits: str, overlap: float = OVERLAP, answer: float = ANSWER_OVERLAP) -> F.Column:
    return F.filter(F.col(hits), lambda h: (h["overlap"] >= overlap) & (h["answer_overlap"] >= answer))


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, n_retrieved, best_overlap) for each row of ``docs``.

    Null and empty texts hold no item. Repeated rows give repeated rows. Without items no row is contaminated.
    Items that share an id, or have none, are told apart: each that is held counts, and its id is listed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("all_hits", F.array().cast(HITS))
    for i, index in enumerate(indexes(items)):
        rows = written(rows, "hits") if i else rows  # one index is sent at a time
        rows = with_hits(rows, index, threshold=threshold).withColumn("all_hits", F.concat("all_hits", "hits")).drop("hits")
    leaks = rows.withColumn("leaks", _leaks("all_hits"))
    return leaks.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        F.array_sort(F.transform("leaks", lambda h: h["item_id"])).alias("item_ids"),
        F.size("all_hits").alias("n_retrieved"),
        F.coalesce(F.array_max(F.transform("all_hits", lambda h: h["overlap"])), F.lit(0.0)).alias("best_overlap"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold no test item, with the columns of ``docs``, whatever their names.

    Null and empty texts stay, repeated rows stay as often as they are there, and without items all rows stay.
    """
    columns, name = docs.columns, fresh(docs, "hits")
    for i, index in enumerate(indexes(items)):
        docs = written(docs, "clean") if i else docs
        docs = with_hits(docs, index, text, name=name).where(F.size(_leaks(name)) == 0).select(*columns)
    return docs
