"""Operator 11: ranked lexical search by range-maximum tables over posting lists.

Documents are indexed once, in shards of bounded size: postings by term, in the order of doc_id. Statistics of
the whole corpus make the weight of a term and the impact of a posting, both whole numbers. Per posting list a
sparse table answers where the largest impact of any range of documents is. A search keeps intervals of
documents by an upper bound, the sum of the lists' range maxima: it takes the highest first, splits it at the
document with its largest impact, scores that document, and bounds what is left on either side. It ends when no
interval can hold a document that belongs to the ten best; intervals of a few documents are scored at once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, tidy_group, written

K = 10
#: Bytes of text in a shard of the index; terms of the items that are searched together; documents in a last interval; intervals split at once.
SHARD_BYTES, BLOCK_TERMS, LEAF, AT_ONCE = 16_000_000, 100_000, 4, 64
#: How the index is written: a shard is a row group of its own, so that those who read it hold one at a time.
ONE_BY_ONE = {"parquet.block.row.count.limit": 1}
# Bytes of ASCII that separate terms become blanks, A-Z become a-z; others stay as they are.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats: runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Postings:
    """The posting lists of some terms in a shard, their impacts, and sparse tables of the largest ones."""

    def __init__(self, lists: list[np.ndarray], impacts: list[np.ndarray], n_docs: int):
        self.n = n_docs
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.docs = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.impact = np.concatenate(impacts).astype(np.int64) if lists else np.zeros(0, np.int64)
        # One sorted sequence for all lists: term number and document.
        self.key = np.repeat(np.arange(len(lists), dtype=np.int64), self.size) * n_docs + self.docs
        # Padded, so that one index takes level and place.
        width = len(self.docs)
        self.table = np.zeros((max(int(self.size.max(initial=0)).bit_length(), 1), width), np.int32)
        self.table[0] = np.arange(width)
        for level in range(1, len(self.table)):
            half, n = 1 << (level - 1), width - (1 << level) + 1
            a, b = self.table[level - 1, :n], self.table[level - 1, half : half + n]
            self.table[level, :n] = np.where(self.impact[a] >= self.impact[b], a, b)

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest impact of each range a .. b - 1 is (the first of equals), and whether the range has any."""
        width = b - a
        some = width > 0
        level = np.frexp(np.maximum(width, 1))[1] - 1
        a = np.where(some, a, 0)
        last = np.where(some, b - (1 << level.astype(np.int64)), 0)
        x, y = self.table[level, a], self.table[level, last]
        return np.where(self.impact[x] >= self.impact[y], x, y), some


class Best:
    """The k best (score, doc) so far: higher scores first, then lower documents."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, score: int, doc: int) -> None:
        if score > 0:
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -doc))
            elif (score, -doc) > self.heap[0]:
                heapq.heapreplace(self.heap, (score, -doc))

    def beaten(self, bound: int, lo: int) -> bool:
        """Whether no document from ``lo`` on with a score of at most ``bound`` can be among the best."""
        return bound <= 0 or len(self.heap) == self.k and (bound, -lo) < self.heap[0]

    def floor(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1


def search(p: Postings, terms: np.ndarray, gain: np.ndarray, k: int = K, leaf: int = LEAF, at_once: int = AT_ONCE) -> tuple[list[tuple[int, int]], int]:
    """[(document, score)] of the k best documents, and how many were scored. ``gain`` multiplies a term's impacts."""
    best, scored = Best(k), 0
    if not len(terms):
        return [], 0
    base = terms * p.n
    a, b = p.start[terms][None], p.start[terms + 1][None]
    heap: list[tuple] = []
    number = 0

    def push(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        nonlocal number
        at, some = p.largest(a, b)
        each = np.where(some, p.impact[at] * gain, 0)
        bound = each.sum(1)
        top = each.argmax(1)
        split = p.docs[at[np.arange(len(at)), top]]
        for i in np.flatnonzero(bound >= best.floor()).tolist():
            if not best.beaten(int(bound[i]), int(lo[i])):
                number += 1
                heapq.heappush(heap, (-int(bound[i]), int(lo[i]), number, int(hi[i]), int(split[i]), a[i], b[i]))

    push(np.zeros(1, np.int64), np.full(1, p.n, np.int64), a, b)
    while heap:
        taken = []
        while heap and len(taken) < at_once:
            x = heapq.heappop(heap)
            if best.beaten(-x[0], x[1]):
                heap = [] if -x[0] < best.floor() else heap
                continue
            taken.append(x)
        if not taken:
            break
        lo, hi, split = (np.array([x[i] for x in taken], np.int64) for i in (1, 3, 4))
        a, b = np.array([x[5] for x in taken]), np.array([x[6] for x in taken])
        small = hi - lo <= leaf
        if small.any():
            # All postings of the small intervals, added up by document.
            own = np.flatnonzero(small)
            width = (b[own] - a[own]).ravel()
            at = np.repeat(a[own].ravel() - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            which = np.repeat(np.repeat(np.arange(len(own)), len(terms)), width)
            sums = np.zeros(len(own) * leaf, np.int64)
            np.add.at(sums, which * leaf + p.docs[at] - lo[own][which], p.impact[at] * np.repeat(np.tile(gain, len(own)), width))
            scored += int((hi[own] - lo[own]).sum())
            good = np.flatnonzero(sums >= best.floor())
            for i in good[np.argsort(-sums[good], kind="stable")].tolist():
                best.add(int(sums[i]), int(lo[own[i // leaf]]) + i % leaf)
        if not small.all():
            lo, hi, split, a, b = (x[~small] for x in (lo, hi, split, a, b))
            want = base[None] + split[:, None]
            x = np.searchsorted(p.key, want)
            hit = (x < b) & (p.key[np.minimum(x, len(p.key) - 1)] == want)
            scores = np.where(hit, p.impact[np.minimum(x, len(p.key) - 1)] * gain, 0).sum(1)
            scored += len(split)
            for s, d in zip(scores.tolist(), split.tolist(), strict=True):
                best.add(s, d)
            push(np.concatenate([lo, split + 1]), np.concatenate([split, hi]), np.concatenate([a, x + hit]), np.concatenate([x, b]))
    return sorted(((-d, s) for s, d in best.heap), key=lambda r: (-r[1], r[0])), scored


_INDEX = "shard long, n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<string>, dfs array<long>, docs binary, tfs binary"


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    """The n numbers that were written in equally many bytes each."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _shard(number: int, ids: list[int | None], words: list[np.ndarray], known: list[bytes]) -> pa.RecordBatch:
    """One row: documents by rising id (nulls last), and for each term, by its number, documents and occurrences."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    sizes = np.array([len(words[i]) for i in order], np.int64)
    n = max(1, len(order))
    flat = np.concatenate([words[i] for i in order]) if order else np.zeros(0, np.int64)
    key, tf = np.unique(flat * n + np.repeat(np.arange(len(order)), sizes), return_counts=True)
    dfs = np.bincount(key // n, minlength=len(known))
    row = {
        "shard": number, "n_docs": len(order), "n_terms": int(sizes.sum()), "ids": [ids[i] for i in order], "sizes": sizes,
        "terms": [w.decode() for w in known], "dfs": dfs, "docs": _narrow(key % n), "tfs": _narrow(tf),
    }
    kinds = {"ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int64()), "docs": pa.binary(), "tfs": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], list(row))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents that have a term, one row for each shard, where the texts lie: nothing is shuffled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def fresh():
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return [], [], numbers, 0

        ids, words, numbers, size = fresh()
        for batch in batches:
            for id_, t in zip(batch["id"], batch["text"], strict=True):
                found = terms_of(t.as_py())
                if found:
                    ids.append(id_.as_py())
                    words.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                    size += 8 * len(found)
                if size >= shard_bytes:
                    yield _shard((part << 32) + made, ids, words, list(numbers))
                    made += 1
                    ids, words, numbers, size = fresh()
        if ids:
            yield _shard((part << 32) + made, ids, words, list(numbers))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(build), _INDEX)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sorted(Counter(terms_of(t)).items()) for t in batch["text"].to_pylist()]
        names = [hashlib.sha256(b" ".join(b"%s %d" % r for r in row)).hexdigest() for row in rows]
        words = pa.array([[w.decode() for w, _ in row] for row in rows], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch["item_id"], pa.array(names, pa.string()), words, pa.array([[n for _, n in row] for row in rows], pa.list_(pa.int64()))], ["item_id", "query", "terms", "counts"]
        )


def weighted(items: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """(query, terms, gains): each distinct query once, with those terms that any of the n documents has; a gain is weight times count."""
    asked = items.groupBy("query").agg(F.first("terms").alias("terms"), F.first("counts").alias("counts"))
    asked = written(asked.select("query", F.inline(F.arrays_zip("terms", "counts"))).toDF("query", "term", "count"), "asked")
    counted = shards.select(F.inline(F.arrays_zip("terms", "dfs"))).toDF("term", "df")
    dfs = counted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("long")
    pairs = asked.join(dfs, "term").withColumn("gain", F.col("count") * w).where("gain > 0")
    packed = F.sort_array(F.collect_list(F.struct("term", "gain"))).alias("p")
    return pairs.groupBy("query").agg(packed).select("query", F.col("p.term").alias("terms"), F.col("p.gain").alias("gains"))


def _blocks(queries: DataFrame, terms: int) -> Iterator[list[tuple[str, list[str], list[int]]]]:
    """The queries in blocks of at most so many terms (one longer query is a block), one block at a time."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        if block and size + len(r["terms"]) > terms:
            yield block
            block, size = [], 0
        block.append((r["query"], r["terms"], r["gains"]))
        size += len(r["terms"])
    if block:
        yield block


def _search_shard(asked, n: int, total: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        row = {c: table[c][0] for c in ("ids", "sizes", "terms", "dfs", "docs", "tfs")}
        sizes = row["sizes"].values.to_numpy()
        m = 100 - 75 + (75 * sizes * n) // total
        wanted = {w for _, terms, _ in asked.value for w in terms}
        ends = np.cumsum(row["dfs"].values.to_numpy())
        docs, tfs = (_numbers(row[c].as_py(), int(ends[-1]) if len(ends) else 0) for c in ("docs", "tfs"))
        number, lists, impacts = {}, [], []
        for w, end, df in zip(row["terms"].values.to_pylist(), ends.tolist(), row["dfs"].values.to_pylist(), strict=True):
            if w in wanted:
                number[w] = len(number)
                d, tf = docs[end - df : end].astype(np.int64), tfs[end - df : end].astype(np.int64)
                lists.append(d)
                impacts.append((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
        postings, out = Postings(lists, impacts, len(sizes)), []
        ids = row["ids"].values.to_pylist()
        for query, terms, gains in asked.value:
            own = sorted((number[w], g) for w, g in zip(terms, gains, strict=True) if w in number)
            found, _ = search(postings, np.array([x for x, _ in own], np.int64), np.array([g for _, g in own], np.int64), k)
            out += [(query, ids[d], s) for d, s in found]
        kinds = {"query": pa.string(), "doc_id": pa.int64(), "score": pa.int64()}
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return run


def ranked(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K,
    shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item.

    Null and empty texts have no terms: such documents are not found nor counted, such items find nothing.
    Repeated documents are documents of their own, with equal scores; null keys come after all others. Each row
    of ``items`` is an item, also if its id is null or repeated; equal texts are searched once. Very long texts
    are indexed whole. Other columns don't matter. No documents or no items, no rows.
    """
    spark = docs.sparkSession
    shards = written(index(docs, key, text, shard_bytes), "lexical-index", **ONE_BY_ONE)
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    kind = dict(asked.dtypes)["item_id"]
    asked = written(asked.mapInArrow(_queries, f"item_id {kind}, query string, terms array<string>, counts array<long>"), "items")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = spark.createDataFrame([], "query string, doc_id long, score long")
    for block in _blocks(written(weighted(asked, shards, n), "queries"), block_terms):
        sent = spark.sparkContext.broadcast(block)
        here = shards.groupBy("shard").applyInArrow(tidy_group(_search_shard(sent, n, total, k)), "query string, doc_id long, score long")
        found = found.unionByName(written(here, "found"))
        sent.destroy()
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item_id", "query").join(best, "query").select("item_id", "rank", "doc_id", "score")
