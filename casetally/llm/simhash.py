"""Operator 8: near-duplicates by SimHash fingerprints and anchor points of a covering code.

A fingerprint of 64 bits is cut into blocks of 24, 24 and 16 bits. If two fingerprints differ in at most
four bits, then they differ in at most one bit in one of the first two blocks, or not at all in the third.
The anchors of a block of 24 bits are the words whose first 15 bits are a codeword of the Hamming code and
whose other 9 bits are free: a covering code of radius 1. Each fingerprint has its home at the nearest
anchor and is replicated to every anchor within radius + threshold, that is 2 (46 or 17 anchors, 18.8 on
average). Of two that differ in one bit of the block, each so comes to the home of the other. The anchors
of the last block are all words, with radius and threshold 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .components import components

BITS, LIMIT, SHINGLE, SEED = 64, 4, 4, 42
#: Homes at one anchor above which its comparisons are spread over several tasks.
SPLIT_ABOVE = 20_000
_CODE, _FREE = 15, 9
_PART = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text: majority of each bit over the XXH64 of its shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    spans = list(zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), _PART):
        part = np.array([hashed(line[i:j], SEED) for i, j in spans[at : at + _PART]], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["key", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "key long, fp long")


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each word of 15 bits; for each syndrome the seven pairs of bits that lead to other codewords."""
    words = np.arange(1 << _CODE)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(_CODE):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    pairs = [[1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, _CODE + 1) if i < i ^ s] for s in range(1, _CODE + 1)]
    return syndrome, np.array(pairs, np.int64)


_SYNDROME, _PAIRS = _code_tables()
_ONE = [1 << i for i in range(_FREE)]
_TWO = [1 << i | 1 << j for i in range(_FREE) for j in range(i)]


def _home(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest anchor of each word of 24 bits, and the syndrome of its first 15 bits."""
    s = _SYNDROME[block & (1 << _CODE) - 1]
    return np.where(s > 0, block ^ (1 << np.maximum(s - 1, 0)), block), s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, whether it is the home) for all anchors of each fingerprint."""
    rows, keys, homes = [], [], []

    def add(row: np.ndarray, key: np.ndarray, home: bool) -> None:
        rows.append(row)
        keys.append(key)
        homes.append(np.full(len(row), home))

    every = np.arange(len(fp))
    for name, shift in ((1, 40), (2, 16)):
        block = (fp >> np.uint64(shift)).astype(np.int64) & (1 << 24) - 1
        at, s = _home(block)
        tag = name << 32
        add(every, at | tag, True)
        for mask in _ONE:
            add(every, at ^ mask << _CODE | tag, False)
        exact, off = np.flatnonzero(s == 0), np.flatnonzero(s)
        for mask in _TWO:
            add(exact, at[exact] ^ mask << _CODE | tag, False)
        for k in range(_PAIRS.shape[1]):
            add(off, block[off] ^ _PAIRS[s[off] - 1, k] | tag, False)
    add(every, (fp & np.uint64(0xFFFF)).astype(np.int64) | 3 << 32, True)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key, home = anchors(fp.view(np.uint64))
            if homes_only:
                row, key, home = row[home], key[home], home[home]
            for at in range(0, len(row), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part]), pa.array(home[part]), pa.array(fp[row[part]])], names=["anchor", "home", "fp"]
                )

    return run


class _Forest:
    """Roots of the groups linked so far; only links that join two groups are kept."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.kept.append((i, j))


def compare(key: np.ndarray, home: np.ndarray, fp: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, homes first: a spanning forest of each key's links.

    Rows at a distance of 1, 2, 3, ... places are compared at once. Within a key only links between rows
    that no earlier link joined are kept, so their number is below that of the rows.
    """
    forest = _Forest(len(key))
    labels, stale = np.arange(len(key)), 0
    left = np.flatnonzero(home)
    step = 1
    while len(left):
        left = left[left + step < len(key)]
        left = left[key[left + step] == key[left]]
        right = left + step
        near = np.bitwise_count(fp[left] ^ fp[right]) <= limit
        a, b = left[near], right[near]
        open_ = labels[a] != labels[b]
        forest.link(a[open_], b[open_])
        stale += int(open_.sum())
        if stale > max(64, len(key) >> 6):
            labels = np.array([forest.root(i) for i in range(len(key))])
            stale = 0
        step += 1
    kept = np.array(forest.kept, np.int64).reshape(-1, 2)
    return kept[:, 0], kept[:, 1]


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and part; an anchor that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []

    def linked(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("anchor").to_numpy() * 65_521 + rows.column("part").to_numpy()
        fp = rows.column("fp").to_numpy()
        i, j = compare(key, rows.column("home").to_numpy(), fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part = batch.column("anchor"), batch.column("part")
        a, p = anchor.to_numpy(), part.to_numpy()
        same = (a == a[-1]) & (p == p[-1])
        if held and same.all() and (held[-1].column("anchor")[-1], held[-1].column("part")[-1]) == (anchor[0], part[0]):
            held.append(batch)
            continue
        cut = int(len(a) - same.sum())
        held.append(batch.slice(0, cut))
        yield linked(pa.Table.from_batches(held))
        held = [batch.slice(cut)]
    if held:
        yield linked(pa.Table.from_batches(held))


def links(distinct: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): links between different fingerprints that connect just what all links up to the limit connect.

    ``distinct`` has one long column without repeats. At an anchor with more than ``split_above`` homes
    these are dealt out to several tasks, each with all the anchor's fingerprints: every comparison is still made.
    """
    rows = distinct.select(F.col(distinct.columns[0]).alias("fp"))
    schema = "anchor long, home boolean, fp long"
    homes = rows.mapInArrow(_replicate(True), schema)
    hot = written(homes.groupBy("anchor").count().where(F.col("count") > split_above), "hot-anchors")
    spread = rows.mapInArrow(_replicate(False), schema)
    if hot.head(1):
        parts = hot.select("anchor", F.ceil(F.col("count") / split_above).alias("parts"))
        spread = (
            spread.join(parts, "anchor", "left")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)).cast("int") - 1)))
            .withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.coalesce(F.col("parts"), F.lit(1))) == F.col("part")))
            .select("anchor", "part", "home", "fp")
        )
    else:
        spread = spread.select("anchor", F.lit(0).alias("part"), "home", "fp")
    dealt = spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return dealt.mapInArrow(tidy(_compare_sorted), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Rows whose fingerprints differ in at most four bits are linked; component_id is the least key that links
    reach. Equal fingerprints are one point: copies are never compared. Rows with a null key take part, and
    their component has the least key that is not null, or null. Repeated rows give repeated rows; null and
    empty texts have fingerprint 0; no rows give no rows. Other columns are ignored.
    """
    made = written(fingerprints(docs, key, text), "fingerprints")
    points = made.groupBy("fp").agg(F.min("key").alias("least"))
    found = written(components(links(points.select("fp"), split_above)), "fingerprint-groups")
    rooted = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return made.join(of_point, "fp").select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a near-duplicate filter keeps: of each component the row with the least key.

    Of equal rows with that key one is kept, of different texts under that key each. A row with a null key
    can't be named in the result, so it stays.
    """
    groups = near_duplicates(docs, key, text)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    known = docs.where(F.col(key).isNotNull())
    kept = known.join(keep, known[key] == keep["_keep"], "left_semi").dropDuplicates([key, text])
    return kept.union(docs.where(F.col(key).isNull()))
