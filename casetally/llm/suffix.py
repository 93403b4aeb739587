"""Operator 9: exact removal of repeated passages by suffix arrays.

A passage is a string of 400 bytes; each byte that a passage covers goes if the passage also starts anywhere
else. The steps:

1. Each passage has an anchor, the 64-byte string in it with the least hash, so equal passages have equal
   anchors. Anchors are counted over the whole corpus; a passage whose anchor occurs once occurs once.
2. What is left is cut into segments, runs of passages of one text with one anchor. Equal segments are one.
   Segments are dealt to shards of bounded size by their anchor: equal passages meet in one shard.
3. In a shard Larsson-Sadakane refinement sorts the suffixes: ranks by 8 bytes, then by twice as many, where
   only groups that are still tied are sorted again. Kasai's method gives the common prefix of neighbours, in
   lock-step over the segments. Neighbours that share 400 bytes are repeats.
4. An anchor with more segments than a shard may hold is split over several shards. These exchange digests of
   their distinct passages; what came from two shards is found in each shard's sorted list by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, tidy_group, written

LENGTH, GRAM = 400, 64
SHARD_BYTES = 2_000_000
_CHUNK = 1 << 20
_ODD, _STIR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 24) - 1
#: Suffixes that are sorted at a time, unless a group of equal ones is larger; bytes of segments that leave at a time.
_SORTED, _SENT = 1 << 18, 4 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD, np.uint64)
    down = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(_CHUNK + 1024)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first passage, number of passages, anchor hash) for each run of passages that share an anchor."""
    first, count, value = [], [], []
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, _CHUNK):
        s = np.frombuffer(data, np.uint8)[at : at + _CHUNK + length - 1].astype(np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * _UP[: len(s)], dtype=np.uint64)))
        h = (total[gram:] - total[:-gram]) * _DOWN[: len(s) - gram + 1]
        h = (h ^ h >> np.uint64(32)) * _STIR
        h ^= h >> np.uint64(29)
        # The least hash wins, of equal ones the last.
        key = h & ~np.uint64(_MASK) | np.uint64(_MASK) - np.arange(len(h), dtype=np.uint64)
        n = len(key) - width + 1
        rows = np.concatenate((key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = _MASK - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(_MASK)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        first.append(start + at)
        count.append(np.diff(np.append(start, n)))
        value.append(h[place[start]].view(np.int64))
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(value)


def _words8(s: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each place on as one number that orders like them; ``s`` has eight more bytes than n."""
    made = np.zeros(n, np.uint64)
    for i in range(8):
        made |= s[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    return made


def _by_words(s: np.ndarray, small: type) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the eight bytes that follow, and which of them begin a group of equal ones."""
    key = _words8(np.concatenate((s, np.zeros(8, np.uint8))), len(s))
    order = np.argsort(key, kind="stable").astype(small)
    key = key[order]
    head = np.ones(len(s), bool)
    head[1:] = key[1:] != key[:-1]
    return order, head


def suffix_array(s: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``length`` bytes that follow, and the rank of each place; equal strings share a rank.

    Larsson-Sadakane refinement: with ranks by h bytes, the pair of ranks at i and at i + h ranks by 2h bytes;
    a place whose rank is its own is never sorted again. Past the end counts as zero bytes.
    """
    n = len(s)
    small = np.int32 if n < 1 << 31 else np.int64
    order, head = _by_words(s, small)
    rank = np.empty(n, small)

    def ranked() -> None:
        first = np.arange(n, dtype=small)
        first[~head] = 0
        rank[order] = np.maximum.accumulate(first, out=first)

    ranked()
    h = 8
    while h < length and n:
        step, any_tied, at = min(h, length - h), False, 0
        while at < n:  # some groups at a time; ranks stay those of h bytes until all are sorted
            end = at + _SORTED
            end = n if end >= n else end + int(np.argmax(cut)) if (cut := head[end:]).any() else n
            tied = np.flatnonzero(~(head[at:end] & np.append(head[at + 1 : end], True))) + at
            at = end
            if not len(tied):
                continue
            any_tied = True
            rows = order[tied]
            pair = rank[rows].astype(np.int64) * (n + 1)
            inside = rows < n - step
            pair[inside] += rank[rows[inside] + step] + 1
            sort = np.argsort(pair, kind="stable")
            order[tied], pair = rows[sort], pair[sort]
            head[tied[1:]] = pair[1:] != pair[:-1]
        if not any_tied:
            break
        ranked()
        h += step
    return order, rank


def kasai(s: np.ndarray, starts: np.ndarray, counts: np.ndarray, before: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes, up to ``length``, that the passage at each place shares with the one sorted before it (-1: none).

    From one place to the next the common prefix shrinks by one byte at most, if the neighbour moves on by one
    as well; as suffixes are sorted by ``length`` bytes only, it may not. All segments advance together.
    """
    padded = np.concatenate((s, np.zeros(length + 8, np.uint8)))
    word = _words8(padded, len(s) + length)
    made = np.zeros(len(s), np.int32)
    by_size = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_size], counts[by_size]
    h, last = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -step, side="left"))
        i = starts[:live] + step
        j = before[i]
        known = np.where(j == last[:live] + 1, np.maximum(h[:live] - 1, 0), 0)
        known[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (known <= length - 8))
        while len(going):
            going = going[word[i[going] + known[going]] == word[j[going] + known[going]]]
            known[going] += 8
            going = going[known[going] <= length - 8]
        going = np.flatnonzero((j >= 0) & (known < length))
        while len(going):
            going = going[padded[i[going] + known[going]] == padded[j[going] + known[going]]]
            known[going] += 1
            going = going[known[going] < length]
        made[i] = h[:live] = known
        last[:live] = j
    return made


class Shard:
    """Segments of a shard, joined, with their passages in sorted order."""

    def __init__(self, segments: list[bytes], length: int = LENGTH):
        sizes = np.array([len(x) for x in segments], np.int64)
        self.length = length
        self.s = np.frombuffer(b"".join(segments), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.counts = sizes - length + 1
        order = suffix_array(self.s, length)[0]
        edge = np.zeros(len(self.s) + 1, np.int8)
        np.add.at(edge, self.starts, 1)
        np.add.at(edge, self.starts + self.counts, -1)
        self.order = order[np.cumsum(edge, dtype=np.int8)[:-1][order] > 0]
        before = np.full(len(self.s), -1, order.dtype)
        del order, edge
        before[self.order[1:]] = self.order[:-1]
        common = kasai(self.s, self.starts, self.counts, before, length)
        self.same = common[self.order] >= length

    def repeated(self) -> np.ndarray:
        """Whether the passage at each place is a repeat within the shard."""
        made = np.zeros(len(self.s), bool)
        made[self.order] = self.same | np.append(self.same[1:], False)
        return made

    def digests(self) -> np.ndarray:
        """Digests of the distinct passages, 16 bytes each."""
        data, made = memoryview(self.s), bytearray()
        for i in self.order[~self.same]:
            made += hashlib.blake2b(data[i : i + self.length], digest_size=16).digest()
        return np.frombuffer(made, "S16")

    def located(self, wanted: np.ndarray) -> np.ndarray:
        """Whether the passage at each place has one of the digests, by binary search among those of the shard."""
        own = self.digests()
        sort = np.argsort(own, kind="stable")
        found = np.searchsorted(own[sort], wanted)
        hit = np.zeros(len(own), bool)
        hit[sort[found[found < len(own)]]] = True
        made = np.zeros(len(self.s), bool)
        made[self.order] = hit[np.cumsum(~self.same) - 1]
        return made

    def runs(self, flagged: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each segment the runs (first, end) of flagged passages, from its start."""
        made = []
        for a, n in zip(self.starts.tolist(), self.counts.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], flagged[a : a + n], [False])).astype(np.int8)))
            made.append([(x, y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        return made


def _int_rows(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _count_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, counts = [], [], []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                _, _, v = anchors(t.as_py().encode(), length)
                v, c = np.unique(v, return_counts=True)
                keys += [d.as_py()] * len(v)
                values.append(v)
                counts.append(c)
            if keys:
                yield _int_rows([keys, np.concatenate(values), np.concatenate(counts)], [pa.binary(), pa.int64(), pa.int64()], ["d", "v", "c"])

    return tidy(run)


def _cut_segments(length: int):
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    names = ["d", "at", "n", "v", "name", "m", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[] for _ in types]
            size = 0
            for d, t, vs, m in zip(*batch.columns, strict=True):
                d, data, m = d.as_py(), t.as_py().encode(), m.as_py()
                first, count, v = anchors(data, length)
                keep = np.isin(v, vs.values.to_numpy())
                for a, n, x in zip(first[keep].tolist(), count[keep].tolist(), v[keep].tolist(), strict=True):
                    segment = data[a : a + n + length - 1]
                    name = hashlib.blake2b(segment, digest_size=16).digest()
                    if len(seen) > 200_000:
                        seen.clear()
                    for column, value in zip(out, (d, a, n, x, name, m, None if name in seen else segment), strict=True):
                        column.append(value)
                    size += 0 if name in seen else len(segment)
                    seen.add(name)
                if size >= _SENT:  # a batch of long texts leaves in several
                    yield _int_rows(out, types, names)
                    out, size = [[] for _ in types], 0
            yield _int_rows(out, types, names)

    return tidy(run)


_RUNS = "v long, name binary, runs array<struct<a:int,b:int>>"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _flag(length: int, in_shard: bool):
    """Runs of repeated passages of the segments of a shard: repeats within it, or passages with given digests."""

    def rows(table: pa.Table, shard: Shard, flagged: np.ndarray) -> pa.Table:
        runs = [[{"a": a, "b": b} for a, b in r] for r in shard.runs(flagged)]
        return pa.table({"v": table.column("v"), "name": table.column("name"), "runs": pa.array(runs, _RUN_TYPE)})

    def within(table: pa.Table) -> pa.Table:
        shard = Shard(table.column("segment").to_pylist(), length)
        return rows(table, shard, shard.repeated())

    def across(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows or not wanted.num_rows:
            return pa.table({"v": pa.array([], pa.int64()), "name": pa.array([], pa.binary()), "runs": pa.array([], _RUN_TYPE)})
        shard = Shard(table.column("segment").to_pylist(), length)
        digests = wanted.column("digest").cast(pa.binary(16)).combine_chunks()
        return rows(table, shard, shard.located(np.frombuffer(digests.buffers()[1], "S16", len(digests), 16 * digests.offset)))

    return tidy_group(within) if in_shard else tidy_group(across, pair=True)


def _digests(length: int):
    def run(table: pa.Table) -> pa.Table:
        made = Shard(table.column("segment").to_pylist(), length).digests()
        v, part = table.column("v")[0].as_py(), table.column("part")[0].as_py()
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(made), [None, pa.py_buffer(made)]).cast(pa.binary())
        return pa.table({"v": pa.array(np.full(len(made), v, np.int64)), "part": pa.array(np.full(len(made), part, np.int32)), "digest": digests})

    return tidy_group(run)


def _keep(length: int):
    names = ["d", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for d, t, runs in zip(*batch.columns, strict=True):
                data, kept, end, spans, removed = t.as_py().encode(), [], 0, 0, 0
                for r in sorted(runs.as_py(), key=lambda r: r["a"]):
                    a, b = r["a"], r["b"] + length - 1
                    if a > end or not spans:
                        kept.append(data[end:a])
                        spans += 1
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    end = max(end, b)
                kept.append(data[end:])
                for column, value in zip(out, (d.as_py(), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    column.append(value)
            yield _int_rows(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], names)

    return tidy(run)


def segments(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Candidate texts (d, text) and their segments (d, at, n, v, name, m, segment), from rows (doc_id, d, text).

    d is a digest of the text and m its number of copies; each distinct text is cut once.
    """
    counted = rows.select("d", "text").mapInArrow(_count_anchors(length), "d binary, v long, c long")
    of_text = written(counted.groupBy("d", "v").agg(F.sum("c").alias("all_c"), F.max("c").alias("c")), "anchors")
    total = of_text.groupBy("v").agg(F.sum("all_c").alias("total"))
    # An anchor that occurs in no other text and once in this one makes no candidate, however many copies there are.
    again = of_text.join(total.where("total > 1"), "v").where("total > all_c or c > 1").groupBy("d").agg(F.collect_list("v").alias("vs"))
    one = rows.groupBy("d").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    found = rows.join(again.join(one, "d"), "d").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = written(found.dropDuplicates(["d"]).select("d", "text", "vs", "m"), "candidate-texts")
    cut = texts.mapInArrow(_cut_segments(length), "d binary, at long, n long, v long, name binary, m long, segment binary")
    return texts, written(cut, "segments")


def repeats(cut: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(v, name, runs): repeated passages of each distinct segment. A segment that occurs twice is repeated whole."""
    distinct = cut.groupBy("v", "name").agg(F.first("segment", ignorenulls=True).alias("segment"), F.sum("m").alias("copies"))
    distinct = written(distinct, "distinct-segments")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.length("segment") - length + 1).cast("int").alias("b")))
    copied = distinct.where("copies > 1").select("v", "name", whole.alias("runs"))
    # Alone with its anchor, a segment can only repeat itself, and that takes more than one passage's length.
    sizes = distinct.groupBy("v").agg(F.sum(F.length("segment")).alias("bytes"), F.count("*").alias("n"))
    sizes = sizes.where((F.col("n") > 1) | (F.col("bytes") > length))
    sized = written(distinct.join(sizes, "v").select("v", "name", "segment", "bytes"), "shared-segments")
    total = sized.agg(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    parts = F.ceil(F.col("bytes") / shard_bytes)
    small = sized.where(F.col("bytes") <= shard_bytes).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    found = copied.union(small.groupBy("shard").applyInArrow(_flag(length, True), _RUNS))
    hot = sized.where(F.col("bytes") > shard_bytes).withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int"))
    if not hot.head(1):
        return found
    found = found.union(hot.groupBy("v", "part").applyInArrow(_flag(length, True), _RUNS))
    sent = written(hot.groupBy("v", "part").applyInArrow(_digests(length), "v long, part int, digest binary"), "passages")
    shared = sent.groupBy("v", "digest").agg(F.count("*").alias("k")).where("k > 1")
    wanted = sent.join(shared, ["v", "digest"]).select("v", "part", "digest")
    return found.union(hot.groupBy("v", "part").cogroup(wanted.groupBy("v", "part")).applyInArrow(_flag(length, False), _RUNS))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    A null text counts as empty. Repeated rows are documents of their own, so each repeats the other; a null key
    is a key like any other. Texts shorter than a passage lose nothing. No rows give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.unhex(F.md5("text")))
    facts = written(rows.select("doc_id", "d", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "documents")
    texts, cut = segments(rows.where(F.octet_length("text") >= length), length)
    runs = (
        cut.select("d", "at", "v", "name")
        .join(repeats(cut, length, shard_bytes), ["v", "name"])
        .select("d", F.explode(F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))).alias("r"))
        .groupBy("d")
        .agg(F.collect_list("r").alias("runs"))
    )
    kept = texts.select("d", "text").join(runs, "d").select("d", "text", "runs")
    kept = kept.mapInArrow(_keep(length), "d binary, n_removed long, n_spans long, kept_sha256 string")
    copies = facts.groupBy("d").agg(F.count("*").alias("m"))
    whole = (F.col("m") > 1) & (F.col("n_bytes") >= length)
    return (
        facts.join(copies.join(kept, "d", "left"), "d")
        .withColumn("n_removed", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))))
        .withColumn("n_spans", F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"))
        .withColumn("kept_sha256", F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")))
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    )
