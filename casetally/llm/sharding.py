"""Operator 12: a reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows are numbered in the order of their key and content: ranges of the order are sorted apart, and a row's
number is its place in its range plus the rows of the ranges before. A balanced Feistel network permutes
0 .. 4^k - 1, the least such domain that holds all numbers; a number that lands beyond the last row is sent
through again until it does not (cycle walking), so what remains is a permutation of the rows themselves.
Permuted number p goes to shard p mod S, slot p div S: counts differ by one at most, slots have no gaps, and
the place of a row, or the row at a place, is computed from the number of rows, the shards and the seed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, SEED, ROUNDS = 16, 12, 6
#: Rows in a file of write_shards, at most.
FILE_ROWS = 100_000
_PRIME = (1 << 31) - 1


class Feistel:
    """A permutation of 0 .. n - 1 that depends on n and the seed alone; n is 2^48 at most."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if n > 1 << 48:
            raise ValueError("more than 2^48 rows")
        self.n = n
        self.bits = max(1, ((n - 1).bit_length() + 1) // 2) if n > 0 else 1
        made = [hashlib.sha256(f"{seed}:{r}".encode()).digest() for r in range(rounds)]
        #: A factor and an offset for each round, below the prime.
        self.keys = [(1 + int.from_bytes(d[:8]) % (_PRIME - 1), int.from_bytes(d[8:16]) % _PRIME) for d in made]

    def _mix(self, half: np.ndarray, key: tuple[int, int]) -> np.ndarray:
        # All products stay below 2^63: halves have 24 bits at most, residues 31.
        t = (half * key[0] + key[1]) % _PRIME
        t = (t * t % _PRIME * key[0] + key[1]) % _PRIME
        return (t >> 7) & ((1 << self.bits) - 1)

    def _walk(self, x: np.ndarray, keys: list[tuple[int, int]], back: bool) -> np.ndarray:
        x = np.array(x, np.int64)
        if x.size and not (0 <= x.min() and x.max() < self.n):
            raise ValueError("a number outside of the permutation")
        open_ = np.arange(x.size)
        while open_.size:
            a, b = x[open_] >> self.bits, x[open_] & ((1 << self.bits) - 1)
            for key in keys:
                a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
            x[open_] = (a << self.bits) | b
            open_ = open_[x[open_] >= self.n]
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Where each number goes."""
        return self._walk(x, self.keys, back=False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        """The number that goes to each place."""
        return self._walk(x, self.keys[::-1], back=True)


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number among n rows."""
    p = int(Feistel(n, seed).forward(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies in a slot of a shard."""
    return int(Feistel(n, seed).inverse(np.array([slot * shards + shard]))[0])


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest) of each row; a null text has size 1, as an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"),
        F.md5(F.encode(whole, "utf-8")).alias("digest"),
    )


def numbered(df: DataFrame, order: list[str], column: str = "row") -> tuple[DataFrame, int]:
    """The table with a gapless row number from 0 in the order of ``order`` (nulls first), and its number of rows.

    Rows equal in ``order`` follow a hash of all their columns; wholly equal rows can't be told apart, and are
    numbered as they lie. However many rows are equal, they are dealt over all ranges that they fill.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    by = [F.col(names[df.columns.index(c)]).asc_nulls_first() for c in order]
    ordered = df.toDF(*names).withColumns({"hash": F.xxhash64(*names), "salt": F.monotonically_increasing_id()})
    cut = ordered.repartitionByRange(*by, F.col("hash"), F.col("salt")).sortWithinPartitions(*by, "hash", "salt")
    # The id holds the range in its upper bits, and counts up within it.
    kept = written(cut.select(*names, F.monotonically_increasing_id().alias("at")), "numbered")
    ranges = kept.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(ranges.select("range", before.alias("before"), "n"), "ranges")  # one row a range
    total = starts.agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0))).first()[0]
    row = (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")
    joined = kept.join(starts, F.shiftright("at", 33) == F.col("range"))
    return joined.select(*names, row.alias("number")).toDF(*df.columns, column), total


def permuted(df: DataFrame, n: int, row: str = "row", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The numbered table with ``shard`` (int) and ``slot`` (long)."""

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        order = Feistel(n, seed)
        for x in numbers:
            yield pd.Series(order.forward(x.to_numpy()))

    put = df.withColumn("place", place(row))
    return put.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("long")}).drop("place")


def shard_table(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row) of each row, under the law ``rows``.

    Null keys come first; repeated keys, and repeated rows, are rows of their own that follow their texts'
    digests. A null text is an empty one. Equal texts are not held together: the law is even counts. Fewer
    rows than shards leave the last shards empty, no rows give no rows. Other columns don't matter.
    """
    table, n = numbered(written(sized(docs, key, text), "sizes"), ["doc_id", "digest"])
    return permuted(table, n, shards=shards, seed=seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row"
    )


def write_shards(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, file_rows: int = FILE_ROWS
) -> int:
    """Write all rows as Parquet under shard=/part= in the order of their slots; returns the number of rows.

    A part holds ``file_rows`` slots, so a shard of any size is written by many tasks and one slot is read from
    one file. The table keeps its columns and gains ``shard``, ``part`` and ``slot``, which may not be among them.
    """
    clash = {"shard", "part", "slot"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are those of the shards")
    names = [f"c{i}" for i in range(len(docs.columns))]
    digest = F.md5(F.encode(F.coalesce(F.col(f"c{docs.columns.index(text)}"), F.lit("")), "utf-8"))
    order = F.col(f"c{docs.columns.index(key)}").cast("long")
    table, n = numbered(docs.toDF(*names).withColumns({"key": order, "digest": digest}), ["key", "digest"])
    dealt = permuted(table, n, shards=shards, seed=seed).withColumn("part", F.floor(F.col("slot") / file_rows))
    dealt = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
    dealt.select(*names, "slot", "shard", "part").toDF(*docs.columns, "slot", "shard", "part").write.partitionBy("shard", "part").parquet(path)
    return n


def read_shard(spark: SparkSession, path: str, shard: int, slot: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """The rows of a shard in the order of their slots, or the row of one slot, for which one part is read."""
    rows = spark.read.parquet(path).where(F.col("shard") == shard)
    if slot is not None:
        return rows.where((F.col("part") == slot // file_rows) & (F.col("slot") == slot))
    return rows.orderBy("slot")
