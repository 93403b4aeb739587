"""Operator 1: exact top-k inner products by ball trees, one for each shard, with branch and bound.

Vectors are dealt to shards of bounded size by a hash of their key. In a shard they form a ball tree. The
inner product of a query q with anything in a ball with centre c and radius r is at most q.c + |q| r; a ball
inside another has at most the bound of that one. Balls are visited in the order of their bounds, and a
query stops at the first ball whose bound is below its k-th score. That score is shared: each query first
searches the shard it lies in, and takes the k-th score it found there along to all other shards.
Queries of one task visit their balls together, so that products are of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, QUERY_EVERY = 20, 64, 20
#: Vectors in a shard, about; shards whose queries meet a shard's vectors in one task; vectors in a leaf.
SHARD_ROWS, SHARDS_AT_ONCE, LEAF = 16_384, 16, 128
_NONE = np.iinfo(np.int64).min


class BallTree:
    """Leaves of a ball tree: order of the rows, their limits, centres and radii, with those of the balls above."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF):
        x = v.astype(np.float64)
        self.order = np.arange(len(x))
        self.balls: list[tuple[np.ndarray, float]] = []
        self.leaves: list[tuple[int, int, list[int]]] = []
        stack = [(0, len(x), [])]
        while stack:
            a, b, path = stack.pop()
            rows = x[self.order[a:b]]
            centre = rows.mean(0)
            off = np.sqrt(((rows - centre) ** 2).sum(1))
            self.balls.append((centre, float(off.max())))
            path = [*path, len(self.balls) - 1]
            if b - a <= leaf or off.max() == 0:
                self.leaves.append((a, b, path))
                continue
            far = rows[off.argmax()]
            other = rows[((rows - far) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            side = np.argpartition(rows @ (other - far), half)
            self.order[a:b] = self.order[a:b][side]
            stack += [(a, a + half, path), (a + half, b, path)]
        self.centres = np.array([c for c, _ in self.balls])
        self.radii = np.array([r for _, r in self.balls])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's products in each leaf: the least of its ball's and those above it."""
        x = q.astype(np.float64)
        norm = np.sqrt((x**2).sum(1))
        each = x @ self.centres.T + norm[:, None] * self.radii[None]
        each += 1e-9 * (1.0 + np.abs(each) + norm[:, None] * (1.0 + np.abs(self.centres).max(initial=0.0) * x.shape[1]))
        return np.stack([each[:, path].min(1) for _, _, path in self.leaves], 1)


def _products(v: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if exact else q @ v.T


def search(v: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, place in v) of each query by score, then id; places of -1 where there are fewer.

    ``own`` are the queries' ids, which are no candidates; nothing below ``floor`` need be found. ``ids`` is sorted.
    """
    n = len(q)
    score, place = np.full((n, k), _NONE, np.int64), np.full((n, k), -1, np.int64)
    if not n or not len(v):
        return score, place
    tree = BallTree(v)
    bound = tree.bounds(q)
    visits = np.argsort(-bound, axis=1, kind="stable")
    # Products of integers are exact in doubles below 2^53.
    exact = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1]) < 2.0**53
    kth = floor.astype(np.float64)
    every = np.arange(n)
    for step in range(visits.shape[1]):
        leaf = visits[:, step]
        active = np.flatnonzero(bound[every, leaf] >= kth)
        if not len(active):
            break
        active = active[np.argsort(leaf[active], kind="stable")]
        for part in np.split(active, np.flatnonzero(np.diff(leaf[active])) + 1):
            a, b, _ = tree.leaves[leaf[part[0]]]
            rows = np.sort(tree.order[a:b])
            made = _products(v[rows], q[part], exact)
            made[ids[rows][None, :] == own[part][:, None]] = _NONE
            scores = np.concatenate((score[part], made), 1)
            places = np.concatenate((place[part], np.broadcast_to(rows, made.shape)), 1)
            # Smaller places are smaller ids; empty places come last by their score.
            best = np.lexsort((places, -(scores.astype(np.float64)) if exact else ~scores), axis=1)[:, :k]
            score[part], place[part] = np.take_along_axis(scores, best, 1), np.take_along_axis(places, best, 1)
        kth = np.maximum(floor, score[:, -1]).astype(np.float64)
    place[score == _NONE] = -1
    return score, place


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _searcher(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        dim = queries.column("dim")[0].as_py()
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        ids, v = rows.column("vec_id").to_numpy()[order], _matrix(rows.column("v"), dim)[order]
        own = queries.column("vec_id").to_numpy()
        score, place = search(v, ids, _matrix(queries.column("v"), dim), own, queries.column("floor").to_numpy(), k)
        at, slot = np.nonzero(place >= 0)
        return pa.table([own[at], ids[place[at, slot]], score[at, slot]], schema=schema)

    return run


def top_k(
    vectors: DataFrame,
    k: int = K,
    scale: int = SCALE,
    every: int = QUERY_EVERY,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each key divisible by ``every`` the k other rows of highest score.

    The score is the inner product of floor(scale * x), a long. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows with a null key; vectors of different lengths have no
    product. Equal scores go to the smaller key. Equal rows count once; a key with several vectors is a
    candidate with each, and its own in none. No rows give no rows; other columns are ignored.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound)
    rows = usable.select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    groups = -(-shards // SHARDS_AT_ONCE)
    rows = rows.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("home", F.col("shard"))
    schema = "query_id long, vec_id long, score long"

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "g"]
        # Both sides come from one table; new names keep their columns apart.
        left = left.select(*(F.col(c).alias(c) for c in ("vec_id", "v", *keys)))
        right = right.select(*(F.col(c).alias(c) for c in ("vec_id", "v", "floor", *keys)))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(k), schema)

    lowest = F.lit(_NONE + 1)
    at_home = meet(rows.withColumn("g", F.lit(0)), queries.select("vec_id", "v", "dim", "shard", F.lit(0).alias("g"), lowest.alias("floor")))
    if shards == 1:
        found = at_home
    else:
        floors = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard")
        sent = (
            queries.join(floors, queries["vec_id"] == floors["query_id"], "left")
            .select("vec_id", "v", "dim", "home", F.coalesce("kth", lowest).alias("floor"))
            .select("vec_id", "v", "dim", "floor", (F.col("home") % groups).alias("g"), others)
        )
        spread = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = at_home.union(meet(spread, sent))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
