"""Operator 13: the trie of conversation prefixes, counted in minimal-perfect-hash tables of its nodes.

1. Turns are put in order by sorted ranges, so that a conversation of any length is dealt over tasks. A prefix
   has a digest of 128 bits, the exclusive or of the digests of its turns at their depths; it is carried along
   in each range, and what a conversation has in earlier ranges is added. Two prefixes are one node if depth
   and digest agree.
2. A node is heavy if more than ``bound`` turns follow it in its members. Below the heavy nodes lie subtrees of
   bounded size, which are dealt to shards whole.
3. A shard lists its distinct prefix digests and gives each a slot by a minimal perfect hash; the digest kept in
   a slot tells apart what is in the shard and what is not. Members are scattered into flat arrays by slot, and
   leaves and saved tokens go from slot to parent slot, deepest first.
4. What a subtree or a heavy node adds to the heavy nodes above it lies on the turns of one of its members, the
   least: summed from the end of that conversation up, then by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written
from .sharding import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Turns below a node beyond which it is heavy, and about as many in a shard.
BOUND = 20_000
GAMMA = 2
NODE = ["depth", "k1", "k2"]
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SlotTable:
    """Slots 0 .. n - 1 for n distinct keys (rows of whole numbers), without gaps and without collisions.

    Keys are hashed into a field of twice as many places; keys alone at their place stay, the others go on to a
    smaller field with another hash. A key's slot is the number of taken places before its own. Each slot keeps
    its key, so that a key from elsewhere is known as such.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.int64)
        self.taken: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, total, level = keys, 0, 0
        while len(left):
            size = max(1, GAMMA * len(left))
            at = self._hash(left, level, size)
            counts = np.bincount(at, minlength=size)
            taken = counts == 1
            self.taken.append(taken)
            self.before.append(total + np.cumsum(taken) - taken)
            total += int(taken.sum())
            left, level = left[counts[at] > 1], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        self.keys = np.empty_like(keys)
        slots = self._find(keys)
        self.keys[slots] = keys
        if not np.array_equal(np.sort(slots), np.arange(len(keys))):
            raise ValueError("two keys share a slot")

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(keys), level + 1, np.uint64) * _ODD
            for column in keys.T:
                h = (h ^ column.astype(np.uint64)) * _ODD
                h ^= h >> np.uint64(29)
            return ((h >> np.uint64(3)) % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (taken, before) in enumerate(zip(self.taken, self.before, strict=True)):
            at = self._hash(keys[open_], level, len(taken))
            hit = taken[at]
            slots[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the table does not have."""
        keys = np.ascontiguousarray(keys, np.int64)
        found = self._find(keys)
        known = found >= 0
        known[known] = (self.keys[found[known]] == keys[known]).all(1)
        return np.where(known, found, -1)


def count_subtrees(depth: np.ndarray, own: np.ndarray, parent: np.ndarray, conv: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of whole subtrees, from one row for each member and depth: digests, members, and sums of subtrees.

    ``own`` and ``parent`` are digests (rows of two numbers). A node's parent slot is -1 where it lies elsewhere.
    """
    keys = np.column_stack([depth, own])
    _, first = np.unique(keys, axis=0, return_index=True)
    table = SlotTable(keys[first])
    slot, n = table.slots(keys), len(first)
    at = slot[first]
    up = np.empty(n, np.int64)
    up[at] = table.slots(np.column_stack([depth[first] - 1, parent[first]]))
    out = {"keys": table.keys, "up": up, "n_convs": np.bincount(slot, minlength=n), "conv_id": np.full(n, np.iinfo(np.int64).max)}
    np.minimum.at(out["conv_id"], slot, conv)
    out["parent"] = np.empty((n, 2), np.int64)
    out["parent"][at] = parent[first]
    text = np.empty(n, np.int64)
    text[at] = words[first]
    inside = up >= 0
    out["n_children"] = np.bincount(up[inside], minlength=n)
    leaves, saved = (out["n_children"] == 0).astype(np.int64), (out["n_convs"] - 1) * text
    levels = table.keys[:, 0]
    order = np.argsort(-levels, kind="stable")
    cuts = np.flatnonzero(np.diff(levels[order])) + 1
    for same in np.split(order, cuts):  # one depth, deepest first
        same = same[inside[same]]
        np.add.at(leaves, up[same], leaves[same])
        np.add.at(saved, up[same], saved[same])
    return out | {"n_leaves": leaves, "saved_tokens": saved}


_SUBTREE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _shard_nodes(table: pa.Table) -> pa.Table:
    c = {n: table[n].to_numpy() for n in ("depth", "k1", "k2", "p1", "p2", "conv_id", "words")}
    made = count_subtrees(c["depth"], np.column_stack([c["k1"], c["k2"]]), np.column_stack([c["p1"], c["p2"]]), c["conv_id"], c["words"])
    top = made["up"] < 0
    columns = [*made["keys"].T, *made["parent"].T, made["conv_id"], pa.array(made["conv_id"][made["up"]], mask=top)]
    columns += [made[n] for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return pa.table([*columns, top], names=[x.split()[0] for x in _SUBTREE.split(", ")])


def _running(values: list[str], xor: bool):
    """For mapInArrow over rows sorted by conv_id: adds the range, and running values within the conversation's run."""
    add = np.bitwise_xor if xor else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, last, carry = TaskContext.get().partitionId(), None, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            which = np.cumsum(np.concatenate([[False], conv[1:] != conv[:-1]]))
            sums = []
            for i, name in enumerate(values):
                total = add.accumulate(batch[name].to_numpy())
                before = np.concatenate([[0], total[starts[1:] - 1]])  # up to the run's start
                made = (total ^ before[which]) if xor else total - before[which]
                if conv[0] == last:
                    own = which == 0
                    made[own] = add(made[own], carry[i])
                carry[i] = made[-1]
                sums.append(pa.array(made))
            last = conv[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, range_, np.int64)), *sums], [*batch.schema.names, "range", *[f"r_{v}" for v in values]]
            )

    return tidy(run)


def running(df: DataFrame, step: str, values: list[str], xor: bool = False) -> DataFrame:
    """The rows with ``r_<value>``: sums, or exclusive ors, of a conversation's values up to the row in rising ``step``.

    (conv_id, step) is distinct. Ranges of that order are run through apart; a conversation that goes on in later
    ranges takes along what its earlier ranges hold, one row for each range that it fills.
    """
    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", range long" + "".join(f", r_{v} long" for v in values)
    cut = df.repartitionByRange("conv_id", step).sortWithinPartitions("conv_id", step)
    kept = written(cut.mapInArrow(_running(values, xor), kinds), "running")
    last = F.max(F.struct(step, *[f"r_{v}" for v in values])).alias("last")
    runs = kept.groupBy("conv_id", "range").agg(last).groupBy("conv_id").agg(F.count("*").alias("n"), F.array_agg(F.struct("range", "last")).alias("runs"))
    # A conversation has more than one run only if it fills whole ranges between; there are fewer such runs than twice the ranges.
    several = runs.where("n > 1").select("conv_id", F.explode("runs").alias("run")).select("conv_id", "run.range", *[F.col(f"run.last.r_{v}").alias(v) for v in values])
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.bit_xor if xor else F.sum
    carried = several.select("conv_id", "range", *[F.coalesce(total(v).over(earlier), F.lit(0)).alias(f"c_{v}") for v in values])
    joined = kept.join(written(carried, "carried"), ["conv_id", "range"], "left")
    made = []
    for v in values:
        before = F.coalesce(F.col(f"c_{v}"), F.lit(0))
        made.append((F.col(f"r_{v}").bitwiseXOR(before) if xor else F.col(f"r_{v}") + before).alias(f"r_{v}"))
    return joined.select(*df.columns, *made)


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, row, a, b, words): turns in order, one after another; ``a`` and ``b`` are digests of role and text.

    Turns without a conversation belong to none and are left out. Null turns come first; equal turns follow
    their digests. A null role or text is an empty one. Repeated rows are turns of their own.
    """
    said = [F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("a"),
        F.xxhash64(F.lit(2), *said[::-1]).alias("b"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"),
    )
    return numbered(written(rows, "turns"), ["conv_id", "turn", "a", "b"])[0].drop("turn")


def shared(rows: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first turns of a common one: (turns, conversations).

    Of conversation c the first h turns, h = crc32(c) mod 4, are those of c - c % 20 (as many as it has), and
    the others its own after its first h. Turns: (conv_id, depth, a, b, words, length); conversations: (conv_id,
    length), also those without turns.
    """
    rows = written(rows, "ordered")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("row"))
    heads = rows.withColumn("j", first).where(F.col("j") <= most).groupBy("conv_id")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("j", "a", "b", "words"))).alias("head"))
    own = rows.groupBy("conv_id").agg(F.min("row").alias("start"), F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    plan = own.withColumns({"h": h, "base": base}).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least(F.col("h"), F.size("head")))
    plan = plan.withColumn("m", taken).withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    plan = written(plan.select("conv_id", "start", "h", "m", "length", F.slice("head", F.lit(1), F.col("m")).alias("head")), "plan")
    given = plan.where("m > 0").select("conv_id", F.inline("head"), "length").select("conv_id", F.col("j").cast("long").alias("depth"), "a", "b", "words", "length")
    place = F.col("row") - F.col("start") + 1
    kept = rows.join(plan.drop("head"), "conv_id").where(place > F.col("h"))
    kept = kept.select("conv_id", (place - F.col("h") + F.col("m")).cast("long").alias("depth"), "a", "b", "words", "length")
    return given.unionByName(kept), plan.select("conv_id", F.col("length").cast("long").alias("length"))


def _ends_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.column_stack([batch[n].to_numpy() for n in NODE])
        cuts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]).any(1)]))
        ids = [str(i) for i in batch["conv_id"].to_pylist()]
        text = [",".join(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts, i]) for i in range(3)] + [batch["conv_id"].take(pa.array(cuts)), pa.array(text)], [*NODE, "first", "ids"])


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        done = []
        for *own, ids in zip(*[batch[n].to_pylist() for n in [*NODE, "ids"]], strict=True):
            if own == node:
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            state.update(ids.encode())
        yield _hashes(done)
    if node:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*NODE, "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from (depth, k1, k2, conv_id): the digest of the rising ids, joined by commas.

    Ids are joined in sorted ranges first; a node's pieces then pass through one hash, a batch at a time.
    """
    cut = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = cut.mapInArrow(tidy(_ends_texts), "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(tidy(_ends_hash), "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame, conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """The trie of (conv_id, depth, a, b, words, length) and (conv_id, length); one row for each node.

    Depths rise from 1 without gaps. The root is there if any conversation is. See ``trie`` for the columns.
    """
    conversations = written(conversations, "conversations")
    all_ = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("length").alias("turns")).first()
    x = {f"x{i}": F.xxhash64(F.lit(i), "depth", "a", "b") for i in (1, 2)}
    made = running(turns.withColumns(x).select("conv_id", "depth", "x1", "x2", "words", "length"), "depth", ["x1", "x2"], xor=True)
    k1, k2 = F.col("r_x1"), F.col("r_x2")
    rows = written(
        made.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), "words", "length"),
        "prefixes",
    )
    # Heavy nodes: a few, as each has more than ``bound`` turns below, of one depth at most turns / bound.
    heavy = rows.groupBy(*NODE).agg(
        F.sum(F.col("length") - F.col("depth") + 1).alias("below"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    heavy = written(heavy.where(F.col("below") > bound).drop("below"), "heavy")
    above = written(rows.join(heavy.select(*NODE), NODE).select("conv_id", *NODE), "above")
    deepest = above.groupBy("conv_id").agg(F.max("depth").alias("cut"))
    cut = F.coalesce(F.col("cut"), F.lit(0))
    tops = rows.join(deepest, "conv_id", "left").where(F.col("depth") == cut + 1)
    shards = max(1, -(-(all_["turns"] or 0) // bound))
    tops = written(tops.select("conv_id", cut.alias("cut"), F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).alias("shard")), "tops")
    light = rows.join(tops, "conv_id").where("depth > cut").select("shard", "conv_id", *NODE, "p1", "p2", "words")
    light = written(light.groupBy("shard").applyInArrow(_shard_nodes, _SUBTREE), "subtrees")

    top = light.where("top")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = written(heavy.select(*parent).unionByName(top.select(*parent)).groupBy(*NODE).agg(F.count("*").alias("n_children")), "children")
    heavy = written(heavy.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "heavy-nodes")
    own = heavy.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    given = own.unionByName(top.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    given = written(given.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "given")
    bearers = above.join(given.select("conv_id").distinct(), "conv_id", "left_semi").join(given, ["conv_id", "depth"], "left")
    bearers = bearers.na.fill(0, ["leaves", "saved"]).withColumn("back", -F.col("depth")).select("conv_id", "back", *NODE, "leaves", "saved")
    sums = running(bearers, "back", ["leaves", "saved"]).groupBy(*NODE).agg(F.sum("r_leaves").alias("n_leaves"), F.sum("r_saved").alias("saved_tokens"))
    heavy = heavy.join(sums, NODE)

    columns = [*NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    spark = rows.sparkSession
    total = given.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).first()
    first = children.where("depth = 0").agg(F.sum("n_children").alias("n")).first()["n"] or 0
    zero = F.lit(0).cast("long")
    # The root has every conversation, so its figures are those of the whole table.
    figures = {"conv_id": all_["conv_id"], "parent_conv_id": None, "n_convs": all_["n"], "n_children": first, "n_leaves": (total["n_leaves"] or 0) if first else 1, "saved_tokens": total["saved_tokens"] or 0}
    root = spark.range(1 if all_["n"] else 0).select(*[zero.alias(n) for n in (*NODE, "p1", "p2")], *[F.lit(v).cast("long").alias(n) for n, v in figures.items()])
    found = light.select(*columns).unionByName(heavy.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    up = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    found = found.join(up, ["depth", "p1", "p2"], "left")
    above_first = F.when(F.col("depth") == 1, F.lit(all_["conv_id"]).cast("long"))
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up", above_first)).select(*columns).unionByName(root)
    last = rows.where("depth = length").select(*NODE, "conv_id")
    last = last.unionByName(conversations.where("length = 0").select(*[zero.alias(n) for n in NODE], "conv_id"))
    found = found.join(ends(last), NODE, "left").na.fill(hashlib.sha256().hexdigest(), ["ends_sha256"])
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "k1", "k2")


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bound: int = BOUND) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id (its least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the digest k1, k2.

    Null turns come first, equal turns follow digests of role and text, null roles and texts are empty ones.
    Turns without conv_id are left out. Repeated rows are turns of their own. No conversation, no node. Other
    columns don't matter.
    """
    return nodes(*shared(ordered(conversations, conv, turn, role, text)), bound)
