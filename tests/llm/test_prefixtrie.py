"""Operator 13 against a plain trie, with heavy nodes, hot and repeated conversations, nulls and ties."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from casetally.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by walking every prefix; rows of equal turns must be equal, as their order is not told here."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(made[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, bound, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "'x' as row", "1 as depth", "2 as words", "3 as k1", "4 as `range`")
    got = sorted((tuple(r)[:8] for r in prefixtrie.trie(df, bound=bound).collect()), key=repr)
    assert got == plain(rows)


def talks(seed, n, most, choices, first=0):
    rng = random.Random(seed)
    rows = []
    for c in range(first, first + n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, choices)))))
    return rows


@pytest.mark.parametrize("bound", [1, 5, 40, 100_000])
def test_trie_equals_plain(spark, bound):
    check(spark, talks(1, 120, 6, 1), bound)


@pytest.mark.parametrize("bound", [30, 100_000])
def test_hot_conversation_and_copies(spark, bound):
    rows = talks(2, 40, 4, 2)
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(150)]  # a third of all turns
    rows += [(c, t, "user", f"same {t}") for c in range(600, 660) for t in range(4)]
    rows += [(c, 0, "system", "you are") for c in range(700, 760)]
    check(spark, rows, bound, parts=11)


def test_nulls_ties_and_turnless(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, "first"), (0, 1, "user", None), (0, 2, None, None), (0, 2, None, None), (1, 0, "user", "a")]
    rows += [(c, 0, "user", "") for c in range(2, 20)]  # shorter than what they share
    rows += [(c, 0, "user", " \t one\n two") for c in range(-45, -20)]
    rows += [(63, 0, "user", "alone"), (63, 1, "user", "word " * 20_000)]
    check(spark, rows, 3)
    check(spark, rows, 100_000)


def test_no_conversation_no_node(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 0, "user", "a")], SCHEMA)).count() == 0


def test_only_turnless(spark):
    # Conversation 1 has no more turns than it would share, and nothing to share them from.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 200)}
    c = next(c for c, v in h.items() if v >= 1 and c % 20)
    check(spark, [(c, 0, "user", "a")], 10)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_know_strangers(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, (n, 3)), axis=0)
    table = prefixtrie.SlotTable(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    other = rng.integers(-(1 << 62), 1 << 62, (500, 3))
    assert (table.slots(other) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        prefixtrie.SlotTable(np.array([[1, 2, 3], [1, 2, 3]]))


@pytest.mark.parametrize("xor", [False, True])
def test_running_values_over_ranges(spark, xor):
    rng = random.Random(4)
    rows = [(c, s, rng.randint(0, 1 << 40)) for c, n in ((1, 400), (2, 3), (3, 0), (4, 500), (5, 1)) for s in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, step long, v long").repartition(5)
    got = {(r["conv_id"], r["step"]): r["r_v"] for r in prefixtrie.running(df, "step", ["v"], xor).collect()}
    want, now = {}, {}
    for c, s, v in rows:
        now[c] = now.get(c, 0) ^ v if xor else now.get(c, 0) + v
        want[c, s] = now[c]
    assert got == want
