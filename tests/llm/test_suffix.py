"""Shards and segments of the removal of repeated passages: memory, parts and results."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from casetally.llm import suffix


def prose(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 18])
def test_suffixes_sorted_some_groups_at_a_time(monkeypatch, at_a_time):
    monkeypatch.setattr(suffix, "_SORTED", at_a_time)
    s = np.frombuffer(b"abracadabra" * 30 + b"a" * 90 + bytes(50) + prose(100).encode() * 2, np.uint8)
    order, rank = suffix.suffix_array(s, 40)
    data = s.tobytes() + bytes(40)
    keys = [data[i : i + 40] for i in range(len(s))]
    assert sorted(order.tolist()) == list(range(len(s))) and [keys[i] for i in order.tolist()] == sorted(keys)
    inner = [i for i in order.tolist() if i < len(s) - 40]
    assert all((rank[a] == rank[b]) == (keys[a] == keys[b]) and rank[a] <= rank[b] for a, b in zip(inner, inner[1:], strict=False))
    assert all(len(x) == 0 for x in suffix.suffix_array(s[:0], 40))


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    """It took 84 for each, so that two tasks of an executor beside a full heap passed its limit."""
    rng = np.random.default_rng(5)
    own = [rng.integers(97, 101, n, np.uint8).tobytes() for n in rng.integers(400, 700, 800)]
    made, size = [*own, *own[:300]], sum(map(len, own + own[:300]))
    tracemalloc.start()
    shard = suffix.Shard(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * size
    counts = collections.Counter(x[i : i + 400] for x in made for i in range(len(x) - 399))
    want = [counts[x[i : i + 400]] > 1 for x in made for i in range(len(x) - 399)]
    flagged = shard.repeated()
    assert [bool(flagged[a + i]) for a, n in zip(shard.starts, shard.counts, strict=True) for i in range(n)] == want


def test_segments_of_a_batch_leave_in_parts(monkeypatch):
    monkeypatch.setattr(suffix, "_SENT", 3_000)
    texts = [prose(300, i) for i in range(6)]
    lists = [suffix.anchors(t.encode())[2].tolist() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(6)], pa.binary()), pa.array(texts), pa.array(lists, pa.list_(pa.int64())), pa.array([1] * 6, pa.int64())], names=["d", "text", "vs", "m"])
    parts = list(suffix._cut_segments(400)(iter([batch])))
    rows = pa.Table.from_batches(parts).to_pylist()
    assert len(parts) == 7 and max(sum(len(x or b"") for x in p.column("segment").to_pylist()) for p in parts) < 20_000
    for i, t in enumerate(texts):
        own = [r for r in rows if r["d"] == bytes([i])]
        assert [r["at"] for r in own] == suffix.anchors(t.encode())[0].tolist() and sum(r["n"] for r in own) == len(t.encode()) - 399
