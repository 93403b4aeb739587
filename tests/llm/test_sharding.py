"""Operator 12 against plain versions: the permutation, the numbers, and shards written and read."""

import hashlib
import zlib

import numpy as np
import pytest
from test_corpus import edge_rows

from casetally.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 12])
def test_feistel_permutes(n, seed):
    order = sharding.Feistel(n, seed)
    made = order.forward(np.arange(n))
    assert sorted(made.tolist()) == list(range(n))
    assert order.inverse(made).tolist() == list(range(n))


def test_feistel_of_large_numbers():
    n = (1 << 48) - 59
    order, x = sharding.Feistel(n), np.array([0, 1, 12345678901, n - 1])
    assert (order.forward(x) < n).all() and (order.inverse(order.forward(x)) == x).all()
    with pytest.raises(ValueError):
        sharding.Feistel((1 << 48) + 1)
    with pytest.raises(ValueError):
        order.forward(np.array([n]))


def test_seeds_give_other_orders_and_neighbours_part():
    a, b = sharding.Feistel(5000, 1).forward(np.arange(5000)), sharding.Feistel(5000, 2).forward(np.arange(5000))
    assert (a == b).sum() < 25
    assert (np.abs(np.diff(a)) == 1).sum() < 25
    assert abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def plain(rows, shards, seed=sharding.SEED):
    """Everything of a row that does not hang on how wholly equal rows are told apart."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, r in enumerate(order):
        raw = (r[1] or "").encode()
        shard, slot = sharding.place_of(i, len(rows), shards, seed)
        assert sharding.row_at(shard, slot, len(rows), shards, seed) == i
        out.append((r[0], len(raw) + 1, zlib.crc32(raw), "rows", shard, slot, None, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_shard_table_equals_plain(spark, documents, parts):
    rows = edge_rows() + [(99, "same")] * 40 + [(i, f"text {i}") for i in range(100, 160)]
    table = sharding.shard_table(documents(rows, extra=True).repartition(parts))
    got = sorted((tuple(r) for r in table.collect()), key=repr)
    assert got == plain(rows, 16)
    sizes = [sum(r[4] == s for r in got) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sizes[s]))


def test_few_rows_and_no_rows(spark, documents):
    assert sharding.shard_table(documents([(1, "a")]).where("false")).count() == 0
    got = sorted(tuple(r) for r in sharding.shard_table(documents([(1, "a"), (2, None)])).collect())
    assert got == plain([(1, "a"), (2, None)], 16)


def test_one_key_on_a_third_of_the_rows_is_dealt_over_ranges(spark, documents):
    rows = [(7, "same text")] * 1000 + [(i, f"t{i}") for i in range(1000, 3000)]
    cut, n = sharding.numbered(sharding.sized(documents(rows)), ["doc_id", "digest"])
    assert n == 3000 and sorted(r["row"] for r in cut.select("row").collect()) == list(range(3000))


def test_written_shards_hold_every_row(spark, documents, tmp_path):
    rows = edge_rows() + [(i, f"text {i}") for i in range(100, 150)]
    path = str(tmp_path / "shards")
    docs = documents(rows).selectExpr("*", "'x' as row", "1 as place", "2 as at", "3 as c0")
    n = sharding.write_shards(docs, path, shards=5, file_rows=4)
    assert n == len(rows)
    want = {(s, k): (i, z) for i, z, _, _, s, k, _, _ in plain(rows, 5)}
    for s in range(5):
        read = sharding.read_shard(spark, path, s).collect()
        assert [r["slot"] for r in read] == list(range(len(read)))
        assert [(r["doc_id"], len((r["text"] or "").encode()) + 1) for r in read] == [want[s, r["slot"]] for r in read]
    one = sharding.read_shard(spark, path, 3, 6, file_rows=4)
    assert [(r["doc_id"], len((r["text"] or "").encode()) + 1) for r in one.collect()] == [want[3, 6]]
    assert docs.columns == [c for c in one.columns if c not in ("slot", "shard", "part")]
    with pytest.raises(ValueError):
        sharding.write_shards(docs.selectExpr("*", "1 as slot"), path + "2")
