"""Operator 11 against brute force, and how much of the corpus it leaves unscored."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_corpus import edge_rows

from casetally.llm import rmqsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scored = []
        for i, c, size in counted:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(q * weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("text", ["Ab-cD_9 É é", "", " .\x00\x7f", "日本x😀Y", "ÀÉAİ b c", "a" * 10 + "\n" + "B"])
def test_terms(text):
    assert [w.decode() for w in rmqsearch.terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("shard_bytes,block", [(16_000_000, 100_000), (20_000, 40)])
def test_ranked_equals_plain(spark, documents, shard_bytes, block):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["the", "É", "日本"]
    docs = edge_rows() + [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(20, 400)]
    docs += [(i, "hot text The w1 w2 É") for i in range(1000, 1300)] + [(1000, "hot text The w1 w2 É")]  # ties, a third of the rows
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    items += [(50, "hot TEXT"), (50, "hot TEXT"), (50, "w1"), (None, "É the w3"), (51, None), (52, ""), (53, "nowhere"), (54, docs[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as query", "1 as score", "2 as terms")
    made = rmqsearch.ranked(documents(docs, extra=True).repartition(3), table, shard_bytes=shard_bytes, block_terms=block)
    assert dict(made.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in made.collect()), key=repr) == plain(docs, items)


def test_no_documents_and_no_items(spark, documents):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = documents([(1, "a"), (2, "b")])
    assert rmqsearch.ranked(docs.where("false"), items).count() == 0
    assert rmqsearch.ranked(docs, items.where("false")).count() == 0
    assert rmqsearch.ranked(documents([(1, None), (2, " . ")]), items).count() == 0


def lists_of(rng, n, shares, most=1_000_000):
    docs = [np.sort(rng.choice(n, max(1, int(n * s)), replace=False)) for s in shares]
    return rmqsearch.Postings(docs, [rng.integers(1, most, len(d)) for d in docs], n)


def test_sparse_tables_equal_maxima():
    rng = np.random.default_rng(1)
    p = lists_of(rng, 300, [1.0, 0.3, 0.05, 0.003], most=6)  # many equals: the first counts
    a = rng.integers(0, len(p.docs), 500)
    b = np.minimum(a + rng.integers(0, 80, 500), len(p.docs))
    at, some = p.largest(a, b)
    assert (some == (b > a)).all()
    for x, y, z in zip(a, b, at, strict=True):
        assert x == y or z == x + p.impact[x:y].argmax()


@pytest.mark.parametrize("leaf,at_once", [(1, 1), (4, 64), (1000, 8)])
def test_search_is_exact_and_leaves_most_documents_unscored(leaf, at_once):
    rng = np.random.default_rng(2)
    n = 4000
    p = lists_of(rng, n, rng.random(30) ** 3 * 0.2)
    for _ in range(5):
        terms = np.sort(rng.choice(30, 12, replace=False))
        gain = rng.integers(1, 9000, 12)
        scores = np.zeros(n, np.int64)
        for t, g in zip(terms, gain, strict=True):
            own = slice(p.start[t], p.start[t + 1])
            np.add.at(scores, p.docs[own], p.impact[own] * g)
        want = [(int(d), int(scores[d])) for d in np.lexsort((np.arange(n), -scores))[:10] if scores[d] > 0]
        found, scored = rmqsearch.search(p, terms, gain, leaf=leaf, at_once=at_once)
        assert found == want
        assert leaf == 1000 or scored < 0.5 * n


def test_index_is_narrow_and_read_shard_by_shard(spark, documents):
    rng = random.Random(5)
    docs = documents([(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200))) for i in range(600)]).coalesce(1)
    shards = rmqsearch.written(rmqsearch.index(docs, shard_bytes=200_000), "index", **rmqsearch.ONE_BY_ONE)
    rows = shards.collect()
    assert len(rows) > 3
    for r in rows:
        n = sum(r["dfs"])
        assert len(r["docs"]) == len(r["tfs"]) == n  # a byte each, where four were written
        assert rmqsearch._numbers(bytes(r["tfs"]), n).sum() == r["n_terms"]
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    assert [m.num_row_groups for m in groups] == [m.num_rows for m in groups]


@pytest.mark.parametrize("most,width", [(0, 1), (255, 1), (256, 2), (65_536, 4)])
def test_numbers_take_as_many_bytes_as_the_largest(most, width):
    data = rmqsearch._narrow(np.array([most, 0, most // 2]))
    assert len(data) == 3 * width
    assert rmqsearch._numbers(data, 3).tolist() == [most, 0, most // 2]
    assert rmqsearch._numbers(b"", 0).tolist() == []
