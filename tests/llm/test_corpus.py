"""Operators against brute-force versions, with nulls, empty, long and repeated texts, ties and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import oracle_check
import pyarrow as pa
import pytest
import xxhash

from casetally.llm import decontaminate, mixing, pii, quality, simhash, suffix, tokens, topk, toxicity
from casetally.llm.components import components
from casetally.llm.html import extract, main_text
from casetally.llm.oracle import ORACLE
from casetally.llm.queries import QUERIES

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdeé") for _ in range(RANDOM.randint(1, 6))) for _ in range(80)]


def prose(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


def edge_rows():
    """Rows that every operator on documents must stand."""
    long = prose(30_000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (6, long + " x"), (7, "one"), (7, "one"), (None, prose(50)), (None, None), (8, "ab" * 5_000), (9, "😀 é日本 . ! ?")]


def same_rows(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_counterparts(spark, small, name):
    if name in QUERIES:
        assert oracle_check.compare(QUERIES[name](spark, small), oracle_check.connect(small), ORACLE[name]) == []


# 1: top-k


def plain_top_k(rows, k):
    made = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in made.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in made.items() if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 40])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows[30:90] = [(i, rows[30][1]) for i in range(30, 90)]  # ties
    rows += [(1000, None), (1020, [None] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, [1.0, 2.0]), (1081, [1.0, -2.0]), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as shard", "3 as dim")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    same_rows(topk.top_k(df, k=5, shard_rows=shard_rows), plain_top_k(rows, 5))
    same_rows(topk.top_k(df.where("false")), [])


def test_products_beyond_double_precision():
    v = np.array([[1 << 30, 1], [1 << 30, 2], [-(1 << 30), 5]], np.int64)
    score, place = topk.search(v, np.arange(3), v, np.arange(3), np.full(3, np.iinfo(np.int64).min + 1), 2)
    assert score.tolist() == [[(1 << 60) + 2, 5 - (1 << 60)], [(1 << 60) + 2, 10 - (1 << 60)], [10 - (1 << 60), 5 - (1 << 60)]]
    assert place.tolist() == [[1, 2], [0, 2], [1, 0]]


# 2: quality


def test_em_finds_the_good_labellers():
    rng = random.Random(1)
    counts, truth = {}, {}
    for _ in range(5_000):
        y = rng.random() < 0.7
        p = "".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < a) != y] for a in (0.95, 0.9, 0.85, 0.6))
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + y
    posterior, table = quality.em(counts)
    assert sum(abs(posterior[p] - truth[p] / n) * n for p, n in counts.items()) / 5_000 < 0.05
    assert table[0, 1, 1] > table[3, 1, 1]
    assert quality.em({})[0] == {}


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    made = QUERIES["op2_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = made.selectExpr("avg(if(keep = (quality = 1), 1, 0))").first()[0]
    assert right > 0.9


def test_diversity_votes_do_not_hang_on_length(spark):
    line, long = [f"w{i}" for i in range(12)], [f"w{i}" for i in range(101)]
    texts = {(name, n): " ".join((words * n)[:n]) for name, words in (("line", line), ("long", long)) for n in (1_999, 2_001, 20_000)}
    texts |= {("prose", n): " ".join(f"w{RANDOM.randint(0, 900)}" for _ in range(n)) for n in (60, 1_999, 2_001, 20_000)}
    texts |= {("few", n): " ".join(RANDOM.choice(line) for _ in range(n)) for n in (200, 1_999, 2_001, 20_000)}
    rows = spark.createDataFrame([(*k, t) for k, t in texts.items()], "name string, n int, text string")
    for r in quality.with_votes(rows).collect():
        assert r["votes"][3] == ("g" if r["name"] == "prose" else "b"), (r["name"], r["n"])


def test_quality_edge_rows(spark, documents):
    made = quality.quality(documents(edge_rows(), extra=True)).collect()
    assert len(made) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in made)
    assert quality.quality(documents([(1, "a")]).where("false")).count() == 0


# 3: toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    made = QUERIES["op3_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    # 3,000 labels; with the 16,000 that the learner takes at most, 0.99 of the toxic rows are found.
    assert (made.predicted[made.toxic == 1]).mean() > 0.8 and (made.predicted[made.toxic == 0]).mean() < 0.02
    toxic, clean = made.score[made.toxic == 1].to_numpy(), np.sort(made.score[made.toxic == 0].to_numpy())
    assert np.searchsorted(clean, toxic).mean() / len(clean) > 0.97


def test_toxicity_edge_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = edge_rows() + [(i, "vile foulword here" if i % 2 else "mild word here") for i in range(10, 400)]
    made = toxicity.toxicity(documents(rows, extra=True), labels).collect()
    assert len(made) == len(rows)
    for r in made:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if (r["doc_id"] or 0) >= 10:
            assert r["predicted"] == r["doc_id"] % 2
    kept = toxicity.without_toxic(documents(rows, extra=True), labels)
    assert kept.count() < len(rows) and "score" in kept.columns
    assert toxicity.toxicity(documents([(1, "a")]).where("false"), labels).count() == 0
    assert toxicity.toxicity(documents([(1, "a")]), labels.where("false")).count() == 1


def test_toxicity_learns_from_16_000_rows(spark):
    numbers = [i for i in range(22_000) if zlib.crc32(str(i).encode()) % 4 != 2][:16_000]
    keys = spark.createDataFrame([(i,) for i in numbers], "doc_id long").selectExpr("doc_id", "row_number() OVER (ORDER BY xxhash64(doc_id), doc_id) AS at")
    # Only rows beyond the 8,000 of least hash tell what the word means.
    rows = keys.selectExpr("doc_id", "IF(at > 8000 AND at % 2 = 0, 'plain foulword', 'plain mildword') AS text", "int(at > 8000 AND at % 2 = 0) AS toxic").localCheckpoint()
    weights = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    scored = toxicity.with_score(spark.createDataFrame([("plain foulword",), ("plain mildword",)], "text string"), weights)
    scores = {r["text"]: r["score"] for r in scored.collect()}
    assert scores["plain foulword"] > 0.9 and scores["plain mildword"] < 0.1


def test_flat_rows_equal_a_list():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, toxicity.DIMS, 40)).astype(np.int32), int(rng.integers(0, 2))) for _ in range(60)] + [(np.zeros(0, np.int32), 1)]
    flat = toxicity._Rows()
    for some in (rows[:25], rows[25:25], rows[25:]):
        flat.add(pa.record_batch([pa.array(range(len(some)), pa.int64()), pa.array([y for _, y in some], pa.int32()), pa.array([x for x, _ in some], pa.list_(pa.int32()))], names=["order", "toxic", "x"]))
    assert all(np.array_equal(a, b) and y == v for (a, y), (b, v) in zip(flat, rows, strict=True))
    (w, b), (v, c) = toxicity.ftrl(flat), toxicity.ftrl(rows)
    assert np.array_equal(w, v) and b == c


# 4: decontamination


def bm25(items):
    texts = {i: decontaminate.words_of(t) for i, t in items}
    texts = {i: w for i, w in texts.items() if w}
    df = {}
    for w in texts.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    return texts, df, sum(map(len, texts.values())) / len(texts)


def test_retrieval_finds_all_above_the_threshold():
    items = [(i, prose(RANDOM.randint(3, 30)) + ". " + prose(4)) for i in range(70)] + [(900, ""), (901, None), (902, "..")]
    texts, df, mean = bm25(items)
    index = decontaminate.Index([i for i in items if i[1]], df, len(texts), mean)
    docs = [prose(60) + " " + RANDOM.choice(items)[1][:90] if i % 2 and items[i][1] else prose(90) for i in range(60)]
    for text in [*docs, "", None, "x"]:
        words = decontaminate.words_of(text)
        want = {}
        for b in range(index.blocks):
            long = int(index.longest[b])
            for at in range(b * 16, min(len(index.ids), b * 16 + 16)):
                item = texts[index.ids[at]]
                counts = {w: item.count(w) for w in item}
                norm = 1.2 * (0.25 + 0.75 * len(item) / mean)
                impact = {w: np.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in counts.items()}
                for start in range(0, len(words), long):
                    have = set(words[start : start + 2 * long])
                    score = sum(v for w, v in impact.items() if w in have) / sum(impact.values())
                    if score >= 0.5:
                        want[index.ids[at]] = True
        assert {index.ids[at] for at in index.search(text)} == set(want)


@pytest.mark.parametrize("chars", [10**9, 300])
def test_contamination(spark, documents, chars, monkeypatch):
    items = [(i, f"{prose(12)}. {prose(8)}.") for i in range(20)] + [(50, None), (51, "")]
    rows = edge_rows() + [(100 + i, f"{prose(40)} {items[i][1].upper()} {prose(40)}") for i in range(20)] + [(200 + i, prose(100)) for i in range(20)]
    rows += [(300, items[3][1] + " " + items[4][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", ("item_id", "text", chars))
    made = {r["doc_id"]: r for r in decontaminate.contamination(documents(rows, extra=True), table).collect()}
    assert all(made[100 + i]["item_ids"] == [i] for i in range(20)) and made[300]["item_ids"] == [3, 4]
    assert not any(made[200 + i]["contaminated"] for i in range(20))
    clean = decontaminate.without_leaks(documents(rows, extra=True), table)
    assert clean.where("doc_id >= 100 and doc_id < 200 or doc_id = 300").count() == 0
    assert clean.count() == len(rows) - 21
    assert decontaminate.contamination(documents(rows), table.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(documents(rows).where("false"), table).count() == 0


def test_items_that_share_an_id_and_passages_with_other_answers(spark, documents):
    question, answer = " ".join(f"q{i}" for i in range(24)), " ".join(f"a{i}" for i in range(8))
    whole = f"{question}. {answer}."
    # More of the question with another answer, then less of it with the answer whole.
    altered = f"{question}. " + " ".join(f"z{i}" for i in range(3)) + " a3 a4 a5 a6 a7"
    leak = " ".join(question.split()[2:]) + f". {answer}."
    other = f"{prose(20)}. {prose(9)}."
    items = spark.createDataFrame([(1, whole), (1, other), (None, other), (2, whole)], "item_id long, text string")
    far = " ".join(f"f{i}" for i in range(150))
    made = {r["doc_id"]: r for r in decontaminate.contamination(documents([(1, f"{altered} {far} {leak}"), (2, other), (3, far)]), items).collect()}
    assert made[1]["contaminated"] and made[1]["n_items"] == 2 and made[1]["item_ids"] == [1, 2]
    assert made[2]["n_items"] == 2 and made[2]["item_ids"] == [1, None] and not made[3]["contaminated"]


def test_stages_stand_any_column_names(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = documents([(i, "vile foulword here" if i % 2 else "mild word here") for i in range(60)]).selectExpr(
        "*", "1 as score", "2 as _score", "3 as score_", "4 as hits", "5 as _hits", "6 as t", "7 as c0"
    )
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 0").count() == 30
    items = spark.createDataFrame([(1, "nothing of this. is there.")], "item_id long, text string")
    assert decontaminate.without_leaks(docs, items).exceptAll(docs).count() == 0


def test_a_key_on_a_third_of_the_rows_does_not_fill_the_learner(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, f"vile foulword {i}" if i % 2 else f"mild word {i}") for i in range(200)] + [(1, f"vile foulword {i}") for i in range(300)]
    made = toxicity.with_score(documents(rows), toxicity.train(documents(rows), labels, rows=150))
    assert made.where("doc_id % 2 = 1").agg({"score": "min"}).first()[0] > made.where("doc_id % 2 = 0").agg({"score": "max"}).first()[0]


def test_the_mix_takes_the_same_rows_of_a_key(documents):
    rows = [(1, f"text {i} " + "w " * i, "a") for i in range(9)] + [(2, "x " * 400, "b")]
    first, second = (sorted(tuple(r) for r in mixing.mixed(documents(rows).repartition(n)).collect()) for n in (1, 5))
    assert first == second


# 5: main text of pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div id="sidebar"><p>Beside, with commas, and words, which are many, and more of them.</p></div>
<div class="cookie-notice"><p>We use cookies, as you know, please accept them, dear reader.</p></div>
<div class="page-content"><h2>Head</h2><p>First  part, with
commas, and a <a href=x>link</a> to follow along.</p><div class="ad"><p>Buy this, now, at once, for less.</p></div>
<ul><li>item one<li>item &lt;two&gt;</ul><p>Second &amp; more&nbsp;text, of decent length&#33;
<form><p>Subscribe now, to get news, every day.</p></form>
<section class="comments"><p>Nice post, I like it, really a lot.</p></section></div><footer><p>&copy; us, all rights, reserved.</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head\n\nFirst part, with commas, and a link to follow along.\n\nitem one\n\nitem <two>\n\nSecond & more text, of decent length!"
    assert [main_text(x) for x in (None, "", "<", "<b", "plain &am", "<p>hi", "<script>x", "<!-- x")] == ["", "", "<", "", "plain &am", "hi", "", ""]
    deep = "<div>" * 5_000 + "<p>deep down, in here</p>"
    assert main_text(deep) == "deep down, in here"


def test_uneven_articles_are_kept_whole():
    def sections(*sizes):
        return "".join("<section>" + "".join(f"<p>Part {i} {j} {'word ' * 78}ends.</p>" for j in range(n)) + "</section>" for i, n in enumerate(sizes))

    links = "<ul>" + "".join(f"<li><a href='/{i}'>more news {i}</a></li>" for i in range(9)) + "</ul>"
    for sizes in ((10, 3), (30, 3), (3, 60, 1)):
        for tag in ("article", "main", "div"):
            made = main_text(f"<body><{tag}><h1>The headline</h1>{sections(*sizes)}</{tag}><nav>menu</nav></body>").split("\n\n")
            assert made[0] == "The headline" and len(made) == 1 + sum(sizes), (sizes, tag)
    made = main_text(f"<body><article><h1><a href='/a'>A headline</a></h1>{sections(30, 3)}{links}</article></body>")
    assert made.startswith("A headline") and made.count("Part") == 33 and "more news" not in made
    for name in ("has-sidebar", "content no-header", "page widget"):
        assert "Part 0 9" in main_text(f"<body><div class='{name}'>{sections(10)}</div></body>")
    assert main_text(f"<body><article>{sections(2)}</article><div class='comments'>{sections(10)}</div></body>").count("Part") == 2


def test_articles_of_the_given_pages(spark, small):
    from html import unescape

    for r in extract(spark.read.parquet(f"{small}/pages.parquet")).join(spark.read.parquet(f"{small}/pages.parquet"), "page_id").collect():
        inside = re.sub(r"<[^<>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.S)[1])
        blocks = [" ".join(unescape(re.sub("<br>|</?b>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


TEXT = "".join(f"<p>Part {i} of the article, with commas, and so on, to its end.</p>" for i in range(3))
TALK = "".join(f"<div class='item'><p>Remark {i}, which goes on, and on, for much longer than what it is about, as remarks do, again and again.</p></div>" for i in range(12))
SIGNED = TALK.replace("<p>", "<span class='author'>A. Reader</span> <time>today</time><p>")


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='post'>{TEXT}</div><div class='comments'>{TALK}</div>",
        f"<article>{TEXT}<section>{TALK.replace('div', 'article')}</section></article>",
        f"<article>{TEXT}</article><article class='comment'>{TALK}</article>",
        f"<article>{TEXT}<article class='comment'>{TALK}</article></article>",
        f"<main><h1>Title</h1>{TEXT}<div class='discussion'>{TALK}</div></main>",
        f"<main>{TEXT}<section><h2>12 Comments</h2>{TALK}</section></main>",
        f"<div id='story'>{TEXT}<h3>Leave a reply</h3>{TALK}</div>",
        f"<div class='entry'>{TEXT}</div><div class='below'>{SIGNED}</div>",
        f"<div class='page-content'>{TEXT}</div><ol class='commentlist'>{TALK.replace('div', 'li')}</ol>",
        f"<article>{TEXT}</article><div class='sidebar'>{TALK}</div>",
        f"<div class='post'><h1>Title</h1>{TEXT}</div><div class='sidebar'>{TALK}</div>",
    ],
)
def test_comments_go_however_long(page):
    made = main_text(f"<html><body><nav><a href='/'>Home</a></nav>{page}<footer>&copy;</footer></body></html>")
    assert "Remark" not in made and made.count("Part") == 3


def test_what_only_looks_like_comments_stays():
    code = "<pre><code><span class='comment'># a note</span> x = 1</code></pre>"
    assert "# a note" in main_text(f"<article>{TEXT}{code}</article>")
    assert main_text(f"<div class='comments-open'><article>{TEXT}</article></div>").count("Part") == 3
    news = "".join(f"<section><h2>News {i}</h2><span class='author'>N. N.</span> <time>today</time>{TEXT}</section>" for i in range(3))
    assert main_text(f"<main>{news}</main>").count("Part") == 9
    assert main_text(f"<main><section><h2>Comments on a text by Homer</h2>{TEXT}</section></main>").count("Part") == 3


def test_extract_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>a"), (2, "u", "")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    same_rows(extract(df), [(1, None, "", 0), (1, None, "", 0), (None, "u", "a", 1), (2, "u", "", 0)])
    assert extract(df.where("false")).count() == 0


# 6: token files


def test_encoder_equals_the_tokenizer():
    make = tokens.encoder(tokens.TOKENIZER)
    parts = ["a", "the", "é", " ", "  ", "\n", "\t", "'s", "1", "...", "<|endoftext|>", " ", "　", "日本", "\x1c", "\x85", "A", "ñ", ".", "%%%", "ç.", "🙂", " x", "Ġ", " Ġ"]
    texts = ["".join(RANDOM.choice(parts) for _ in range(RANDOM.randint(0, 30))) for _ in range(3_000)]
    assert make(texts) == make.plain(texts)


def test_encoder_takes_a_column_in_chunks():
    make = tokens.Encoder(tokens.TOKENIZER)
    words = ["".join(RANDOM.choices("abcdeé", k=RANDOM.randint(1, 6))) + RANDOM.choice(["", ".", ",$", ".\nA", "\n\nbe", "\n"]) for _ in range(3_000)]
    texts = [" ".join(RANDOM.choices(words, k=RANDOM.randint(0, 40))) for _ in range(400)] + ["", "a", "a b" * 50]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"]).slice(3)
    seen = []
    plain, make.plain = make.plain, lambda part: seen.extend(part) or plain(part)
    assert make(batch.column(1)) == plain(texts[3:])
    # A word that every text holds is encoded with a space before it once, not once a text.
    assert make(pa.array(["a bécade"] * 1_000)) == plain(["a bécade"] * 1_000)
    assert sum(" bécade" in x for x in seen) == 1
    old, tokens.CHUNK_BYTES = tokens.CHUNK_BYTES, 1_000
    try:
        parts = list(tokens._chunks(batch))
    finally:
        tokens.CHUNK_BYTES = old
    assert len(parts) > 10 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(tokens._chunks(batch.slice(0, 0))) == []


def test_token_files_round_trip(spark, documents):
    rows = [*edge_rows(), *((i, prose(RANDOM.randint(0, 60))) for i in range(20, 3_000))]
    path = tokens.shared_path(spark, "test-tokens")
    tokens.write_tokens(documents(rows, extra=True), path)
    plain = tokens.encoder(tokens.TOKENIZER).plain
    want = {}
    for k, t in rows:
        ids = plain([t or ""])[0] + bytes(4)
        want.setdefault(k, []).append((len(ids) // 4, zlib.crc32(ids)))
    made = sorted(tokens.digest(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in made] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in made:
        assert r["start"] == start
        start += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    one = tokens.read_ids(spark, path, 100).collect()
    text = dict(rows)[100]
    assert [r["ids"] for r in one] == [[*np.frombuffer(plain([text])[0], "<u4").tolist(), 0]]
    name, data = spark.read.parquet(f"{path}/dictionary").first()
    assert hashlib.sha256(bytes(data)).hexdigest() == name and len(data) > 0


def test_token_files_without_rows(spark, documents):
    assert tokens.encode_corpus(documents([(1, "a")]).where("false")).count() == 0
    same_rows(tokens.encode_corpus(documents([(1, None)])), [(1, 0, 1, zlib.crc32(bytes(4)))])


# 7: mixing


def test_mix_keeps_its_promises(spark, documents):
    rows = [(i, prose(RANDOM.randint(0, 80)), ["a", "b", "c", None, "é"][min(4, i % 9)]) for i in range(3_000)]
    made = mixing.mix(documents(rows, extra=True)).toPandas()
    assert len(made) == 3_000 and (made.taken <= 3 * made["size"]).all()
    assert abs(made.groupby("source", dropna=False).target.first().sum() - made["size"].sum()) < 1e-3
    sums = made.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((sums.taken - sums.target).abs() < 0.02 * sums.target + 10).all() and (sums.target <= 3 * sums["size"] + 1e-6).all()
    again = mixing.mix(documents(rows)).toPandas().set_index("doc_id").taken
    assert (again.loc[made.doc_id].values == made.taken.values).all()
    mix = mixing.mixed(documents(rows, extra=True)).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    copies = made.set_index("doc_id").copies
    assert (mix == copies[copies > 0].loc[mix.index]).all() and len(mix) == (copies > 0).sum()


def test_mix_edge_rows(spark, documents):
    rows = [(k, t, s) for (k, t), s in zip(edge_rows(), ["a", None, "b"] * 4, strict=True)]
    made = mixing.mix(documents(rows, extra=True)).toPandas()
    assert len(made) == len(rows) and (made.taken <= 3 * made["size"]).all()
    assert mixing.mix(documents(rows).where("false")).count() == 0
    assert mixing.mix(documents([(1, None, "a"), (2, "", "b")])).toPandas().target.tolist() == [0.0, 0.0]


# 8: SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(fps, keys):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((k for k, x in zip(keys, group, strict=True) if x == g and k is not None), default=None) for g in set(group)}
    return [least[g] for g in group]


def near_rows():
    base = prose(200).split()
    rows = edge_rows()
    for i in range(20, 120):
        words = list(base)
        for _ in range(RANDOM.randint(0, 3)):
            words[RANDOM.randrange(200)] = RANDOM.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    return rows + [(i, prose(60).upper()) for i in range(200, 300)]


@pytest.mark.parametrize("split_above", [20_000, 3])
def test_near_duplicates(spark, documents, split_above):
    rows = near_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps, [k for k, _ in rows])
    want = [(k, f"{f:016x}", g) for (k, _), f, g in zip(rows, fps, groups, strict=True)]
    same_rows(simhash.near_duplicates(documents(rows, extra=True), split_above=split_above), want)


def test_one_of_each(spark, documents):
    rows = near_rows()
    groups = plain_components([plain_fingerprint(t) for _, t in rows], [k for k, _ in rows])
    kept = simhash.one_of_each(documents(rows, extra=True))
    want = {g for g in groups if g is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(documents(rows).where("false")).count() == 0


def test_anchors_meet_all_close_pairs():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fp.copy()
    for i in range(len(near)):
        for b in rng.choice(64, 4, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    row, key, home = simhash.anchors(np.concatenate((fp, near)))
    homes = {(int(r), int(k)) for r, k in zip(row[home], key[home], strict=True)}
    every = {(int(r), int(k)) for r, k in zip(row, key, strict=True)}
    for i in range(300):
        assert any((i, k) in homes for r, k in every if r == i + 300) if i < 3 else {k for r, k in homes if r == i} & {k for r, k in every if r == i + 300}


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 300)] + [(7, 7), (None, 3)]
    made = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert made == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 300)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9: repeated passages


def plain_removal(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(d, gone[:-1], strict=True) if not g)
        out.append((k, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [2_000_000, 4_000])
def test_repeated_passages(spark, documents, shard_bytes):
    passages = [prose(150) for _ in range(3)]
    rows = [(k, t if t is None or len(t) < 30_000 else t[:12_000]) for k, t in edge_rows()]
    for i in range(20, 90):
        parts = [prose(RANDOM.randint(0, 60))]
        if i % 2:
            parts.append(RANDOM.choice(passages))
        if i % 10 == 0:
            parts += [passages[0][:450], prose(40), passages[0][:450]]
        rows.append((i, " ".join([*parts, prose(RANDOM.randint(0, 60))])))
    same_rows(suffix.remove_repeats(documents(rows, extra=True), shard_bytes=shard_bytes), plain_removal(rows, 400))


def test_no_repeats(spark, documents):
    assert suffix.remove_repeats(documents([(1, "a")]).where("false")).count() == 0
    same_rows(suffix.remove_repeats(documents([(1, None), (2, "b" * 401)])), plain_removal([(1, None), (2, "b" * 401)], 400))


def test_suffix_array_orders_by_the_bytes_that_follow():
    s = np.frombuffer(b"abracadabra" * 30 + prose(200).encode(), np.uint8)
    order, rank = suffix.suffix_array(s, 40)
    data = s.tobytes() + bytes(40)
    keys = [data[i : i + 40] for i in order.tolist()]
    assert keys == sorted(keys)
    assert all((rank[a] == rank[b]) == (x == y) for a, b, x, y in zip(order[:-1], order[1:], keys[:-1], keys[1:], strict=True) if max(a, b) < len(s) - 40)


# 10: personal data


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_base(text):
    found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PLAIN.items()}
    return [len(v) for v in found.values()], ",".join(x for v in found.values() for x in v)


def test_patterns(spark, documents):
    parts = ["a@b.c", "_", "x@", "@", "a.b", "1", "22", "255", "256", "1.2.3.4", ".", "+", "+1 (555) 123-4567", " ", "-", "é", "4111111111111111", "5500 0000 0000 0004 ", "😀", "%", "0001", "\n", "("]
    rows = edge_rows() + [(i, "".join(RANDOM.choice(parts) for _ in range(RANDOM.randint(0, 25)))) for i in range(20, 1_500)]
    rows += [(5_000, "1" * 20_000 + " " + "a.b@" + "c." * 5_000 + "d"), (5_001, "a" * 100_000 + "@")]
    made = pii.report(pii.find(documents(rows, extra=True))).collect()
    got = sorted((repr(r["doc_id"]), [r[f"n_{k}"] for k in pii.KINDS], r["base_sha256"]) for r in made)
    assert got == sorted((repr(k), plain_base(t)[0], hashlib.sha256(plain_base(t)[1].encode()).hexdigest()) for k, t in rows)
    assert pii.report(pii.find(documents(rows).where("false"))).count() == 0


def test_disclosing_terms(spark, documents):
    rows = [(i, f"{prose(10)} Ravenholm write to jo@x.org please {prose(10)}") for i in range(8)]
    rows += [(i, f"{prose(20)} please write {prose(5)}") for i in range(20, 400)] + [(500, f"call +1 555 123 4567 {prose(5)}")]
    made = {r["doc_id"]: r for r in pii.report(pii.find(documents(rows))).collect()}
    for i in range(8):
        at = rows[i][1].index("Ravenholm")
        assert f"term:{at}:{at + 9}" in made[i]["spans"] and made[i]["n_email"] == 1
        assert "write" not in [rows[i][1][int(a) : int(b)] for _, a, b in (s.split(":") for s in made[i]["spans"].split(","))]
    assert all(made[i]["spans"] == "" for i in range(20, 400)) and made[500]["n_term"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(rows)).collect()}
    assert "[TERM] write to [EMAIL] please" in clean[0] and "jo@x.org" not in clean[0] and clean[30] == rows[18][1]


def test_disclosing_terms_far_from_the_value(spark, documents):
    rows = [(i, f"Ravenholm {prose(60)} jo@x.org") for i in range(8)] + [(i, f"{prose(20)} Ravenholm {prose(5)} ravenholm") for i in (10, 11)]
    rows += [(i, prose(30)) for i in range(20, 400)] + [(500, "ravenholm@x.org"), (501, "ravenholm@x.org"), (502, "ravenholm@x.org")]
    made = {r["doc_id"]: r for r in pii.report(pii.find(documents(rows, extra=True))).collect()}
    assert all(made[i]["spans"].endswith("term:0:9") and made[i]["n_term"] == 1 for i in range(8))
    for i in (10, 11):
        at = [m.start() for m in re.finditer("(?i)ravenholm", rows[i - 2][1])]
        assert made[i]["spans"] == ",".join(f"term:{a}:{a + 9}" for a in at) and len(at) == 2
    assert all(made[i]["n_term"] == 0 for i in made if i > 11)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(rows)).collect()}
    assert not any("ravenholm" in t.lower() for t in clean.values())
