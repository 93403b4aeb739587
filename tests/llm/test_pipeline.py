"""The stages of the pipeline, one by one, against plain versions on the smallest tables."""

import zlib

import pytest
from test_corpus import plain_components, plain_fingerprint

import corpus_pipeline
from casetally.llm import decontaminate, mixing, tokens
from casetally.llm.common import table, written


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage got and gave."""
    docs, out = table(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        got, docs = docs, written(stage(spark, docs, small), "test-stage")
        out[name] = (got, docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages, spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == table(spark, small, "documents").columns


def test_toxic_documents_go(stages, spark, small):
    got, kept = (set(texts(x)) for x in stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, small, "labels").collect()}
    clean = {i for i in got if labels.get(i) == 0}
    assert kept <= got and len(clean & kept) >= 0.95 * len(clean)  # from 60 labels


def test_one_document_of_each_group(stages):
    got, kept = (texts(x) for x in stages["near_duplicates"])
    groups = plain_components([plain_fingerprint(t) for t in got.values()], list(got))
    assert set(kept) == set(groups)


def test_leaks_go(stages, spark, small):
    got, kept = (texts(x) for x in stages["decontamination"])
    items = [r["text"] for r in table(spark, small, "benchmark").collect()]
    held = {k for k, t in got.items() if any(" ".join(decontaminate.words_of(i)) in " ".join(decontaminate.words_of(t)) for i in items)}
    assert set(kept) == set(got) - held


def test_the_mix_is_taken(stages):
    got, mixed = stages["mixing"]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(got).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_token_files_hold_the_mix(stages):
    got, made = stages["token_output"]
    plain = tokens.encoder(tokens.TOKENIZER).plain
    want = []
    for r in got.select("doc_id", "text").collect():
        ids = plain([r["text"] or ""])[0] + bytes(4)
        want.append((r["doc_id"], len(ids) // 4, zlib.crc32(ids)))
    rows = sorted(made.collect(), key=lambda r: r["start"])
    assert sorted(want) == sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
