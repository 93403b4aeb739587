"""Readers, writers, resuming runs and incremental validation."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from casetally.operators import prepare, runs, validate
from casetally.plans.catalog import stub_factory
from casetally.schema import FEATURE_NAMES, RESPONSE_LOG, TARGET, TableMetadata
from casetally.sources import runlog, tables
from casetally.streaming.validate import validate_stream, write_batch


def test_csv(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    (tmp_path / "raw.csv").write_text(",".join([*FEATURE_NAMES, TARGET]) + "\n" + ",".join(["1"] * 22 + ["", "Bad"]) + "\n")
    row = tables.read_csv(spark, path).first()
    assert row.ExternalRiskEstimate == 1.0 and row.PercentTradesWBalance is None and row[TARGET] == "Bad"
    tables.write_csv(tables.read_csv(spark, path), str(tmp_path / "copy"))
    assert tables.read_csv(spark, str(tmp_path / "copy")).first() == row
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"))


def test_splits_and_metadata(spark, tmp_path):
    df = spark.range(30).select("id", F.element_at(F.array(*map(F.lit, ["train", "val", "test"])), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    metadata = TableMetadata(TARGET, "Bad", ["a"], ["a_missing_condition_not_met"], split_sizes={"train": 10})
    tables.write_splits(df, str(tmp_path / "t"))
    tables.write_metadata(spark, metadata, str(tmp_path / "m"))
    splits, read = tables.load_processed(spark, str(tmp_path / "t"), str(tmp_path / "m"))
    assert read == metadata and {n: s.count() for n, s in splits.items()} == {"train": 10, "val": 10, "test": 10}
    plan = splits["val"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_nested_top_features(spark, tmp_path):
    path = tmp_path / "tops.json"
    path.write_text(json.dumps({"shap_top": {"m": {"c1": ["a", "b"], "c2": ["a"]}}, "lime_top": {"m": {"c1": ["b"]}}, "overlap": {"m": 0.5}}, indent=1))
    got = {(r.method, r.model, r.case_id): r.top_features for r in tables.read_top_features(spark, str(path)).collect()}
    assert got == {("shap", "m", "c1"): ["a", "b"], ("shap", "m", "c2"): ["a"], ("lime", "m", "c1"): ["b"]}


def test_results_document(spark, tmp_path):
    tables.write_results(spark.createDataFrame([("a", 1.5)], "system string, value double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"system": "a", "value": 1.5}


def test_json_log_with_a_cut_line(spark, tmp_path):
    good = {"case_id": "c1", "pipeline": "stock", "seed": 0, "true_label": 1, "raw_response": "x", "parse_success": True, "key_factors": ["a"]}
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps(good) + "\n" + json.dumps(good)[:40])
    log = runlog.read_json_log(spark, str(path))
    assert runlog.corrupt_count(log) == 1
    kept = runlog.sound(log.cache()).collect()
    assert len(kept) == 1 and kept[0].key_factors == ["a"] and set(RESPONSE_LOG.fieldNames()) == set(kept[0].asDict())


def people(spark, n=6):
    row = [f"cast(id + {i} AS double) AS {f}" for i, f in enumerate(FEATURE_NAMES)]
    return spark.range(n).selectExpr("concat('case_', id) AS case_id", *row, f"cast(id % 2 AS int) AS {TARGET}")


def test_run_and_resume(spark, tmp_path):
    path, metadata = str(tmp_path / "log"), TableMetadata(TARGET, "Bad", FEATURE_NAMES, [])
    cases = people(spark)
    assert runs.run_pipeline(cases.limit(2), metadata, "structured", stub_factory, path, batch=0, n_repeats=3, parts=2, tasks=2) == 6
    assert runs.run_pipeline(cases, metadata, "structured", stub_factory, path, batch=1, n_repeats=3, parts=2) == 12
    assert runs.run_pipeline(cases, metadata, "structured", stub_factory, path, batch=2, n_repeats=3, parts=1) == 0
    assert runs.run_pipeline(cases, metadata, "stock", stub_factory, path, batch=3, n_repeats=1, parts=1, profile="reworded") == 6
    log = runlog.read_log(spark, path)
    assert log.count() == 24 and runlog.completed(log).count() == 24
    assert log.where("pipeline = 'structured'").where("parse_success").count() == 18
    assert log.where("pipeline = 'stock'").where("parse_success").count() == 0
    doubled = log.unionByName(log.withColumn("batch", F.lit(9)).withColumn("label", F.lit("late")))
    kept = runlog.first_records(doubled)
    assert kept.count() == 24 and kept.where("label = 'late'").count() == 0


def test_a_failure_keeps_the_parts_before_it(spark, tmp_path):
    path, metadata = str(tmp_path / "log"), TableMetadata(TARGET, "Bad", FEATURE_NAMES, [])
    broken = tmp_path / "broken"

    def breaks_later():
        call, flag = stub_factory(), str(broken)

        def answer(user_prompt, seed, system_prompt, max_new_tokens):
            import os

            if seed == 7 and not os.path.exists(flag):
                raise RuntimeError("the generator died")
            return call(user_prompt, seed, system_prompt, max_new_tokens)

        return answer

    options = {"n_repeats": 8, "parts": 4}
    with pytest.raises(Exception, match="the generator died"):
        runs.run_pipeline(people(spark), metadata, "structured", breaks_later, path, batch=0, **options)
    log = runlog.read_log(spark, path)
    kept = 0 if log is None else log.count()
    broken.touch()
    assert runs.run_pipeline(people(spark), metadata, "structured", breaks_later, path, batch=1, **options) == 48 - kept
    assert runlog.completed(runlog.read_log(spark, path)).count() == 48


def test_revalidated_copy(spark, tmp_path):
    text = json.dumps({"label": "Good", "confidence": 80, "key_factors": [], "explanation": "It is 5."})
    log = spark.createDataFrame([("a", "structured", 0, text, False), ("z", "structured", 0, text, True)],
                                "case_id string, pipeline string, seed int, raw_response string, parse_success boolean")
    cases = spark.createDataFrame([("a", 5.0)], "case_id string, v double")
    again = validate.revalidate(log, cases, ["v"])
    assert validate.verdict_changes(again).first().asDict() == {
        "n_records": 1, "n_old_pass": 0, "n_new_pass": 1, "newly_passing": 1, "newly_failing": 0,
    }
    assert [r.case_id for r in validate.missing_cases(log, cases).collect()] == ["z"]
    runlog.write_log_copy(again, str(tmp_path / "copy"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runlog.write_log_copy(again, str(tmp_path / "copy"))


def test_stream_validation_appends_each_key_once(spark, tmp_path):
    text = json.dumps({"label": "Bad", "confidence": 80, "explanation": "It is 5."})
    rows = [(f"c{i % 4}", "structured", i % 2, text, 5.0) for i in range(8)]
    schema = "case_id string, pipeline string, seed int, raw_response string, v double"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for turn in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        query = validate_stream(stream, "structured", log, str(tmp_path / "state"), ["v"])
        query.awaitTermination(60)
        query.stop()
        got = spark.read.parquet(log)
        assert got.count() == 4 and got.where("parse_success").count() == 4


def test_stream_with_event_time_remembers_keys_and_not_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runlog, "read_log", lambda *args: pytest.fail("the log is not read"))
    text = json.dumps({"label": "Bad", "confidence": 80, "explanation": "It is 5."})
    schema = "case_id string, pipeline string, seed int, raw_response string, v double, at timestamp"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for turn in range(3):
        rows = [(f"c{i % 4 + 2 * turn}", "structured", i % 2, text, 5.0, datetime.datetime(2026, 1, 1, 0, turn)) for i in range(8)]
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        query = validate_stream(stream, "structured", log, str(tmp_path / "state"), ["v"], event_time="at")
        query.awaitTermination(60)
        query.stop()
    got = spark.read.parquet(log)
    keys = [(r.case_id, r.seed) for r in got.select("case_id", "seed").collect()]
    assert len(keys) == len(set(keys)) == 8 and got.where("parse_success").count() == 8
    # A batch that runs again replaces its own folder.
    first = got.where("batch = 0")
    before = first.count()
    write_batch(log)(spark.createDataFrame(first.drop("batch").collect(), first.drop("batch").schema), 0)
    assert spark.read.parquet(log).count() == 8 and spark.read.parquet(log).where("batch = 0").count() == before


def test_broken_lines_keep_what_could_be_read(spark):
    lines = spark.createDataFrame([(1, "5,x,1.5"), (2, "6,y,none"), (3, "7"), (4, None), (5, '8,"a,b",2')], "k int, line string")
    got = {r.k: r for r in tables.parse_lines(lines, "line", "a long, b string, c double").collect()}
    assert [(got[k].a, got[k].b, got[k].c) for k in (1, 2, 3, 5)] == [(5, "x", 1.5), (6, "y", None), (7, None, None), (8, "a,b", 2.0)]
    assert [got[k]._corrupt_record for k in (1, 2, 3, 5)] == [None, "6,y,none", "7", None] and got[4].a is None
    bad = tables.parse_lines(spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b',)], "line string"), "line", "a long", "json").collect()
    assert [(r.a, r._corrupt_record is None) for r in bad] == [(1, True), (None, False)]


def test_top_features_by_the_line(spark):
    lines = spark.createDataFrame([('{"case_id": "c1", "top": {"shap": {"m": ["a", "b"], "n": []}, "lime": {"m": ["b"]}}}',), ("{",), (None,)], "value string")
    got = {(r.method, r.model, r.case_id): r.top_features for r in tables.explode_top_features(lines).collect()}
    assert got == {("shap", "m", "c1"): ["a", "b"], ("shap", "n", "c1"): [], ("lime", "m", "c1"): ["b"]}


def test_metadata_is_counted_in_what_was_written(spark, tmp_path):
    rows = [(i, ["train", "train", "val"][i % 3], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, f"case_id long, split string, {TARGET} int")
    made = tables.write_prepared(df, str(tmp_path / "t"), str(tmp_path / "m"), ["a"], [])
    splits, read = tables.load_processed(spark, str(tmp_path / "t"), str(tmp_path / "m"))
    assert read == made == prepare.build_metadata(df, ["a"], [])
    assert made.split_sizes == {"train": 8, "val": 4} and made.class_balance == {"train": {"0": 0.5, "1": 0.5}, "val": {"0": 0.5, "1": 0.5}}
    assert splits["val"].count() == 4
