"""Parsing and validation rules on hand-made responses."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casetally.functions.numbers import extract_numbers, one_decimal_sql, plain_number_sql, round_tenth
from casetally.functions.responses import contradicts, strip_fences
from casetally.operators import validate
from casetally.schema import vocabulary_numbers


def parse(spark, *texts, value=5.0, **options):
    rows = spark.createDataFrame([(i, t, value) for i, t in enumerate(texts)], "i int, raw string, v double")
    found = validate.parse_structured(rows, "raw", ["v"], **options).orderBy("i").collect()
    return found if len(texts) > 1 else found[0]


def answer(**changes):
    base = {"label": "Good", "confidence": 85, "key_factors": ["value is 5"], "explanation": "It is 5.", "uncertainty_reason": "none"}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "DROP"})


def test_clean_answer_passes(spark):
    row = parse(spark, answer())
    assert row.parse_success and row.label == "Good" and row.confidence == 85.0 and row.key_factors == ["value is 5"]


@pytest.mark.parametrize("text", ["```json\n{}\n```", "```\n{}```", "  ```json{}```  ", "{}", " {} ", "\x1f{}\n"])
def test_fences_and_white_space(spark, text):
    body = answer()
    row = parse(spark, text.replace("{}", body))
    assert row.is_valid_json and row.parse_success


@pytest.mark.parametrize(
    "text",
    ["", "no json", "[1]", '"text"', "12", "null", '{"label": "Good"', '{"a": 1} and more', '{"a": 1}, {"b": 2}', '{"a": 1}] x {"b": [2}',
     '{"a": 1}] }', '{"a": 1}}', '{"a": 1,}', "{'a': 1}"],
)
def test_not_one_json_object(spark, text):
    row = parse(spark, text)
    assert not row.is_valid_json and not row.parse_success and row.explanation_grounded is None


def test_nested_lists_of_objects_are_valid(spark):
    assert parse(spark, answer(extra=[{"a": [{"b": 1}]}])).parse_success


@pytest.mark.parametrize("label,expected", [(" bad ", "Bad"), ("GOOD", "Good"), ("maybe", None), (1, None), (None, None), ("DROP", None), (["Good"], None)])
def test_label(spark, label, expected):
    row = parse(spark, answer(label=label))
    assert row.label == expected and row.label_valid == (expected is not None)
    assert row.no_contradiction is (None if expected is None else True)


@pytest.mark.parametrize(
    "value,expected",
    [(0, 0.0), (100, 100.0), (85.5, 85.5), (100.5, None), (-1, None), ("85", None), (None, None), ("DROP", None), (True, 1.0), ([85], None)],
)
def test_confidence(spark, value, expected):
    row = parse(spark, answer(confidence=value))
    assert row.confidence == expected and row.confidence_valid == (expected is not None)


@pytest.mark.parametrize(
    "explanation,loose",
    [
        ("It is 5 or 5.0.", []),
        ("Off by some: 8.", [8.0]),
        ("Over 24 months, 60+ and 90+ days, 30 days, 120.", []),
        ("Stated at 85.", []),
        ("A range 2-3.", [2.0, -3.0]),
        ("Exactly 1,200 of them.", [1.0, 200.0]),
        ("Ends with 12345.", [12345.0]),
        ("Rounded 5.04 or 4.96.", []),
        ("Too far 8.6.", [8.6]),
    ],
)
def test_grounding(spark, explanation, loose):
    row = parse(spark, answer(explanation=explanation))
    assert row.ungrounded_numbers == loose and row.explanation_grounded == (not loose) and row.parse_success == (not loose)


def test_stated_confidence_is_exempt_even_out_of_range(spark):
    row = parse(spark, answer(confidence=140, explanation="Sure at 140."))
    assert row.ungrounded_numbers == [] and not row.confidence_valid


def test_older_vocabulary_lacks_status_numbers(spark):
    text = answer(explanation="It was 30 days delinquent.")
    assert parse(spark, text).explanation_grounded
    assert not parse(spark, text, vocabulary=vocabulary_numbers(with_status_labels=False)).explanation_grounded
    assert set(vocabulary_numbers()) == {6.0, 7.0, 12.0, 24.0, 30.0, 60.0, 90.0, 120.0, 2018.0}


def test_explanation_and_factor_types(spark):
    assert parse(spark, answer(explanation="")).parse_success
    assert not parse(spark, answer(explanation="DROP")).parse_success
    assert not parse(spark, answer(explanation=None)).parse_success
    assert not parse(spark, answer(explanation=["x"])).parse_success
    assert not parse(spark, answer(key_factors=[1])).parse_success
    assert parse(spark, answer(key_factors="DROP")).parse_success
    assert parse(spark, answer(key_factors=None)).parse_success
    assert parse(spark, answer(key_factors="ab")).key_factors == ["a", "b"]


def test_contradiction_terms(spark):
    rows = spark.createDataFrame(
        [("Good", "HIGH risk"), ("Bad", "high risk"), ("Bad", "an unreliable payer"), ("Good", None), ("Bad", "excellent")], "label string, e string"
    )
    plain = [r[0] for r in rows.select(contradicts(F.col("label"), F.col("e"))).collect()]
    words = [r[0] for r in rows.select(contradicts(F.col("label"), F.col("e"), whole_words=True)).collect()]
    assert plain == [True, False, True, False, True] and words == [True, False, False, False, True]


def test_without_a_case_row_grounding_stays_open(spark):
    rows = spark.createDataFrame([(answer(explanation="It is 999."),)], "raw string")
    row = validate.parse_structured(rows, "raw").first()
    assert row.explanation_grounded is None and row.parse_success


def test_a_filter_does_not_repeat_the_parse(spark):
    rows = spark.createDataFrame([(answer(), 5.0)], "raw string, v double")
    plan = validate.parse_structured(rows, "raw", ["v"]).where("explanation_grounded AND parse_success")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat([,") == 1 and len(plan) < 100_000


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Classification: **Good**\nConfidence: 85%\nExplanation: fine", ("Good", 85.0, "fine", True)),
        ("**Classification:** bad **Confidence:** 12.5 **Explanation:** one\ntwo", ("Bad", 12.5, "one\ntwo", True)),
        ("classification BAD confidence 101 explanation x", ("Bad", None, "x", False)),
        ("Classification: unsure Classification: Good\nConfidence: 5\nExplanation: x", (None, 5.0, "x", False)),
        ("Classification: Good\nConfidence: 5\nExplanation:   ", ("Good", 5.0, None, False)),
        ("nothing", (None, None, None, False)),
    ],
)
def test_stock_answers(spark, text, expected):
    row = validate.parse_stock(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert (row.label, row.confidence, row.explanation, row.parse_success) == expected


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(3)
    values = [0.15, 0.25, 0.35, 2.5, 65.05, 12.35, -0.15, 1e20, 0.0] + [rng.randint(-(10**6), 10**6) / 100 for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_tenth("x").alias("r"), F.expr(one_decimal_sql("x")).alias("t"))
    assert [(r.x, r.r, r.t) for r in frame.collect() if r.r != round(r.x, 1) or r.t != f"{r.x:.1f}"] == []


def test_plain_numbers(spark):
    frame = spark.createDataFrame([(5.0,), (67.5,), (12345678.25,), (-3.0,)], "x double").select(F.expr(plain_number_sql("x")))
    assert [r[0] for r in frame.collect()] == ["5", "67.5", "12345678.25", "-3"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.-, ab+%", max_size=40), min_size=1, max_size=40))
def test_number_extraction_matches_a_plain_scan(spark, texts):
    import re

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract_numbers(F.col("t")).alias("n"))
    found = {r.i: r.n for r in frame.collect()}
    assert found == {i: [float(x) for x in re.findall(r"-?[0-9]+\.?[0-9]*", t)] for i, t in enumerate(texts)}


def test_strip_fences_keeps_inner_fences(spark):
    frame = spark.createDataFrame([("```json\na ``` b\n```",)], "t string").select(strip_fences(F.col("t")))
    assert frame.first()[0] == "a ``` b"


def test_stored_texts_are_read_before_they_meet_their_case(spark):
    """Of a response only what is asked for goes through the join, not its text."""
    body = '{"label": "Good", "confidence": 80, "explanation": "Value 5 and 41.5."}'
    log = spark.createDataFrame([(1, body, True), (2, body, False), (3, body, True)], "case_id long, raw_response string, parse_success boolean")
    cases = spark.createDataFrame([(1, 5.0, 41.5), (2, 5.0, None)], "case_id long, v double, w double")
    again = validate.revalidate(log, cases, ["v", "w"])
    assert [(r.case_id, r.ungrounded_numbers, r.old_parse_success, r.parse_success) for r in again.orderBy("case_id").collect()] == [(1, [], True, True), (2, [41.5], False, False)]
    plan = again.select("case_id", "parse_success")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner"):].splitlines()
    assert "raw_response" not in joined[1], joined[1]
