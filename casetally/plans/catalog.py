"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetally.functions.profiles import profile_text, reworded_profile_text, unmapped_status
from casetally.functions.prompts import stock_prompt, structured_prompt
from casetally.functions.responses import is_correct, label_name
from casetally.operators import (
    agreement,
    attribution,
    grounding,
    metrics,
    models,
    ordering,
    paired,
    prepare,
    robustness,
    runs,
    sampling,
    trees,
    validate,
    votes,
)
from casetally.plans import fixtures as fx
from casetally.plans import reports
from casetally.schema import FEATURE_NAMES, PERTURBATIONS, RAW_COLUMNS, STATUS_CODES, TARGET, TableMetadata, vocabulary_numbers
from casetally.session import shared_folder
from casetally.sources import runlog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CONDITIONS = [(method, model) for model in fx.MODELS for method in fx.METHODS]
SYSTEMS = ["stock", "structured", *fx.MODELS]
DESCRIBED = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def digits(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    """Round means and ratios, whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(c, n) for c in columns})


def cases_of(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pipeline and case: the log is reduced once a session, all reports read the summary."""
    return fx.derived(spark, sf, "cases", lambda: (tables.kept(votes.case_summary(fx.runs(spark, sf)), "cases"),))[0]


# ---------------------------------------------------------------- runs


@query
def majority_vote_accuracy(spark, sf):
    return digits(votes.vote_accuracy(cases_of(spark, sf)), "accuracy")


@query
def confusion_cube(spark, sf):
    return votes.confusion_with_margins(cases_of(spark, sf))


@query
def case_consistency(spark, sf):
    cases = cases_of(spark, sf).select("pipeline", "case_id", "n_runs", "n_parsed", "vote", "true_name", "never_parsed", "consistency")
    return digits(cases, "consistency")


@query
def low_consistency_split(spark, sf):
    return votes.low_consistency_split(cases_of(spark, sf))


@query
def consistency_describe(spark, sf):
    return digits(ordering.describe(cases_of(spark, sf), ["pipeline"], "consistency"), *DESCRIBED)


@query
def run_completeness(spark, sf):
    return votes.completeness(votes.case_summary(fx.interrupted_runs(spark, sf)), fx.run_cases(spark, sf))


@query
def run_progress(spark, sf):
    return runs.progress(fx.planned_runs(spark, sf), fx.interrupted_runs(spark, sf))


@query
def resume_plan(spark, sf):
    return runs.remaining(fx.planned_runs(spark, sf), fx.interrupted_runs(spark, sf))


@query
def confidence_describe(spark, sf):
    described = ordering.describe(fx.runs(spark, sf).where("parse_success"), ["pipeline"], "confidence")
    return digits(reports.low_spread(described), *DESCRIBED)


@query
def label_distribution(spark, sf):
    return digits(prepare.value_counts(fx.runs(spark, sf).where("parse_success"), "label", ["pipeline"]), "share")


@query
def true_label_distribution(spark, sf):
    named = fx.runs(spark, sf).withColumn("true_name", label_name(F.col("true_label")))
    return digits(prepare.value_counts(named, "true_name", ["pipeline"], keep_null=False), "share")


@query
def parse_rates(spark, sf):
    return digits(votes.parse_rates(fx.runs(spark, sf)), "rate_parse_success")


@query
def prob_bad_per_case(spark, sf):
    cases = cases_of(spark, sf).where("n_parsed > 0").select("pipeline", "case_id", "true_label", "mean_confidence", "prob_bad")
    return digits(cases, "mean_confidence", "prob_bad")


@query
def run_timing(spark, sf):
    return digits(votes.run_timing(fx.interrupted_runs(spark, sf), fx.planned_runs(spark, sf)), "mean_seconds", "projected_hours")


@query
def votes_without_label(spark, sf):
    """Cases of which some parsed runs have no label: those runs are counted and have no vote."""
    log = fx.runs(spark, sf).withColumn("label", F.when(F.col("case_id") % 4 != 0, F.when(F.col("seed") % 3 != 0, F.col("label"))))
    return votes.case_summary(log).select("pipeline", "case_id", "n_parsed", "n_unlabelled", "n_good", "n_bad", "vote")


@query
def run_report(spark, sf):
    """All figures of the analysis of a log in one table."""
    report = reports.run_analysis(fx.runs(spark, sf), cases=cases_of(spark, sf))
    return reports.as_facts({name: table for name, table in report.items() if name != "false_negatives"})


@query
def uniform_answers(spark, sf):
    return reports.run_analysis(fx.runs(spark, sf), None)["uniform_answers"]


@query
def always_failing_cases(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    log = fx.runs(spark, sf).withColumn("explanation_grounded", F.col("parse_success")).withColumn("ungrounded_numbers", F.array().cast("array<double>"))
    return reports.grounding_diagnosis(log, people, [], indicators)["always_failing"]


@query
def false_negative_examples(spark, sf):
    log = fx.runs(spark, sf)
    return reports.false_negative_examples(log, votes.case_summary(log), ["pipeline"], 3)


# ---------------------------------------------------------------- several systems


def truth_and_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cases = cases_of(spark, sf)
    truth = cases.groupBy("case_id").agg(F.min("true_label").alias("true_label"))
    return truth, reports.scored_cases(cases, fx.predictions(spark, sf))


def aligned_systems(spark: SparkSession, sf: str) -> DataFrame:
    truth, scored = truth_and_labels(spark, sf)
    return paired.align(truth.select("case_id", label_name(F.col("true_label")).alias("label")), scored, SYSTEMS)


@query
def aligned_cases(spark, sf):
    return paired.alignment_counts(aligned_systems(spark, sf), SYSTEMS)


@query
def system_accuracy(spark, sf):
    return digits(paired.system_accuracy(paired.common_cases(aligned_systems(spark, sf)), SYSTEMS), "accuracy")


@query
def paired_counts(spark, sf):
    return paired.discordance(paired.common_cases(aligned_systems(spark, sf)), reports.PRIMARY_PAIRS + reports.SECONDARY_PAIRS)


@query
def mcnemar_statistic(spark, sf):
    counts = paired.discordance(paired.common_cases(aligned_systems(spark, sf)), reports.PRIMARY_PAIRS + reports.SECONDARY_PAIRS)
    return digits(paired.mcnemar(counts).select("comparison", "n_discordant", "test_type", "statistic", "p_value"), "statistic", "p_value")


@query
def holm_adjust(spark, sf):
    truth, scored = truth_and_labels(spark, sf)
    named = truth.select("case_id", label_name(F.col("true_label")).alias("label"))
    tests = reports.paired_significance(named, scored)["tests"]
    return digits(tests.select("family", "comparison", "p_value", "p_value_holm", "significant"), "p_value", "p_value_holm")


@query
def system_calibration(spark, sf):
    truth, scored = truth_and_labels(spark, sf)
    return digits(reports.calibration_report(truth, scored)["metrics"], "brier_score", "ece")


@query
def robustness_flips(spark, sf):
    cases = cases_of(spark, sf)
    comparison = robustness.compare_runs(cases.where("pipeline = 'structured'"), cases.where("pipeline = 'stock'"))
    return digits(robustness.flip_summary(comparison), "flip_rate", "mean_abs_delta", "max_abs_delta")


@query
def flip_directions(spark, sf):
    cases = cases_of(spark, sf)
    return robustness.flip_directions(robustness.compare_runs(cases.where("pipeline = 'structured'"), cases.where("pipeline = 'stock'")))


@query
def attempted_without_vote(spark, sf):
    return robustness.attempted_without_vote(cases_of(spark, sf).where("pipeline = 'stock'"))


@query
def magnitude_by_flip(spark, sf):
    log = fx.runs(spark, sf)
    people, _ = fx.applicants(spark, sf)
    report = reports.robustness_report(log.where("pipeline = 'structured'"), log.where("pipeline = 'stock'"), people, sampling.perturb(people))
    return digits(report["magnitude"], *DESCRIBED, n=4)


@query
def flipped_examples(spark, sf):
    log = fx.runs(spark, sf)
    original, variant = log.where("pipeline = 'structured'"), log.where("pipeline = 'stock'")
    return reports.robustness_report(original, variant)["examples"]


# ---------------------------------------------------------------- predictions


@query
def binary_metrics(spark, sf):
    return digits(metrics.classification(fx.predictions(spark, sf), ["system"]), "accuracy", "precision", "recall", "f1")


@query
def roc_auc(spark, sf):
    return digits(metrics.ranking(fx.predictions(spark, sf), ["system"]).select("system", "n_pos", "n_neg", "roc_auc"), "roc_auc")


@query
def average_precision(spark, sf):
    return digits(metrics.ranking(fx.predictions(spark, sf), ["system"]).select("system", "average_precision"), "average_precision")


@query
def metrics_summary(spark, sf):
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    return digits(metrics.summary(fx.predictions(spark, sf), ["system"]).select("system", *names), *names)


@query
def brier_ece(spark, sf):
    return digits(metrics.calibration(fx.predictions(spark, sf), ["system"]), "brier_score", "ece")


@query
def calibration_curve(spark, sf):
    return digits(metrics.calibration_curve(fx.predictions(spark, sf), ["system"]), "prob_true", "prob_pred")


def scored_applicants(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Prepared applicants with the score of one classifier."""
    people, indicators = fx.applicants(spark, sf)
    draw = fx.uniform(7, "case_id", F.lit("boosted"))
    return people.withColumn("score", F.floor(60 * draw + 40 * F.col(TARGET)) / 100.0), indicators


@query
def eval_subset(spark, sf):
    people, _ = scored_applicants(spark, sf)
    return sampling.select_subset(people.select("case_id", TARGET, "score"), "score", 50)


@query
def worked_examples(spark, sf):
    people, indicators = scored_applicants(spark, sf)
    shown = sampling.worked_examples(people, "score", indicators)
    return shown.select(
        "example",
        "case_id",
        "profile_text",
        "ideal_response.label",
        "ideal_response.confidence",
        F.array_join("ideal_response.key_factors", "|").alias("key_factors"),
        "ideal_response.explanation",
        "ideal_response.uncertainty_reason",
    )


# ---------------------------------------------------------------- applicants


@query
def rename_columns(spark, sf):
    """Raw export names to canonical names, identifiers off, features and target kept."""
    back = {name: raw for raw, name in RAW_COLUMNS.items()}
    exported = fx.raw_applicants(spark, sf).withColumnsRenamed(back).withColumn("row_index", F.col("case_id"))
    table = prepare.drop_identifier_columns(prepare.rename_columns(exported))
    return table.select("case_id", *FEATURE_NAMES, TARGET)


@query
def drop_unusable(spark, sf):
    return prepare.drop_unusable_rows(fx.raw_applicants(spark, sf), FEATURE_NAMES).select("case_id", "ExternalRiskEstimate", TARGET)


@query
def sentinel_encode(spark, sf):
    table, _, _ = prepare.prepare(fx.raw_applicants(spark, sf), keys=["case_id"])
    return table


@query
def table_metadata(spark, sf):
    """Prepared table, split and written; sizes and class balance as the metadata document tells them, read back."""
    people, indicators = fx.applicants(spark, sf)
    split = sampling.stratified_split(people)
    folder = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
    tables.write_prepared(split, f"{folder}/table", f"{folder}/metadata", FEATURE_NAMES, indicators)
    splits, metadata = tables.load_processed(spark, f"{folder}/table", f"{folder}/metadata")
    rows = [
        splits[s].agg(F.count("*").alias("n_read")).select(
            F.lit(s).alias("split"), F.lit(metadata.split_sizes[s]).cast("long").alias("n_rows"), "n_read",
            F.round(F.lit(float(metadata.class_balance[s]["1"])), 6).alias("share_bad"), F.lit(len(metadata.indicators)).alias("n_indicators"),
        )
        for s in metadata.split_sizes
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def special_code_counts(spark, sf):
    return prepare.special_code_counts(fx.raw_applicants(spark, sf), FEATURE_NAMES)


@query
def target_polarity(spark, sf):
    return digits(prepare.target_polarity(prepare.encode_target(fx.raw_applicants(spark, sf))), "mean_good", "mean_bad")


@query
def target_distribution(spark, sf):
    return digits(prepare.value_counts(fx.raw_applicants(spark, sf), TARGET), "share")


@query
def sentinel_flags(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    return prepare.sentinel_flags(people, indicators).select("case_id", "n_sentinel_flags")


@query
def fill_missing(spark, sf):
    people, _ = fx.applicants(spark, sf)
    return prepare.fill_missing(people, FEATURE_NAMES).select("case_id", *FEATURE_NAMES)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    people, _ = fx.applicants(spark, sf)
    return people.select("case_id", TARGET)


@query
def stratified_split(spark, sf):
    return sampling.stratified_split(labelled(spark, sf))


@query
def stratified_split_sizes(spark, sf):
    return digits(prepare.split_summary(sampling.stratified_split(labelled(spark, sf))), "share")


@query
def stratified_folds(spark, sf):
    return sampling.stratified_folds(labelled(spark, sf))


@query
def sample_rows(spark, sf):
    return sampling.sample_rows(labelled(spark, sf), 20)


@query
def background_means(spark, sf):
    people, _ = fx.applicants(spark, sf)
    picked = sampling.sample_rows(people.select("case_id", *FEATURE_NAMES), 100)
    return digits(picked.agg(*[F.avg(f).alias(f) for f in FEATURE_NAMES]), *FEATURE_NAMES)


@query
def profile_texts(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    return people.select("case_id", profile_text(indicators).alias("profile_text"))


@query
def reworded_profile(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    return people.select("case_id", reworded_profile_text(indicators).alias("profile_text"))


@query
def status_coverage(spark, sf):
    people, _ = fx.applicants(spark, sf)
    return people.agg(F.count("*").alias("n_rows"), *[F.count_if(unmapped_status(f)).alias(f"unmapped_{f}") for f in STATUS_CODES])


@query
def prompts(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    profile = profile_text(indicators)
    return people.select("case_id", stock_prompt(profile)[1].alias("stock_prompt"), structured_prompt(profile)[1].alias("structured_prompt"))


@query
def perturb_numeric(spark, sf):
    people, _ = fx.applicants(spark, sf)
    return sampling.perturb(people.select("case_id", *PERTURBATIONS))


@query
def perturbation_magnitude(spark, sf):
    people, _ = fx.applicants(spark, sf)
    return digits(robustness.perturbation_magnitude(people, sampling.perturb(people)), "total_perturbation_magnitude", n=4)


@query
def linear_attribution(spark, sf):
    people, _ = fx.applicants(spark, sf)
    coefficients = {f: fx.coefficient("shap", "logreg", f) for f in FEATURE_NAMES}
    wide = attribution.linear_attribution(people, coefficients, fx.feature_means(spark, sf))
    return digits(attribution.unpivot_weights(wide, ["case_id"], FEATURE_NAMES), "weight", n=4)


@query
def topk_factors(spark, sf):
    people, _ = fx.applicants(spark, sf)
    coefficients = {f: fx.coefficient("lime", "rf", f) for f in FEATURE_NAMES}
    wide = attribution.linear_attribution(people, coefficients, fx.feature_means(spark, sf))
    long = digits(attribution.unpivot_weights(wide, ["case_id"], FEATURE_NAMES), "weight")
    return agreement.top_features(long, ["case_id"]).select("case_id", F.array_join("top_features", ",").alias("top_features"))


@query
def explainer_overlap(spark, sf):
    return digits(agreement.explainer_overlap(fx.reference_tops(spark, sf), ("shap", "lime")), "mean_overlap")


# ---------------------------------------------------------------- responses


def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    return validate.revalidate(fx.responses(spark, sf), fx.response_cases(spark, sf), fx.RESPONSE_VALUES)


@query
def stock_parse(spark, sf):
    log = fx.responses(spark, sf).select("case_id", "stock_response")
    return validate.parse_stock(log, "stock_response").drop("stock_response")


@query
def structured_validate(spark, sf):
    parsed = parsed_responses(spark, sf)
    return parsed.select(
        "case_id", "label", "confidence", F.array_join("key_factors", "|").alias("key_factors"), "explanation", "uncertainty_reason",
        "is_valid_json", "label_valid", "confidence_valid", "explanation_grounded", "no_contradiction",
        F.array_size("ungrounded_numbers").cast("long").alias("n_ungrounded"), "parse_success",
    )


@query
def check_breakdown(spark, sf):
    return votes.check_breakdown(parsed_responses(spark, sf))


@query
def revalidation_diff(spark, sf):
    return validate.verdict_changes(validate.revalidate(fx.responses(spark, sf), fx.known_cases(spark, sf), fx.RESPONSE_VALUES))


@query
def vocabulary_rule_diff(spark, sf):
    """Verdicts under the older vocabulary against the present one."""
    log, cases = fx.responses(spark, sf), fx.response_cases(spark, sf)
    older = validate.revalidate(log, cases, fx.RESPONSE_VALUES, vocabulary=vocabulary_numbers(with_status_labels=False))
    return validate.verdict_changes(validate.revalidate(older.drop("old_parse_success"), cases, fx.RESPONSE_VALUES))


@query
def missing_cases(spark, sf):
    return validate.missing_cases(fx.responses(spark, sf), fx.known_cases(spark, sf))


@query
def ungrounded_distance(spark, sf):
    parsed = parsed_responses(spark, sf).join(fx.response_cases(spark, sf), "case_id")
    return digits(grounding.ungrounded_distances(parsed, fx.RESPONSE_VALUES, ["case_id"]), "distance")


@query
def ungrounded_distance_describe(spark, sf):
    log = parsed_responses(spark, sf)
    return digits(reports.grounding_diagnosis(log, fx.response_cases(spark, sf), fx.RESPONSE_VALUES, [])["distances"], *DESCRIBED)


@query
def confidence_by_grounding(spark, sf):
    log = parsed_responses(spark, sf)
    return digits(reports.grounding_diagnosis(log, fx.response_cases(spark, sf), fx.RESPONSE_VALUES, [])["confidence"], *DESCRIBED)


@query
def sentinels_of_failing_cases(spark, sf):
    people, indicators = fx.applicants(spark, sf)
    log = fx.runs(spark, sf).withColumn("explanation_grounded", F.col("parse_success"))
    flagged = grounding.flag_always_failing(prepare.sentinel_flags(people, indicators), votes.case_summary(log, []))
    return digits(ordering.describe(flagged, ["always_fails"], "n_sentinel_flags"), *DESCRIBED)


@query
def borderline_of_failing_cases(spark, sf):
    scores = fx.predictions(spark, sf).where("system = 'boosted'").select("case_id", "score")
    cases = fx.run_cases(spark, sf)
    flagged = grounding.flag_always_failing(cases, votes.case_summary(fx.runs(spark, sf), []))
    near = flagged.join(scores, "case_id", "left").withColumn("dist_from_half", F.abs(F.col("score") - 0.5))
    return digits(ordering.describe(near, ["always_fails"], "dist_from_half"), *DESCRIBED)


@query
def factor_mapping(spark, sf):
    mapped = agreement.map_factors(parsed_responses(spark, sf).where("parse_success"))
    return mapped.select("case_id", F.array_join("cited_features", ",").alias("cited_features"), F.col("n_factors"), F.col("n_unmapped"))


@query
def unmapped_factors(spark, sf):
    return digits(agreement.unmapped_rate(agreement.map_factors(parsed_responses(spark, sf).where("parse_success"))), "unmapped_rate")


def precision_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed responses of an applicant against the applicant's top features."""
    log = parsed_responses(spark, sf).where("parse_success").withColumn("response_id", F.col("case_id"))
    log = log.withColumn("case_id", F.col("applicant_id"))
    mapped = agreement.map_factors(log).withColumn("correct", is_correct(F.col("label"), F.col("true_label")))
    return agreement.with_precision(mapped, agreement.reference_table(fx.reference_tops(spark, sf), CONDITIONS), CONDITIONS)


@query
def grounding_precision(spark, sf):
    return digits(agreement.precision_summary(precision_rows(spark, sf), CONDITIONS), "mean_precision")


@query
def precision_by_correctness(spark, sf):
    names = [f"precision_{m}_{model}" for m, model in CONDITIONS]
    return digits(agreement.precision_by_correctness(precision_rows(spark, sf), CONDITIONS), *names)


@query
def lowest_precision(spark, sf):
    lowest = agreement.lowest_precision(precision_rows(spark, sf), CONDITIONS, 10, ["response_id"])
    return digits(lowest.select("response_id", "mean_precision", "correct"), "mean_precision")


# ---------------------------------------------------------------- models and generation


def metadata_of(indicators: list[str]) -> TableMetadata:
    return TableMetadata(TARGET, "Bad", FEATURE_NAMES, indicators)


def stub_factory():
    """A repeatable stand-in for a text generator: the answer is a hash of the prompt."""

    def call(user_prompt: str, seed: int, system_prompt: str, max_new_tokens: int) -> str:
        digest = hashlib.md5(f"{user_prompt}|{seed}".encode()).hexdigest()
        answer = {
            "label": "Bad" if int(digest[0], 16) < 8 else "Good",
            "confidence": 50 + int(digest[1:3], 16) % 50,
            "key_factors": ["total number of trades"],
            "explanation": "Seen over 24 months.",
            "uncertainty_reason": "none",
        }
        return json.dumps(answer)

    return call


class BatchedStub:
    """The same stand-in for whole batches, with an answer in free text."""

    def many(self, prompts: list[str], seeds: list[int], system_prompt: str, max_new_tokens: int) -> list[str]:
        made = []
        for prompt, seed in zip(prompts, seeds, strict=True):
            digest = hashlib.md5(f"{prompt}|{seed}".encode()).hexdigest()
            label, confidence = "Bad" if int(digest[0], 16) < 8 else "Good", 50 + int(digest[1:3], 16) % 50
            made.append(f"Classification: {label}\nConfidence: {confidence}\nExplanation: seen over 24 months")
        return made


def open_stock_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, TableMetadata]:
    people, indicators = fx.applicants(spark, sf)
    return runs.remaining(runs.plan_runs(people, ["stock"], 2), fx.runs(spark, sf)), metadata_of(indicators)


@query
def stock_generate(spark, sf):
    """Two free-text runs for every applicant on the reworded profile, less those the log has, generated by the batch."""
    open_runs, metadata = open_stock_runs(spark, sf)
    answered = runs.responses_for(open_runs, metadata, "stock", BatchedStub, profile="reworded")
    return answered.select("pipeline", "case_id", "seed", "true_label", "label", "confidence", "explanation", "parse_success")


def label_parser(df: DataFrame, raw: str = "raw_response", **_) -> DataFrame:
    """A parser of one's own, over Arrow batches: the first word of the answer, and how many numbers it states."""

    @F.pandas_udf("label string, n_numbers long, parse_success boolean")
    def parse(texts: pd.Series) -> pd.DataFrame:
        label = texts.str.extract(r"Classification: (\w+)", expand=False)
        return pd.DataFrame({"label": label, "n_numbers": texts.str.count(r"\d+"), "parse_success": label.notna()})

    return df.withColumn("_own", parse(raw)).select(*df.columns, "_own.*")


@query
def custom_parser(spark, sf):
    """The same runs on the plain profile, read by a parser that is handed in."""
    open_runs, metadata = open_stock_runs(spark, sf)
    answered = runs.responses_for(open_runs, metadata, "stock", BatchedStub, parser=label_parser)
    return answered.select("pipeline", "case_id", "seed", "true_label", "label", "n_numbers", "parse_success")


# ---------------------------------------------------------------- sources


@query
def csv_lines(spark, sf):
    """Customers as lines of CSV, some of them broken, parsed again."""
    key = F.col("c_custkey")
    money = F.when(key % 10 == 3, F.lit("none")).otherwise(F.format_string("%.2f", "c_acctbal"))
    whole = F.concat_ws(",", key, F.col("c_name"), "c_nationkey", money, F.col("c_mktsegment"))
    lines = fx.table(spark, sf, "customer").select(F.when(key % 10 == 7, F.concat_ws(",", key, F.col("c_name"))).otherwise(whole).alias("line"))
    rows = tables.parse_lines(lines, "line", "custkey long, name string, nation int, balance double, segment string")
    return rows.withColumn("broken", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


@query
def json_lines(spark, sf):
    """Events as lines of JSON, some of them cut off, parsed again; those that can't be read are counted by type."""
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 9 == 4, F.substring(whole, 1, 25)).otherwise(whole)
    lines = fx.table(spark, sf, "events").select(F.col("event_type").alias("kind"), line.alias("line"))
    rows = tables.parse_lines(lines, "line", "event_id long, user_id long, event_type string, value double", "json")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n_lines"), F.count("_corrupt_record").alias("n_broken"), F.count_if(F.col("event_type") == F.col("kind")).alias("n_read"),
        F.sum(F.when(F.col("_corrupt_record").isNull(), F.col("event_id"))).alias("sum_of_keys"),
    )


@query
def log_batches(spark, sf):
    """The log appended in batches, one of which repeats keys with other figures; the earliest record of a key counts."""
    log, folder = fx.runs(spark, sf), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    again = log.where("seed % 3 = 0 AND case_id % 5 = 0").withColumn("confidence", F.lit(-1.0))
    for batch, part in enumerate([*(log.where(F.col("seed") % 3 == i) for i in range(3)), again]):
        runlog.append_log(part, f"{folder}/log", batch)
    first = runlog.first_records(runlog.read_log(spark, f"{folder}/log"))
    runlog.write_log_copy(first, f"{folder}/settled")
    settled = runlog.read_log(spark, f"{folder}/settled")
    return settled.select("pipeline", "case_id", "seed", "label", "confidence", F.col("batch").cast("int").alias("batch"))


@query
def csv_round_trip(spark, sf):
    """Raw applicants as CSV with a header, written and read back without inferring types."""
    raw, _ = fx.usable_applicants(spark, sf)
    path = f"{shared_folder(spark)}/applicants-{uuid.uuid4().hex}"
    tables.write_csv(raw.select(*FEATURE_NAMES, TARGET), path)
    return tables.read_csv(spark, path).groupBy(TARGET).agg(F.count("*").alias("n_rows"), *[F.sum(F.floor(f)).alias(f) for f in FEATURE_NAMES])


@query
def results_document(spark, sf):
    """Metrics of the systems written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    results = digits(metrics.classification(fx.predictions(spark, sf), ["system"]), "accuracy", "precision", "recall", "f1")
    tables.write_results(results, path)
    return spark.read.schema(results.schema).json(path)


@query
def top_feature_lines(spark, sf):
    """Top features written as a document a line and read back."""
    tops = fx.reference_tops(spark, sf)
    per_method = tops.groupBy("case_id", "method").agg(F.map_from_entries(F.collect_list(F.struct("model", "top_features"))).alias("models"))
    docs = per_method.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "models"))).alias("top"))
    folder = f"{shared_folder(spark)}/top-lines-{uuid.uuid4().hex}"
    docs.select(F.to_json(F.struct(F.col("case_id").cast("string").alias("case_id"), "top")).alias("value")).write.text(folder)
    rows = tables.explode_top_features(spark.read.text(folder))
    return rows.select("method", "model", "case_id", F.array_join("top_features", ",").alias("top_features"))


# ---------------------------------------------------------------- more generation


@query
def batch_generate(spark, sf):
    """Two runs for every applicant, less those the log has already."""
    people, indicators = fx.applicants(spark, sf)
    open_runs = runs.remaining(runs.plan_runs(people, ["structured"], 2), fx.runs(spark, sf))
    answered = runs.responses_for(open_runs, metadata_of(indicators), "structured", stub_factory)
    return answered.select("pipeline", "case_id", "seed", "true_label", "label", "confidence", "explanation_grounded", "parse_success")


def model_table(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Usable applicants with their split, written once, and the columns that models learn from."""
    people, indicators = fx.applicants(spark, sf)
    return tables.kept(sampling.stratified_split(tables.kept(people))), [*FEATURE_NAMES, *indicators]


def known_models(table: DataFrame, columns: list[str]) -> dict[str, models.FittedModel]:
    """The three families at the points known to be best, trained side by side on the rows given."""
    with ThreadPoolExecutor(len(models.FAMILIES)) as pool:
        fitted = pool.map(lambda family: models.train(table, family, columns, models.KNOWN_POINTS[family]), models.FAMILIES)
        return dict(zip(models.FAMILIES, fitted, strict=True))


@query
def train_score_models(spark, sf):
    """Three model families, trained on the train split and scored on the test split."""
    table, columns = model_table(spark, sf)
    return models.evaluate(table.where("split = 'test'"), known_models(table.where("split = 'train'"), columns), columns)


def searched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """All grid points of the three families in five folds of the train split: the table, a row a point, the columns.

    The scores lie in the shared folder under the names of session and tables: a second query, or a run that broke
    off, goes on from them.
    """
    table, columns = model_table(spark, sf)
    folds = sampling.stratified_folds(table.where("split = 'train'"), k=5)
    path = f"{shared_folder(spark)}/grid-search-{hashlib.sha256(f'{spark.sparkContext.applicationId} {sf}'.encode()).hexdigest()[:16]}"
    return table, models.search_summary(models.grid_scores(folds, columns, path=path)), columns


@query
def grid_search_models(spark, sf):
    """The 29 grid points with their mean F1 over the folds; those chosen also with F1 on the validation split and the note on a gap."""
    table, points, columns = searched(spark, sf)
    best = {r["family"]: json.loads(r["params"]) for r in points.where("best").collect()}
    train = table.where("split = 'train'")
    fitted = {family: models.train(train, family, columns, point) for family, point in best.items()}
    checked = models.evaluate(table.where("split = 'val'"), fitted, columns).select(F.col("system").alias("family"), F.lit(True).alias("best"), F.col("f1").alias("val_f1"))
    rows = points.withColumnRenamed("mean_f1", "cv_f1").join(checked, ["family", "best"], "left")
    return metrics.overfit_note(rows)


@query
def grid_search_rows(spark, sf):
    """How many folds and rows each grid point was judged on."""
    _, points, _ = searched(spark, sf)
    return points.select("family", "params", F.col("n_folds").cast("bigint").alias("n_folds"), "n_rows")


def explained(spark: SparkSession, sf: str) -> tuple[dict[str, models.FittedModel], DataFrame, list[str]]:
    """The three families trained on all usable applicants, these applicants, and their columns."""

    def make() -> tuple:
        people, indicators = fx.applicants(spark, sf)
        people, columns = tables.kept(fx.spread(people)), [*FEATURE_NAMES, *indicators]
        return known_models(people, columns), people, columns

    return fx.derived(spark, sf, "models", make)


@query
def score_gap(spark, sf):
    """Scores of each model against those worked out from its parts: coefficients, the forest's node table, the saved trees."""
    fitted, people, columns = explained(spark, sf)
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(1) as pool:  # the scores are written while the models are saved and read again
        scored = pool.submit(lambda: tables.kept(models.score_wide(people, fitted, columns)))
        models.save_models(fitted, path)
        loaded = models.load_models(path)
        forest = trees.forest_ensemble(loaded["random_forest"], columns)
        wide = scored.result()
    odds = attribution.logistic_log_odds(loaded["logistic_regression"], columns)
    again = models.as_doubles(people, columns).select(
        "case_id", (1.0 / (1.0 + F.exp(-odds))).alias("logistic_regression"), trees.score_column(forest).alias("random_forest"),
        trees.score_column(loaded["boosted_trees"]).alias("boosted_trees"),
    )
    gaps = [F.struct(F.lit(f).alias("system"), (F.round(F.col(f"{f}_proba") - F.col(f), 9) + 0.0).alias("gap")) for f in fitted]
    return wide.join(again, "case_id").select("case_id", F.inline(F.array(*gaps)))


def fitted_logistic(spark: SparkSession, sf: str):
    people, indicators = fx.applicants(spark, sf)
    people = tables.kept(people)
    columns = [*FEATURE_NAMES, *indicators]
    return models.train(people, "logistic_regression", columns, {"C": 0.01}), people, columns


@query
def logistic_attribution(spark, sf):
    model, people, columns = fitted_logistic(spark, sf)
    wide = attribution.logistic_attribution(model, people, people, columns)
    return attribution.unpivot_weights(wide, ["case_id"], columns)


@query
def sampled_shapley(spark, sf):
    model, people, columns = fitted_logistic(spark, sf)
    return attribution.sampled_shapley(model, people, people, columns)


def tree_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of the forest and of the boosted trees for every usable applicant."""
    return fx.derived(spark, sf, "tree-weights", lambda: (_tree_weights(spark, sf),))[0]


def _tree_weights(spark: SparkSession, sf: str) -> DataFrame:
    fitted, people, columns = explained(spark, sf)
    parts = [
        attribution.tree_attribution(fitted[family], people, people, columns).select(F.lit(family).alias("system"), "*")
        for family in ("random_forest", "boosted_trees")
    ]
    return tables.kept(parts[0].unionByName(parts[1]))


@query
def tree_attribution(spark, sf):
    return tree_weights(spark, sf).select("system", "case_id", "feature", "weight")


@query
def tree_attribution_gap(spark, sf):
    """Per model and case the number of attributions, and how far they are from the score less the expected one: not at all."""
    gap = F.sum("weight") - (F.max("score") - F.max("expected"))
    rows = tree_weights(spark, sf).groupBy("system", "case_id").agg(F.count("*").alias("n_features"), (F.round(gap, 6) + 0.0).alias("gap"))
    return rows.withColumn("n_features", F.col("n_features") >= len(FEATURE_NAMES)).withColumnRenamed("n_features", "all_features")


@query
def rule_tree_attribution(spark, sf):
    """Exact attributions of a small forest that is written down, against two background rows, for every usable applicant."""
    people, _ = fx.applicants(spark, sf)
    weights = trees.attribution(fx.rule_forest(), people, np.array(fx.RULE_BACKGROUND))
    return digits(weights.select("case_id", "feature", "weight"), "weight").withColumn("weight", F.col("weight") + 0.0)


def surrogate_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Surrogates of the three models around every usable applicant."""

    def make() -> tuple[DataFrame]:
        fitted, people, columns = explained(spark, sf)
        scores = {family: attribution.scorer(model) for family, model in fitted.items()}
        return (tables.kept(attribution.local_surrogates(scores, people, people, columns, fill=0.0)),)

    return fx.derived(spark, sf, "surrogates", make)[0]


@query
def local_surrogate(spark, sf):
    return surrogate_weights(spark, sf)


@query
def surrogate_fit(spark, sf):
    """Mean and least R2 of the surrogates of each model."""
    return attribution.fit_quality(surrogate_weights(spark, sf), ["system"])


@query
def surrogate_residuals(spark, sf):
    """What is left of the normal equations of each case's surrogate, nothing, and whether its fit is a share."""
    weights = surrogate_weights(spark, sf)
    return weights.groupBy("system", "case_id").agg((F.round(F.max("residual"), 6) + 0.0).alias("residual"), F.expr("every(r2 <= 1)").alias("r2_at_most_1"))


@query
def surrogate_of_linear_score(spark, sf):
    """Surrogates of a linear score, without a penalty: its coefficients in standard units come back, for every usable applicant."""
    people, _ = fx.applicants(spark, sf)
    people = tables.kept(people.select("case_id", *fx.SCORED))
    made = attribution.local_surrogate(lambda df: df.withColumn("_prob", F.expr(fx.linear_score())), people, people, list(fx.SCORED), fill=0.0, ridge=0.0)
    rows = made.select("case_id", "feature", (F.round("weight", 4) + 0.0).alias("weight"), F.round("r2", 4).alias("r2"))
    return rows


@query
def model_chain(spark, sf):
    """Train, score, calibrate and pair: the three models on the test split, with calibration and discordance per pair."""
    table, columns = model_table(spark, sf)
    fitted = known_models(table.where("split = 'train'"), columns)
    wide = tables.kept(models.score_wide(table.where("split = 'test'"), fitted, columns))
    long = models.wide_to_long(wide, list(fitted))
    own = metrics.calibration(long, ["system"]).join(metrics.summary(long, ["system"]), "system")
    pairs = [(a, b) for i, a in enumerate(models.FAMILIES) for b in models.FAMILIES[i + 1 :]]
    names = {f: label_name(F.col(f"{f}_pred")) for f in models.FAMILIES}
    aligned = wide.select("case_id", label_name(F.col("true_label")).alias("true"), *[v.alias(k) for k, v in names.items()])
    tests = paired.mcnemar(paired.discordance(aligned, pairs))
    facts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("n_cases", "brier_score", "ece", "accuracy", "f1", "roc_auc", "pr_auc")]
    both = own.select("system", F.inline(F.array(*facts)))
    told = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("n_discordant", "statistic", "p_value")]
    return both.unionByName(tests.select(F.col("comparison").alias("system"), F.inline(F.array(*told))))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return majority_vote_accuracy(spark, sf)
