"""The evaluation reports, each a set of small result tables.

A report takes the log and reduces it to one row per case once; all its tables
are aggregates of that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions.responses import is_correct, label_name
from casetally.operators import agreement, grounding, metrics, ordering, paired, prepare, robustness, votes

PRIMARY_PAIRS = [("structured", "stock"), ("structured", "logreg"), ("structured", "rf"), ("structured", "boosted")]
SECONDARY_PAIRS = [("stock", "logreg"), ("stock", "rf"), ("stock", "boosted")]


def low_spread(described: DataFrame, below: float = 5.0) -> DataFrame:
    """Flag a confidence that hardly varies."""
    return described.withColumn("low_spread", F.coalesce(F.col("std") < below, F.lit(False)))


def as_facts(report: dict[str, DataFrame]) -> DataFrame:
    """All tables of a report as rows of (table, item, metric, value): texts make the item, figures and flags are metrics.

    Empty figures are left out; an empty text, the margin of a crosstab, reads ``all``.
    """
    parts = []
    for table, df in report.items():
        texts = [c for c, t in df.dtypes if t == "string"]
        items = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("all")) for c in texts]).alias("item")
        rows = [F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in df.columns if c not in texts]
        parts.append(df.select(F.lit(table).alias("table"), items, F.inline(F.array(*rows))).where("value is not null"))
    return reduce(DataFrame.unionByName, parts)


def run_analysis(
    log: DataFrame, planned: DataFrame | None = None, by: Sequence[str] = ("pipeline",), n_examples: int = 3, cases: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Parse rates, checks, label and confidence distributions, consistency, confusion and accuracy of a log.

    ``cases`` is the log's case summary, where it has been made and kept before.
    """
    by = list(by)
    cases = votes.case_summary(log, by) if cases is None else cases
    parsed = log.where("parse_success")
    confidence = low_spread(ordering.describe(parsed, by, "confidence"))
    stability = votes.low_consistency_split(cases, by)
    report = {
        "parse_rates": votes.parse_rates(log, by=by),
        "labels": prepare.value_counts(parsed, "label", by),
        "true_labels": prepare.value_counts(log.withColumn("true_name", label_name(F.col("true_label"))), "true_name", by, keep_null=False),
        "confidence": confidence,
        "consistency": ordering.describe(cases, by, "consistency"),
        "stability": stability,
        "uniform_answers": stability.join(confidence, by).select(*by, ((F.col("n_low") == 0) & F.col("low_spread")).alias("uniform_answers")),
        "confusion": votes.confusion_with_margins(cases, by),
        "accuracy": votes.vote_accuracy(cases, by),
        "false_negatives": false_negative_examples(log, cases, by, n_examples),
    }
    if any(c in log.columns for c in votes.CHECKS):
        report["checks"] = votes.check_breakdown(log, by=by)
    if planned is not None:
        report["completeness"] = votes.completeness(cases, planned, by)
    return report


def false_negative_examples(log: DataFrame, cases: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """Raw responses at seed 0 of the first n cases per group that are Bad but voted Good."""
    missed = votes.voted(cases).where("true_name = 'Bad' AND vote = 'Good'")
    first = F.row_number().over(Window.partitionBy(*by).orderBy("case_id"))
    chosen = missed.withColumn("_rank", first).where(F.col("_rank") <= n).select(*by, "case_id")
    return log.where("seed = 0").join(chosen, [*by, "case_id"], "left_semi").select(*by, "case_id", "raw_response")


def scored_cases(cases: DataFrame, predictions: DataFrame, by: str = "pipeline") -> DataFrame:
    """Voting systems and classifiers in one long table of (system, case, label, score)."""
    runs = cases.select(F.col(by).alias("system"), "case_id", F.col("vote").alias("label"), F.col("prob_bad").alias("score"))
    models = predictions.select("system", "case_id", label_name(F.col("pred")).alias("label"), "score")
    return runs.unionByName(models)


def paired_significance(
    truth: DataFrame,
    predictions: DataFrame,
    primary: Sequence[tuple[str, str]] = PRIMARY_PAIRS,
    secondary: Sequence[tuple[str, str]] = SECONDARY_PAIRS,
) -> dict[str, DataFrame]:
    """Accuracy on the common cases and paired tests; only the primary family is corrected.

    ``truth`` has (case_id, label), ``predictions`` (system, case_id, label).
    """
    systems = list(dict.fromkeys(s for pair in [*primary, *secondary] for s in pair))
    aligned = paired.align(truth, predictions, systems)
    common = paired.common_cases(aligned)
    tests = paired.mcnemar(paired.discordance(common, [*primary, *secondary]))
    is_primary = F.col("comparison").isin(*[f"{a} vs {b}" for a, b in primary])
    tests = tests.withColumn("family", F.when(is_primary, F.lit("primary")).otherwise(F.lit("secondary")))
    corrected = paired.holm(tests, ["family"]).withColumns(
        {c: F.when(F.col("family") == "primary", F.col(c)) for c in ("p_value_holm", "significant")}
    )
    return {
        "cases": paired.alignment_counts(aligned, systems),
        "accuracy": paired.system_accuracy(common, systems),
        "tests": corrected,
    }


def calibration_report(truth: DataFrame, scores: DataFrame, n_bins: int = 10) -> dict[str, DataFrame]:
    """Brier score, calibration error and curve; each system on its own cases with a truth.

    ``truth`` has (case_id, true_label), ``scores`` (system, case_id, score).
    """
    scored = scores.where(F.col("score").isNotNull()).join(truth.select("case_id", "true_label"), "case_id")
    return {
        "metrics": metrics.calibration(scored, ["system"], n_bins=n_bins),
        "curve": metrics.calibration_curve(scored, ["system"], n_bins=n_bins),
    }


def explanation_agreement(log: DataFrame, tops: DataFrame, conditions: Sequence[tuple[str, str]], n_examples: int = 3) -> dict[str, DataFrame]:
    """Cited factors against the explainers' top features."""
    mapped = agreement.map_factors(log.where("parse_success")).withColumn("correct", is_correct(F.col("label"), F.col("true_label")))
    scored = agreement.with_precision(mapped, agreement.reference_table(tops, conditions), conditions)
    return {
        "summary": agreement.precision_summary(scored, conditions),
        "by_correctness": agreement.precision_by_correctness(scored, conditions),
        "unmapped": agreement.unmapped_rate(mapped),
        "lowest": agreement.lowest_precision(scored, conditions, n_examples),
    }


def robustness_report(
    original: DataFrame,
    variant: DataFrame,
    original_cases: DataFrame | None = None,
    changed_cases: DataFrame | None = None,
    n_examples: int = 3,
) -> dict[str, DataFrame]:
    """A log on changed inputs against the original log of the same system."""
    before, after = votes.case_summary(original, []), votes.case_summary(variant, [])
    comparison = robustness.compare_runs(before, after)
    report = {
        "flips": robustness.flip_summary(comparison),
        "directions": robustness.flip_directions(comparison),
        "without_vote": robustness.attempted_without_vote(after),
        "examples": robustness.flipped_examples(comparison, original, variant, n_examples),
        "comparison": comparison,
    }
    if original_cases is not None and changed_cases is not None:
        sized = robustness.with_magnitude(comparison, robustness.perturbation_magnitude(original_cases, changed_cases))
        report["comparison"] = sized
        report["magnitude"] = ordering.describe(sized, ["flipped"], "total_perturbation_magnitude")
    return report


def grounding_diagnosis(
    log: DataFrame, cases: DataFrame, features: Sequence[str], indicators: Sequence[str], scores: DataFrame | None = None, n_examples: int = 3
) -> dict[str, DataFrame]:
    """What sets the cases apart whose responses never pass.

    ``scores`` has (case_id, score) of one classifier.
    """
    summary = votes.case_summary(log, [])
    flagged = grounding.flag_always_failing(prepare.sentinel_flags(cases, indicators), summary)
    columns = [*features, *indicators]
    rows = cases.select("case_id", *[F.col(c).cast("double").alias(f"_row_{c}") for c in columns])
    joined = log.where(~F.col("explanation_grounded")).join(rows, "case_id")
    distances = grounding.ungrounded_distances(joined, [f"_row_{c}" for c in columns], ["case_id"])
    report = {
        "always_failing": summary.agg(F.count_if("never_parsed").alias("n_failing"), F.count("*").alias("n_cases")),
        "sentinels": ordering.describe(flagged, ["always_fails"], "n_sentinel_flags"),
        "confidence": ordering.describe(log.where(F.col("explanation_grounded").isNotNull()), ["explanation_grounded"], "confidence"),
        "distances": ordering.describe(distances.withColumn("measure", F.lit("distance")), ["measure"], "distance"),
        "examples": flagged.where("always_fails").orderBy("case_id").limit(n_examples).select("case_id", "n_sentinel_flags"),
    }
    if scores is not None:
        near = flagged.join(scores, "case_id", "left").withColumn("dist_from_half", F.abs(F.col("score") - 0.5))
        report["borderline"] = ordering.describe(near, ["always_fails"], "dist_from_half")
    return report
