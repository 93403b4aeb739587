"""One row per case out of repeated runs.

Every per-case figure comes from one aggregate: labels are counted apart by
condition, so a case with very many runs is reduced before the shuffle and
never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.functions.responses import label_name, prob_bad
from casetally.schema import CHECKS


def case_summary(log: DataFrame, by: Sequence[str] = ("pipeline",), key: str = "case_id") -> DataFrame:
    """Votes, consistency, confidence and truth of every case.

    Votes and means use parsed runs only, consistency divides by all runs. On a
    tie the label of the earliest seed wins. A case without a run labelled Good or
    Bad has no vote; ``n_unlabelled`` counts parsed runs without such a label.
    """
    ok = F.coalesce(F.col("parse_success"), F.lit(False))
    good, bad = ok & (F.col("label") == "Good"), ok & (F.col("label") == "Bad")
    # Two counts cover all votes; a parsed run with another label, or none, has no vote and is counted apart.
    cases = log.groupBy(*by, key).agg(
        F.count("*").alias("n_runs"),
        F.count_if(ok).alias("n_parsed"),
        F.count_if(good).alias("n_good"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(ok & ~F.coalesce(F.col("label").isin("Good", "Bad"), F.lit(False))).alias("n_unlabelled"),
        F.min(F.when(good, F.col("seed"))).alias("_first_good"),
        F.min(F.when(bad, F.col("seed"))).alias("_first_bad"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
        F.avg(F.when(ok, prob_bad(F.col("label"), F.col("confidence")))).alias("prob_bad"),
        F.min_by("true_label", "seed").alias("true_label"),
        (F.min("true_label") != F.max("true_label")).alias("truth_differs"),
    )
    bad_wins = (F.col("n_bad") > F.col("n_good")) | (
        (F.col("n_bad") == F.col("n_good")) & (F.col("_first_bad") < F.col("_first_good"))
    )
    return cases.withColumns(
        {
            "vote": F.when(F.col("n_good") + F.col("n_bad") > 0, F.when(bad_wins, F.lit("Bad")).otherwise(F.lit("Good"))),
            "consistency": F.greatest("n_good", "n_bad") / F.col("n_runs"),
            "never_parsed": F.col("n_parsed") == 0,
            "true_name": label_name(F.col("true_label")),
        }
    ).drop("_first_good", "_first_bad")


def voted(cases: DataFrame) -> DataFrame:
    """Cases that have both a vote and a truth."""
    return cases.where(F.col("vote").isNotNull() & F.col("true_name").isNotNull())


def vote_accuracy(cases: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    return voted(cases).groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.avg((F.col("vote") == F.col("true_name")).cast("int")).alias("accuracy")
    )


def confusion_with_margins(cases: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Votes against truth with row, column and grand totals, shown as ``All``.

    Four counts are taken in one aggregate and the totals are added up from
    them, instead of expanding every case four times.
    """
    counts = voted(cases).groupBy(*by, F.col("true_name").alias("true"), F.col("vote").alias("predicted")).agg(
        F.count("*").alias("n")
    )
    keyed = counts.cube(*by, "true", "predicted").agg(
        F.sum("n").alias("n_cases"), F.grouping_id().alias("_g")
    )
    # Keep the four levels in which the leading group columns are present.
    return keyed.where(F.col("_g") < 4).select(
        *by,
        F.when(F.col("_g").isin(2, 3), F.lit("All")).otherwise(F.col("true")).alias("true"),
        F.when(F.col("_g").isin(1, 3), F.lit("All")).otherwise(F.col("predicted")).alias("predicted"),
        "n_cases",
    )


def low_consistency_split(cases: DataFrame, by: Sequence[str] = ("pipeline",), below: float = 0.6) -> DataFrame:
    """Unstable cases, and how many of them never parsed or truly changed their label."""
    low = F.col("consistency") < below
    return (
        cases.groupBy(*by)
        .agg(F.count_if(low).alias("n_low"), F.count_if("never_parsed").alias("n_never_parsed"))
        .withColumn("n_split", F.col("n_low") - F.col("n_never_parsed"))
    )


def always_failing(cases: DataFrame) -> DataFrame:
    return cases.where("never_parsed")


def check_breakdown(log: DataFrame, checks: Sequence[str] = CHECKS, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Per check: passed, failed, not evaluated. One aggregate over the log, then one row per check."""
    present = [c for c in checks if c in log.columns]
    one = log.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("check"),
                F.count_if(F.col(c)).alias("n_pass"),
                F.count_if(~F.col(c)).alias("n_fail"),
                F.count_if(F.col(c).isNull()).alias("n_not_evaluated"),
            ).alias(c)
            for c in present
        ]
    )
    return one.select(*by, F.inline(F.array(*present)))


def parse_rates(log: DataFrame, flags: Sequence[str] = ("parse_success",), by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Records and the rate of each flag over the records that have it."""
    return log.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        *[F.avg(F.col(f).cast("int")).alias(f"rate_{f}") for f in flags],
    )


def completeness(cases: DataFrame, planned: DataFrame, by: Sequence[str] = ("pipeline",), key: str = "case_id") -> DataFrame:
    """Cases and records present against the plan.

    ``planned`` lists the planned cases; the repeats per case are the most
    frequent number seen, the smaller one on a tie.
    """
    sizes = cases.groupBy(*by, "n_runs").agg(F.count("*").alias("_cases"))
    seen = sizes.groupBy(*by).agg(
        F.sum("_cases").alias("n_seen_cases"),
        F.sum(F.col("_cases") * F.col("n_runs")).alias("n_records"),
        F.max_by("n_runs", F.struct(F.col("_cases"), -F.col("n_runs"))).alias("n_repeats"),
    )
    n_planned = planned.select(key).distinct().agg(F.count("*").alias("n")).scalar()
    return (
        seen.withColumn("n_planned_cases", n_planned)
        .withColumn("n_expected", F.col("n_planned_cases") * F.col("n_repeats"))
        .withColumn(
            "complete",
            (F.col("n_seen_cases") >= F.col("n_planned_cases")) & (F.col("n_records") >= F.col("n_expected")),
        )
    )


def run_timing(log: DataFrame, planned: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Mean seconds per response and projected hours for all planned runs."""
    plan = planned.groupBy(*by).agg(F.count("*").alias("n_planned"))
    means = log.groupBy(*by).agg(F.avg("elapsed_seconds").alias("mean_seconds"))
    return means.join(plan, list(by)).withColumn("projected_hours", F.col("mean_seconds") * F.col("n_planned") / 3600.0)
