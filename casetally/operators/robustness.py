"""A run on changed inputs against the original run of the same cases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.schema import PERTURBATIONS


def compare_runs(original: DataFrame, variant: DataFrame, key: str = "case_id", name: str = "variant") -> DataFrame:
    """Cases with a vote in both runs: labels, confidences, flip and confidence change.

    Takes case summaries of one system each.
    """
    def side(cases: DataFrame, prefix: str) -> DataFrame:
        return cases.where(F.col("vote").isNotNull()).select(
            key, F.col("vote").alias(f"{prefix}_label"), F.col("mean_confidence").alias(f"{prefix}_confidence")
        )

    return side(original, "original").join(side(variant, name), key).withColumns(
        {
            "flipped": F.col("original_label") != F.col(f"{name}_label"),
            "confidence_delta": F.col(f"{name}_confidence") - F.col("original_confidence"),
        }
    )


def flip_summary(comparison: DataFrame) -> DataFrame:
    delta = F.abs("confidence_delta")
    return comparison.agg(
        F.count("*").alias("n_cases"),
        F.count_if("flipped").alias("n_flipped"),
        F.avg(F.col("flipped").cast("int")).alias("flip_rate"),
        F.avg(delta).alias("mean_abs_delta"),
        F.max(delta).alias("max_abs_delta"),
    )


def flip_directions(comparison: DataFrame, name: str = "variant") -> DataFrame:
    return comparison.where("flipped").groupBy(
        F.concat_ws(" -> ", "original_label", f"{name}_label").alias("direction")
    ).agg(F.count("*").alias("n_cases"))


def attempted_without_vote(variant: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases tried in the changed run that never parsed; they are left out, not counted as stable."""
    return variant.where(F.col("vote").isNull()).select(key)


def perturbation_magnitude(
    original: DataFrame, changed: DataFrame, key: str = "case_id", features: Sequence[str] = tuple(PERTURBATIONS)
) -> DataFrame:
    """Summed absolute change of the perturbable values that are present on both sides."""
    used = [f for f in features if f in original.columns]
    old = original.select(key, *[F.col(f).alias(f"_o_{f}") for f in used])
    new = changed.select(key, *[F.col(f).alias(f"_n_{f}") for f in used])
    parts = [F.coalesce(F.abs(F.col(f"_n_{f}") - F.col(f"_o_{f}")), F.lit(0.0)) for f in used]
    return old.join(new, key).select(key, reduce(add, parts).alias("total_perturbation_magnitude"))


def with_magnitude(comparison: DataFrame, magnitudes: DataFrame, key: str = "case_id") -> DataFrame:
    return comparison.join(magnitudes, key, "left")


def flipped_examples(comparison: DataFrame, original: DataFrame, variant: DataFrame, n: int = 3, key: str = "case_id") -> DataFrame:
    """The first parsed response of either run for the first n flipped cases."""
    chosen = comparison.where("flipped").orderBy(key).limit(n).select(key)

    def first(log: DataFrame, column: str) -> DataFrame:
        kept = log.join(F.broadcast(chosen), key, "left_semi").where("parse_success")
        return kept.groupBy(key).agg(F.min_by("raw_response", "seed").alias(column))

    return first(original, "original_response").join(first(variant, "variant_response"), key)
