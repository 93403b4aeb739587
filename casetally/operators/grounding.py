"""Why responses fail the grounding check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_distance(number: Column, values: Column) -> Column:
    """Distance of a number to the nearest present value, NULL if there is none."""
    return F.array_min(F.transform(F.array_compact(values), lambda v: F.abs(number - v)))


def ungrounded_distances(failed: DataFrame, row_columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per unsupported number of a failed response, with its distance to the row's values."""
    values = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in row_columns])
    numbers = failed.where(~F.col("explanation_grounded")).select(
        *keep, values.alias("_values"), F.explode("ungrounded_numbers").alias("number")
    )
    return numbers.select(*keep, "number", nearest_distance(F.col("number"), F.col("_values")).alias("distance")).where(
        F.col("distance").isNotNull()
    )


def flag_always_failing(cases: DataFrame, summary: DataFrame, key: str = "case_id") -> DataFrame:
    """Case rows with a flag for cases whose runs all failed."""
    failing = summary.where("never_parsed").select(key).withColumn("_failing", F.lit(True))
    return cases.join(failing, key, "left").withColumn("always_fails", F.coalesce("_failing", F.lit(False))).drop("_failing")
