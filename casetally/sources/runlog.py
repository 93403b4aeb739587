"""The response log: an append-only table with one row per (pipeline, case, seed)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.schema import RESPONSE_LOG

KEY = ["pipeline", "case_id", "seed"]
CORRUPT = "_corrupt_record"


def read_json_log(spark: SparkSession, path: str, schema: T.StructType = RESPONSE_LOG) -> DataFrame:
    """JSON-lines log; a line cut off by a crash is kept in ``_corrupt_record`` and can be counted."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).json(path)


def sound(log: DataFrame) -> DataFrame:
    """Rows that could be read."""
    return log.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in log.columns else log


def corrupt_count(log: DataFrame) -> int:
    # Spark needs a data column next to the corrupt one in a JSON scan.
    return log.groupBy(F.col(CORRUPT).isNotNull().alias("bad"), F.col("case_id").isNull().alias("empty")).count().where("bad").agg(
        F.coalesce(F.sum("count"), F.lit(0))
    ).first()[0]


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet log, or None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def append_log(records: DataFrame, path: str, batch: int) -> None:
    """Append one batch, partitioned by pipeline."""
    records.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("pipeline").parquet(path)


def write_log_copy(records: DataFrame, path: str) -> None:
    """Write a changed log to a new place; an existing one is never overwritten."""
    records.write.mode("errorifexists").partitionBy("pipeline").parquet(path)


def first_records(log: DataFrame) -> DataFrame:
    """One row per key, from the earliest batch.

    Two batches hold the same key only if two runs overlapped.
    """
    columns = [c for c in log.columns if c not in KEY]
    kept = log.groupBy(*KEY).agg(F.min_by(F.struct(*columns), "batch").alias("_row"))
    return kept.select(*KEY, "_row.*")


def completed(log: DataFrame) -> DataFrame:
    """Keys already in the log; only the key columns are read."""
    return log.select(*KEY).distinct()
