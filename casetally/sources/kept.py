"""Tables written once to the shared folder, for work that reads them many times.

Figures of such a table are taken from what was written, a scan of the columns they need, and not from its
source. Observed metrics would save that scan, but after the first of them a session can no longer send the
functions of a fitted Spark ML model to its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from casetally.session import shared_folder


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written once to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def figures(df: DataFrame, wanted: dict[str, Column]) -> dict:
    """Aggregates over all rows, as a dictionary."""
    return df.agg(*[c.alias(n) for n, c in wanted.items()]).first().asDict() if wanted else {}
