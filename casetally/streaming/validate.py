"""Validation of responses as they arrive.

Validation has no state, so the batch operator runs on a stream unchanged. Without an event time the sink appends
only keys the log lacks. With one, the stream itself remembers the keys of the last while, and each micro-batch is
a folder of the log that a repeated micro-batch writes anew: what a batch costs does not hang on the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from casetally.operators.validate import PARSERS
from casetally.sources import runlog


def append_new(path: str):
    """A micro-batch sink that skips keys already in the log."""

    def sink(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(runlog.KEY)
        log = runlog.read_log(batch.sparkSession, path)
        if log is not None:
            fresh = fresh.join(log.select(*runlog.KEY), runlog.KEY, "left_anti")
        runlog.append_log(fresh, path, number)

    return sink


def write_batch(path: str):
    """A micro-batch sink with a folder for each batch; a batch that runs again replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("pipeline").parquet(f"{path}/batch={number}")

    return sink


def validate_stream(
    responses: DataFrame,
    pipeline: str,
    path: str,
    checkpoint: str,
    row_columns: Sequence[str] | None = None,
    event_time: str | None = None,
    delay: str = "1 hour",
    **options,
) -> StreamingQuery:
    """Validate a stream of raw responses and append them to the log until the source is drained.

    With ``event_time`` a key counts once within ``delay`` of its first response, and its state goes when the
    watermark has passed; a key that comes again later is a row again, for ``runlog.first_records`` to settle.
    """
    parse = PARSERS[pipeline]
    if event_time is None:
        parsed, sink = parse(responses, "raw_response", row_columns=row_columns, **options), append_new(path)
    else:
        once = responses.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(runlog.KEY)
        parsed, sink = parse(once, "raw_response", row_columns=row_columns, **options), write_batch(path)
    return parsed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
