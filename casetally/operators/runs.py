"""Planning, resuming and running repeated generations over a case table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.functions.profiles import PROFILES
from casetally.functions.prompts import PROMPTS
from casetally.operators.validate import PARSERS
from casetally.schema import TableMetadata
from casetally.sources import runlog

# Given once per task, returns generate(user_prompt, seed, system_prompt, max_new_tokens) -> str. What it returns may
# have a method ``many`` instead, which takes lists of prompts and seeds and returns a list: one call a batch.
GeneratorFactory = Callable[[], Callable[[str, int, str, int], str]]
# Adds the parsed fields to a table of responses: parser(df, raw, row_columns=..) -> df, as those of validate.PARSERS.
Parser = Callable[..., DataFrame]


def plan_runs(cases: DataFrame, pipelines: Sequence[str], n_repeats: int, key: str = "case_id") -> DataFrame:
    """Every (pipeline, case, seed) that a full run has."""
    names = F.array(*[F.lit(p) for p in pipelines])
    seeds = F.sequence(F.lit(0), F.lit(n_repeats - 1))
    return cases.withColumn("pipeline", F.explode(names)).withColumn("seed", F.explode(seeds))


def remaining(planned: DataFrame, log: DataFrame | None, key: str = "case_id") -> DataFrame:
    """Planned runs that the log does not hold yet."""
    if log is None:
        return planned
    return planned.join(log.select("pipeline", key, "seed"), ["pipeline", key, "seed"], "left_anti")


def progress(planned: DataFrame, log: DataFrame | None, key: str = "case_id") -> DataFrame:
    """Planned, done and open runs per pipeline."""
    left = remaining(planned, log, key).groupBy("pipeline").agg(F.count("*").alias("n_open"))
    total = planned.groupBy("pipeline").agg(F.count("*").alias("n_planned"))
    return total.join(left, "pipeline", "left").select(
        "pipeline",
        "n_planned",
        (F.col("n_planned") - F.coalesce("n_open", F.lit(0))).alias("n_done"),
        F.coalesce("n_open", F.lit(0)).alias("n_open"),
    )


def generate(
    requests: DataFrame, factory: GeneratorFactory, system_prompt: str, max_new_tokens: int, prompt: str = "user_prompt"
) -> DataFrame:
    """Add ``raw_response`` and ``elapsed_seconds``; the only step that runs in Python."""
    columns = [c for c in requests.columns if c != prompt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for batch in batches:
            texts, seconds = [], []
            if hasattr(call, "many"):
                start = time.perf_counter()
                texts = call.many(list(batch[prompt]), [int(s) for s in batch["seed"]], system_prompt, max_new_tokens)
                each = (time.perf_counter() - start) / max(len(texts), 1)
                yield batch[columns].assign(raw_response=texts, elapsed_seconds=each)
                continue
            for text, seed in zip(batch[prompt], batch["seed"]):
                start = time.perf_counter()
                texts.append(call(text, int(seed), system_prompt, max_new_tokens))
                seconds.append(time.perf_counter() - start)
            yield batch[columns].assign(raw_response=texts, elapsed_seconds=seconds)

    schema = T.StructType(
        [requests.schema[c] for c in columns]
        + [T.StructField("raw_response", T.StringType()), T.StructField("elapsed_seconds", T.DoubleType())]
    )
    return requests.mapInPandas(run, schema)


def responses_for(
    open_runs: DataFrame,
    metadata: TableMetadata,
    pipeline: str,
    factory: GeneratorFactory,
    max_new_tokens: int = 400,
    profile: str | Callable[..., Column] = "standard",
    examples: Sequence[dict] = (),
    tasks: int | None = None,
    parser: Parser | None = None,
) -> DataFrame:
    """Render, generate and validate the open runs of one pipeline, with its own parser or another one.

    Rendering and validation are columns around the one Python step, and no
    shuffle follows it: a lost task repeats its own rows only.
    """
    build = PROFILES[profile] if isinstance(profile, str) else profile
    system_prompt, user_prompt = PROMPTS[pipeline](build(metadata.indicators), examples)
    keep = ["case_id", "seed", metadata.target, *metadata.features]
    requests = open_runs.where(F.col("pipeline") == pipeline).select(*keep, user_prompt.alias("user_prompt"))
    # Generation costs far more than moving a prompt; spread it evenly.
    requests = requests.repartition(*([tasks] if tasks else []), "case_id", "seed")
    answered = generate(requests, factory, system_prompt, max_new_tokens)
    parsed = (parser or PARSERS[pipeline])(answered, "raw_response", row_columns=metadata.features)
    return parsed.withColumn("pipeline", F.lit(pipeline)).withColumnRenamed(metadata.target, "true_label").drop(*metadata.features)


def run_pipeline(
    cases: DataFrame,
    metadata: TableMetadata,
    pipeline: str,
    factory: GeneratorFactory,
    path: str,
    batch: int,
    n_repeats: int = 5,
    parts: int = 8,
    **options,
) -> int:
    """Run what the log lacks and append it; returns the number of new responses.

    Open runs are dealt by hash into ``parts``, each appended to the log when it is done. A failure so loses
    the part that runs at most; started again, it goes on where the log ends.
    """
    spark = cases.sparkSession
    log = runlog.read_log(spark, path)
    open_runs = remaining(plan_runs(cases, [pipeline], n_repeats), log)

    def count() -> int:
        """Responses of this pipeline in this batch."""
        written = runlog.read_log(spark, path)
        return 0 if written is None else written.where((F.col("pipeline") == pipeline) & (F.col("batch") == batch)).count()

    before = count()
    for part in range(parts):
        own = open_runs.where(F.pmod(F.xxhash64("case_id", "seed"), F.lit(parts)) == part)
        runlog.append_log(responses_for(own, metadata, pipeline, factory, **options), path, batch)
    return count() - before
