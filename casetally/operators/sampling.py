"""Splits, folds, samples and example picks by a hash of the row key.

The row key must be unique. Its digest is a seeded shuffle: rows sorted by it
are in random order, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions.draws import digest, uniform
from casetally.functions.numbers import round_tenth
from casetally.functions.profiles import LOW_UNCERTAINTY, MODERATE_UNCERTAINTY, ideal_response, profile_text
from casetally.schema import PERTURBATIONS, TARGET

# The first hex digits of a digest name its bucket: 65536 buckets per stratum.
BUCKET_DIGITS = 4


def stratum_sizes(df: DataFrame, stratum: str) -> dict:
    """Rows per stratum; a stratum is a class, so there are few."""
    return {row[stratum]: row["count"] for row in df.groupBy(stratum).count().collect()}


def digest_cuts(df: DataFrame, stratum: str, key: str, seed: int, ranks: dict) -> dict:
    """The digests at which a stratum, sorted by digest, is cut after the given ranks.

    Counting buckets finds the bucket that holds each rank; only those buckets,
    1/65536 of a stratum each, are sorted. The result is one digest per cut.
    """
    hashed = df.select(F.col(stratum).alias("_s"), digest(seed, key).alias("_d")).withColumn(
        "_b", F.substring("_d", 1, BUCKET_DIGITS)
    )
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = [(s, r) for s, rs in ranks.items() for r in rs if r > 0]
    if not wanted:
        return {s: [None for _ in rs] for s, rs in ranks.items()}
    holds = reduce(
        lambda a, b: a | b,
        [F.col("_s").eqNullSafe(F.lit(s)) & (F.col("start") < r) & (F.col("start") + F.col("n") >= r) for s, r in wanted],
    )
    # At most one bucket for every cut that was asked for.
    found = counts.where(holds).select("_s", "_b", "start").collect()
    bucket = reduce(
        lambda a, b: a | b, [F.col("_s").eqNullSafe(F.lit(r["_s"])) & (F.col("_b") == r["_b"]) for r in found]
    )
    start = reduce(
        lambda acc, r: acc.when(F.col("_s").eqNullSafe(F.lit(r["_s"])) & (F.col("_b") == r["_b"]), F.lit(r["start"])),
        found,
        F.when(F.lit(False), F.lit(0)),
    )
    order = Window.partitionBy("_s", "_b").orderBy("_d")
    ranked = hashed.where(bucket).withColumn("_rank", start + F.row_number().over(order))
    at = ranked.where(
        reduce(lambda a, b: a | b, [F.col("_s").eqNullSafe(F.lit(s)) & (F.col("_rank") == r) for s, r in wanted])
    ).collect()
    digests = {(r["_s"], r["_rank"]): r["_d"] for r in at}
    return {s: [digests.get((s, r)) for r in rs] for s, rs in ranks.items()}


def _part_of(stratum: str, key: str, seed: int, cuts: dict, parts: Sequence) -> Column:
    """Name of the part a row falls into; a pure projection."""
    value = digest(seed, key)
    result = F.when(F.lit(False), F.lit(parts[-1]))
    for s, edges in cuts.items():
        for edge, part in zip(edges, parts):
            if edge is not None:
                result = result.when(F.col(stratum).eqNullSafe(F.lit(s)) & (value <= edge), F.lit(part))
    return result.otherwise(F.lit(parts[-1]))


def allocate(total: int, sizes: dict) -> dict:
    """Share ``total`` over strata in proportion to size, largest remainders first."""
    n = sum(sizes.values())
    exact = {s: total * size / n for s, size in sizes.items()}
    shares = {s: int(x) for s, x in exact.items()}
    order = sorted(sizes, key=lambda s: (-(exact[s] - shares[s]), str(s)))
    for s in order[: total - sum(shares.values())]:
        shares[s] += 1
    return shares


def stratified_split(
    df: DataFrame, target: str = TARGET, key: str = "case_id", test_size: float = 0.15, val_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split`` (test, val, train) with exact sizes overall and per class.

    The split itself moves no rows: after two counting passes it is a
    comparison of digests.
    """
    # Key and class are read once for both counting passes.
    keyed = df.select(target, key).persist()
    sizes = stratum_sizes(keyed, target)
    n = sum(sizes.values())
    n_test = math.ceil(n * test_size)
    test = allocate(n_test, sizes)
    rest = {s: sizes[s] - test[s] for s in sizes}
    val = allocate(math.ceil((n - n_test) * (val_size / (1 - test_size))), rest)
    ranks = {s: [test[s], test[s] + val[s]] for s in sizes}
    cuts = digest_cuts(keyed, target, key, seed, ranks)
    keyed.unpersist()
    return df.withColumn("split", _part_of(target, key, seed, cuts, ["test", "val", "train"]))


def stratified_folds(df: DataFrame, target: str = TARGET, key: str = "case_id", k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1); fold sizes per class differ by at most one."""
    keyed = df.select(target, key).persist()
    sizes = stratum_sizes(keyed, target)
    ranks = {s: [size * (i + 1) // k for i in range(k - 1)] for s, size in sizes.items()}
    cuts = digest_cuts(keyed, target, key, seed, ranks)
    keyed.unpersist()
    return df.withColumn("fold", _part_of(target, key, seed, cuts, list(range(k))))


def shuffled(df: DataFrame, key: str = "case_id", seed: int = 42) -> DataFrame:
    """All rows in a seeded random order."""
    return df.orderBy(digest(seed, key), key)


def sample_rows(df: DataFrame, n: int, key: str = "case_id", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen at random; each task keeps its own best n."""
    return shuffled(df, key, seed).limit(n)


def select_subset(
    df: DataFrame, score: str, n_per_class: int = 50, target: str = TARGET, key: str = "case_id", seed: int = 42
) -> DataFrame:
    """Per class the clearest and the most borderline rows, shuffled and numbered ``case_0000``...

    A class with fewer rows than asked for is taken whole, each row once. The
    original key is kept as ``original_<key>``.
    """
    scored = df.withColumn("_clear", F.abs(F.col(score) - 0.5))
    half = n_per_class // 2

    def top(order: Column, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(target).orderBy(order, F.col(key)))
        return scored.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    clear = top(F.col("_clear").desc(), half)
    borderline = top(F.col("_clear").asc(), n_per_class - half)
    # From here on there are at most n_per_class rows per class.
    chosen = clear.unionByName(borderline).dropDuplicates([key]).drop("_clear")
    number = F.row_number().over(Window.orderBy(digest(seed, key), F.col(key))) - 1
    return chosen.select(
        F.format_string("case_%04d", number).alias("case_id"),
        F.col(key).alias(f"original_{key}"),
        *[c for c in chosen.columns if c not in (key, "case_id")],
    )


def worked_examples(
    df: DataFrame, score: str, indicators: Sequence[str], target: str = TARGET, key: str = "case_id"
) -> DataFrame:
    """The clearest Good row, the clearest Bad row and the row nearest 0.5, each with its ideal response."""
    row = F.struct(*df.columns)
    p, y = F.col(score), F.col(target)
    picks = df.agg(
        F.min_by(F.when(y == 0, row), F.when(y == 0, F.struct(p, F.col(key)))).alias("good"),
        F.min_by(F.when(y == 1, row), F.when(y == 1, F.struct(-p, F.col(key)))).alias("bad"),
        F.min_by(row, F.struct(F.abs(p - 0.5), F.col(key))).alias("borderline"),
    )
    rows = picks.select(F.stack(F.lit(3), F.lit("good"), "good", F.lit("bad"), "bad", F.lit("borderline"), "borderline").alias("example", "row"))
    rows = rows.where(F.col("row").isNotNull()).select("example", "row.*")
    edge = F.col("example") == "borderline"
    label = F.when(y == 1, F.lit("Bad")).otherwise(F.lit("Good"))
    confidence = F.when(edge, F.rint(F.greatest(p, 1.0 - p) * 100.0)).otherwise(F.lit(90.0))
    reason = F.when(edge, F.lit(MODERATE_UNCERTAINTY)).otherwise(F.lit(LOW_UNCERTAINTY))
    return rows.select(
        "example",
        key,
        profile_text(indicators).alias("profile_text"),
        ideal_response(indicators, label, confidence, reason).alias("ideal_response"),
    )


def perturb(df: DataFrame, magnitudes: dict[str, float] = PERTURBATIONS, key: str = "case_id", seed: int = 42) -> DataFrame:
    """Shift each perturbable value by a uniform draw; missing values stay missing."""
    missing = [f for f in magnitudes if f not in df.columns]
    if missing:
        raise ValueError(f"perturbable features not in the table: {missing}")

    def moved(name: str, magnitude: float) -> Column:
        value = F.col(name) + (uniform(seed, key, F.lit(name)) * (2.0 * magnitude) - float(magnitude))
        if "Percent" in name or "Fraction" in name:
            value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
        elif name == "ExternalRiskEstimate":
            value = F.greatest(F.lit(0.0), value)
        # greatest and least skip NULLs, so a missing value has to be kept explicitly.
        return F.when(F.col(name).isNotNull() & ~F.isnan(name), value)

    # Two steps, so that each draw is computed once.
    shifted = df.withColumns({name: moved(name, m) for name, m in magnitudes.items()})
    return shifted.withColumns({name: round_tenth(name) for name in magnitudes})
