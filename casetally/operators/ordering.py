"""Exact order statistics without sorting a whole group in one task.

Equal values are counted together first, so hot values cost one row. The value
axis is then cut into fixed narrow ranges, and each of them again; a running
total is the total of the ranges before, plus that of the parts before inside
the own range, plus the running total inside the own part. Only totals of
ranges, or of the parts of one range, meet in one task, and their number is
limited by the cut and not by the data. Crowded values, such as scores close to
1, spread over the parts of their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions.sqltext import name

# Ranges between a power of two and the next, and parts of a range. A part so
# holds values that agree to one part in 16 million.
RANGES = 4096
PARTS = 4096


def range_number(value: str, ranges: int = RANGES) -> str:
    """SQL for a whole number that never falls as the value rises.

    It depends on the value alone, so every task and every retry cuts alike.
    """
    size = f"abs({value})"
    octave = f"floor(log2({size}))"
    step = f"((1100 + {octave}) * {2 * ranges}L + floor({size} / pow(2D, {octave}) * {ranges}))"
    return f"coalesce(CASE WHEN {value} = 0D THEN 0L ELSE cast(sign({value}) AS bigint) * {step} END, -9000000000000000000L)"


def part_number(value: str, ranges: int = RANGES, parts: int = PARTS) -> str:
    """SQL for the place within a range: the digits of the value that follow those of the range."""
    place = f"(abs({value}) / pow(2D, floor(log2(abs({value})))) * {ranges})"
    return f"coalesce(CASE WHEN {value} = 0D THEN 0L ELSE cast(sign({value}) AS bigint) * floor(({place} - floor({place})) * {parts}) END, 0L)"


def running_totals(counted: DataFrame, by: Sequence[str], value: str, totals: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Running and overall sums of ``totals`` in rising order of ``value`` within ``by``.

    ``counted`` has one row per (by, value), with finite values. Adds
    ``cum_<name>`` (up to and including the row) and ``all_<name>`` (over the group).
    """
    by = list(by)
    v = name(value)
    cut = counted.withColumns({"_range": F.expr(range_number(v, ranges)), "_part": F.expr(part_number(v, ranges))})
    group, own = Window.partitionBy(*by), Window.partitionBy(*by, "_range")
    earlier = (Window.unboundedPreceding, -1)
    parts = cut.groupBy(*by, "_range", "_part").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
    sums = parts.groupBy(*by, "_range").agg(*[F.sum(f"_{t}").alias(f"_{t}") for t in totals])

    def apart(*columns: str) -> list:
        return [F.col(c).alias(f"_by_{c}") for c in by] + [F.col(c).alias(f"_at{c}") for c in columns]

    def same(*columns: str) -> list:
        return [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col(c) == F.col(f"_at{c}") for c in columns]

    before_range = sums.select(
        *apart("_range"),
        *[F.coalesce(F.sum(f"_{t}").over(group.orderBy("_range").rowsBetween(*earlier)), F.lit(0)).alias(f"_start_{t}") for t in totals],
        *[F.sum(f"_{t}").over(group).alias(f"all_{t}") for t in totals],
    )
    before_part = parts.withColumns(
        {f"_inner_{t}": F.coalesce(F.sum(f"_{t}").over(own.orderBy("_part").rowsBetween(*earlier)), F.lit(0)) for t in totals}
    )
    starts = before_part.join(before_range, same("_range")).select(
        *apart("_range", "_part"),
        *[(F.col(f"_start_{t}") + F.col(f"_inner_{t}")).alias(f"_start_{t}") for t in totals],
        *[f"all_{t}" for t in totals],
    )
    inside = Window.partitionBy(*by, "_range", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(starts, same("_range", "_part"))
        .withColumns({f"cum_{t}": F.col(f"_start_{t}") + F.sum(t).over(inside) for t in totals})
        .select(*counted.columns, *[f"{p}_{t}" for p in ("cum", "all") for t in totals])
    )


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float] | None = None, ranges: int = RANGES) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles of a column per group.

    Quantiles interpolate linearly. Everything comes from the counts per
    distinct value, so the source is read once.
    """
    quantiles = QUARTILES if quantiles is None else quantiles
    by = list(by)
    v = F.when(~F.isnan(value), F.col(value).cast("double")).alias("_v")
    # A group without any value keeps its one NULL row of weight 0.
    counted = df.select(*by, v).groupBy(*by, "_v").agg(F.count("_v").alias("n")).withColumn("nv", F.col("n") * F.coalesce("_v", F.lit(0.0)))
    ranked = running_totals(counted, by, "_v", ["n", "nv"], ranges)
    at = {q: f"{float(p)!r}D * (all_n - 1)" for q, p in quantiles.items()}
    found = ranked.groupBy(*by).agg(
        F.expr("max(all_n) AS count"),
        F.expr("max(all_nv / nullif(all_n, 0)) AS mean"),
        F.expr("sqrt(sum(n * pow(_v - all_nv / nullif(all_n, 0), 2)) / nullif(max(all_n) - 1, 0)) AS std"),
        F.expr("min(_v) AS min"),
        F.expr("max(_v) AS max"),
        *[F.expr(f"min(CASE WHEN cum_n > floor({a}) THEN _v END) AS _low_{q}") for q, a in at.items()],
        *[F.expr(f"min(CASE WHEN cum_n > ceil({a}) THEN _v END) AS _high_{q}") for q, a in at.items()],
        *[F.expr(f"max({a} - floor({a})) AS _part_{q}") for q, a in at.items()],
    )
    between = [F.expr(f"_low_{q} + (_high_{q} - _low_{q}) * _part_{q} AS {q}") for q in quantiles]
    return found.select(*by, "count", "mean", F.when(F.col("count") > 1, F.col("std")).alias("std"), "min", *between, "max")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name."""
    return describe(df, by, value, quantiles, ranges).select(*by, *quantiles)
