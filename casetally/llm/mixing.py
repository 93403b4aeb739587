"""Operator 7: mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words. Every document first gets the certain whole copies, the integer
part of target / size of the source. The words that are still missing are sampled: documents are ranked by
the odds of a uniform draw divided by the odds of their inclusion, which grow with their length, and the
first ones are taken until the words are filled: a sample of fixed size, counted in words, with unequal
probabilities. One closing document, the one whose length comes closest to what is missing, ends it.

No source is sorted as a whole. Ranks are mapped into (0, 1) and cut into bins; sums of bins show the bin
in which a source's sample ends, which is cut again; only the documents of that finest bin are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, MOST, BINS = (5, 2, 1), 3, 4096
WORD = r"[^\x20\x09-\x0D]+"


def _draw(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(part, n, source_size, target) for each source, from rows (part, size); part orders the sources.

    Weights repeat in the order of the sources. A target stops at ``most`` times the source's size, and the
    excess goes to the others by weight until none is above: sources are ordered by size over weight, and the
    common level is the largest at which those before it are full. One row a source is all that is ordered.
    """
    one = sizes.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("part")) - 1) % len(weights) + 1)
    one = one.withColumn("w", w).withColumn("room", F.col("source_size") * most)
    order = Window.orderBy(F.col("room") / F.col("w"), "part")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        one.withColumn("before", F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("room"))
        .withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("level", (F.col("all_words") - F.col("before")).cast("double") / F.col("left_w"))
        .withColumn("fits", F.when(F.col("level") <= F.col("room") / F.col("w"), F.col("level")))
        .withColumn("common", F.max("fits").over(every))
    )
    return filled.select(
        "part", "n", "source_size", F.least(F.col("room").cast("double"), F.col("w") * F.col("common")).alias("target")
    )


def _ends(rows: DataFrame, bin_: str, start: str) -> DataFrame:
    """(part, bin, words before it): the first bin of each source whose words go beyond the budget."""
    sums = rows.groupBy("part", bin_).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first(start).alias("start"))
    upto = F.col("start") + F.sum("words").over(Window.partitionBy("part").orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).where("upto > budget")
    first = F.min(F.struct(F.col(bin_), (F.col("upto") - F.col("words")).alias("before"))).alias("end")
    return over.groupBy("part").agg(first).select("part", F.col(f"end.{bin_}").alias(f"end_{bin_}"), F.col("end.before").alias(f"before_{bin_}"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 7,
    bins: int = BINS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row: how often the mix takes it.

    A null text has size 0 and is taken 0 times in words; a null source is a source of its own, the last one.
    A null key is a key like any other. Repeated rows share a draw and stay neighbours in rank; each is a row
    of its own, and equal ranks go by key, then size. Sources of size 0 have target 0. No rows give no rows.
    """
    part = F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source)))
    sizes = written(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            part.alias("part"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _draw(F.col(key), seed).alias("u"),
        ),
        "mix-sizes",
    )
    per_source = written(targets(sizes, weights, most), "mix-sources")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sizes.join(per_source, "part")
        .withColumn("whole", F.floor(share))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("frac", share - F.col("whole"))
    )
    odds = F.col("frac") / (1 - F.col("frac")) * (F.col("size") * F.col("n") / F.col("source_size"))
    rows = written(
        rows.withColumn("rank", F.when((F.col("frac") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) / odds))
        .withColumn("place", F.col("rank") / (1 + F.col("rank")))
        .withColumn("coarse", F.floor(F.col("place") * bins))
        .withColumn("fine", F.floor(F.col("place") * bins * bins))
        .withColumn("zero", F.lit(0).cast("long"))
        .select("doc_id", "source", "part", "size", "source_size", "target", "whole", "budget", "rank", "coarse", "fine", "zero"),
        "mix-ranks",
    )
    ranked = rows.where("rank is not null")
    coarse = _ends(ranked, "coarse", "zero")
    inside = ranked.join(coarse, "part").where("coarse = end_coarse")
    fine = _ends(inside, "fine", "before_coarse")
    ends = written(coarse.join(fine, "part"), "mix-ends")
    placed = rows.join(ends, "part", "left")
    edge = placed.where("fine = end_fine")
    upto = F.col("before_fine") + F.sum("size").over(
        Window.partitionBy("part").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    first = placed.where("rank is null or fine is null or not (fine <=> end_fine)").withColumn(
        "extra", F.coalesce((F.col("fine") < F.col("end_fine")).cast("int"), F.lit(0))
    )
    chosen = written(first.unionByName(edge.withColumn("extra", (upto <= F.col("budget")).cast("int"))), "mix-chosen")
    gap = chosen.where("rank is not null").groupBy("part").agg((F.first("budget") - F.sum(F.col("size") * F.col("extra"))).alias("gap"))
    gap = written(gap, "mix-gaps")  # one row a source: as a table, Spark knows that it is small
    closing = (
        chosen.where("rank is not null and extra = 0")
        .join(gap, "part")
        .where("size < 2 * gap")
        .groupBy("part")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", F.col("doc_id").alias("close_id"), F.col("size").alias("close_size"))).alias("c"))
        .select("part", F.lit(True).alias("closes"), "c.close_id", "c.close_size")
    )
    closing = written(closing, "mix-closing")
    marked = chosen.join(closing, "part", "left").withColumn(
        "closes",
        F.coalesce("closes", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("close_id")) & (F.col("size") == F.col("close_size")) & (F.col("extra") == 0) & F.col("rank").isNotNull(),
    )
    number = F.row_number().over(Window.partitionBy("part", "doc_id").orderBy("size"))
    closed = marked.where("closes").withColumn("extra", F.when(number == 1, 1).otherwise(0))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return marked.where("not closes").unionByName(closed).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows that share a key share the copies the mix gave them. Rows with a null key are one such group.
    """
    per_key = (
        mix(docs, key, text, source, **options)
        .groupBy(F.col("doc_id").alias("_key"))
        .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    )
    names = [f"c{i}" for i in range(len(docs.columns))]  # apart from all other names
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*names), *[c for c, t in zip(names, docs.dtypes) if t[1] in ("string", "bigint")]))
    joined = docs.toDF(*names).join(per_key, F.col(f"c{docs.columns.index(key)}").cast("long").eqNullSafe(F.col("_key")))
    times = F.floor(F.col("_copies") / F.col("_n")) + F.when(number <= F.col("_copies") % F.col("_n"), 1).otherwise(0)
    repeated = joined.withColumn("_times", times.cast("int")).where("_times > 0")
    return repeated.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*names).toDF(*docs.columns)
