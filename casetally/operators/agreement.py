"""Cited factors of a response against the top features of an explainer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions import sqltext
from casetally.schema import FEATURES


def feature_of_factor(factor: str) -> str:
    """SQL for the feature whose label a lower-case text contains; the longest label wins, of equal ones the first listed."""
    listed = sqltext.array(
        f"named_struct('size', {len(label)}, 'place', -{place}, 'feature', '{feature}', 'label', {sqltext.text(label.lower())})"
        for place, (feature, (label, _)) in enumerate(FEATURES.items())
    )
    return f"array_max(filter({listed}, l -> contains({factor}, l.label))).feature"


def map_factors(df: DataFrame, factors: str = "key_factors") -> DataFrame:
    """Add the set of cited features and the number of factors that name none.

    The label list is a constant, so this is a projection and not a join.
    """
    lowered = f"transform(coalesce({sqltext.name(factors)}, array()), f -> lower(f))"
    step = df.withColumn("_mapped", F.expr(f"transform({lowered}, f -> {feature_of_factor('f')})"))
    return step.withColumns(
        {
            "cited_features": F.expr("array_sort(array_distinct(array_compact(_mapped)))"),
            "n_factors": F.expr("size(_mapped)"),
            "n_unmapped": F.expr("size(_mapped) - size(array_compact(_mapped))"),
        }
    ).drop("_mapped")


def grounding_precision(cited: Column, reference: Column) -> Column:
    """Share of the cited features among the reference features; NULL if none is cited or no reference exists."""
    return F.size(F.array_intersect(cited, reference)) / F.nullif(F.size(cited), F.lit(0))


def top_features(long: DataFrame, by: Sequence[str], k: int = 5, feature: str = "feature", weight: str = "weight") -> DataFrame:
    """The k features of largest absolute weight per group, by name on a tie.

    Each task keeps its best k rows of a group before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.abs(F.col(weight)).desc(), F.col(feature))
    best = long.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", feature)))
    return best.groupBy(*by).agg(F.transform(ordered, lambda s: s[feature]).alias("top_features"))


def top_features_of_row(weights: dict[str, str], k: int = 5) -> Column:
    """The same from a wide row that holds all weights (SQL by feature): no shuffle at all."""
    items = sqltext.array(f"named_struct('w', -abs({w}), 'f', '{feature}')" for feature, w in weights.items())
    return F.expr(f"transform(slice(array_sort({items}), 1, {k}), s -> s.f)")


def reference_table(top: DataFrame, conditions: Sequence[tuple[str, str]], key: str = "case_id") -> DataFrame:
    """Top features with one column ``top_<method>_<model>`` per reference, one row per case."""
    columns = [
        F.max(F.when((F.col("method") == method) & (F.col("model") == model), F.col("top_features"))).alias(f"top_{method}_{model}")
        for method, model in conditions
    ]
    return top.groupBy(key).agg(*columns)


def with_precision(responses: DataFrame, references: DataFrame, conditions: Sequence[tuple[str, str]], key: str = "case_id") -> DataFrame:
    """Responses with one ``precision_<method>_<model>`` column per reference."""
    joined = responses.join(references, key, "left")
    names = {(m, model): f"{m}_{model}" for m, model in conditions}
    return joined.withColumns(
        {f"precision_{n}": grounding_precision(F.col("cited_features"), F.col(f"top_{n}")) for n in names.values()}
    ).drop(*[f"top_{n}" for n in names.values()])


def precision_summary(scored: DataFrame, conditions: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean precision and valid rows per reference."""
    names = [f"{m}_{model}" for m, model in conditions]
    one = scored.agg(
        *[F.avg(f"precision_{n}").alias(f"m_{n}") for n in names], *[F.count(f"precision_{n}").alias(f"n_{n}") for n in names]
    )
    rows = [F.struct(F.lit(n).alias("reference"), F.col(f"m_{n}").alias("mean_precision"), F.col(f"n_{n}").alias("n_valid")) for n in names]
    return one.select(F.inline(F.array(*rows)))


def precision_by_correctness(scored: DataFrame, conditions: Sequence[tuple[str, str]]) -> DataFrame:
    names = [f"precision_{m}_{model}" for m, model in conditions]
    return scored.groupBy("correct").agg(*[F.avg(n).alias(n) for n in names])


def unmapped_rate(mapped: DataFrame, warn_above: float = 0.1) -> DataFrame:
    rate = F.sum("n_unmapped") / F.greatest(F.sum("n_factors"), F.lit(1))
    return mapped.agg(
        F.sum("n_unmapped").alias("n_unmapped"), F.sum("n_factors").alias("n_factors"), rate.alias("unmapped_rate")
    ).withColumn("warning", F.col("unmapped_rate") > warn_above)


def lowest_precision(scored: DataFrame, conditions: Sequence[tuple[str, str]], n: int = 3, keys: Sequence[str] = ("case_id", "seed")) -> DataFrame:
    """The n responses with the lowest mean precision over the references they have."""
    names = [f"precision_{m}_{model}" for m, model in conditions]
    present = F.array_compact(F.array(*names))
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    kept = scored.na.drop("all", subset=names).withColumn("mean_precision", mean)
    return kept.orderBy("mean_precision", *keys).limit(n)


def explainer_overlap(top: DataFrame, methods: tuple[str, str], k: int = 5, key: str = "case_id") -> DataFrame:
    """Mean share of features that both explainers rank in their top k, per model."""
    a, b = (F.max(F.when(F.col("method") == m, F.col("top_features"))) for m in methods)
    paired = top.groupBy("model", key).agg(a.alias("_a"), b.alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    return paired.groupBy("model").agg(
        F.count("*").alias("n_cases"), F.avg(F.size(F.array_intersect("_a", "_b")) / F.lit(k)).alias("mean_overlap")
    )
