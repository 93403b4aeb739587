"""Cleaning and inspection of a raw applicant table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.functions.sqltext import array, name, text
from casetally.schema import LABELS, POSITIVE_LABEL, RAW_COLUMNS, SPECIAL_CODES, TARGET, TableMetadata, indicator_name
from casetally.sources.kept import figures, kept


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, or an error that names the missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def rename_columns(df: DataFrame, names: dict[str, str] = RAW_COLUMNS) -> DataFrame:
    return require_columns(df, list(names)).withColumnsRenamed(names)


def drop_identifier_columns(df: DataFrame) -> DataFrame:
    """Drop columns that only number the rows."""
    return df.drop(*[c for c in df.columns if "unnamed" in c.lower() or "index" in c.lower() or c.lower() == "id"])


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN becomes NULL, so that comparisons and aggregates skip it."""
    floats = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.selectExpr(*[f"nullif({name(c)}, double('NaN')) AS {name(c)}" if c in floats else name(c) for c in df.columns])


def drop_unusable_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Keep a row if any feature is above -9."""
    values = array(f"nullif(cast({name(c)} AS double), double('NaN'))" for c in features)
    return df.where(f"array_max({values}) > -9")


def code_masks(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Aggregates that tell which codes occur: one bit mask per feature."""
    cases = " ".join(f"WHEN {code} THEN {1 << i}" for i, code in enumerate(SPECIAL_CODES))
    return {f"codes_{i}": F.expr(f"coalesce(bit_or(CASE {name(c)} {cases} ELSE 0 END), 0)") for i, c in enumerate(numeric_columns(df, features))}


def pairs_from(masks: dict, columns: Sequence[str]) -> list[tuple[str, int]]:
    """(feature, code) pairs of the masks' bits."""
    return [(c, code) for i, c in enumerate(columns) for bit, code in enumerate(SPECIAL_CODES) if masks[f"codes_{i}"] & (1 << bit)]


def live_sentinels(df: DataFrame, features: Sequence[str]) -> list[tuple[str, int]]:
    """(feature, code) pairs that occur at least once: one aggregate row with a bit mask per feature."""
    return pairs_from(figures(df, code_masks(df, features)), numeric_columns(df, features))


def encode_sentinels(
    df: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, int]] | None = None
) -> tuple[DataFrame, list[str]]:
    """Sentinel codes become NULL plus a 0/1 indicator for each pair that occurs in the table.

    Pass ``pairs`` to encode another table (or a stream) the same way without a pass over it.
    """
    pairs = live_sentinels(df, features) if pairs is None else list(pairs)
    numeric = set(numeric_columns(df, features))
    codes = ", ".join(map(str, SPECIAL_CODES))
    indicators = [f"CASE WHEN {name(c)} = {code} THEN 1 ELSE 0 END AS {name(indicator_name(c, code))}" for c, code in pairs]
    values = [
        f"CASE WHEN {name(c)} NOT IN ({codes}) THEN {name(c)} END AS {name(c)}" if c in numeric else name(c) for c in df.columns
    ]
    return df.selectExpr(*values, *indicators), [indicator_name(c, code) for c, code in pairs]


def encode_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Good/Bad becomes 0/1; a 0/1 target stays; any other value fails the job."""
    y = F.col(target)
    wrong = F.raise_error(F.concat(F.lit(f"unexpected value in {target}: "), F.coalesce(y.cast("string"), F.lit("NULL"))))
    if isinstance(df.schema[target].dataType, T.NumericType):
        code = F.when(y.isNull() | y.isin(0, 1), y.cast("int")).otherwise(wrong.cast("int"))
    else:
        code = F.when(y.isin(*LABELS), (y == POSITIVE_LABEL).cast("int")).otherwise(wrong.cast("int"))
    return df.withColumn(target, code)


def special_code_counts(df: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent (feature, code) pairs.

    All pairs are counted in one aggregate row, which is then turned into rows.
    """
    pairs = [(c, code) for c in numeric_columns(df, features) for code in SPECIAL_CODES]
    one = df.agg(*[F.expr(f"count_if({name(c)} = {code}) AS n{i}") for i, (c, code) in enumerate(pairs)])
    items = F.expr(
        array(
            f"named_struct('feature', {text(c)}, 'code', {code}, 'meaning', '{SPECIAL_CODES[code]}', 'n_rows', n{i})"
            for i, (c, code) in enumerate(pairs)
        )
    )
    rows = one.select(F.inline(items)).where("n_rows > 0")
    return rows.orderBy(F.desc("n_rows"), "feature", "code").limit(n)


def target_polarity(df: DataFrame, estimate: str = "ExternalRiskEstimate", target: str = TARGET) -> DataFrame:
    """Mean risk estimate by target, and whether Bad has the higher one (then the labels are likely swapped)."""
    y = F.col(target)
    means = df.where(F.col(estimate) >= 0).agg(
        F.avg(F.when(y == 0, F.col(estimate))).alias("mean_good"), F.avg(F.when(y == 1, F.col(estimate))).alias("mean_bad")
    )
    return means.withColumn("swapped", F.coalesce(F.col("mean_bad") > F.col("mean_good"), F.lit(False)))


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), keep_null: bool = True) -> DataFrame:
    """Rows per value and their share, within ``by`` if given; only counted values meet in a window."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*by)))


def inspect_table(df: DataFrame, features: Sequence[str], target: str = TARGET) -> dict[str, DataFrame]:
    """Target distribution and special codes, next to the shape that the schema tells."""
    return {
        "target": value_counts(df, target),
        "special_codes": special_code_counts(df, features),
        "types": df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes if c in set(features)], "feature string, type string")
        .groupBy("type").count(),
    }


def sentinel_flags(df: DataFrame, indicators: Sequence[str], column: str = "n_sentinel_flags") -> DataFrame:
    """Number of fired indicators per row."""
    return df.withColumn(column, F.expr(" + ".join(["0", *[f"coalesce({name(c)}, 0)" for c in indicators]])))


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def split_summary(df: DataFrame, target: str = TARGET, split: str = "split") -> DataFrame:
    """Rows and share of each class within each split."""
    return value_counts(df, target, by=[split])


SPLITS = ("train", "val", "test")


def class_counts(target: str = TARGET, split: str = "split") -> dict[str, Column]:
    """Aggregates with the rows of each class in each split."""
    return {f"n_{s}_{y}": F.count_if((F.col(split) == s) & (F.col(target) == y)) for s in SPLITS for y in (0, 1)}


def metadata_from(counts: dict, features: Sequence[str], indicators: Sequence[str], target: str = TARGET, seed: int = 42) -> TableMetadata:
    """Metadata of a prepared and split table from its class counts; splits and classes without rows are left out."""
    sizes = {s: n for s in SPLITS if (n := counts[f"n_{s}_0"] + counts[f"n_{s}_1"])}
    balance = {s: {str(y): counts[f"n_{s}_{y}"] / n for y in (0, 1) if counts[f"n_{s}_{y}"]} for s, n in sizes.items()}
    return TableMetadata(target, POSITIVE_LABEL, list(features), list(indicators), seed, dict(SPECIAL_CODES), sizes, balance)


def build_metadata(
    df: DataFrame, features: Sequence[str], indicators: Sequence[str], target: str = TARGET, seed: int = 42
) -> TableMetadata:
    """Metadata of a prepared and split table, from one pass over it."""
    return metadata_from(figures(df, class_counts(target)), features, indicators, target, seed)


def usable_rows(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows that carry information, written once, and the (feature, code) pairs that occur in them."""
    table = drop_unusable_rows(nan_to_null(df, features), features)
    table = kept(table, "usable")
    return table, pairs_from(figures(table, code_masks(table, features)), numeric_columns(table, features))


def prepare(df: DataFrame, target: str = TARGET, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Raw table to prepared table: identifiers off, unusable rows off, target and sentinels encoded.

    The source is read once: its usable rows are written to the shared folder, where the codes that occur are
    looked up. ``keys`` are carried along and are no features.
    """
    table = drop_identifier_columns(require_columns(df, [target, *keys]))
    features = [c for c in table.columns if c != target and c not in keys]
    table, pairs = usable_rows(table, features)
    table, indicators = encode_sentinels(encode_target(table, target), features, pairs)
    return table, features, indicators
