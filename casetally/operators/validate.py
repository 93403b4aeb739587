"""Validation of a response log, stored or fresh.

All checks are projections: a log is validated in the stage that reads it,
without a shuffle and without leaving the JVM. Intermediate values are columns
of their own so that each is computed once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.functions import responses as R
from casetally.functions.numbers import extract_numbers
from casetally.functions.sqltext import name
from casetally.schema import vocabulary_numbers

PARSED = [
    "label", "confidence", "key_factors", "explanation", "uncertainty_reason",
    "is_valid_json", "label_valid", "confidence_valid", "explanation_grounded",
    "no_contradiction", "ungrounded_numbers", "parse_success",
]


def parse_structured(
    df: DataFrame,
    raw: str = "raw_response",
    row_columns: Sequence[str] | None = None,
    vocabulary: Sequence[float] | None = None,
    whole_words: bool = False,
) -> DataFrame:
    """Add the parsed fields and checks of a JSON response, replacing older ones.

    ``row_columns`` are the case's values that numbers in the response are
    checked against; without them the grounding check stays open (NULL).
    Objects whose factors or explanation have an unusable type are not valid.
    """
    keep = [c for c in df.columns if c not in PARSED]
    values = F.lit(None).cast("array<double>") if row_columns is None else R.row_numbers(row_columns)
    return _judged(_read(df.withColumn("_values", values), raw, whole_words), keep, vocabulary)


def _read(df: DataFrame, raw: str, whole_words: bool = False) -> DataFrame:
    """Fields and checks that take the response alone, with what the other checks need of it."""
    col = F.col
    step = df.withColumn("_clean", R.strip_fences(col(raw)))
    step = step.withColumn("_wrapped", R.wrap_object(col("_clean")))
    step = step.withColumn("_doc", R.sole_object(col("_wrapped"), col("_clean")))
    doc = col("_doc")
    expr = F.expr
    kinds = {"_label_type": "label", "_confidence_type": "confidence", "_factor_type": "key_factors", "_explanation_type": "explanation"}
    step = step.withColumns(
        {column: R.json_type(doc, f"$.{member}") for column, member in kinds.items()}
        | {"_items": expr("try_variant_get(_doc, '$.key_factors', 'array<variant>')")}
    )
    step = step.withColumns(
        {
            "label": F.when(col("_label_type") == "STRING", R.normal_label(expr("try_variant_get(_doc, '$.label', 'string')"))),
            # A JSON boolean counts as the number 0 or 1, a quoted number does not count.
            "_stated": expr(
                "CASE WHEN _confidence_type IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith(_confidence_type, 'DECIMAL') "
                "THEN try_variant_get(_doc, '$.confidence', 'double') "
                "WHEN _confidence_type = 'BOOLEAN' THEN cast(try_variant_get(_doc, '$.confidence', 'boolean') AS double) END"
            ),
            # A bare string is a sequence of characters, as for any consumer that iterates it.
            "key_factors": expr(
                "CASE WHEN startswith(_factor_type, 'ARRAY') THEN transform(_items, v -> try_variant_get(v, '$', 'string')) "
                "WHEN _factor_type = 'STRING' THEN split(try_variant_get(_doc, '$.key_factors', 'string'), '') END"
            ),
            "_usable": expr(
                "_explanation_type IN ('VOID', 'STRING') AND (_factor_type IN ('VOID', 'STRING') OR (startswith(_factor_type, 'ARRAY') "
                "AND forall(_items, v -> coalesce(schema_of_variant(v), 'VOID') = 'STRING')))"
            ),
            "explanation": expr("CASE WHEN _explanation_type = 'STRING' THEN try_variant_get(_doc, '$.explanation', 'string') END"),
            "uncertainty_reason": expr("try_variant_get(_doc, '$.uncertainty_reason', 'string')"),
            "is_valid_json": expr("_doc IS NOT NULL"),
        }
    )
    text = F.concat_ws(" ", F.array_join("key_factors", " "), F.coalesce("explanation", F.lit("")))
    step = step.withColumns(
        {
            "confidence": expr("CASE WHEN _stated BETWEEN 0 AND 100 THEN _stated END"),
            "_numbers": F.when(expr("is_valid_json AND _usable"), extract_numbers(text)),
            "no_contradiction": F.when(expr("label IS NOT NULL"), ~R.contradicts(col("label"), col("explanation"), whole_words)),
        }
    )
    sound = "is_valid_json AND _usable AND label IS NOT NULL AND confidence IS NOT NULL AND explanation IS NOT NULL AND coalesce(no_contradiction, true)"
    return step.withColumn("_sound", expr(f"coalesce({sound}, false)"))


def _judged(read: DataFrame, keep: Sequence[str], vocabulary: Sequence[float] | None) -> DataFrame:
    """``keep`` and the results of responses that were read, checked against the ``_values`` of their case."""
    vocabulary = vocabulary_numbers() if vocabulary is None else vocabulary
    expr = F.expr
    step = read.withColumn("_quoted", expr("CASE WHEN _values IS NOT NULL THEN _numbers END"))
    step = step.withColumn("ungrounded_numbers", R.ungrounded("_quoted", "_stated", "_values", vocabulary))
    step = step.withColumns(
        {
            "label_valid": expr("label IS NOT NULL"),
            "confidence_valid": expr("confidence IS NOT NULL"),
            "explanation_grounded": expr("CASE WHEN ungrounded_numbers IS NOT NULL THEN size(ungrounded_numbers) = 0 END"),
        }
    )
    return _parsed_once(step.withColumn("parse_success", expr("_sound AND coalesce(explanation_grounded, true)")), keep, PARSED)


def _parsed_once(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Select the results through a generator of one row.

    A filter on a check would otherwise be pushed down to the scan, where it
    repeats the whole parse; a filter on generated columns stays above.
    """
    row = f"inline(array(named_struct({', '.join(f"'{f}', {name(f)}" for f in fields)})))"
    return df.selectExpr(*map(name, keep), row)


def parse_stock(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add label, confidence, explanation and success of a free-text response."""
    keep = [c for c in df.columns if c not in PARSED]
    found = df.select(
        *keep,
        R.stock_label(F.col(raw)).alias("label"),
        R.stock_number(F.col(raw)).alias("_stated"),
        R.stock_explanation(F.col(raw)).alias("explanation"),
    )
    checked = found.withColumn("confidence", F.expr("CASE WHEN _stated BETWEEN 0 AND 100 THEN _stated END"))
    checked = checked.withColumn("parse_success", F.expr("label IS NOT NULL AND confidence IS NOT NULL AND explanation IS NOT NULL"))
    return _parsed_once(checked, keep, ["label", "confidence", "explanation", "parse_success"])


PARSERS = {"structured": parse_structured, "stock": lambda df, raw="raw_response", **_: parse_stock(df, raw)}


def with_case_rows(log: DataFrame, cases: DataFrame, columns: Sequence[str], key: str = "case_id") -> DataFrame:
    """Responses with the values of their case in ``_row_*`` columns and, rounded, in ``_values``; responses without a case drop out.

    Roundings are made on the side of the cases: after the join they would be, for each number of a response.
    """
    rows = cases.select(key, *[F.col(c).cast("double").alias(f"_row_{c}") for c in columns])
    return log.join(rows.withColumn("_values", R.row_numbers([f"_row_{c}" for c in columns])), key, "inner")


def missing_cases(log: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Case keys that the log mentions and the case table lacks."""
    return log.select(key).distinct().join(cases.select(key), key, "left_anti")


def revalidate(
    log: DataFrame,
    cases: DataFrame,
    columns: Sequence[str],
    key: str = "case_id",
    vocabulary: Sequence[float] | None = None,
) -> DataFrame:
    """Validate stored responses again; the stored verdict stays as ``old_parse_success``.

    Responses are read where they lie and then meet their case, so that of the texts only what is asked for is shuffled.
    """
    stored = log.withColumnRenamed("parse_success", "old_parse_success")
    keep = [c for c in stored.columns if c not in PARSED]
    return _judged(with_case_rows(_read(stored, "raw_response"), cases, columns, key), keep, vocabulary)


def verdict_changes(revalidated: DataFrame) -> DataFrame:
    """How many responses pass, newly pass and newly fail, against the stored verdict."""
    old, new = F.coalesce("old_parse_success", F.lit(False)), F.col("parse_success")
    return revalidated.agg(
        F.count("*").alias("n_records"),
        F.count_if(old).alias("n_old_pass"),
        F.count_if(new).alias("n_new_pass"),
        F.count_if(~old & new).alias("newly_passing"),
        F.count_if(old & ~new).alias("newly_failing"),
    )
