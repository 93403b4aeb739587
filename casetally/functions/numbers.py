"""Number extraction, exact rounding and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetally.schema import NUMBER_PATTERN


def extract_numbers(text: Column) -> Column:
    """All numbers in a text: ``12.`` counts, ``2-3`` gives 2 and -3, ``1,200`` gives 1 and 200."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)), lambda t: t.cast("double"))


def round_tenth_sql(x: str) -> str:
    """Round a column (or lambda variable) to one decimal by the exact binary value, ties to even.

    ``bround`` rounds the printed digits, so it takes 0.15 (really
    0.1499999...) for a tie. A printed tie means that 20x is next to an odd
    integer; adding 16x and 4x with the rounding error kept tells on which side
    of it x lies.
    """
    a, b = f"({x} * 16D)", f"({x} * 4D)"
    s = f"({a} + {b})"
    bb = f"({s} - {a})"
    err = f"(({a} - ({s} - {bb})) + ({b} - {bb}))"
    odd = f"(abs({s}) < 1e15 AND abs({s} % 2D) = 1D)"
    return (
        f"CASE WHEN {odd} AND {err} < 0D THEN floor(({s} - 1D) / 2D) / 10D "
        f"WHEN {odd} AND {err} > 0D THEN floor(({s} + 1D) / 2D) / 10D ELSE bround({x}, 1) END"
    )


def round_tenth(column: str) -> Column:
    return F.expr(round_tenth_sql(column))


def plain_number_sql(x: str) -> str:
    """Whole numbers without a decimal point, others with their shortest digits."""
    return (
        f"CASE WHEN {x} = floor({x}) AND abs({x}) < 9e18D THEN cast(cast({x} AS bigint) AS string) "
        f"WHEN abs({x}) >= 1e7D THEN regexp_replace(cast(cast({x} AS decimal(38,10)) AS string), '0+$', '') "
        f"ELSE cast({x} AS string) END"
    )


def one_decimal_sql(x: str) -> str:
    """Text with exactly one decimal."""
    return f"format_string('%.1f', {round_tenth_sql(x)})"
