"""Text pieces for large generated expressions.

An expression with hundreds of nodes is built as SQL text and parsed once; a
Column call per node would cost a round trip to the JVM each.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def double(value: float) -> str:
    """A double literal with all its digits."""
    return f"{float(value)!r}D"


def array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"
