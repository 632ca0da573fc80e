"""Checks of what an operator is given."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require(df: DataFrame, columns: Iterable[str], what: str = "") -> None:
    """Raise at once if columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what + ' ' if what else ''}columns: {missing}")
